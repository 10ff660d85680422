"""The methods themselves against plain Python: license copies by construction, votes, reliabilities, span classifier."""

import hashlib
import itertools
import random

import numpy as np

from slideloom.llm import license_scan, pii


def edited(rng, words, share):
    """Words with some replaced, left out or doubled; and the words that stayed."""
    out, same = [], 0
    for w in words:
        x = rng.random()
        if x > share:
            out.append(w)
            same += 1
        elif x < share / 3:
            out.append(f"new{rng.randrange(99)}")
        elif x < share * 2 / 3:
            out += [f"and{rng.randrange(99)}", w]
            same += 1
    return out, same


def test_licenses_are_found_as_often_as_they_were_planted(spark):
    rng = random.Random(9)
    names = [n for n in license_scan.TEMPLATES if len(license_scan.words_of(license_scan.TEMPLATES[n])) >= 30]
    texts, planted = [], []
    for copies in (0, 1, 2, 5):
        for name in names:
            words, own = [], 0
            template = license_scan.TEMPLATES[name].split()
            for _ in range(copies):
                copy, same = edited(rng, template, 0.08)
                words += [*(f"filler{rng.randrange(50)}" for _ in range(rng.choice([0, 3, 200]))), *copy]
                own += same >= 0.85 * len(template)
            texts.append(" ".join([*words, "all", "under", "the", "license"]))
            planted.append((name, copies, own))
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    family = lambda name: {"GPL-2.0": "GPL", "GPL-3.0": "GPL", "AGPL-3.0": "GPL", "LGPL-2.1": "GPL", "BSD-2-Clause": "BSD", "BSD-3-Clause": "BSD"}.get(name.rsplit("-", 1)[0], name)
    for i, (name, copies, sure) in enumerate(planted):
        found = sum(family(x.license) == family(name) for x in got[i])
        assert sure <= found <= copies, (name, copies, sure, [x.license for x in got[i]])
        assert all(x.coverage >= license_scan.MIN_COVERAGE for x in got[i])


def test_odd_texts_have_no_licenses(spark):
    rows = [(1, None, "x"), (1, "", "x"), (2, "All rights reserved.", None), (2, "All rights reserved.", None), (None, "license " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = [[x.license for x in r.licenses] for r in license_scan.scan_licenses(docs).collect()]
    assert got == [[], [], ["all-rights-reserved"], ["all-rights-reserved"], []]


def test_reliabilities_match_plain_expectation_maximisation():
    rng = random.Random(2)
    patterns = [p for p in itertools.product((-1, 0, 1), repeat=4) if rng.random() < 0.5]
    n = [rng.randrange(1, 200) for _ in patterns]
    kind = 3
    chance, _ = pii.reliabilities(np.full(len(n), kind), np.array(patterns), np.array(n))
    right, prior = [[0.8] * 4, [0.8] * 4], 0.5
    for _ in range(50):
        ps = []
        for p in patterns:
            yes, no = prior, 1 - prior
            for j, v in enumerate(p):
                if v >= 0:
                    yes *= right[0][j] if v else 1 - right[0][j]
                    no *= 1 - right[1][j] if v else right[1][j]
            ps.append(yes / (yes + no))
        for j in range(4):
            for truth in (0, 1):
                said = sum((q if truth == 0 else 1 - q) * m for q, m, p in zip(ps, n, patterns, strict=True) if p[j] >= 0)
                agreed = sum((q if truth == 0 else 1 - q) * m for q, m, p in zip(ps, n, patterns, strict=True) if p[j] == 1 - truth)
                right[truth][j] = min(0.98, max(0.55, (agreed + 8) / (said + 10)))
        prior = min(0.95, max(0.05, (sum(q * m for q, m in zip(ps, n, strict=True)) + 1) / (sum(n) + 2)))
    assert np.allclose(chance, ps, atol=1e-9)


def secret(i, size=32):
    """Letters and digits, with no run of digits that could be a card."""
    text = "".join(hashlib.sha256(f"{i}:{k}".encode()).hexdigest() for k in range(size // 64 + 1))[:size]
    return "".join("z" if k % 9 == 4 else c for k, c in enumerate(text))


def test_classifier_finds_planted_spans_and_leaves_others(spark):
    texts = []
    for i in range(300):
        texts.append(f"The api_key: {secret(i)} opens the login. Write to user{i} (at) example (dot) org by mail.")
        texts.append(f"The token = abcdef{'a' * (i % 5)} here. Order no {1000000000000 + i * 7919} page {i}, total {i}.")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.detect_pii(docs).collect()}
    good = [got[i] for i in range(0, len(texts), 2)]
    other = [got[i] for i in range(1, len(texts), 2)]
    assert sum("secret:" in s and "hidden_email:" in s for s in good) >= 0.98 * len(good)
    assert sum("number:" in s for s in other) <= 0.02 * len(other)


def test_no_byte_of_a_planted_secret_is_left(spark):
    for size in (400, 10_000):
        plain = [f"The password: {secret(i, 40)} opens it." for i in range(60)]
        texts = [*plain, f"The password: {secret('x', size)} opens it.", f"Reach {'j' * size}.doe [at] {'e' * size} [dot] com by mail today."]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.text for r in pii.redact_pii(docs).collect()}
        assert got[60] == "The password: [SECRET] opens it."
        found = dict((k, (s, e)) for k, s, e in pii.extra_candidates(texts[61], []))
        assert texts[61][slice(*found["hidden_email"])] == f"{'j' * size}.doe [at] {'e' * size} [dot] com"


def test_very_many_candidates_take_linear_time():
    text = "".join(f"password: {secret(i, 24)} card 4000 0000 0000 {i:04d} me at home dot org; " for i in range(20_000))
    base = pii.base_spans(text)
    extra = pii.extra_candidates(text, base)
    assert len(extra) > 40_000 and all(a[1] <= a[2] for a in extra)


def plain_alignment(text, template):
    """The most words of the template that appear in order in the text."""
    best = [0] * (len(template) + 1)
    for w in text:
        for j in range(len(template), 0, -1):
            if template[j - 1] == w:
                best[j] = max(best[j], max(best[:j]) + 1)
    return max(best)


def test_alignments_are_in_order_and_near_the_longest():
    rng = random.Random(11)
    for _ in range(300):
        template = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 25))]
        text = [w if rng.random() > 0.15 else f"x{rng.randrange(9)}" for w in template for _ in range(rng.choice([1, 1, 1, 0, 2]))]
        aligned = license_scan.patience(text, template)
        assert all(text[i] == template[j] for i, j in aligned)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(aligned, aligned[1:], strict=False))
        assert len(aligned) <= plain_alignment(text, template)
        once = list(dict.fromkeys(template))  # distinct words: anchors are all that can be aligned
        kept = [w for w in once if rng.random() > 0.2]
        assert len(license_scan.patience(kept, once)) == plain_alignment(kept, once) == len(kept)


def test_short_notices_need_all_words_in_order(spark):
    rng = random.Random(7)
    short = {n: t for n, t in license_scan.TEMPLATES.items() if len(license_scan.words_of(t)) < license_scan.WHOLE_WORDS}
    assert short
    texts, want = [], []
    for name, t in short.items():
        words = [w for w, _, _ in license_scan.words_of(t)]
        if len(words) > 2:
            shuffled = list(words)
            while shuffled == words:
                rng.shuffle(shuffled)
            texts.append(" ; ".join(" ".join(shuffled) for _ in range(20)) if len(set(words)) > 2 else "none")
            want.append(None)
        texts.append(f"Some words before. {t} And some behind.")
        want.append(name)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan_licenses(docs).collect():
        found = [x.license for x in r.licenses]
        own = [w for w, _, _ in license_scan.words_of(texts[r.doc_id])]
        if want[r.doc_id] is None:  # whatever is found stands there in order, with one word between at most
            for n in set(found):
                t = [w for w, _, _ in license_scan.words_of(license_scan.TEMPLATES[n])]
                assert any(plain_alignment(own[i : i + len(t) + 1], t) == len(t) for i in range(len(own)))
        else:
            assert found and all(x.coverage == 1.0 for x in r.licenses if x.license == want[r.doc_id])
