"""Texts beyond the stretch in which bytes are hashed, and code lengths of language models against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from slideloom.llm import _words, decontaminate, langid, license_scan, neardup, pii, substring, tokens


def prose(rng, size):
    out, n = [], 0
    while n < size:
        w = rng.choice(["word", "Wörter", "другой", "x"]) + str(rng.randrange(10**5)) + rng.choice(["", "", "", ".", "\n"])
        out.append(w)
        n += len(w.encode()) + 1
    return " ".join(out)


@pytest.mark.parametrize("separators", [_words.SPACES, _words.NON_ALNUM])
def test_words_are_the_same_across_stretches(separators):
    rng = random.Random(3)
    border = _words.STRETCH
    texts = [prose(rng, 3 * border), "a" * (border - 3) + " bcd efg " + "ü" * (2 * border) + " end", " " * (border - 1) + "at the border " + " " * border + "x"]
    splits = re.compile(rb"[^\x20\x09-\x0D]+" if separators == _words.SPACES else rb"[0-9A-Za-z\x80-\xff]+")
    for text in texts:
        data, offsets = _words.utf8(pa.array([text]))
        hashes, bounds, starts, ends = _words.words(data, offsets, separators)
        want = [(m.start(), m.end()) for m in splits.finditer(text.encode())]
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want and bounds.tolist() == [0, len(want)]
        alone = {}
        for (a, b), h in zip(want, hashes.tolist(), strict=True):
            alone.setdefault(text.encode()[a:b].lower(), set()).add(h)
        assert all(len(h) == 1 for h in alone.values()) and len({min(h) for h in alone.values()}) == len(alone)
        small = list(alone)[:200]
        data, offsets = _words.utf8(pa.array([w.decode() for w in small]))
        assert _words.words(data, offsets, separators)[0].tolist() == [min(alone[w]) for w in small]


def test_operators_see_across_stretches(spark):
    """Passages that lie over the border of two stretches, in texts of more than a megabyte."""
    rng = random.Random(5)
    border = _words.STRETCH
    head = prose(rng, border - 400)
    passage = "\n" + ". ".join(" ".join(f"p{rng.randrange(10**6)}" for _ in range(14)) for _ in range(12)) + ".\n"
    long = head + passage + prose(rng, 2 * border)
    near = long.replace("word1", "other1", 40)
    texts = [long, near, "Short text of its own.\n" + passage + "\nAnd its end.", None, prose(rng, 2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, shingle=2).collect()}
    assert groups == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    item = " ".join(passage.split()[80:95])
    found = decontaminate.find_contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).where("contaminated")
    assert sorted(r.doc_id for r in found.collect()) == [0, 1, 2]
    cut = {r.doc_id: r.text for r in substring.drop_repeats(docs).collect()}
    assert cut[0] == long and "And its end." in cut[2] and not any(w in cut[2] for w in passage.split())
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()} == {i: len(library.encode(t or "")) for i, t in enumerate(texts)}


def test_spans_in_long_texts(spark):
    rng = random.Random(8)
    mail = "someone.else@mail.example.org"
    text = prose(rng, _words.STRETCH) + f" {mail} " + prose(rng, _words.STRETCH)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.detect_pii(docs).first()
    assert row.n_email == 1 and f"email:{text.index(mail)}:{text.index(mail) + len(mail)}" in row.spans.split(",")
    assert mail not in pii.redact_pii(docs).first().text
    assert license_scan.scan_licenses(docs).first().licenses == []


def plain_bits(model, text, order):
    """The code length of one text under the counts of one language."""
    bits = 0.0
    for i, byte in enumerate(text):
        for d in range(min(i, order), -1, -1):
            seen = model[d].get(text[i - d : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if byte in seen:
                bits -= math.log2(seen[byte] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8.0
    return bits


def test_code_lengths_match_plain_python(spark):
    rng = random.Random(2)
    letters = {"a": "abcde ", "b": "defgé ", "c": "xyz"}
    rows = [(i, "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 60))), lang) for i, lang in enumerate("aabbbcabc" * 3)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for order in (1, 4):
        model = langid.train(labelled, order=order)
        counts = {lang: [defaultdict(Counter) for _ in range(order + 1)] for lang in letters}
        for _, text, lang in rows:
            data = text.encode()
            for d in range(order + 1):
                for i in range(d, len(data)):
                    counts[lang][d][data[i - d : i]][data[i]] += 1
        texts = [r[1] for r in rows[:6]] + ["é", "q", "abc xyz defg", "", "中文" * 5, "aaaa" * 50]
        data, offsets = _words.utf8(pa.array(texts))
        got = model.bits(data, offsets)
        want = np.array([[plain_bits(counts[lang], t.encode(), order) for lang in model.languages] for t in texts])
        assert model.languages == ["a", "b", "c"] and np.allclose(got, want, rtol=1e-5, atol=1e-4)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
        assert found == {i: model.languages[int(w.argmin())] if any(c.isalpha() for c in t) else "und" for i, (t, w) in enumerate(zip(texts, want, strict=True))}
