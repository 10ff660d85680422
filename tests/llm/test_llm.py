import random
import re
from collections import defaultdict

import pytest

from slideloom.llm import decontaminate, html_text, langid, license_scan, mixing, neardup, pii, quality, substring, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bands string, h long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, "clash", 1) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(120)]
    near = []
    for _ in range(30):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(10**6))
        near.append(" ".join(w))
    return [None, "", " \n ", "one", "ONE", "two words", "Two Words", " ".join(base), *near, " ".join(base), "long " * 60_000, "word. " * 30, "é à ü 中文"]


def test_near_duplicates_match_brute_force(spark, odd):
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, odd), shingle=2).collect()}
    sets = {}
    for i, t in enumerate(odd):
        w = re.findall(r"[^ \t-\r]+", (t or "").lower())
        sets[i] = frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    assert all(got[i].component_id == root(i) and got[i].n_shingles == len(sets[i]) and got[i].kept == (root(i) == i) for i in sets)


def test_ids_of_any_type_and_clashing_columns(spark, odd):
    """String ids, one id with two texts, a null id, and columns with the names that operators use inside."""
    clash = "id_ string, hash_ string, spans_ string, dirty_key string, text_key string, rep string, key string, component string, topic_ string, tokens_ string, probability_ string, source_ string, lang_ string, text_ string, words_ string, lines_ string, host_ string"
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    passage = " ".join(f"p{i}" for i in range(30)) + ". " + " ".join(f"q{i}" for i in range(25)) + "."
    texts = [("x1", a), ("x1", b), ("x2", a + " more"), ("x0", b + " more"), (None, a), ("x3", passage), ("x4", "Before.\n" + passage), (None, passage), ("x5", None)]
    rows = [(i, t, "en", "s", *["clash"] * (clash.count(",") + 1)) for i, t in texts]
    docs = spark.createDataFrame(rows, f"doc_id string, text string, lang string, source string, {clash}")
    got = sorted((r.doc_id or "", r.component_id or "", r.kept) for r in neardup.near_duplicates(docs).collect())
    # the smaller component of an id with two texts is that of its own text
    assert got == sorted([("x1", "x1", True), ("x1", "x0", False), ("x2", "x1", False), ("x0", "x0", True), ("", "", True), ("x3", "x3", True), ("x4", "x3", False), ("", "", True), ("x5", "x5", True)])
    items = spark.createDataFrame([("i", "a3 a4 a5 a6 a7 a8 a9 a10 a11 a12")], "item_id string, text string")
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id or "" for r in clean.collect()) == ["", "x0", "x1", "x3", "x4", "x5"]
    cut = substring.drop_repeats(docs)
    assert cut.columns[: len(docs.columns)] == docs.columns and sorted((r.doc_id or "", r.n_removed) for r in cut.collect() if r.n_removed) == [("", 1), ("", 2), ("x4", 2)]
    assert mixing.sample_mixture(docs).columns == docs.columns and mixing.mix_sources(docs).count() == len(rows)
    judged = quality.apply_quality_rules(docs)
    assert set(docs.columns) - {"text"} < set(judged.columns) and judged.count() == len(rows)
    assert {r.doc_id for r in tokens.count_tokens(docs).collect()} == {i for i, _ in texts}
    assert langid.identify(docs, langid.train(docs)).columns == [*docs.columns, "lang_pred", "score"]
    assert set(pii.redact_pii(docs).columns) == set(docs.columns)


def test_token_counts(spark, odd):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [*odd, "a  b ", " ", "▁x <s> y▁", "tab\there"]
    got = {r.doc_id: r for r in tokens.count_tokens(frame(spark, texts), limit=5).collect()}
    assert all(got[i].n_tokens == len(sp.encode(t or "")) and got[i].n_bytes == len((t or "").encode()) for i, t in enumerate(texts))


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_contamination_matches_brute_force(spark, broadcast_rows):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    items = [" ".join(rng.choices(words, k=k)) for k in (30, 12, 10, 4, 1)] + [None, ""]
    texts = [None, "", *(" ".join(rng.choices(words, k=30)) for _ in range(5))]
    texts += [" ".join(rng.choices(words, k=9)) + " " + t[: len(t) // k] + ", END" for t in items[:4] for k in (1, 2)]
    got = {r.doc_id: r for r in decontaminate.find_contamination(frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), broadcast_rows=broadcast_rows).collect()}
    windows = defaultdict(set)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    for i, t in enumerate(items):
        w = split(t)
        for k in range(len(w) - min(10, len(w)) + 1) if w else ():
            windows[tuple(w[k : k + min(10, len(w))])].add(i)
    for d, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        assert (got[d].n_words, got[d].n_hit, list(got[d]["items"])) == (len(w), len(hit), sorted(found))


def test_a_phrase_that_many_items_and_texts_have_meets_nothing(spark):
    rng = random.Random(12)

    def prose(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    phrase = "which of the following"
    items = [f"{prose(rng.randrange(3, 12))} {phrase} {prose(rng.randrange(3, 12))}" for _ in range(10_000)]
    texts = [f"{prose(rng.randrange(3, 20))} {phrase} {prose(rng.randrange(3, 20))}" for _ in range(10_000)] + [f"{prose(5)} {items[7]} {prose(5)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert decontaminate._meetings(docs, "doc_id", bench, decontaminate.SPAN, decontaminate.GRAM, None)[1].count() < 100
    assert [(r.doc_id, list(r["items"])) for r in decontaminate.find_contamination(docs, bench).where("contaminated").collect()] == [(10_000, [7])]


def test_repeated_passage_goes_from_later_documents(spark):
    passage = " ".join(f"p{i}" for i in range(30)) + ". " + " ".join(f"q{i}" for i in range(25)) + "."
    texts = [f"Own words here.\n{passage}\nEnd one.", f"Other start.\n{passage}\nEnd two.", "Clean text.", None, ""]
    got = {r.doc_id: r for r in substring.drop_repeats(frame(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[2].text == texts[2] and got[3].text is None
    assert "p3" not in got[1].text and "q3" not in got[1].text and "Other start." in got[1].text and "End two." in got[1].text


def test_others_take_odd_and_empty_tables(spark, odd):
    docs, none = frame(spark, odd), frame(spark, odd).where("false")
    for f in (substring.drop_repeats, neardup.near_duplicates, tokens.count_tokens, mixing.mix_sources, quality.apply_quality_rules, license_scan.scan_licenses, pii.detect_pii):
        assert f(docs).count() == len(odd)
        assert f(none).count() == 0
    assert langid.identify(docs, langid.train(docs)).count() == len(odd)
    assert langid.identify(none, langid.train(none)).count() == 0


def test_language_is_learned(spark):
    docs = spark.createDataFrame([(i, "the house and the garden " * 3, "en") for i in range(9)] + [(i + 9, "der garten und das haus " * 3, "de") for i in range(9)], "doc_id long, text string, lang string")
    got = langid.identify(docs.select("doc_id", "text"), langid.train(docs)).collect()
    assert all(r.lang_pred == ("en" if r.doc_id < 9 else "de") for r in got)


def test_html():
    page = "<body><nav><a href=x>Menu</a></nav><div class=ad>Buy</div><article><h1>A&amp;B</h1><p><b>First  line.<br><p>Second\nline is longer, with more words in it.</p></article><footer>&copy; x</footer></body>"
    assert html_text.main_text(page) == "A&B\n\nFirst line.\n\nSecond line is longer, with more words in it."
    assert html_text.main_text(None) == "" and html_text.main_text("<p>") == ""


def test_personal_data():
    text = "mail a.b@c.org, 10.0.0.1 or 999.1.1.1, +1 (212) 555-0100, 4111 1111 1111 1111"
    assert [k for k, _, _ in pii.base_spans(text)] == ["email", "ip", "card", "phone"]
    assert pii.redact("x a@b.de y", [("email", 2, 8)]) == "x [EMAIL] y"


def test_patience_alignment():
    assert license_scan.patience("a b c d".split(), "b x d".split()) == [(1, 0), (3, 2)]
