"""Operators 11 to 13 against plain Python and the tokenizer's library."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from slideloom.llm import bpe, fill_middle, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, v string, code string, error string, own string"


def plain_codes(rows, parts, entries, rounds, scale):
    """(vec_id, label, code, error, label_error) of each row and the codebooks, with Python's own integers."""
    kept = []
    for i, vector, label, *_ in rows:
        if vector and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((i, label, [math.floor(float(np.float32(x)) * scale) for x in vector]))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    fit = [r for r in kept if len(r[2]) % parts == 0]
    if not fit:
        return [], []
    size = len(fit[0][2])
    kept, width = [r for r in kept if len(r[2]) == size], size // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for r in kept:
                members.setdefault(nearest(cut(r[2], p), books[p])[0], []).append(cut(r[2], p))
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if e in members else old for e, old in enumerate(books[p])]
    out = []
    for i, label, v in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    of = {}
    for r in out:
        of[r[1]] = of.get(r[1], 0) + r[3]
    return sorted(((*r, of[r[1]]) for r in out), key=str), books


@pytest.mark.parametrize("spread", [1.0, 20_000.0])
def test_vector_codes_equal_plain_integers(spark, spread):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * spread for _ in range(8)], rng.choice([1, 1, 1, 2, None]), "v", "c", "e", "o") for i in range(120)]
    rows += [(i, rows[3][1], 1, *"vceo") for i in range(120, 150)]  # ties
    rows += [(7, rows[7][1], 5, *"vceo"), (7, rows[7][1], 5, *"vceo"), (None, rows[1][1], None, *"vceo")]
    rows += [(900, None, 1, *"vceo"), (901, [], 1, *"vceo"), (902, [1.0, None] * 4, 1, *"vceo"), (903, [math.nan] * 8, 1, *"vceo"), (904, [math.inf] + [0.0] * 7, 1, *"vceo"), (905, [1.0] * 12, 1, *"vceo")]
    coded, books = vector_codes.compress_vectors(spark.createDataFrame(rows, VECTORS).repartition(5), parts=4, entries=16, rounds=3)
    want, want_books = plain_codes(rows, 4, 16, 3, 1024)
    assert [b.tolist() for b in books] == want_books
    assert sorted((tuple(r) for r in coded.select("vec_id", "label", "code", "error", "label_error").collect()), key=str) == want
    near = vector_codes.decode_vectors(coded.where("vec_id = 3"), books).first()
    assert near.approximation == [x / 1024 for p in range(4) for x in want_books[p][int(near.code[2 * p : 2 * p + 2], 16)]]


def test_vector_codes_of_no_rows(spark):
    coded, books = vector_codes.compress_vectors(spark.createDataFrame([(1, None, 1, *"vceo")], VECTORS))
    assert coded.count() == 0 and books == [] and coded.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert vector_codes.books_digest(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(Exception, match="more than 26 bits"):
        vector_codes.compress_vectors(spark.createDataFrame([(1, [1e30] * 4, 1, *"vceo")], VECTORS))


def test_limb_products_are_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 30), 1 << 30, (40, 7)), rng.integers(-(1 << 30), 1 << 30, (30, 7))
    a[0], b[0] = -(1 << 30), (1 << 30) - 1
    for bits in (5, 11, vector_codes.limb_bits(7)):
        x, y = vector_codes.limbs(a, bits), vector_codes.limbs(b, bits)
        assert len(x) > 1 and all(np.abs(m).max() <= 1 << bits for m in x + y)
        assert vector_codes.exact_products(x, y, bits).tolist() == [[sum(int(p) * int(q) for p, q in zip(r, s, strict=True)) for s in b] for r in a]
    assert all(w * 4 ** vector_codes.limb_bits(w) <= 1 << 53 for w in range(1, 5000))


DOCS = "doc_id long, text string, block string, ids string, word string, row string"
BPE = "byte_bpe_50k.json"


def odd_texts(seed, n):
    """Texts of the pieces that the vocabulary's rules treat in their own ways, and of any characters."""
    rng = random.Random(seed)
    parts = ["'s", "'ll", "'", "s", "ve", " ", "  ", "\n", "\t", "a", "Word", " word", "é", "1", "٣", "½", "!", "<|endoftext|>", "<|", "|>", " ", "　", "中文", "😀", "​"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(n)]
    made += ["".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(rng.randrange(9))) if not 0xD800 <= c < 0xE000) for _ in range(n)]
    prose = [" ".join(rng.choice(["tree", "house", "river", f"w{rng.randrange(10**6)}"]) for _ in range(60)) for _ in range(n)]
    return [None, "", " ", *made, *prose, *prose[:5]]


SMALL = bpe.Sizes(frequent=2, sent_words=40, held_words=500, block=300, stretch=1000, packed=50)


@pytest.mark.parametrize("sizes", [bpe.Sizes(), SMALL])
def test_encoding_and_decoding_equal_the_library(spark, sizes):
    texts = odd_texts(2, 150) + ["so on and on " * 40_000, "x" * 300_000, "'s" * 1000, "-" * 300 + " end"] + ["-" * 300] * 6
    rows = [(i if i % 50 else None, t, *"clash"[:4]) for i, t in enumerate(texts)]
    got = bpe.encode_texts(spark.createDataFrame(rows, DOCS), BPE, sizes).withColumns({"text": bpe.decoded(F.col("ids")), "sha": bpe.ids_digest(F.col("ids"))}).collect()
    known = bpe.tokenizer(BPE)
    want = [known.encode(t or "", add_special_tokens=False).ids for t in texts]
    as_bytes = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert sorted((str(r.doc_id), r.ids, r.text, r.sha) for r in got) == sorted((str(row[0]), ids, known.decode(ids, skip_special_tokens=False), as_bytes(ids)) for row, ids in zip(rows, want, strict=True))
    assert all((t or "") == known.decode(ids, skip_special_tokens=False) for t, ids in zip(texts, want, strict=True))


def test_no_documents_and_ids_that_make_no_text(spark):
    assert bpe.encode_texts(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(0, None), (1, []), (2, [50256, 447]), (3, [-1, 99_999_999, 64]), (4, [None, 64]), (5, [94, 95, 96, 188])]
    df = spark.createDataFrame(rows, "doc_id int, ids array<int>").coalesce(1)
    known = bpe.tokenizer(BPE)
    got = [r.text for r in df.select("doc_id", bpe.decoded(F.col("ids")).alias("text")).orderBy("doc_id").collect()]
    assert got == [None, ""] + [known.decode([x for x in ids if x is not None and 0 <= x < 50257], skip_special_tokens=False) for _, ids in rows[2:]]


def plain_middle(doc_id, text, percent=90, suffix_first=20):
    """(n, form, prefix chars, middle chars, output) by the rules, on whole texts."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    sha = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < suffix_first
    return len(units), "spm" if spm else "psm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("frame_bytes", [5, 64, fill_middle.FRAME_BYTES])
def test_fill_in_middle_equals_whole_texts(spark, frame_bytes):
    texts = odd_texts(4, 60) + ["a" * 500 + "é" * 300 + "中", "one <P> marker", "<S", "M>", "<<M>", "x" * 300_000 if frame_bytes > 100 else "x" * 700, "ab cd. " * 20_000 if frame_bytes > 100 else "ab cd. " * 90]
    rows = [(i if i % 40 else None, t, *"clas") for i, t in enumerate(texts)] * 2
    store = fill_middle.frame_store(spark.createDataFrame(rows, DOCS), frame_bytes)
    f, s, form = F.col("frames"), F.col("sizes"), F.col("form")
    got = fill_middle.fill_in_middle(store, frame_bytes=frame_bytes).withColumns({"output": fill_middle.text_of(f, s), "back": fill_middle.original_of(f, s, form), "sha": fill_middle.digests(f, s, form)}).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(str(i), *plain_middle(i, t), t or "", sha(plain_middle(i, t)[4]), sha(t or "")) for i, t, *_ in rows]
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back, r.sha.output, r.sha.restored)) for r in got)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert all(max(r.sizes, default=0) <= max(2 * frame_bytes, frame_bytes + 8) and len(r.frames) == len(r.sizes) for r in got)


def test_frames_of_no_documents(spark):
    assert fill_middle.fill_in_middle(fill_middle.frame_store(spark.createDataFrame([], DOCS))).collect() == []
