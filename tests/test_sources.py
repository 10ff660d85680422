import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from slideloom.functions import scalars
from slideloom.operators import chunks, embed, search, tables, texts
from slideloom.operators import names as names_module
from slideloom.sources import files, slide_store, watch


def deck(*slides):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, text in enumerate(slides, 1):
            z.writestr(f"ppt/slides/slide{n}.xml", text if text == "broken" else f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:sld>')
    return out.getvalue()


def test_decks_become_slides(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pptx").write_bytes(deck("One", "broken", "Three"))
    (tmp_path / "bad.pptx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_bytes(b"x")
    found = watch.scan_decks(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.pptx", "bad.pptx"]
    decks = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pptx").load(str(tmp_path))
    slides, failures = files.explode_deck_slides(decks)
    assert [(r.file_name, r.slide_number, r.text) for r in slides.orderBy("slide_number").collect()] == [("a.pptx", 1, "One"), ("a.pptx", 3, "Three")]
    assert sorted(r.slide_number or 0 for r in failures.collect()) == [0, 2]


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 800, 600)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 480, 640) + b"\x03"
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (799).to_bytes(3, "little") + (599).to_bytes(3, "little")
    df = spark.createDataFrame([(0, png), (1, jpeg), (2, webp), (3, b""), (4, None), (5, b"GIF89a")], "id int, content binary")
    valid, invalid = files.check_image_headers(df)
    assert [(r.format, r.width, r.height) for r in valid.orderBy("id").collect()] == [("PNG", 800, 600), ("JPEG", 640, 480), ("WEBP", 800, 600)]
    assert sorted(r.id for r in invalid.collect()) == [3, 4, 5]


def test_base64_has_no_line_breaks(spark):
    row = files.load_image_records(spark.createDataFrame([("p/x.png", b"a" * 100)], "path string, content binary")).first()
    assert len(row.image_base64) == 136 and row.file_name == "x.png"


def test_store_takes_the_latest_and_replays(spark, tmp_path):
    store = str(tmp_path / "store")
    df = lambda *rows: spark.createDataFrame(list(rows), "file_path string, slide_number int, v int")
    slide_store.write_slides(df(("a", 1, 1), ("a", 2, 1)), store, 0)
    for _ in range(2):
        slide_store.write_slides(df(("a", 2, 2)), store, 1)
    assert sorted(tuple(r) for r in slide_store.read_slides(spark, store).collect()) == [("a", 1, 1), ("a", 2, 2)]
    slide_store.clear_slides(spark, store)
    assert slide_store.read_slides(spark, store).count() == 0 and slide_store.read_slides(spark, store).columns == ["file_path", "slide_number", "v"]


def test_cell_specs(spark):
    text = 'worksheet name="S" | cell="A1" | formula="=1+1" | bold=yes\n\nworksheet name="S" | cell="1A"\nworksheet name="S" | cell="B2" | a=1 | a=2\nworksheet name="T" | cell="C3"'
    cells, rejected = texts.parse_cell_specs(spark.createDataFrame([(1, text), (2, None)], "id int, text string"))
    assert [(r.sheet, r.cell, r.attrs) for r in cells.collect()] == [("S", "A1", {"formula": "=1+1", "bold": "yes"}), ("T", "C3", {})]
    assert [r.line_no for r in rejected.orderBy("line_no").collect()] == [3, 4]


def test_answers(spark):
    rows = [('data: {"chunk": "a"}\ndata: {no\ndata: {"chunk": "b"}\ndata: [DONE]\ndata: {"chunk": "c"}', "ab", None), ('data: {"chunk": "a"}\ndata: {"error": "x"}\ndata: {"chunk": "b"}', "a", "x"), ("", "", None)]
    df = spark.createDataFrame(rows, "raw string, answer string, error string")
    for r in df.select("answer", "error", texts.decode_sse(F.col("raw")).alias("got")).collect():
        assert (r.got.answer, r.got.error) == (r.answer, r.error)


def test_cache_levels(spark):
    log = [(i, i, 1, q) for i, q in enumerate("a b c a d b a".split())] + [(9, 9, 2, "a")]
    out = chunks.replay_lru(spark.createDataFrame(log, "event_id long, ts long, tenant long, query string"), memory=2, disk=3)
    assert [r.outcome for r in out.orderBy("event_id").collect()] == ["miss", "miss", "miss", "disk", "miss", "miss", "disk", "miss"]


def test_packing(spark):
    out = texts.pack_by_tokens(spark.createDataFrame([(1, "\n".join(["x" * 8, "x" * 8, "x" * 100, "y"])), (2, None), (3, "")], "id long, text string"), "id", max_tokens=4)
    assert sorted((r.id, r.line_no, r.chunk) for r in out.collect()) == [(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 2), (3, 1, 0)]


def test_folder_removal_takes_its_files(spark):
    rows = [("d", "addDir", 1), ("d/x", "add", 2), ("d", "unlinkDir", 3), ("d/y", "add", 4), ("e/z", "add", 1), ("e/z", "unlink", 2), ("dd/x", "change", 1)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "path string, type string, ts long, event_id long")
    assert sorted(r.path for r in chunks.live_paths(df).collect()) == ["d/y", "dd/x"]


def test_embedding_failures_are_kept_apart(spark):
    def embedder(batch):
        if "bad" in batch:
            raise ValueError("bad")
        return [[1.0, float(len(t))] for t in batch]

    good, failed = embed.embed_slides(spark.createDataFrame([(1, "x"), (2, "bad"), (3, "yy"), (4, None)], "id int, slide_text string"), embedder, waits=())
    assert sorted((r.id, r.embedding) for r in good.collect()) == [(1, [1.0, 1.0]), (3, [1.0, 2.0]), (4, [1.0, 0.0])]
    assert [r.id for r in failed.collect()] == [2]


def test_pipeline_uses_the_cache(spark):
    slides, _ = embed.embed_slides(spark.createDataFrame([("d/Deck v1.pptx", "Deck v1.pptx", 1, "blue whale"), ("d/Deck v2.pptx", "Deck v2.pptx", 1, "red fox")], "file_path string, file_name string, slide_number int, slide_text string"))
    queries = spark.createDataFrame([(1, " RED  fox"), (2, "  "), (3, "red fox")], "query_id long, query string")
    empty = spark.createDataFrame([], "query_hash string, embedding array<float>")
    hits, cache, stats = embed.search_pipeline(slides, queries, empty, top_k=1)
    assert sorted((r.query_id, r.file_name, round(r.score, 5), r.presentation_name, r.group_rank) for r in hits.collect()) == [(1, "Deck v2.pptx", 1.0, "Deck", 0), (3, "Deck v2.pptx", 1.0, "Deck", 0)]
    assert cache.count() == 1 and sorted(map(tuple, stats.collect())) == [(1, 1, False, False), (3, 1, False, False)]
    images = spark.createDataFrame([("p2", "aW1n")], "image_path string, image_base64 string")
    shown = slides.withColumn("image_path", F.concat(F.lit("p"), F.substring("file_name", 7, 1)))
    full, _, stats = embed.search_pipeline(shown, queries, cache, top_k=2, images=images, scorer=lambda q, t: [float(len(x)) for x in t])
    got = sorted((r.query_id, r.file_name, r.image_base64, r.rerank_rank) for r in full.collect())
    assert got == [(q, *x) for q in (1, 3) for x in (("Deck v1.pptx", "", 1), ("Deck v2.pptx", "aW1n", 2))]
    assert sorted(map(tuple, stats.collect())) == [(1, 2, True, True), (3, 2, True, True)]
    one, _, _ = embed.search_pipeline(shown, queries, cache, file_filter="Deck v1.pptx", scorer=lambda q, t: 1 / 0)
    assert sorted((r.query_id, r.file_name, r.rerank_score) for r in one.collect()) == [(1, "Deck v1.pptx", None), (3, "Deck v1.pptx", None)]

    def never(batch):
        raise AssertionError

    assert embed.search_pipeline(slides, queries, cache, never, top_k=1)[0].count() == 2


def test_scores_of_a_failing_scorer_are_null(spark):
    df = spark.createDataFrame([("q", "t")], "query string, slide_text string")
    assert embed.score_pairs(df, lambda q, t: [0.5] * len(q)).first().rerank_score == 0.5
    assert embed.score_pairs(df, lambda q, t: 1 / 0).first().rerank_score is None


def test_relative_age(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS a, TIMESTAMP '2024-01-01 00:00:59' AS b, TIMESTAMP '2024-01-01 02:10:00' AS c, TIMESTAMP '2024-02-01 00:00:00' AS d")
    assert list(df.select(*[scalars.relative_age(F.col("a"), F.col(x)) for x in "bcd"]).first()) == ["Just now", "2h ago", "2024-01-01"]


def test_same_presentation(spark):
    df = spark.createDataFrame([("Budget v1.pptx", "Budget v2.pptx", True), ("Budget v1.pptx", "Budgets v2.pptx", True), ("Budget.pptx", "Budgets.pptx", False)], "a string, b string, want boolean")
    assert all(r.want == r.got for r in df.select("want", scalars.same_presentation(F.col("a"), F.col("b")).alias("got")).collect())


def test_upsert_twice_is_once(spark):
    df = spark.createDataFrame([("a", 1, 1, [1.0]), ("a", 2, 2, [1.0]), ("a", 2, 3, [1.0])], "file_path string, slide_number int, vec_id int, embedding array<double>")
    once = tables.upsert(df.limit(0), df, 1)
    assert sorted(map(str, once.collect())) == sorted(map(str, tables.upsert(once, df, 1).collect())) and once.count() == 2
    assert search.dedupe_hits(df.selectExpr("1 AS query_id", "file_path", "slide_number", "vec_id AS score")).count() == 2


def test_a_store_takes_upserts_deletes_and_compaction(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [(f"d{i % 3}/f{i}.pptx", 1, i, [1.0, float(i)]) for i in range(9)] + [("d0/f0.pptx", 1, 99, [1.0]), ("d0/f0.pptx", 1, 98, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "file_path string, slide_number int, seen int, embedding array<double>")
    slide_store.upsert_slides(spark, df, store, 2, 0, "seen")
    assert slide_store.read_slides(spark, store).count() == 9 and slide_store.read_slides(spark, store).where("seen = 98").count() == 1
    slide_store.upsert_slides(spark, df.where("seen < 3").withColumn("seen", F.col("seen") + 200), store, 2, 1, "seen")
    assert slide_store.read_slides(spark, store).count() == 9 and slide_store.read_slides(spark, store).where("seen >= 200").count() == 3
    gone = slide_store.delete_slides(spark, store, spark.createDataFrame([("d0/f3.pptx",)], "file_path string"), spark.createDataFrame([("d1",)], "folder string"))
    assert gone == 4 and slide_store.read_slides(spark, store).count() == 5
    assert slide_store.compact_slides(spark, store) > 0 and slide_store.compact_slides(spark, store) == 0
    assert slide_store.vacuum_store(spark, store, keep=1) > 0
    assert slide_store.read_slides(spark, store).count() == 5
    slide_store.upsert_slides(spark, df.where("seen = 4"), store, 2, 2, "seen")
    assert slide_store.read_slides(spark, store).count() == 6


def test_a_killed_commit_or_compaction_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(f"d{i % 3}/f{i}.pptx", 1, i, [1.0]) for i in range(40)], "file_path string, slide_number int, seen int, embedding array<double>")
    state = lambda: sorted((r.file_path, r.seen) for r in slide_store.read_slides(spark, path).collect())
    publish = slide_store._publish

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(slide_store, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        slide_store.upsert_slides(spark, df, path, 1, 0, "seen")
    assert slide_store.read_manifest(spark, path) is None
    monkeypatch.setattr(slide_store, "_publish", publish)
    slide_store.upsert_slides(spark, df, path, 1, 0, "seen")
    slide_store.upsert_slides(spark, df.where("seen < 5").withColumn("seen", F.col("seen") + 100), path, 1, 1, "seen")
    before = state()
    reader = slide_store.read_slides(spark, path)
    monkeypatch.setattr(slide_store, "_publish", killed)
    for job in (lambda: slide_store.compact_slides(spark, path), lambda: slide_store.delete_slides(spark, path, df), lambda: slide_store.upsert_slides(spark, df, path, 1, 2, "seen")):
        with pytest.raises(KeyboardInterrupt):
            job()
        assert state() == before
    monkeypatch.setattr(slide_store, "_publish", publish)
    slide_store.compact_slides(spark, path)
    assert state() == before == sorted((r.file_path, r.seen) for r in reader.collect())  # the old files are still there
    assert slide_store.vacuum_store(spark, path, keep=1) >= 4 and state() == before
    assert "Exchange" not in slide_store.read_slides(spark, path)._jdf.queryExecution().executedPlan().toString()


def test_deletes_touch_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(f"d/f{i}.pptx", s, i) for i in range(60) for s in (1, 2)], "file_path string, slide_number int, v int")
    slide_store.write_slides(df, path, 0)
    old = slide_store.read_manifest(spark, path)
    assert slide_store.delete_slides(spark, path, df.where("v = 7")) == 2
    new = slide_store.read_manifest(spark, path)
    assert len(new["live"]) == len(old["live"]) + 1 and new["live"][: len(old["live"])] == old["live"]
    slide_store.write_slides(df.where("v = 7 AND slide_number = 2"), path, 1)
    assert slide_store.read_slides(spark, path).count() == 119 and slide_store.compact_slides(spark, path) == 1
    slide_store.write_slides(df.withColumn("v", F.lit(-1)), path, 1)  # a replay
    assert slide_store.read_slides(spark, path).where("v < 0").count() == 0
    assert slide_store.delete_slides(spark, path, folders=spark.createDataFrame([("d",)], "folder string")) == 119 and slide_store.read_slides(spark, path).count() == 0


def test_listings_have_all_names(spark, tmp_path):
    for name in ("_x.pptx", "_folder/a.pptx", "_folder/deep/.b.pptx", "c.PPTX", "c.pptx.tmp", "many/1/2/3/d.pptx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(deck("One") if name.endswith("x") else b"abc")
    found = watch.scan_decks(spark, str(tmp_path)).collect()
    assert sorted(r.path.removeprefix(f"{tmp_path}/") for r in found) == ["_folder/a.pptx", "_folder/deep/.b.pptx", "_x.pptx", "many/1/2/3/d.pptx"] and all(r.length > 0 and r.mtime for r in found)
    assert watch.scan_folder(spark, str(tmp_path)).where("is_directory").count() == 6
    listed = watch.scan_decks(spark, str(tmp_path)).union(spark.createDataFrame([(f"{tmp_path}/none.pptx", 1, None)], "path string, length bigint, mtime timestamp"))
    read = watch.with_contents(listed)
    slides, failures = files.explode_deck_slides(read.where("error IS NULL"))
    assert sorted(r.file_name for r in slides.collect()) == [".b.pptx", "_x.pptx", "a.pptx", "d.pptx"] and failures.count() == 0
    assert [r.error.split(":")[0] for r in read.where("error IS NOT NULL").collect()] == ["FileNotFoundError"]


def plain_packing(text, limit):
    chunk, used, held, out = 0, 0, 0, []
    for line in text.split("\n"):
        n = -(-len(line) // 4)
        if held and used + n > limit:
            chunk, used, held = chunk + 1, 0, 0
        used, held = used + n, held + 1
        out.append((chunk, n))
    return out


def test_long_texts_are_packed_without_python(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join("x" * rng.choice([0, 1, 3, 8, 30, 500]) for _ in range(n))) for i, n in enumerate((1, 255, 256, 257, 5000, 60_000))]
    for limit in (1, 18_000):
        df = texts.pack_by_tokens(spark.createDataFrame(rows, "id long, text string"), "id", max_tokens=limit)
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Pandas" not in df._jdf.queryExecution().executedPlan().toString()
        got = {}
        for r in df.orderBy("id", "line_no").collect():
            got.setdefault(r.id, []).append((r.chunk, r.tokens))
        assert got == {i: plain_packing(t, limit) for i, t in rows}


def test_rows_are_numbered_over_all_tasks(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50) if rng.random() < 0.5 else 7, i) for i in range(5000)] + [(None, -1)]
    df = tables.assign_batches(spark.createDataFrame(rows, "k int, v int").repartition(6), "k", 100)
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    got = df.collect()
    order = [r.k for r in sorted(got, key=lambda r: r.batch)]
    assert sorted(r.v for r in got) == sorted(v for _, v in rows) and [r.batch for r in got if r.k is None] == [0]
    counts = {b: sum(r.batch == b for r in got) for b in range(51)}
    assert all(counts[b] == 100 for b in range(50)) and counts[50] == 1
    assert all(max(r.k or 0 for r in got if r.batch == b) <= min(r.k or 0 for r in got if r.batch == b + 1) for b in range(50)) and len(order) == 5001
    assert tables.assign_batches(spark.createDataFrame([], "k int"), "k").count() == 0


def test_broken_bytes_are_rows(spark):
    df = spark.createDataFrame([(1, "aé\nü".encode()), (2, b"ok \xff\xc3\xa9"), (3, None), (4, b"plain")], "id int, content binary")
    got = [tuple(r) for r in scalars.non_ascii_report(df, "id", "content").orderBy("id", "line_no").collect()]
    assert got == [(1, 1, 2, "é", "U+00e9", "aé"), (1, 2, 1, "ü", "U+00fc", "ü"), (2, None, None, "Could not decode file", "", "")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def test_a_common_word_brings_no_product_of_names(spark):
    rng = random.Random(3)
    rest = lambda n: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n))
    names = [f"quarterly{rest(12)}" for _ in range(300)] + [rest(rng.randrange(6, 24)) for _ in range(300)]
    for x in rng.sample(names, 120):  # near copies
        x = list(x)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(x))
            x[at : at + rng.randrange(2)] = rng.choice(["", "z"])
        names.append("".join(x))
    names = sorted(set(names))
    df = spark.createDataFrame([(f"{x} v1.pptx",) for x in names], "file_name string")
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if abs(len(a) - len(b)) < 6 and 1 - edits(a, b) / max(len(a), len(b)) > 0.8}
    compared = {}
    for common in (10**9, 500):
        got = {(r.base_a, r.base_b) for r in names_module.similar_name_pairs(df, common=common).collect()}
        assert got == want and len(want) > 60
        compared[common] = names_module.candidate_pairs(names_module._bases(df, "file_name"), common).count()
    assert compared[10**9] > 40_000 and compared[500] < compared[10**9] / 10, compared
