import random
import re

import numpy as np
from pyspark.sql import functions as F

from slideloom.functions import scalars as S
from slideloom.operators import ann, names, search, tables


def test_names_and_versions(spark):
    rows = [("Deck_v2.pptx", "Deck", "2"), ("Deck  v2.pptx", "Deck", "2"), ("a - v3.pptx", "a -", "3"), (" x .pptx", " x ", None), ("Deck V10.PPTX", "Deck", "10"), ("nov12.pptx", "no", "12"), ("plain.pptx", "plain", None), ("v7.pptx", "", "7")]
    df = spark.createDataFrame(rows, "name string, base string, version string")
    out = df.select("base", "version", S.name_base(F.col("name")).alias("b"), S.name_version(F.col("name")).alias("v")).collect()
    assert all(r.base == r.b and r.version == r.v for r in out)


def test_clean_path(spark):
    df = spark.createDataFrame([(" '/a/./b/../c//' ", "/a/c"), ("a/../..", ".."), ('"x/y', '"x/y')], "p string, want string")
    assert all(r.want == r.got for r in df.select("want", S.clean_path(F.col("p")).alias("got")).collect())


def test_folder_delete_needs_the_separator(spark):
    store = spark.createDataFrame([("/a/b/x.pptx",), ("/a/bc/x.pptx",)], "file_path string")
    kept = tables.delete_by_folder(store, spark.createDataFrame([("/a/b",)], "folder string"))
    assert [r.file_path for r in kept.collect()] == ["/a/bc/x.pptx"]


def test_newest_of_several(spark):
    rows = [("p/a", 1, False, 1), ("q/a", 2, False, 2), ("p/b", 1, True, 3), ("q/b", 2, True, 4), ("r/b", 9, False, 5), ("p/c", 1, False, 6)]
    df = spark.createDataFrame(rows, "path string, mtime int, file_exists boolean, input_order long").withColumn("name", S.base_name(F.col("path")))
    kept, removed = tables.keep_newest(df, "name")
    assert sorted(r.path for r in kept.collect()) == ["p/c", "q/b"] and removed.count() == 4


def test_search_skips_other_dimensions(spark):
    slides = spark.createDataFrame([("f", 1, [1.0, 0.0]), ("f", 2, [0.0, 1.0]), ("g", 1, [1.0]), ("h", 1, None)], "file_path string, slide_number int, embedding array<double>")
    queries = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, query_vec array<double>")
    out = search.search_slides(slides, queries, 5).orderBy("rank").collect()
    assert [(r.file_path, r.slide_number, r.score) for r in out] == [("f", 1, 1.0), ("f", 2, 0.0)]


def test_many_queries_take_several_passes(spark, monkeypatch):
    slides = spark.createDataFrame([(f"f{i}", 1, [float(i % 7), 1.0]) for i in range(40)], "file_path string, slide_number int, embedding array<double>")
    queries = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(9)], "query_id long, query_vec array<double>")
    whole = sorted(map(tuple, search.search_slides(slides, queries, 5).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, search.search_slides(slides, queries, 5).collect())) == whole and len(whole) == 45


def test_similar_names_match_brute_force(spark):
    rng = random.Random(5)
    base = ["quarterly budget review", "plan", "roadmap for the team", "a", "ab"]
    listed = []
    for _ in range(250):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["x", "", "yz"])
        listed.append("".join(w) + rng.choice(["", " v2"]) + ".pptx")
    df = spark.createDataFrame([(x,) for x in [*listed, None]], "file_name string")
    got = {(r.base_a, r.base_b) for r in names.similar_name_pairs(df).collect()}
    b = df.select("file_name", F.lower(S.name_base(F.col("file_name"))).alias("base")).distinct()
    every = b.toDF("n1", "b1").join(b.toDF("n2", "b2"), F.col("b1") < F.col("b2")).where(S.same_presentation(F.col("n1"), F.col("n2"))).where("b1 <> ''")
    want = {(r.b1, r.b2) for r in every.select("b1", "b2").distinct().collect()}
    assert got == want and len(want) > 50


def test_approximate_search_finds_most_and_takes_copies(spark):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(centres)]) for i in range(600)] + [(600 + i, centres[0]) for i in range(300)] + [(900, None), (901, [1.0]), (902, [0.0] * 16)]
    slides = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = slides.where("vec_id % 20 = 0 AND size(embedding) = 16").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = {(r.query_id, r.rank): r for r in search.search_slides(slides, queries, 10, keys=("vec_id",)).collect()}
    got = ann.search_ann(slides, queries, 10, keys=("vec_id",)).collect()
    want = {(r.query_id, r.vec_id) for r in exact.values()}
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)
    # the copies tie: the first keys win
    assert sorted(r.vec_id for r in got if r.query_id == 600) == list(range(600, 610))
    assert ann.search_ann(slides.where("false"), queries, 10, keys=("vec_id",)).count() == ann.search_ann(slides, queries.where("false"), 10, keys=("vec_id",)).count() == 0


def test_copies_at_the_border_do_not_pile_up():
    scores = np.array([[0.5] * 50 + [0.9, 0.5]])
    q, s = search._top(scores, 3)
    assert q.tolist() == [0, 0, 0] and s.tolist() == [0, 1, 50]


def test_empty_chunks_and_markdown(spark):
    cells = spark.createDataFrame([("w", "s", 1, 1, "a|b"), ("w", "s", 2, 2, "c\nd"), ("w", "s", 25, 99, "far"), ("w", None, 11, 1, None)], "workbook string, sheet string, row_no int, col_no int, v string")
    got = {(r.sheet, r.chunk): (r.first_row, r.last_row, r.cells) for r in tables.chunk_rows(cells, include_empty=True).collect()}
    assert got == {("s", 0): (1, 2, 2), ("s", 1): (11, 20, 0), ("s", 2): (21, 30, 0), (None, 0): (1, 10, 0), (None, 1): (11, 11, 1)}
    assert tables.chunk_rows(cells).count() == 2
    out = tables.compress_chunks(cells.where("row_no < 3"), ("workbook", "sheet"), ("row_no", "col_no"), "v", markdown=("row_no",)).first()
    assert out.markdown == "| row_no | v |\n| - | - |\n| 1 | a\\|b |\n| 2 | c d |" and out.text == "a|b | c\nd"


def test_groups_match_a_plain_fold(spark):
    rng = random.Random(8)
    words = ["Budget", "Budgets", "Budget plan", "Roadmap", "Roadmaps", "Team"]
    rows = []
    for q in range(6):
        for i in range(25):
            name = rng.choice(words) + rng.choice(["", " v1", " v2", "_v10", " V3"]) + ".pptx"
            rows.append((q, f"d{i}/{name}", name, i, rng.random()))
    df = spark.createDataFrame(rows, "query_id int, file_path string, file_name string, slide_number int, score double")
    level = lambda a, b: S.name_similarity(F.lit(a), F.lit(b))
    bases = sorted({w.lower() for w in words})
    pairs = [(a, b) for a in bases for b in bases]
    near = dict(zip(pairs, spark.range(1).select(*[level(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first(), strict=True))
    got = {(r.query_id, r.group_rank): r for r in search.group_presentations(df).collect()}
    seen = 0
    for q in range(6):
        groups = []
        for _, path, name, number, score in sorted((r for r in rows if r[0] == q), key=lambda r: -r[4]):
            m = re.fullmatch(r"(.*?)(?:[ _-]?[vV](\d+))?\.pptx", name)
            base, version = m[1].strip() if m[2] else m[1], m[2]
            for g in groups:
                limit = 0.8 if version and g["version"] else 0.9
                if near[base.lower(), g["base"].lower()] > limit if version or g["version"] else base.lower() == g["base"].lower():
                    break
            else:
                g = {"base": base, "version": version, "slides": [], "versions": set()}
                groups.append(g)
            g["slides"].append((path, number, score))
            g["versions"].add(f"v{version or 1}")
        for rank, g in enumerate(groups):
            r = got[q, rank]
            assert (r.presentation_name, r.versions, [(x.file_path, x.slide_number, x.score) for x in r.slides]) == (g["base"], sorted(g["versions"]), g["slides"])
            seen += 1
    assert seen == len(got)


def test_ignored_paths(spark):
    paths = ["report.log", "report.log.pptx", ".hidden/x.pptx", "a/.x", "dist/x.pptx", "cabin.pptx", "a.tmp", "a.tmp.pptx", "Release/x", "release/x", "~$x.pptx", "a/b.lock", "x/Thumbs.db"]
    kept = {r.path for r in S.drop_ignored(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert kept == {"report.log.pptx", "dist/x.pptx", "a.tmp.pptx", "release/x"}
