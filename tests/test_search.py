import numpy as np
from pyspark.sql import functions as F

from slideloom.operators import ann, search

SLIDES = "file_path string, slide_number int, embedding array<float>"


def unit_rows(n, dim, seed, clusters=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    if clusters:
        v = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + 0.4 * v
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def slides_of(spark, v):
    return spark.createDataFrame([(f"f{i // 4:05d}", i % 4, x.tolist()) for i, x in enumerate(v)], SLIDES)


def asked(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "query_id long, query_vec array<float>")


def exact(q, v, k):
    scores = q.astype(float) @ v.astype(float).T
    return [set(map(int, np.argsort(-s, kind="stable")[:k])) for s in scores]


def hits_of(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.query_id, set()).add(int(r.file_path[1:]) * 4 + r.slide_number)
    return found


def test_twenty_thousand_queries_read_the_slides_once(spark):
    v, q = unit_rows(3000, 16, 1), unit_rows(20_000, 16, 2)
    df = search.search_slides(slides_of(spark, v).repartition(3), asked(spark, q), 3)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got, want = hits_of(df), exact(q, v, 3)
    assert all(got[i] == w for i, w in enumerate(want))


def test_passes_blocks_ties_and_odd_vectors(spark, monkeypatch):
    v = np.concatenate([unit_rows(300, 8, 3, 5)] * 3 + [np.zeros((5, 8), np.float32)])
    q = np.concatenate([unit_rows(40, 8, 4, 5), np.zeros((1, 8), np.float32)])
    slides = slides_of(spark, v).union(spark.createDataFrame([("odd", 1, [1.0]), ("none", 1, None), ("empty", 1, [])], SLIDES))
    more = asked(spark, q).union(spark.createDataFrame([(100, [2.0]), (101, None), (102, [1.0, 2.0, 3.0])], "query_id long, query_vec array<float>"))
    scores = np.round(q.astype(float) @ v.astype(float).T, 9)
    names = [f"f{i // 4:05d}-{i % 4}" for i in range(len(v))]
    want = {i: [names[j] for j in sorted(range(len(v)), key=lambda j: (-s[j], names[j]))[:7]] for i, s in enumerate(scores)}
    for size, query_block, slide_block in ((1 << 26, 2048, 4096), (400, 4, 10), (1 << 26, 4, 10)):
        monkeypatch.setattr(search, "QUERY_BYTES", size)
        monkeypatch.setattr(search, "QUERY_BLOCK", query_block)
        monkeypatch.setattr(search, "SLIDE_BLOCK", slide_block)
        rows = search.search_slides(slides, more, 7).orderBy("query_id", "rank").collect()
        got = {}
        for r in rows:
            got.setdefault(r.query_id, []).append(f"{r.file_path}-{r.slide_number}")
        assert got.pop(100) == ["odd-1"] and got == want


def test_approximate_search_has_the_recall_and_few_exact_products(spark):
    for clusters, dim in ((0, 16), (40, 24), (12, 10)):
        v = unit_rows(6000, dim, 7, clusters)
        slides, q = slides_of(spark, v), v[::100]
        got, want = hits_of(ann.search_ann(slides, asked(spark, q), 10)), exact(q, v, 10)
        recall = np.mean([len(got[i] & w) / 10 for i, w in enumerate(want)])
        print("recall", clusters, dim, recall)
        assert recall >= 0.93, (clusters, dim, recall)
        index, model = ann.build_index(slides, dim)
        assert index.count() == 6000
        queries = asked(spark, q).withColumnRenamed("query_vec", "_v").withColumn("_v", F.col("_v").cast("array<double>"))
        chosen = ann.candidates(index, model, queries, 2.0, 80)
        assert chosen.count() == 80 * len(q)  # exact products, of 6000 a query


def test_approximate_search_of_odd_input(spark):
    v = unit_rows(30, 5, 9)
    slides = slides_of(spark, np.concatenate([v, v, np.zeros((3, 5), np.float32)]))
    assert ann.search_ann(slides, asked(spark, v[:0]), 3).count() == 0 and ann.search_ann(slides.where("false"), asked(spark, v), 3).count() == 0
    mixed = asked(spark, v[:4]).union(spark.createDataFrame([(50, [1.0]), (51, None)], "query_id long, query_vec array<float>"))
    rows = ann.search_ann(slides, mixed, 2).collect()
    assert {r.query_id for r in rows} == {0, 1, 2, 3} and all(abs(r.score - 1) < 1e-6 for r in rows)
