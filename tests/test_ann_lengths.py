import numpy as np

from slideloom.operators import ann, search


def test_each_length_of_queries_is_searched(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=3 if i % 10 == 0 else 8)]) for i in range(200)]
    slides = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, rows[3][1]), (2, rows[50][1]), (3, [1.0]), (4, rows[7][1])], "query_id long, query_vec array<double>")
    exact = {(r.query_id, r.vec_id) for r in search.search_slides(slides, queries, 5, keys=("vec_id",)).collect()}
    got = {(r.query_id, r.vec_id) for r in ann.search_ann(slides, queries, 5, recall=1.0, keys=("vec_id",)).collect()}
    assert got == exact and {q for q, _ in got} == {1, 2, 4}
