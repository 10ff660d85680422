import os
import subprocess
import sys

import numpy as np

from slideloom.operators import search
from slideloom.plans import registry


def test_searches_ask_every_hundredth_vector_in_passes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    rows = np.random.default_rng(3).normal(size=(1200, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"part {i}") for i in range(80)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    scores = rows[::100].astype(np.float32).astype(float) @ rows.astype(np.float32).astype(float).T
    run = registry.queries()
    hits = run["search_chunks"](spark, str(tmp_path)).collect()
    pool = np.arange(3, 1200, 5)
    assert {(r.query_id, r.chunk_id) for r in hits} == {(q * 100, int(k)) for q in range(12) for k in pool[np.argsort(-scores[q, pool])[:5]]}
    found = run["search_slides"](spark, str(tmp_path)).collect()
    best = {q * 100: round(float(scores[q].max()), 4) for q in range(12)}
    assert {q: round(max(r.score for r in found if r.query_id == q), 4) for q in best} == best
    groups = run["group_presentations"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in groups} == set(best)


def test_executors_older_than_the_library_get_it(tmp_path):
    """A session that began elsewhere, without the library's folder on its path."""
    code = f"""
import os, sys
os.environ.pop("PYTHONPATH", None)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.warehouse.dir", "{tmp_path}/w").getOrCreate()
assert spark.range(3).rdd.map(lambda x: 1).count() == 3
spark.createDataFrame([(i, [float(i), 1.0]) for i in range(200)], "vec_id long, embedding array<float>").write.parquet("{tmp_path}/embeddings.parquet")
spark.createDataFrame([(i, f"part {{i}}") for i in range(80)], "p_partkey long, p_name string").write.parquet("{tmp_path}/part.parquet")
sys.path.insert(0, "{os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}")
import __spark_entry__
os.environ.pop("PYTHONPATH", None)
print("rows", __spark_entry__.queries()["search_slides"](spark, "{tmp_path}").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 20" in done.stdout, done.stderr[-2000:]
