import tracemalloc
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from slideloom.fixtures import view
from slideloom.functions import scalars
from slideloom.llm import bpe
from slideloom.operators import ann, search
from slideloom.plans import registry
from slideloom.sources import files
from slideloom.streaming import events


def test_score_texts_are_rounded_as_exact_values(spark):
    scores = [0.0305, 0.0115, 0.0435, 0.0125, -0.0125, 0.0225, 0.0075, 0.0, -0.0004, 1.0, None]
    got = scalars.shape_hits(spark.createDataFrame([(None, i, s) for i, s in enumerate(scores)], "file_path string, slide_number int, score double")).collect()
    want = [f"{Decimal((s or 0.0) * 100).quantize(Decimal('0.1'), ROUND_HALF_UP)}%" for s in scores]
    assert [r.score_text for r in sorted(got, key=lambda r: r.slide_number)] == want
    assert want[:6] == ["3.0%", "1.1%", "4.3%", "1.3%", "-1.3%", "2.3%"]


def test_upserts_replace_and_insert_slides(spark):
    folder = "/root/testdata/sf0.001"
    slides = view(spark, folder, "slides_fx")
    ids = {r.vec_id for r in slides.select("vec_id").collect()}
    for name in ("upsert_slides", "read_slides"):
        rows = registry.queries()[name](spark, folder).collect()
        kept, replaced = {r.vec_id for r in rows if r.vec_id in ids}, ids - {r.vec_id for r in rows}
        assert kept and replaced and len([r for r in rows if r.file_path.startswith("new/")]) > 0
        # what stays is what did not come again
        assert replaced == {i for i in ids if i % 2 == 0} and kept == ids - replaced, name
        if name == "upsert_slides":  # each key that came is one row
            came = [(r.file_path, r.slide_number) for r in rows if r.vec_id not in ids]
            assert len(came) == len(set(came))


def test_slides_of_many_small_decks_go_on_together(spark):
    """The time of many small decks is that of their slides, without a table for each deck."""
    decks = spark.range(0, 25_000, 1, 2).select(F.concat(F.lit("d\\"), F.col("id").cast("string")).alias("path"), F.col("id").cast("string").cast("binary").alias("content"))

    def parts(content):
        n = int(content)
        if n % 5 == 0:
            raise ValueError("bad")
        yield 1, f"first {n}", None
        yield 2, None, "broken" if n % 5 == 1 else None

    slides, failures = files.explode_deck_slides(decks, parts)
    rows = slides.collect()
    assert len(rows) == 15_000 * 2 + 5_000 and {r.text for r in rows if r.slide_number == 1} == {f"first {n}" for n in range(25_000) if n % 5}
    assert all(r.file_name == r.file_path[2:] for r in rows) and all(r.text is None for r in rows if r.slide_number == 2)
    assert sorted({(r.slide_number, r.error) for r in failures.collect()}, key=str) == [(2, "broken"), (None, "ValueError: bad")] and failures.count() == 10_000
    # what goes on at a time is a bounded number of whole slides
    sizes = [b.num_rows for b in files._slide_batches(iter([("p", b"x")] * 25), lambda c: iter([(i, "y" * 10, None) for i in range(4)]), rows_out=10)]
    assert sizes == [12] * 8 + [4]


def test_released_work_of_a_table_has_no_join(spark, capsys):
    """Work and removals that share a folder and a time do not meet in pairs."""
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i % 3600), "add" if i % 3 else "change", f"d/f{i % 500}.pptx") for i in range(0, 4000, 5)]
    rows += [(10_000 + i, start + timedelta(seconds=60 * i + 7), "unlinkDir", "d") for i in range(50)]
    rows += [(20_000, start, "add", "d/same.pptx"), (20_001, start, "change", "d/same.pptx"), (20_001, start, "change", "d/other.pptx"), (20_002, None, "add", "d/none.pptx"), (20_003, start + timedelta(seconds=3599), "add", "e/x.txt")]
    for ts in ("timestamp", "timestamp_ntz"):
        queue = events.process_queue(spark.createDataFrame(rows, f"event_id long, ts {ts}, type string, path string"), "20 seconds")
        taken = lambda w: any(
            b[1] is not None and w[1] is not None and w[1:2] + w[:1] < b[1:2] + b[:1] and b[1] < w[1] + timedelta(seconds=20) and (b[3] == w[3] or b[2] == "unlinkDir" and w[3].startswith(b[3] + "/"))
            for b in rows
        )
        assert sorted(r.event_id for r in queue.collect()) == sorted(w[0] for w in rows if w[2] in ("add", "change") and w[3].endswith(".pptx") and not taken(w))
    capsys.readouterr()
    queue.explain()
    assert "Join" not in capsys.readouterr().out


def test_blocks_of_scores_stay_small():
    scores = np.random.default_rng(1).normal(size=(search.QUERY_BLOCK, search.SLIDE_BLOCK))
    tracemalloc.start()
    q, _ = search._top(scores, 10, np.full(len(scores), -np.inf))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(q) == 10 * search.QUERY_BLOCK
    assert scores.nbytes + peak < 100e6


def test_a_full_block_of_codes_is_scored_in_little_memory():
    rng = np.random.default_rng(2)
    asked, rows = rng.normal(size=(ann.ASK_SLICE, 64)), rng.normal(size=(ann.ROW_BLOCK, 64))
    tracemalloc.start()
    q, s, scores = ann._best_rows(asked, rows, 320, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and len(q) == 320 * len(asked) and q.min() == 1000
    first = asked[0] @ rows.T
    assert set(s[q == 1000]) == set(np.argsort(-first)[:320]) and np.allclose(scores[q == 1000], first[s[q == 1000]])


def test_word_counts_do_not_depend_on_when_they_are_merged():
    classes = bpe.character_classes("byte_bpe_50k.json")
    texts = [" ".join(f"w{i % 7}" for i in range(n, n + 40)) for n in range(30)]
    batches = [pa.record_batch({"text": pa.array(texts[i : i + 3])}) for i in range(0, 30, 3)]
    got = []
    for merged in (1, 25, 10**6):
        out = bpe._frequent_words(lambda m=merged: bpe.Splitter(classes, None, bpe.Sizes(merged=m)))(iter(batches))
        rows = [r for b in out for r in b.to_pylist()]
        got.append(sorted((r["word"], r["n"]) for r in rows))
    assert got[0] == got[1] == got[2] and sum(n for _, n in got[0]) > 1000
