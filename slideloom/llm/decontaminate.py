"""Benchmark decontamination by winnowing.

Of every ``window`` consecutive k-word grams the smallest hash is kept (the rightmost of equal ones), for
texts and benchmark items alike.  A span of ``window + k - 1`` words that both share has the same grams on
both sides, so both keep the same one.  Such a span has half of its other words at least before or behind the gram, so
the kept gram with as many neighbours on one side is the fingerprint: every shared span meets in a join on
one of the two sides, and a common phrase of ``k`` words alone meets nothing.  Each meeting is extended word
by word to both sides; only extensions of a whole span count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bit_sieve, free_names, materialize, require, sieve_has
from ._words import NON_ALNUM, blocks, frugal, grams, row_of, word_hashes

SPAN = 10
GRAM = 4
#: The filter that keeps most texts out of the join has this many bits, whatever the benchmark's size.
FILTER_BITS = 1 << 26
#: Fingerprints of the benchmark are broadcast up to this size.
BROADCAST_BYTES = 24 << 20
#: Kinds of fingerprints: a kept gram with its neighbours before, or behind; whole items of m words have span + m.
BEFORE, BEHIND = 1, 2


def _winnow(hashes: np.ndarray, bounds: np.ndarray, k: int, window: int) -> np.ndarray:
    """Word positions of the kept k-grams, over all rows of a block."""
    values = grams(hashes, k)
    if not len(values):
        return np.zeros(0, np.int64)
    row = row_of(bounds)
    inside = row[: len(values)] == row[k - 1 :]
    count = len(values) - window + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    # the rightmost of equal minima: compare from the right with "smaller or equal loses"
    best = values[window - 1 : window - 1 + count].copy()
    where = np.arange(window - 1, window - 1 + count)
    for i in range(window - 2, -1, -1):
        other = values[i : i + count]
        less = other < best
        best[less] = other[less]
        where[less] = np.flatnonzero(less) + i
    whole = inside[:count] & inside[window - 1 :] & (row[:count] == row[window - 1 : window - 1 + count])
    return np.unique(where[whole])


def _contexts(hashes: np.ndarray, bounds: np.ndarray, row: np.ndarray, places: np.ndarray, before: int, after: int, outside: int) -> np.ndarray:
    """Word hashes around each place; ``outside`` where the row has no word."""
    at = places[:, None] + np.arange(-before, after)[None, :]
    r = row[places]
    ok = (at >= bounds[r][:, None]) & (at < bounds[r + 1][:, None])
    out = hashes[np.clip(at, 0, max(0, len(hashes) - 1))].view(np.int64)
    return np.where(ok, out, outside)


def _list_of(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).reshape(-1)))


def _seeds(hashes: np.ndarray, bounds: np.ndarray, span: int, k: int, short: tuple[int, ...], item_side: bool):
    """(word position of the gram, kind, fingerprint) of a block.

    ``short`` holds the lengths below ``span`` of whole items: an item side gives one gram of the whole
    item, a text side gives all its grams of these lengths.
    """
    places, beside = _winnow(hashes, bounds, k, span - k + 1), (span - k + 1) // 2
    longer, found = grams(hashes, k + beside), []
    first, past = (bounds[row_of(bounds)[places]], bounds[row_of(bounds)[places] + 1]) if len(places) else (places, places)
    for kind, start, fits in ((BEFORE, places - beside, places - beside >= first), (BEHIND, places, places + k + beside <= past)):
        at = start[fits]
        found.append((places[fits], np.full(len(at), kind), longer[at] ^ np.uint64(kind) if len(at) else np.zeros(0, np.uint64)))
    row, counts = row_of(bounds), np.diff(bounds)
    for m in short if not item_side else [int(m) for m in np.unique(counts) if 0 < m < span]:
        all_m = grams(hashes, m)
        if item_side:
            at = bounds[:-1][counts == m]
        else:
            at = np.flatnonzero(row[: len(all_m)] == row[m - 1 :]) if len(all_m) else np.zeros(0, np.int64)
        # short items' fingerprints are apart from kept grams of equal length
        found.append((at, np.full(len(at), m + span), all_m[at] ^ np.uint64(0xD1B54A32D192ED03) if len(at) else np.zeros(0, np.uint64)))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def benchmark_fingerprints(items: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """(item_id, h, kind, around): fingerprints of every item with the words around the grams.  ``kind`` is BEFORE or BEHIND, or span + m for a whole item of m words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in blocks(batch.column("text")):
                hashes, bounds = word_hashes(data, offsets, NON_ALNUM)
                places, kind, values = _seeds(hashes, bounds, span, k, (), True)
                row = row_of(bounds)
                around = _contexts(hashes, bounds, row, places, span - k, span, -1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("item_id").slice(start, end - start).take(pa.array(row[places])), pa.array(values.view(np.int64)),
                    pa.array(kind.astype(np.int32)), _list_of(around),
                ], ["item_id", "h", "kind", "around"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), f"item_id {kind}, h bigint, kind int, around array<bigint>")


def find_contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = GRAM, broadcast_rows: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated.

    A text word is hit if it lies in an occurrence of ``span`` consecutive words of an item, or of a whole
    shorter item.  Words are runs of letters and digits with A-Z lower-cased.  Null or empty texts have no
    words and no hits; empty items never match; repeated rows of ``docs`` are judged each; an empty benchmark
    leaves all texts clean.  Items with equal ids count once.
    """
    require(docs, ["doc_id", "text"])
    return _judged(docs.select("doc_id", "text"), "doc_id", items, span, k, broadcast_rows)


def _meetings(docs: DataFrame, key: str, items: DataFrame, span: int, k: int, broadcast_rows: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, meetings of their fingerprints with those of items, items of each context): a context is the words around a gram, and
    items that have the same ones are extended together."""
    require(items, ["item_id", "text"])
    prints = materialize(benchmark_fingerprints(items, span, k).withColumn("context", F.xxhash64("around")), "fingerprints")
    short = tuple(sorted(r[0] - span for r in prints.where(F.col("kind") > span).select("kind").distinct().collect()))  # fewer than ``span`` lengths
    members = prints.select("context", "item_id").distinct()
    theirs = materialize(prints.groupBy("h", "kind", "context").agg(F.first("around").alias("item_around")), "contexts")
    if broadcast_rows is None:
        broadcast_rows = BROADCAST_BYTES // (8 * (2 * span - k) + 80)  # rows of one size
    n_prints = theirs.count()
    sieve = docs.sparkSession.sparkContext.broadcast(bit_sieve(prints, "h", FILTER_BITS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in blocks(batch.column("text")):
                hashes, bounds = word_hashes(data, offsets, NON_ALNUM)
                places, kind, values = _seeds(hashes, bounds, span, k, short, False)
                met = sieve_has(sieve.value, values.view(np.int64))
                places, kind, values = places[met], kind[met], values[met]
                row = row_of(bounds)
                order = np.argsort(row[places], kind="stable") if len(places) else np.zeros(0, np.int64)
                places, kind, values = places[order], kind[order], values[order]
                around = _contexts(hashes, bounds, row, places, span - k, span, -2)
                n = end - start
                cut = pa.array(np.searchsorted(row[places], np.arange(n + 1)).astype(np.int32))
                seeds = pa.StructArray.from_arrays(
                    [pa.array(places - bounds[row[places]]), pa.array(kind.astype(np.int32)), pa.array(values.view(np.int64)), _list_of(around)],
                    ["at", "kind", "h", "around"],
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(start, n), batch.column("key").slice(start, n), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(cut, seeds)],
                    ["row", "key", "n_words", "seeds"],
                )

    scanned = materialize(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
        .mapInArrow(frugal(scan), f"row bigint, key {docs.schema[key].dataType.simpleString()}, n_words bigint, seeds array<struct<at:bigint,kind:int,h:bigint,around:array<bigint>>>"),
        "seeds",
    )
    seeds = scanned.where(F.size("seeds") > 0).select("row", F.explode("seeds").alias("s")).select("row", "s.*")
    if n_prints <= broadcast_rows:
        met = seeds.join(F.broadcast(theirs), ["h", "kind"])
    else:  # texts that share one passage are many: spread each fingerprint over 16 keys
        salts = 16
        theirs = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = seeds.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int")).join(theirs, ["h", "kind", "salt"])

    return scanned, met, members


def _judged(docs: DataFrame, key: str, items: DataFrame, span: int = SPAN, k: int = GRAM, broadcast_rows: int | None = None) -> DataFrame:
    """:func:`find_contamination` of (key, text), with ``key`` in place of doc_id."""
    scanned, met, members = _meetings(docs, key, items, span, k, broadcast_rows)
    item_type = items.schema["item_id"].dataType.simpleString()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * span - k
        for batch in batches:
            if not batch.num_rows:
                continue
            mine = batch.column("around").flatten().to_numpy().reshape(-1, width)
            other = batch.column("item_around").flatten().to_numpy().reshape(-1, width)
            same = mine == other
            at, kind = batch.column("at").to_numpy(), batch.column("kind").to_numpy()
            left = np.cumprod(same[:, : span - k][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, span - k :], axis=1).sum(axis=1)
            whole = kind > span  # an item of fewer words than a span
            length = np.where(whole, kind - span, left + right)
            good = np.where(whole, right >= kind - span, length >= span)
            start = np.where(whole, at, at - left)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").filter(keep), batch.column("context").filter(keep), pa.array(start[good]), pa.array((start + length)[good])],
                ["row", "context", "first", "past"],
            )

    spans = materialize(met.select("row", "at", "kind", "around", "context", "item_around").mapInArrow(frugal(extend), "row bigint, context bigint, first bigint, past bigint"), "spans")
    of_row = spans.select("row", "context").distinct().join(members, "context").groupBy(F.col("row").alias("items_row")).agg(F.collect_set("item_id").alias("items"))
    hits = (
        spans.groupBy("row")
        .agg(F.collect_set(F.struct("first", "past")).alias("spans"))
        .join(of_row, F.col("row") == F.col("items_row"))
        .select(
            F.col("row").alias("hit_row"), "items",
            F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["past"] - 1))))).cast("long").alias("hit"),
        )
    )
    out = scanned.drop("seeds").join(hits, F.col("row") == F.col("hit_row"), "left")
    return out.select(
        F.col("key").alias(key), "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"),
        F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.when(F.col("items").isNull(), F.array().cast(f"array<{item_type}>")).otherwise(F.array_sort("items")).alias("items"),
        F.col("hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that share no span with an item, with all their columns, whatever their names.

    Rows are judged by their texts, named by a 64-bit hash: repeated rows share their fate, a null doc_id makes no
    difference, null and empty texts stay.  An empty benchmark keeps all; an empty table gives an empty table.
    """
    require(docs, ["text"])
    key, dirty = free_names(docs, "text_key", "dirty_key")
    own = F.xxhash64(F.col("text").cast("string"))
    judged = _judged(docs.select(own.alias(key), "text"), key, items, **options)
    # a table of its own: its size is known before the join, so that few of them are broadcast and no text is shuffled
    gone = materialize(judged.where("contaminated").select(F.col(key).alias(dirty)).distinct(), "dirty")
    return docs.join(gone, own == F.col(dirty), "left_anti")
