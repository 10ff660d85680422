"""Near-duplicate detection by circulant MinHash.

Two permutations of a fixed universe make every signature coordinate: the first spreads the shingles, the
second, shifted circularly by k places, gives coordinate k.  Rows of coordinates are banded, members of a
bucket are verified on their full shingle sets by exact integer Jaccard, and links are closed transitively.

Large groups never meet as all pairs.  Texts with equal sets collapse first.  Each bucket then compares its
members with one centre only, the member that shares most buckets with others.  Buckets that still hold
several components are finished in blocks of bounded size that give at most one link for each text and
component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, require
from ._words import SPACES, blocks, distinct_shingles, frugal, mix, word_hashes
from .components import connected_components

UNIVERSE_BITS = 20
BANDS = 32
ROWS = 4  # a pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 32, below 1e-7
#: Bounds of a block that is compared in one task: members and shingles of each side.
BLOCK = 256
BLOCK_ITEMS = 1 << 20
#: Members of a bucket that share a join key; larger buckets are spread over several.
SLOT = 512
_CHUNK = 2048


@lru_cache(maxsize=2)
def _permutations(coordinates: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The spreading permutation, and the rows of the circulant one: row p holds coordinate values of place p."""
    size = 1 << UNIVERSE_BITS
    rng = np.random.default_rng(seed)
    spread = rng.permutation(size).astype(np.int32)
    second = rng.permutation(size).astype(np.int32)
    ring = np.concatenate([second, second[: coordinates - 1]])
    return spread, np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def circulant_signatures(values: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """Signatures (rows x coordinates) of sorted shingle sets; rows without shingles hold the largest value."""
    spread, rings = _permutations(coordinates)
    places = spread[(values & np.uint64((1 << UNIVERSE_BITS) - 1)).astype(np.int64)]
    rows = len(bounds) - 1
    out = np.full((rows, coordinates), np.iinfo(np.int32).max, np.int32)
    full = np.flatnonzero(np.diff(bounds))
    ends = bounds[full + 1]
    at = 0
    while at < len(full):  # some thousand shingles at a time bound the memory
        low = int(bounds[full[at]])
        end = max(int(np.searchsorted(ends, low + _CHUNK, side="right")), at + 1)
        part, high = full[at:end], int(ends[end - 1])
        if len(part) == 1:
            for i in range(low, high, _CHUNK):
                np.minimum(out[part[0]], rings[places[i : min(high, i + _CHUNK)]].min(axis=0), out=out[part[0]])
        else:
            out[part] = np.minimum.reduceat(rings[places[low:high]], bounds[part] - low, axis=0)
        at = end
    return out


def _shingle_batches(batches: Iterator[pa.RecordBatch], shingle: int):
    for batch in batches:
        for start, end, data, offsets in blocks(batch.column("text")):
            values, bounds = distinct_shingles(*word_hashes(data, offsets, SPACES), shingle)
            yield batch.slice(start, end - start), values, bounds


def signatures(docs: DataFrame, shingle: int = 2, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, key, bands): the set's hash, null if it is empty, stands for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values, bounds in _shingle_batches(batches, shingle):
            n = batch.num_rows
            signature = circulant_signatures(values, bounds, bands * rows)
            keys = np.zeros((n, bands), np.uint64)
            for b in range(bands):
                h = np.full(n, b + 1, np.uint64)
                for r in range(rows):
                    h = mix(h ^ signature[:, b * rows + r].astype(np.uint64)) + np.uint64(r)
                keys[:, b] = h
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(bounds)), *_set_sums(values, bounds),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64))),
            ], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.mapInArrow(frugal(run), f"doc_id {kind}, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")
    return signed.select("doc_id", "n_shingles", _key().alias("key"), "bands")


def _set_sums(values: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Two sums of hashes of each set; together with its size they identify it."""
    totals = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(s)), dtype=np.uint64)]) for s in (11, 97)]
    return [pa.array((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64)) for t in totals]


def _key() -> Column:
    return F.when(F.col("n_shingles") > 0, F.xxhash64("set_a", "set_b", "n_shingles"))


def shingle_sets(docs: DataFrame, shingle: int = 2) -> DataFrame:
    """(key, items): the full shingle set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values, bounds in _shingle_batches(batches, shingle):
            items = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(bounds)), *_set_sums(values, bounds), items], ["n_shingles", "set_a", "set_b", "items"])

    sets = docs.mapInArrow(frugal(run), "n_shingles bigint, set_a bigint, set_b bigint, items array<bigint>")
    return sets.select(_key().alias("key"), "items")


def _block_links(percent: int):
    """Links between the two sides of a block; at most one for each left text and right component."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        node, comp = table["node"].combine_chunks(), table["component"].to_numpy()
        items = table["items"].combine_chunks()
        flat, cut = items.flatten().to_numpy(), np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = right[np.argsort(comp[right], kind="stable")]
        size = np.diff(cut)
        pool = np.concatenate([flat[cut[r] : cut[r + 1]] for r in right]) if len(right) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(size[right])])[:-1]
        found: list[tuple[int, int]] = []
        for x in left if len(pool) else ():
            mine = flat[cut[x] : cut[x + 1]]
            place = np.minimum(np.searchsorted(mine, pool), len(mine) - 1)
            common = np.add.reduceat((mine[place] == pool).astype(np.int64), starts)
            linked = (100 * common >= percent * (size[right] + size[x] - common)) & (comp[right] != comp[x])
            hit = np.flatnonzero(linked)
            if len(hit):
                _, one = np.unique(comp[right[hit]], return_index=True)
                found += [(x, right[h]) for h in hit[one]]
        return pa.table({side: node.take(pa.array([f[i] for f in found], pa.int64())) for i, side in enumerate("ab")})

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts are linked when 100 * shared shingles >= ``percent`` * all their shingles; component_id is the
    smallest doc_id that links reach.  Null and empty texts have no shingles and stay alone.  Rows with a null
    doc_id cannot be named in a link: they keep a null component and are kept.  Repeated rows with one doc_id
    share its component; rows with one doc_id and different texts are different texts, each with its own links.
    doc_id may have any type with an order.  An empty table gives an empty table.
    """
    require(docs, ["doc_id", "text"])
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = materialize(signatures(docs, shingle, bands, rows), "signatures")
    named = signed.where("doc_id IS NOT NULL AND key IS NOT NULL")
    # equal sets are one text from here on; a node is its smallest doc_id and the hash of the set
    distinct = materialize(named.groupBy("key").agg(F.min("doc_id").alias("rep")), "sets")
    reps = named.join(distinct.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"], "left_semi").dropDuplicates(["key"])
    placed = reps.select(F.col("key").alias("doc"), F.col("doc_id").alias("rep"), "n_shingles", F.explode("bands").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("items")).where("members > 1")
    slots = F.ceil(F.col("members") / SLOT).cast("int")
    shared = materialize(placed.join(sizes, "bucket").withColumn("slot", F.pmod(F.xxhash64("doc"), slots).cast("int")), "buckets")

    def spread(buckets: DataFrame) -> DataFrame:
        """One row of each bucket for every slot of its members, so that no large bucket meets in one task."""
        return buckets.withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1)))

    degree = shared.groupBy("doc").agg(F.sum("members").alias("degree"))
    ranked = shared.join(degree, "doc")
    chosen = F.max_by(F.struct(F.col("doc").alias("centre"), F.col("rep").alias("centre_rep"), F.col("n_shingles").alias("centre_n"), "members"), F.struct("degree", -F.col("doc")))
    centre = materialize(ranked.groupBy("bucket").agg(chosen.alias("c")).select("bucket", "c.*"), "centres")
    smaller, larger = F.least("n_shingles", "centre_n"), F.greatest("n_shingles", "centre_n")
    near = shared.drop("members").join(spread(centre), ["bucket", "slot"]).where((F.col("doc") != F.col("centre")) & (100 * smaller >= percent * larger))
    pairs = materialize(near.select("doc", "rep", "centre", "centre_rep").distinct(), "pairs")
    # full sets only of texts that share a bucket
    wanted = shared.select("doc", "rep").distinct()
    texts = docs.join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("text")
    sets = shingle_sets(texts, shingle).join(wanted.select(F.col("doc").alias("key")), "key", "left_semi").dropDuplicates(["key"])
    sets = materialize(sets, "shingles")
    one = sets.select(F.col("key").alias("doc"), F.col("items").alias("x"))
    two = sets.select(F.col("key").alias("centre"), F.col("items").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    linked = pairs.join(one, "doc").join(two, "centre").where(100 * common >= percent * (F.size("x") + F.size("y") - common))
    node = lambda rep, key: F.struct(F.col(rep).alias("doc_id"), F.col(key).alias("key"))
    links = materialize(linked.select(node("rep", "doc").alias("a"), node("centre_rep", "centre").alias("b")), "links")
    labels = connected_components(links)

    # buckets whose members are still apart: the centre's component against the rest, in bounded blocks
    def labelled(rows: DataFrame, doc: str) -> DataFrame:
        by = labels.select(F.col("node.key").alias("node_key"), F.col("component.key").alias("component"))
        return rows.join(by, F.col(doc) == F.col("node_key"), "left").withColumn("component", F.coalesce("component", doc)).drop("node_key")

    open_members = labelled(shared.where("members > 2"), "doc")
    main = labelled(centre.where("members > 2").select("bucket", "centre", "members"), "centre").select("bucket", "members", F.col("component").alias("main"))
    members = open_members.join(spread(main).drop("members"), ["bucket", "slot"])
    members = materialize(members.withColumn("apart", F.col("component") != F.col("main")).drop("main"), "members")
    small = members.where("apart").groupBy("bucket").agg(F.count("*").alias("n_apart"), F.sum("n_shingles").alias("items_apart"), F.max("members").alias("members"))
    both = members.join(spread(small).drop("members"), ["bucket", "slot"])
    parts = lambda n, items: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(items) / BLOCK_ITEMS)).cast("int")
    n_left, n_right, mine = parts("n_apart", "items_apart"), parts("members", "items"), F.xxhash64("doc")
    kept = ["bucket", "doc", "rep", "component"]
    left = both.where("apart").select(*kept, F.lit(0).alias("side"), F.pmod(mine, n_left).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), n_right - 1)).alias("j"))
    right = both.select(*kept, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), n_left - 1)).alias("i"), F.pmod(mine, n_right).cast("int").alias("j"))
    work = left.union(right).join(sets.select(F.col("key").alias("doc"), "items"), "doc")
    work = work.select("bucket", "i", "j", "side", "component", "items", node("rep", "doc").alias("node"))
    pair = f"struct<doc_id:{kind},key:bigint>"
    more = materialize(work.groupBy("bucket", "i", "j").applyInArrow(_block_links(percent), f"a {pair}, b {pair}"), "more-links")
    if not more.isEmpty():
        labels = connected_components(links.union(more))

    # of two components that hold one doc_id with different texts each keeps its own smallest doc_id
    named_sets = distinct.join(labels.select(F.col("node.key").alias("key"), F.col("component.doc_id").alias("smallest")), "key", "left")
    named_sets = named_sets.select(F.col("key").alias("set_key"), F.coalesce("smallest", "rep").alias("component_id"))
    joined = signed.select("doc_id", "n_shingles", "key").join(named_sets, (F.col("key") == F.col("set_key")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
