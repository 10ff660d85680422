"""Approximate search by cosine: lists around centroids, one-byte codes of each row's rest, and exact scores for the rows that survive.

A row is its list's centroid plus a rest, which is cut into parts of four numbers, each named by the nearest of up to 256
codebook entries.  A query scores the rows of its near lists by these codes, which take a sixteenth of the bytes of float
vectors, and only the best ``survivors`` times top_k of them by their whole vectors.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from slideloom.operators import search
from slideloom.sources.shared import written

#: Centroids are fitted on about so many rows; every row is indexed.
FIT_ROWS = 20_000
MAX_LISTS = 1024
#: The number of lists to read is set on about so many queries, searched exactly.
TUNING_QUERIES = 200
#: Numbers in a part of a row's rest, and entries of its codebook.
PART = 4
ENTRIES = 256
#: Rows and queries that one task scores at a time.
ROW_BLOCK = 16_384
ASK_BLOCK = 1024
#: Queries of a block whose scores are held at once.
ASK_SLICE = 64


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def about(df: DataFrame, rows: int, by: list[Column], count: int) -> DataFrame:
    """About ``rows`` rows of ``df``, never over twice as many, chosen by a hash of ``by``."""
    return df.where(F.pmod(F.xxhash64(*by), F.lit(max(1, count))) < rows).limit(2 * rows)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors; fewer than ``lists`` where the sample is small."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    centroids = sample[rng.permutation(len(sample))[:lists]]
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), centroids)
    return centroids


class Model(NamedTuple):
    """What an index is built by: unit centroids, and a codebook for each part of the rest."""

    centroids: np.ndarray
    edges: np.ndarray
    books: list[np.ndarray]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the codes (a byte for each part) of unit rows."""
        lists = (rows @ self.centroids.T).argmax(axis=1)
        rest = rows - self.centroids[lists]
        return lists, np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books, strict=True)], axis=1).astype(np.uint8)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centroids[lists] + np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)


def _nearest(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(axis=1) - 2 * rows @ book.T).argmin(axis=1)


def fit_model(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> Model:
    """Centroids and codebooks of a bounded sample of unit rows."""
    centroids = fit_centroids(sample, lists, rounds, seed)
    rest = sample - centroids[(sample @ centroids.T).argmax(axis=1)]
    dim = sample.shape[1]
    edges = np.linspace(0, dim, -(-dim // PART) + 1).astype(int)
    rng, books = np.random.default_rng(seed), []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = rest[:, a:b]
        book = part[rng.permutation(len(part))[:ENTRIES]].copy()
        for _ in range(rounds):
            near = _nearest(part, book)
            counts = np.bincount(near, minlength=len(book))
            sums = np.stack([np.bincount(near, weights=part[:, i], minlength=len(book)) for i in range(b - a)], axis=1)
            book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        books.append(book)
    return Model(centroids, edges, books)


def build_index(slides: DataFrame, dim: int, keys: tuple[str, ...] = ("file_path", "slide_number"), vector: str = "embedding") -> tuple[DataFrame, Model] | None:
    """(index, model) of all rows of ``slides`` with vectors of ``dim`` numbers: ``keys``, _id, _v, _list and _code, written; None without rows.

    The model is fitted on about FIT_ROWS rows; every row is indexed.
    """
    rows = slides.select(*keys, F.col(vector).cast("array<double>").alias("_v")).where(F.size("_v") == dim)
    count = rows.count()
    sample = unit(_matrix(about(rows, FIT_ROWS, [F.col(k) for k in keys], count).select("_v").toArrow()["_v"], dim)) if dim else np.zeros((0, 0))
    if not len(sample):
        return None
    model = fit_model(sample, int(min(MAX_LISTS, max(1, 4 * np.sqrt(count)))))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, codes = model.encode(unit(_matrix(batch.column("_v"), dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], [*batch.schema.names, "_list", "_code"])

    numbered = rows.withColumn("_id", F.monotonically_increasing_id())
    schema = T.StructType([*numbered.schema.fields, T.StructField("_list", T.IntegerType()), T.StructField("_code", T.BinaryType())])
    return written(numbered.mapInArrow(coded, schema), "index"), model


def _best_rows(asked: np.ndarray, rows: np.ndarray, survivors: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries (counted from ``at``) and of their ``survivors`` best rows, and the scores."""
    scores = asked @ rows.T
    q, s = search._top(scores, survivors)
    return q + at, s, scores[q, s]


def candidates(index: DataFrame, model: Model, asked: DataFrame, margin: float, survivors: int) -> DataFrame:
    """(query_id, _id) of the ``survivors`` rows of each of (query_id, _v) that score best by their codes.

    A query reads the lists whose centroid's score is within ``margin`` of its best.  A list is scored in blocks of bounded size, so one
    that holds most rows is spread over many tasks.  query_id names one query.
    """
    dim = model.centroids.shape[1]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ASK_BLOCK):
                part = batch.slice(start, ASK_BLOCK)
                score = unit(_matrix(part.column("_v"), dim)) @ model.centroids.T
                row, own = np.nonzero(score >= score.max(axis=1, keepdims=True) - margin)
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(row)).columns, pa.array(own.astype(np.int32))], [*batch.schema.names, "_list"])

    asks = written(asked.mapInArrow(near, T.StructType([*asked.schema.fields, T.StructField("_list", T.IntegerType())])), "asks")

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("_list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    sizes = blocks(index, ROW_BLOCK, "_rows").join(blocks(asks, ASK_BLOCK, "_asks"), "_list")  # lists that are asked

    def dealt(df: DataFrame, own: str, other: str, key: Column, places: tuple[str, str]) -> DataFrame:
        """Each row in its block, once for each block of the other side."""
        spread = df.join(F.broadcast(sizes), "_list")  # at most MAX_LISTS rows
        return spread.withColumns({places[0]: F.pmod(key, F.col(own)).cast("int"), places[1]: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}).drop(own, other)

    left = dealt(index.select("_id", "_list", "_code"), "_rows", "_asks", F.xxhash64("_id"), ("_i", "_j"))
    right = dealt(asks, "_asks", "_rows", F.xxhash64("query_id"), ("_j", "_i"))
    id_field = asked.schema["query_id"]
    found = T.StructType([T.StructField("query_id", id_field.dataType), T.StructField("_id", T.LongType()), T.StructField("_near", T.DoubleType())])

    def score(_: tuple, here: pa.Table, ask: pa.Table) -> pa.Table:
        if not here.num_rows or not ask.num_rows:
            return pa.Table.from_pylist([], pa.schema([ask.schema.field("query_id"), ("_id", pa.int64()), ("_near", pa.float64())]))
        codes = np.frombuffer(b"".join(here["_code"].to_pylist()), np.uint8).reshape(here.num_rows, -1)
        rows = model.decode(here["_list"].to_numpy(), codes)
        own = unit(_matrix(ask["_v"], dim))
        best = [_best_rows(own[at : at + ASK_SLICE], rows, survivors, at) for at in range(0, len(own), ASK_SLICE)]
        q, s, near_by = (np.concatenate([b[i] for b in best]) for i in range(3))
        return pa.table([ask["query_id"].take(pa.array(q)), here["_id"].take(pa.array(s)), pa.array(near_by)], names=found.fieldNames())

    where = ["_list", "_i", "_j"]
    scored = left.groupBy(*where).cogroup(right.groupBy(*where)).applyInArrow(score, found)
    best = Window.partitionBy("query_id").orderBy(F.desc("_near"), "_id")
    return scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= survivors).select("query_id", "_id")


def search_ann(
    slides: DataFrame, queries: DataFrame, top_k: int = 25, recall: float = 0.95, dim: int | None = None, keys: tuple[str, ...] = ("file_path", "slide_number"), vector: str = "embedding", survivors: int = 32
) -> DataFrame:
    """:func:`search.search_slides` with about ``recall`` of its hits: query_id, ``keys``, score, rank.

    Vectors of ``dim`` numbers are indexed and asked, others are left out; by default each length that queries have is
    searched in turn, among the rows of that length.  About TUNING_QUERIES queries are searched exactly, and a query reads all
    lists within a margin of its nearest centroid, the smallest that found ``recall`` of these hits.  ``survivors`` * top_k rows of
    each query are scored exactly.  query_id names one query.
    """
    spark = slides.sparkSession
    asked = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("_v")).where("size(_v) > 0")
    if dim is None:
        dims = sorted(r["_n"] for r in asked.select(F.size("_v").alias("_n")).distinct().collect())
        if len(dims) > 1:
            return functools.reduce(DataFrame.unionByName, (search_ann(slides, queries, top_k, recall, n, keys, vector, survivors) for n in dims))
        dim = dims[0] if dims else 0
    asked = asked.where(F.size("_v") == dim)
    fields, id_field = [slides.schema[k] for k in keys], queries.schema["query_id"]
    found = T.StructType([T.StructField("query_id", id_field.dataType), *fields, T.StructField("score", T.DoubleType())])
    n_asked = asked.count()
    built = build_index(slides, dim, keys, vector) if n_asked else None
    if built is None:
        return search._best(spark.createDataFrame([], found), top_k, keys)
    index, model = built
    margin = _margin(index, about(asked, TUNING_QUERIES, [F.col("query_id")], n_asked), model.centroids, top_k, recall, keys)
    chosen = candidates(index, model, asked, margin, survivors * top_k)
    pairs = chosen.join(index.select("_id", *keys, "_v"), "_id").join(asked.select("query_id", F.col("_v").alias("_q")), "query_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = np.einsum("ij,ij->i", unit(_matrix(batch.column("_q"), dim)), unit(_matrix(batch.column("_v"), dim)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), *[batch.column(k) for k in keys], pa.array(exact)], found.fieldNames())

    return search._best(pairs.select("query_id", *keys, "_q", "_v").mapInArrow(score, found), top_k, keys)


def _margin(index: DataFrame, some: DataFrame, centroids: np.ndarray, top_k: int, recall: float, keys: tuple[str, ...]) -> float:
    """The least margin below a query's best centroid within which lists hold ``recall``, and half of the rest, of the exact hits of ``some`` queries (a bounded number of them)."""
    some = some.select("query_id", F.col("_v").alias("query_vec")).dropDuplicates(["query_id"])
    vectors = {r["query_id"]: r["query_vec"] for r in some.collect()}
    hits = search.search_slides(index, some, top_k, keys=(*keys, "_list"), vector="_v").select("query_id", "_list").collect()
    if not hits:
        return 2.0
    scores = {q: centroids @ unit(np.asarray(v)[None, :])[0] for q, v in vectors.items()}
    gaps = np.sort([scores[h["query_id"]].max() - scores[h["query_id"]][h["_list"]] for h in hits])
    return float(gaps[min(len(gaps) - 1, int(np.ceil((1 + recall) / 2 * len(gaps))) - 1)]) + 1e-12
