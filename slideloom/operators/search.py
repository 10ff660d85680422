"""Search by cosine, re-ranking, de-duplication and grouping of hits."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from slideloom.functions import scalars
from slideloom.sources.shared import written

#: Query vectors that one pass over the slides takes with it, in bytes; more queries take more passes.
QUERY_BYTES = 1 << 26
#: Queries and slides that a task scores at a time: 8 MB of scores, and a few times that while the best are taken.
QUERY_BLOCK = 512
SLIDE_BLOCK = 2048


def search_slides(
    slides: DataFrame, queries: DataFrame, top_k: int = 25, file_filter: str | None = None, keys: tuple[str, ...] = ("file_path", "slide_number"), vector: str = "embedding"
) -> DataFrame:
    """Top ``top_k`` slides by cosine for each of (query_id, query_vec): query_id, ``keys``, score, rank.

    A pass over the slides takes QUERY_BYTES of query vectors with it (100 000 of 64 numbers), and scores blocks of
    slides against blocks of queries.  Every task keeps the ``top_k`` best scores of each query so far: what falls below
    this floor is not given out, and a block of slides that cannot reach it, by its centre and radius, is not scored.  So a
    few multiples of top_k rows per query and task are shuffled, ties by ``keys`` included.  Queries beyond one pass are written
    and taken pass by pass.  Vectors of another length than the query's are not scored; zero vectors score 0.
    """
    spark = slides.sparkSession
    if file_filter is not None:
        slides = slides.where(F.col("file_name") == file_filter)
    slides = slides.select(*keys, F.col(vector).cast("array<double>").alias("_v"))
    fields = [slides.schema[k] for k in keys]
    id_field = queries.schema["query_id"]
    schema = T.StructType([T.StructField("query_id", id_field.dataType), *fields, T.StructField("score", T.DoubleType())])
    names, query_block, slide_block = schema.fieldNames(), QUERY_BLOCK, SLIDE_BLOCK

    def kernel(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_size = []
            for ids, matrix in shared.value:
                by_size.append((ids, matrix, np.full((len(matrix), top_k), -np.inf)))
            for batch in batches:
                sizes = np.asarray(batch.column("_v").value_lengths().fill_null(-1))
                for ids, matrix, best in by_size:
                    fitting = batch.filter(pa.array(sizes == matrix.shape[1]))
                    for start in range(0, fitting.num_rows, slide_block):
                        part = _in_order(fitting.slice(start, slide_block), keys)
                        v = part.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                        norm = np.linalg.norm(v, axis=1, keepdims=True)
                        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
                        centre = v.mean(axis=0)
                        reach = float(np.linalg.norm(v - centre, axis=1).max()) + 1e-9
                        may = np.flatnonzero(matrix @ centre + reach >= best[:, 0])
                        for at in range(0, len(may), query_block):
                            asked = may[at : at + query_block]
                            scores = matrix[asked] @ v.T
                            q, s = _top(scores, top_k, best[asked, 0])
                            if len(q):
                                best[asked] = _raised(best[asked], q, scores[q, s])
                                yield pa.RecordBatch.from_arrays([ids.take(pa.array(asked[q])), *[part.column(k).take(pa.array(s)) for k in keys], pa.array(scores[q, s])], names)

        return run

    asked = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec")).where("query_vec IS NOT NULL")

    def scored(table: pa.Table) -> DataFrame:
        """The hits of one bounded table of queries, in one pass."""
        if not table.num_rows:
            return spark.createDataFrame([], schema)
        sizes, taken = np.asarray(table["query_vec"].combine_chunks().value_lengths()), []
        for size in sorted(set(sizes.tolist())):
            block = table.filter(pa.array(sizes == size)).combine_chunks()
            matrix = block["query_vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)
            norm = np.linalg.norm(matrix, axis=1, keepdims=True)
            taken.append((block["query_id"].combine_chunks(), np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)))
        return slides.mapInArrow(kernel(spark.sparkContext.broadcast(taken)), schema)

    size = asked.agg(F.sum(F.size("query_vec").cast("long") * 8 + 64)).first()[0] or 0
    passes = -(-size // QUERY_BYTES)
    if passes <= 1:
        return _best(scored(asked.toArrow()), top_k, keys)
    asked = written(asked, "queries")  # each pass reads its own part
    tables = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == b).toArrow() for b in range(passes))
    return functools.reduce(DataFrame.unionByName, (written(_best(scored(p), top_k, keys), "hits") for p in tables))


def _raised(best: np.ndarray, q: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The best scores of each query, smallest first, with new ``scores`` of the queries ``q`` (sorted) among them."""
    k = best.shape[1]
    counts = np.bincount(q, minlength=len(best))
    new = np.full((len(best), int(counts.max())), -np.inf)
    new[q, np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)] = scores
    return np.sort(np.concatenate([best, new], axis=1), axis=1)[:, -k:]


def _in_order(part: pa.RecordBatch | pa.Table, keys: tuple[str, ...]) -> pa.RecordBatch | pa.Table:
    """The rows by ``keys``, nulls first as Spark sorts them."""
    return part.take(pc.sort_indices(part.select(list(keys)), sort_keys=[(k, "ascending") for k in keys], null_placement="at_start"))


def _top(scores: np.ndarray, top_k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``top_k`` best of each line that reach ``least``; of equal scores at the border the first ones, so that copies of a vector cannot pile up."""
    reach = np.ones_like(scores, bool) if least is None else scores >= least[:, None] - 2e-9
    if scores.shape[1] <= top_k:
        return np.nonzero(reach)
    many = np.flatnonzero(reach.sum(axis=1) > top_k)
    if len(many):
        rounded = np.round(scores[many], 9)
        floor = np.partition(rounded, -top_k, axis=1)[:, -top_k, None]
        above, tied = rounded > floor, rounded == floor
        reach[many] &= above | tied & (np.cumsum(tied, axis=1) <= top_k - above.sum(axis=1, keepdims=True))
    return np.nonzero(reach)


def _best(out: DataFrame, top_k: int, keys: tuple[str, ...]) -> DataFrame:
    """The first ``top_k`` hits of each query, with their rank."""
    out = out.withColumn("_order", F.round("score", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("_order"), *keys)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).drop("_order")


def rerank(hits: DataFrame, scores: DataFrame, top_k: int, keys: tuple[str, ...] = ("query_id", "file_path", "slide_number")) -> DataFrame:
    """Hits with a re-rank score, cut and ordered by it; score becomes 0.6 * rerank_score + 0.4 * original_score."""
    joined = hits.join(scores.select(*keys, "rerank_score"), list(keys)).withColumnRenamed("score", "original_score")
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), *keys[1:])
    ranked = joined.withColumn("rerank_rank", F.row_number().over(w)).where(F.col("rerank_rank") <= top_k)
    return ranked.withColumn("score", 0.6 * F.col("rerank_score") + 0.4 * F.col("original_score"))


def dedupe_hits(hits: DataFrame, order: str | None = None) -> DataFrame:
    """The best hit of each (query_id, file_path, slide_number), with all its columns.

    Of equal scores the first seen stays: the first by ``order``, a column, or by rank if there is one.
    """
    order = order or ("rank" if "rank" in hits.columns else None)
    keys = ("query_id", "file_path", "slide_number")
    rest = [c for c in hits.columns if c not in keys]
    first = F.struct(F.col("score").isNull(), -F.col("score"), *([order] if order else []))
    best = hits.groupBy(*keys).agg(F.min_by(F.struct(*rest), first).alias("_row"))  # minima are taken in every task before the shuffle
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in hits.columns])


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), "query_id", "file_path", "slide_number").limit(k)


def attach_images(hits: DataFrame, images: DataFrame) -> DataFrame:
    return hits.join(images.select("image_path", "image_base64"), "image_path", "left").withColumn("image_base64", F.coalesce("image_base64", F.lit("")))


def presentation_names(hits: DataFrame) -> DataFrame:
    """(query_id, file_name, presentation_name, group_rank): the group of each file name among one query's hits.

    Names go in order of their best score; each joins the first group whose first name is a version of the same
    presentation, or begins one.  The names of one query, at most as many as its hits, are folded in one array.
    """
    best = hits.groupBy("query_id", F.coalesce("file_name", F.lit("")).alias("file_name")).agg(F.max("score").alias("best"))
    name = F.col("file_name")
    base = scalars.name_base(name)
    item = F.struct((-F.coalesce("best", F.lit(float("-inf")))).alias("at"), name, F.lower(base).alias("low"), scalars.name_version(name).isNotNull().alias("versioned"), base.alias("base"))
    listed = best.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("names"))
    none = F.array().cast("array<struct<file_name:string,low:string,versioned:boolean,title:string,at:int,leads:boolean>>")

    def place(done, x):
        leaders = F.filter(done, lambda d: d["leads"])
        mine = F.get(F.filter(leaders, lambda d: scalars.same_base(x["low"], x["versioned"], d["low"], d["versioned"])), F.lit(0))
        return F.concat(done, F.array(F.struct(
            x["file_name"].alias("file_name"), x["low"].alias("low"), x["versioned"].alias("versioned"), F.coalesce(mine["title"], x["base"]).alias("title"),
            F.coalesce(mine["at"], F.size(leaders)).alias("at"), mine.isNull().alias("leads"),
        )))

    folded = listed.select("query_id", F.explode(F.aggregate("names", none, place)).alias("g"))
    return folded.select("query_id", F.col("g.file_name").alias("file_name"), F.col("g.title").alias("presentation_name"), F.col("g.at").alias("group_rank"))


def assign_presentations(hits: DataFrame) -> DataFrame:
    """Hits with presentation_name and group_rank (0 for the group with the best hit); a missing file name is ''."""
    return hits.withColumn("file_name", F.coalesce("file_name", F.lit(""))).join(presentation_names(hits), ["query_id", "file_name"])


def group_presentations(hits: DataFrame) -> DataFrame:
    """(query_id, group_rank, presentation_name, versions, slides): one row for each group of a query's hits.

    versions are the distinct ones in the order of strings, v1 for names without; slides are whole hits, the best first.
    """
    rest = [c for c in hits.columns if c != "query_id"]
    version = F.coalesce(F.concat(F.lit("v"), scalars.name_version(F.col("file_name"))), F.lit("v1"))
    slide = F.struct((-F.col("score")).alias("_at"), *rest)
    grouped = assign_presentations(hits).groupBy("query_id", "group_rank", "presentation_name")
    rows = grouped.agg(F.array_sort(F.collect_set(version)).alias("versions"), F.array_sort(F.collect_list(slide)).alias("_slides"))
    return rows.withColumn("slides", F.transform("_slides", lambda x: F.struct(*[x[c].alias(c) for c in rest]))).drop("_slides")
