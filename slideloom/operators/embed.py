"""Embedding with a caller's function, re-rank scores, and the search pipeline from query text to grouped hits."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slideloom.functions import scalars
from slideloom.operators import search
from slideloom.sources.shared import written

Embedder = Callable[[list[str]], list]
DIM = 64


def hashed_ngrams(texts: list[str], dim: int = DIM) -> list[list[float]]:
    """A deterministic embedder for tests and offline runs: signed counts of hashed character trigrams, of length 1."""
    out = []
    for text in texts:
        data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
        v = np.zeros(dim)
        for at in range(0, len(data) - 2, 1 << 20):  # a very long text in stretches
            part = data[at : at + (1 << 20) + 2]
            h = (part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(0x9E3779B1)
            h ^= h >> 15
            v += np.bincount((h >> 1) % dim, weights=np.where(h & 1, 1.0, -1.0), minlength=dim)
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def _tried(embedder: Embedder, texts: list[str], waits: tuple[float, ...]) -> list:
    """The vectors of ``texts``; a batch that fails or comes back short after all tries is redone text by text, and what fails then is None."""
    for wait in (*waits, None):
        try:
            out = list(embedder(texts))
            if len(out) == len(texts):
                return out
            break
        except Exception:  # any embedder may be passed in
            if wait is None:
                break
            time.sleep(wait)
    if len(texts) == 1:
        return [None]
    return [_tried(embedder, [t], ())[0] for t in texts]


class Paced:
    """A caller's function that is called at most ``per_minute`` / ``tasks`` times a minute in each task: a service's limit that ``tasks`` tasks share."""

    def __init__(self, call: Callable, per_minute: float, tasks: int) -> None:
        self.call, self.gap, self.next = call, 60.0 * tasks / per_minute, 0.0

    def __call__(self, *args):
        now = time.monotonic()
        if now < self.next:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap
        return self.call(*args)


def paced(df: DataFrame, embedder: Embedder, per_minute: float | None, tasks: int) -> tuple[DataFrame, Embedder]:
    """Rows in ``tasks`` partitions and an embedder that keeps all of these together to ``per_minute`` calls a minute; None is no limit."""
    return (df, embedder) if per_minute is None else (df.repartition(tasks), Paced(embedder, per_minute, tasks))


def _embedded(df: DataFrame, text: str, embedder: Embedder, batch_size: int, waits: tuple[float, ...]) -> DataFrame:
    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = texts.fillna("").tolist()
            out: list = []
            for at in range(0, len(texts), batch_size):
                out += _tried(embedder, texts[at : at + batch_size], waits)
            yield pd.Series(out, dtype=object)

    return df.withColumn("embedding", vectors(text))


def embed_slides(slides: DataFrame, embedder: Embedder = hashed_ngrams, batch_size: int = 75, waits: tuple[float, ...] = (2.0, 4.0), text: str = "slide_text") -> tuple[DataFrame, DataFrame]:
    """(slides with embedding, slides whose text could not be embedded).  Vectors are written once, so that both sides see the same calls."""
    rows = written(_embedded(slides, text, embedder, batch_size, waits), "embedded")
    return rows.where("embedding IS NOT NULL"), rows.where("embedding IS NULL").drop("embedding")


def embed_queries(misses: DataFrame, cache: DataFrame, embedder: Embedder = hashed_ngrams) -> DataFrame:
    """The cache (query_hash, embedding) with the vectors of the missing queries; each normalised query is embedded once."""
    named = misses.select(scalars.normalize_query(F.col("query")).alias("text")).where("text <> ''").distinct()
    good, _ = embed_slides(named, embedder, text="text")
    return cache.select("query_hash", "embedding").unionByName(good.select(F.sha2("text", 256).alias("query_hash"), F.col("embedding").cast(cache.schema["embedding"].dataType)))


def normalize_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Vectors of length 1; zero vectors stay."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn(vector, F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v))


def embed_chunks(chunks: DataFrame, embedder: Embedder = hashed_ngrams, normalize: bool = True, text: str = "text") -> DataFrame:
    """Chunks with embedding; a chunk that brings a vector keeps it."""
    if "embedding" in chunks.columns:
        brought = chunks.where("embedding IS NOT NULL")
        made = _embedded(chunks.where("embedding IS NULL").drop("embedding"), text, embedder, 75, (2.0, 4.0))
        out = brought.withColumn("embedding", F.col("embedding").cast("array<float>")).unionByName(made)
    else:
        out = _embedded(chunks, text, embedder, 75, (2.0, 4.0))
    return normalize_vectors(out) if normalize else out


def score_pairs(hits: DataFrame, scorer: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """Hits (query, slide_text) with rerank_score by a caller's function; null where the scorer fails."""

    @F.pandas_udf("double")
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        try:
            return pd.Series(scorer(query.tolist(), text.tolist()), dtype=float)
        except Exception:  # any scorer may be passed in
            return pd.Series([None] * len(query), dtype=float)

    return hits.withColumn("rerank_score", score("query", "slide_text"))


def rerank_hits(hits: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], top_k: int) -> DataFrame:
    """Hits (query_id, query, slide_text, score, rank) re-ranked by a caller's function: rerank_score, original_score, rerank_rank.

    score becomes 0.6 * rerank_score + 0.4 * original_score, and the ``top_k`` by rerank_score stay.  A query any of
    whose hits could not be scored keeps its hits as they were, with null rerank_score and rerank_rank.
    """
    scored = written(score_pairs(hits, scorer), "scored")  # the scorer is asked once
    query = Window.partitionBy("query_id")
    failed = F.max(F.col("rerank_score").isNull()).over(query)
    nth = F.row_number().over(query.orderBy(F.desc("rerank_score"), "rank"))
    judged = scored.withColumns({"_failed": failed, "_nth": nth}).where(F.col("_failed") | (F.col("_nth") <= top_k))
    fine = ~F.col("_failed")
    return judged.withColumns({
        "original_score": F.col("score"), "score": F.when(fine, 0.6 * F.col("rerank_score") + 0.4 * F.col("score")).otherwise(F.col("score")),
        "rerank_rank": F.when(fine, F.col("_nth")), "rerank_score": F.when(fine, F.col("rerank_score")),
    }).drop("_failed", "_nth")


def search_pipeline(
    slides: DataFrame, queries: DataFrame, cache: DataFrame, embedder: Embedder = hashed_ngrams, top_k: int = 25, file_filter: str | None = None,
    images: DataFrame | None = None, scorer: Callable[[list[str], list[str]], list[float]] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, new cache, stats) of queries (query_id, query).

    Blank queries go, cached vectors are used, missing ones are embedded once; then come search (in one file if
    ``file_filter`` names it), the ``images`` (image_path, image_base64) of slides with an image_path, re-ranking if
    there is a ``scorer`` (slides need slide_text), de-duplication and grouping: hits carry presentation_name and
    group_rank.  stats has query_id, total_found (hits before de-duplication), cached and used_reranker.
    """
    asked = scalars.drop_blank_queries(queries).withColumn("query_hash", scalars.query_hash(F.col("query")))
    held = cache.select("query_hash").distinct().withColumn("_held", F.lit(True))
    asked = asked.join(held, "query_hash", "left").withColumn("cached", F.coalesce("_held", F.lit(False))).drop("_held")
    cache = written(embed_queries(asked.where("NOT cached"), cache, embedder), "cache")
    vectors = asked.join(cache, "query_hash").select("query_id", F.col("embedding").alias("query_vec"))
    keys = ("file_path", "file_name", "slide_number", *[c for c in ("image_path", "slide_text") if c in slides.columns])
    found = written(search.search_slides(slides, vectors, top_k, file_filter, keys=keys), "hits")
    if images is not None:
        found = search.attach_images(found, images)
    if scorer is not None:
        found = rerank_hits(found.join(asked.select("query_id", "query"), "query_id"), scorer, top_k).drop("query")
    totals = found.groupBy("query_id").agg(F.count("*").alias("total_found"))
    stats = asked.select("query_id", "cached").join(totals, "query_id", "left").select(
        "query_id", F.coalesce("total_found", F.lit(0)).alias("total_found"), "cached", F.lit(scorer is not None).alias("used_reranker")
    )
    return search.assign_presentations(search.dedupe_hits(found)), cache, stats
