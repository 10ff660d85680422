"""Spreadsheet chunks, their versions and edits, and reports on runs."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slideloom.functions import scalars
from slideloom.operators import search


def zip_chunks(chunks: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks (key, idx) with the text of the same position; '' where there is none."""
    return chunks.join(texts.select(key, "idx", "text"), [key, "idx"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def search_chunks(chunks: DataFrame, queries: DataFrame, workbook: str | None = None, top_k: int = 5, return_format: str = "both") -> DataFrame:
    """Top chunks of each query by cosine, in one workbook or all, with text, markdown or both."""
    if return_format not in ("text", "markdown", "both"):
        raise ValueError(f"return_format: {return_format}")
    pool = chunks if workbook is None else chunks.where(F.col("workbook") == workbook)
    hits = search.search_slides(pool, queries, top_k, keys=("chunk_id",))
    shown = ["text", "markdown"] if return_format == "both" else [return_format]
    return hits.join(pool.select("chunk_id", "workbook", *shown), "chunk_id")


def run_summary(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of totals, failed files) of results (file, ok, slides); the run succeeds even if files fail."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    totals = results.agg(
        F.lit(True).alias("success"), F.count(F.when(ok, 1)).alias("files"), F.coalesce(F.sum(F.when(ok, F.col("slides"))), F.lit(0)).cast("long").alias("slides"),
        F.count(F.when(~ok, 1)).alias("failed"),
    )
    return totals, results.where(~ok).select("file")


def chunk_token_summary(chunks: DataFrame) -> DataFrame:
    """Totals of chunks (text, token_count, sheet) whose text is not blank, with lines and kilobytes."""
    body = chunks.where(F.col("text").rlike(r"\S"))
    tokens = F.coalesce(F.sum("token_count"), F.lit(0)).cast("long")
    lines = F.coalesce(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1), F.lit(0)).cast("long")
    return body.agg(
        F.count("*").alias("chunks"), tokens.alias("tokens"), F.coalesce(F.round(tokens / F.count("*"), 0), F.lit(0)).cast("long").alias("average"),
        F.countDistinct("sheet").alias("sheets"), lines.alias("lines"), F.coalesce(F.round(F.sum(F.length("text")) / 1024, 0), F.lit(0)).cast("long").alias("kb"),
    )


def chunk_sources(chunks: DataFrame) -> DataFrame:
    """Chunks of each question by workbook and sheet; what is missing is 'Unknown'."""
    known = [F.coalesce(F.col(c), F.lit("Unknown")).alias(c) for c in ("workbook", "sheet")]
    return chunks.groupBy("question", *known).agg(F.count("*").alias("chunks"))


def list_workbooks(store: DataFrame) -> DataFrame:
    return store.groupBy("workbook").agg(F.countDistinct("version").alias("versions"), F.count("*").alias("chunks"))


def throughput_report(batches: DataFrame, min_success: float = 90.0) -> DataFrame:
    """Per batch size: items, seconds, items_per_s, calls, success_pct, failed, and whether it is the fastest that did not fail."""
    calls = F.ceil(F.col("items") / F.col("batch_size"))
    sizes = batches.withColumn("_calls", calls).groupBy("batch_size").agg(
        F.sum("items").cast("long").alias("items"), F.sum("ok_items").cast("long").alias("_ok"), F.sum("seconds").alias("seconds"), F.sum("_calls").cast("long").alias("calls")
    )
    rated = sizes.select(
        "batch_size", "items", "seconds", "calls", F.when(F.col("seconds") > 0, F.round(F.col("items") / F.col("seconds"), 4)).alias("items_per_s"),
        F.when(F.col("items") > 0, F.round(100.0 * F.col("_ok") / F.col("items"), 2)).otherwise(F.lit(0.0)).alias("success_pct"),
    ).withColumn("failed", F.col("success_pct") < min_success)
    best = rated.where("NOT failed").agg(F.max_by("batch_size", F.struct("items_per_s", -F.col("batch_size"))).alias("_best"))
    return rated.join(F.broadcast(best)).withColumn("best", F.col("batch_size").eqNullSafe(F.col("_best"))).drop("_best")  # one row


def store_versions(new: DataFrame, store: DataFrame, create_new_version: bool = True) -> DataFrame:
    """The store (workbook, version, ...) with ``new`` chunks under each workbook's next version, or in place of its latest."""
    latest = store.groupBy("workbook").agg(F.max("version").alias("_latest"))
    step = 1 if create_new_version else 0
    numbered = new.drop("version").join(latest, "workbook", "left").withColumn("version", F.coalesce(F.col("_latest") + step, F.lit(1)).cast(store.schema["version"].dataType)).drop("_latest")
    kept = store if create_new_version else store.join(numbered.select("workbook", "version").distinct(), ["workbook", "version"], "left_anti")
    return kept.unionByName(numbered)


def file_versions(versions: DataFrame, path: str) -> DataFrame:
    """The versions of one file in order, without their contents."""
    return versions.where(F.col("path") == path).drop("content").orderBy("version_number")


def limit_chunks(chunks: DataFrame, n: int = 10, order: str = "chunk_index") -> DataFrame:
    """The first ``n`` chunks of each question, numbered from 0; a missing score, or 0, is 1.0."""
    w = Window.partitionBy("question").orderBy(order)
    first = chunks.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return first.withColumns({"chunk_index": (F.col("_n") - 1).cast("long"), "score": F.when(F.col("score") != 0, F.col("score")).otherwise(1.0)}).drop("_n")


def apply_edits(edits: DataFrame, ids: DataFrame, action: str) -> tuple[DataFrame, DataFrame]:
    """(edits with new statuses, ids that failed): pending edits named by ``ids`` are accepted or rejected."""
    status = {"accept": "accepted", "reject": "rejected"}[action]
    named = ids.select("edit_id").distinct()
    pending = edits.where("status = 'pending'").select("edit_id")
    hit = named.join(pending, "edit_id", "left_semi").withColumn("_hit", F.lit(True))
    changed = edits.join(hit, "edit_id", "left").withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).drop("_hit")
    return changed, named.join(pending, "edit_id", "left_anti")


def edit_counts(edits: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: how many of the named ``ids`` :func:`apply_edits` changes, and how many fail."""
    named = ids.select("edit_id").distinct()
    pending = edits.where("status = 'pending'").select("edit_id").distinct().withColumn("_ok", F.lit(1))
    return named.join(pending, "edit_id", "left").agg(F.count("_ok").alias("changed"), (F.count("*") - F.count("_ok")).alias("failed"))


def replay_lru(log: DataFrame, memory: int = 1000, disk: int = 5000) -> DataFrame:
    """(event_id, tenant, outcome) of a query log (event_id, ts, tenant, query): memory, disk or miss.

    A miss enters both levels, a disk hit enters memory; each level drops its oldest entry.  A memory hit does
    not renew the entry on disk.  Rows of a tenant stream through one task in order of time: it holds at most
    memory + disk hashes, however long the log.
    """
    log = log.withColumn("query_hash", scalars.query_hash(F.col("query"))).select("tenant", "ts", "event_id", "query_hash")
    kinds = {c: log.schema[c].dataType.simpleString() for c in ("event_id", "tenant")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, begun = None, False
        fast: OrderedDict[str, None] = OrderedDict()
        slow: OrderedDict[str, None] = OrderedDict()
        for frame in frames:
            out = []
            for owner, key in zip(frame["tenant"], frame["query_hash"], strict=True):
                owner = None if pd.isna(owner) else owner
                if not begun or owner != tenant:
                    tenant, begun = owner, True
                    fast.clear()
                    slow.clear()
                if key in fast:
                    fast.move_to_end(key)
                    out.append("memory")
                    continue
                out.append("disk" if key in slow else "miss")
                for level, size in ((fast, memory), (slow, disk)):
                    level[key] = None
                    level.move_to_end(key)
                    if len(level) > size:
                        level.popitem(last=False)
            yield pd.DataFrame({"event_id": frame["event_id"], "tenant": frame["tenant"], "outcome": out})

    return log.repartition("tenant").sortWithinPartitions("tenant", "ts", "event_id").mapInPandas(run, f"event_id {kinds['event_id']}, tenant {kinds['tenant']}, outcome string")


def _above(path: str) -> Column:
    """The folders above a path."""
    parts = F.split(path, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")), lambda f: (f != F.col(path)) & (f != ""))


def _alive(events: DataFrame) -> DataFrame:
    """(path, since, type) of the paths of :func:`live_paths`."""
    last = events.groupBy("path").agg(F.max_by(F.struct("ts", "event_id", "type"), F.struct("ts", "event_id")).alias("e"))
    alive = last.where("e.type NOT IN ('unlink', 'unlinkDir')").select("path", F.struct("e.ts", "e.event_id").alias("since"), "e.type")
    removed = events.where("type = 'unlinkDir'").groupBy(F.col("path").alias("folder")).agg(F.max(F.struct("ts", "event_id")).alias("removed"))
    gone = alive.select("path", "since", F.explode(_above("path")).alias("folder")).join(removed, "folder").where("removed > since").select("path").distinct()
    return alive.join(gone, "path", "left_anti")


def live_paths(events: DataFrame) -> DataFrame:
    """Paths that exist after a table of events (path, type, ts, event_id): the last event of the path is no unlink, and no folder above it was removed later."""
    return _alive(events).select("path")


def live_tree(events: DataFrame) -> DataFrame:
    """(path, is_directory) of the tree after a table of events: the paths of :func:`live_paths` whose folders above are all live folders.

    A path below an absent folder is not in the tree.  In which order the events come makes no difference.
    """
    alive = _alive(events).select("path", (F.col("type") == "addDir").alias("is_directory"))
    folders = alive.where("is_directory").select(F.col("path").alias("folder"))
    lost = alive.select("path", F.explode(_above("path")).alias("folder")).join(folders, "folder", "left_anti").select("path").distinct()
    return alive.join(lost, "path", "left_anti")
