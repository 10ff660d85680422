"""Jobs on file mappings, caches, chunks, versions, chat logs and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slideloom.functions import scalars
from slideloom.sources.shared import written


# -- catalogues and mappings ---------------------------------------------------------------------------------

def scan_images(files: DataFrame, max_files: int | None = None) -> DataFrame:
    found = files.where(scalars.extension(F.col("path")).isin(*scalars.IMAGE_EXTENSIONS) & (F.col("length") > 0))
    return found.orderBy("path").limit(max_files) if max_files else found


def list_entries(files: DataFrame) -> DataFrame:
    """Every file and every directory on the way to it: path, is_directory."""
    parts = F.split("path", "/")
    dirs = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir"), "path").where("dir <> path")
    return files.select("path", F.lit(False).alias("is_directory")).union(dirs.select("dir", F.lit(True))).distinct()


def link_parents(entries: DataFrame) -> DataFrame:
    """Entries with their parent; those whose parent is absent are dropped, top-level ones have the parent ''."""
    child = entries.withColumn("parent", scalars.parent(F.col("path")))
    held = entries.where("is_directory").select(F.col("path").alias("parent"))
    return child.where("parent = ''").unionByName(child.where("parent <> ''").join(held, "parent", "left_semi"))


def drop_deleted(mapping: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    return mapping.join(listing.select("path"), "path", "left_semi"), mapping.join(listing.select("path"), "path", "left_anti")


def delete_by_file(store: DataFrame, paths: DataFrame) -> DataFrame:
    return store.join(paths.select("file_path").distinct(), "file_path", "left_anti")


def paths_below(store: DataFrame, folders: DataFrame) -> DataFrame:
    """The file_path values that are one of (folder) or below it: each path meets the folders by its ancestors, an equi-join however many folders there are."""
    parts = F.split("file_path", "/")
    ancestors = store.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder"))
    return ancestors.join(folders.select("folder").distinct(), "folder", "left_semi").select("file_path").distinct()


def delete_by_folder(store: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows outside all of (folder)."""
    return store.join(paths_below(store, folders), "file_path", "left_anti")


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, type): add, change (size or time differ) or unlink between two listings (path, length, mtime)."""
    a = old.select("path", F.col("length").alias("l0"), F.col("mtime").alias("m0"), F.lit(1).alias("in_old"))
    b = new.select("path", F.col("length").alias("l1"), F.col("mtime").alias("m1"), F.lit(1).alias("in_new"))
    kind = F.when(F.col("in_old").isNull(), "add").when(F.col("in_new").isNull(), "unlink").when(~F.col("l0").eqNullSafe(F.col("l1")) | ~F.col("m0").eqNullSafe(F.col("m1")), "change")
    return a.join(b, "path", "full_outer").select("path", kind.alias("type")).where("type IS NOT NULL")


def keep_newest(mapping: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) of a mapping (path, mtime, file_exists, input_order): the newest existing path of every value of ``by``
    that has several paths; values with one path stay as they are."""
    several = mapping.groupBy(by).agg(
        F.count("*").alias("_n"),
        F.max_by("path", F.when(F.col("file_exists"), F.struct("mtime", -F.col("input_order")))).alias("_best"),
    )
    judged = mapping.join(several, by).withColumn("_keep", (F.col("_n") == 1) | (F.col("file_exists") & F.col("path").eqNullSafe(F.col("_best"))))
    return judged.where("_keep").drop("_n", "_best", "_keep"), judged.where("NOT _keep").drop("_n", "_best", "_keep")


def register_folders(known: DataFrame, new: DataFrame) -> DataFrame:
    return known.select("path").union(new.select("path")).distinct()


def refused_folders(known: DataFrame, new: DataFrame) -> DataFrame:
    """(path, refused): how many of the ``new`` paths are exact duplicates, of a known path or of each other."""
    old = known.select("path").distinct().withColumn("_old", F.lit(1))
    counted = new.groupBy("path").agg(F.count("*").alias("_n")).join(old, "path", "left")
    return counted.select("path", (F.col("_n") - F.when(F.col("_old").isNull(), 1).otherwise(0)).alias("refused")).where("refused > 0")


def corpus_catalog(decks: DataFrame, images: DataFrame) -> DataFrame:
    return decks.withColumn("kind", F.lit("deck")).unionByName(images.withColumn("kind", F.lit("image")))


def directory_breakdown(files: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` directories by name with their file counts and the number of directories left out."""
    counts = files.groupBy(scalars.parent(F.col("path")).alias("dir")).agg(F.count("*").alias("files"))
    total = counts.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("left_out"))
    return counts.orderBy("dir").limit(n).join(F.broadcast(total))  # total is one row


# -- stores and statistics -----------------------------------------------------------------------------------

def last_of(rows: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """The row of each key with the greatest ``order``, whole; maxima are taken in every task before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns])


def upsert(store: DataFrame, new: DataFrame, dim: int, keys: tuple[str, ...] = ("file_path", "slide_number"), order: str = "vec_id", mode: str = "replace") -> DataFrame:
    """The store with ``new`` rows of the right dimension; the last row of a key (by ``order``) wins; mode append keeps all."""
    good, _ = scalars.validate_vectors(new, dim)
    if mode == "append":
        return store.unionByName(good)
    last = last_of(good, keys, order)
    return store.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def index_stats(slides: DataFrame, vector: str = "embedding") -> DataFrame:
    return slides.agg(F.count(vector).alias("vectors"), F.max(F.size(vector)).alias("dim"), F.lit("cosine").alias("metric"))


def storage_stats(files: DataFrame, n_vectors: int) -> DataFrame:
    size = F.coalesce(F.sum("length"), F.lit(0))
    per = F.round(size / n_vectors, 2) if n_vectors else F.lit(0.0)
    return files.agg(size.alias("bytes"), F.round(size / 1048576, 2).alias("mb"), F.count("*").alias("files"), per.alias("bytes_per_vector"))


def folder_stats(slides: DataFrame) -> DataFrame:
    """Slides by folder, file and version with the sub-totals of all combinations of these; level has a bit for each that is left out."""
    named = slides.select(scalars.parent(F.col("file_path")).alias("folder"), "file_name", F.coalesce(scalars.name_version(F.col("file_name")), F.lit("1")).alias("version"))
    return named.cube("folder", "file_name", "version").agg(F.count("*").alias("slides"), F.grouping_id().alias("level"))


def cache_stats(log: DataFrame) -> DataFrame:
    """hits, misses, total and hit_rate (%, one decimal) of a log with a boolean ``hit``."""
    hits = F.coalesce(F.sum(F.when(F.col("hit"), 1).otherwise(0)), F.lit(0))
    total = F.count("*")
    return log.agg(hits.alias("hits"), (total - hits).alias("misses"), total.alias("total"), F.when(total > 0, F.round(hits * 100.0 / total, 1)).otherwise(F.lit(0.0)).alias("hit_rate"))


def cache_report(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Counters of a log of accesses (outcome: memory, disk or miss) and of the entries on disk (bytes); every miss is saved."""
    count = lambda x: F.count(F.when(F.col("outcome") == x, 1))
    counted = log.agg(count("memory").alias("memory_hits"), count("disk").alias("disk_hits"), count("miss").alias("misses"), F.count("*").alias("total_queries"))
    rate = F.when(F.col("total_queries") > 0, F.round((F.col("memory_hits") + F.col("disk_hits")) * 100.0 / F.col("total_queries"), 1)).otherwise(0.0)
    size = entries.agg(F.count("*").alias("disk_entries"), F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / 1048576, 2).alias("disk_size_mb"))
    return counted.withColumns({"cache_saves": F.col("misses"), "hit_rate_percent": rate}).join(F.broadcast(size))  # one row each


def lookup_cached(queries: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    return queries.join(cache, "query_hash"), queries.join(cache, "query_hash", "left_anti")


def first_accesses(log: DataFrame) -> DataFrame:
    """Cache hits with an unbounded cache: an access misses if its tenant has not sent the query before."""
    w = Window.partitionBy("tenant", "query_hash").orderBy("ts", "event_id")
    return log.withColumn("query_hash", scalars.query_hash(F.col("query"))).withColumn("hit", F.row_number().over(w) > 1)


def evict_lru(cache: DataFrame, max_entries: int = 1000, key: str = "query_hash", by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted): the ``max_entries`` latest entries by last_access, of each value of ``by`` or of all."""
    if by is None:
        kept = cache.orderBy(F.desc("last_access"), key).limit(max_entries)
        return kept, cache.join(kept.select(key), key, "left_anti")
    w = Window.partitionBy(by).orderBy(F.desc("last_access"), key)
    ranked = cache.withColumn("_n", F.row_number().over(w))
    return ranked.where(F.col("_n") <= max_entries).drop("_n"), ranked.where(F.col("_n") > max_entries).drop("_n")


# -- chunks ---------------------------------------------------------------------------------------------------

def chunk_rows(cells: DataFrame, rows_per_chunk: int = 10, max_cols: int = 50, include_empty: bool = False) -> DataFrame:
    """(workbook, sheet, chunk, first_row, last_row, cells) of row ranges; columns beyond ``max_cols`` are cut.

    ``include_empty`` keeps the ranges without cells up to the sheet's last row; their rows are those of the whole range.
    """
    chunk = F.floor((F.col("row_no") - 1) / rows_per_chunk)
    inside = F.when(F.col("col_no") <= max_cols, F.col("row_no"))
    found = cells.groupBy("workbook", "sheet", chunk.alias("chunk")).agg(F.min(inside).alias("first_row"), F.max(inside).alias("last_row"), F.count(inside).alias("cells"))
    if not include_empty:
        return found.where("cells > 0")
    kind = cells.schema["row_no"].dataType
    ranges = found.groupBy("workbook", "sheet").agg(F.max("chunk").alias("_last")).select("workbook", "sheet", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("chunk"))
    first = F.coalesce("first_row", (F.col("r.chunk") * rows_per_chunk + 1).cast(kind))
    last = F.coalesce("last_row", ((F.col("r.chunk") + 1) * rows_per_chunk).cast(kind))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("workbook", "sheet", "chunk")]
    filled = ranges.alias("r").join(found.alias("f"), same, "left")
    return filled.select("r.workbook", "r.sheet", "r.chunk", first.alias("first_row"), last.alias("last_row"), F.coalesce("cells", F.lit(0)).cast("long").alias("cells"))


def sheet_totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("workbook").agg(F.countDistinct("sheet").alias("sheets"), F.count("*").alias("cells"))


def chunk_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.sum(F.length(text)).alias("characters"), F.bround(F.avg(F.length(text)), 0).cast("long").alias("average"))


def compress_chunks(
    cells: DataFrame, by: tuple[str, ...], order: tuple[str, ...], value: str, max_cells: int = 1000, max_length: int = 200, markdown: tuple[str, ...] = ()
) -> DataFrame:
    """The first ``max_cells`` cells of each chunk, each cut to ``max_length`` characters, as one text.

    With ``markdown``, the columns that place a cell, there is also a markdown table of one line a cell: these columns and
    the value, with bars escaped and line breaks as spaces.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    first = cells.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_cells)
    short = F.substring(F.col(value).cast("string"), 1, max_length)
    line = F.concat_ws(" | ", *[_markdown_cell(F.col(c).cast("string")) for c in markdown], _markdown_cell(short))
    parts = F.array_sort(F.collect_list(F.struct("_n", short.alias("t"), line.alias("line"))))
    packed = first.groupBy(*by).agg(parts.alias("_parts"), F.count("*").alias("cells"))
    text = F.array_join(F.transform("_parts", lambda x: x["t"]), " | ").alias("text")
    if not markdown:
        return packed.select(*by, text, "cells")
    names = [*markdown, value]
    head = f"| {' | '.join(names)} |\n| {' | '.join('-' for _ in names)} |\n"
    table = F.concat(F.lit(head), F.array_join(F.transform("_parts", lambda x: F.concat(F.lit("| "), x["line"], F.lit(" |"))), "\n"))
    return packed.select(*by, text, table.alias("markdown"), "cells")


def _markdown_cell(text: Column) -> Column:
    return F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*[\r\n]+\s*", " "), F.lit("|"), F.lit("\\|"))


def row_numbers(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with ``name``, the row's number from 0 in the order of ``order``; rows are sorted over all tasks, no task sees all of them.

    Rows go by ranges of ``order`` into sorted partitions, which are written; the driver adds up the sizes of these, one number each.
    """
    spot = 1 << 33  # rows of a partition, as monotonically_increasing_id counts them
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = written(df.repartitionByRange(ranges, order).sortWithinPartitions(order).withColumn("_spot", F.monotonically_increasing_id()), "numbered")
    part = F.floor(F.col("_spot") / spot).cast("int")
    before, starts = 0, []
    for r in ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect():  # as many rows as partitions
        starts.append((r["_part"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.pmod("_spot", F.lit(spot))).drop("_part", "_start", "_spot")


def assign_batches(df: DataFrame, order: str, size: int = 75, by: str | None = None) -> DataFrame:
    """``batch`` numbers in order; a size below 1 means 75, one above 1000 means 1000.  ``by`` numbers each group on its own."""
    size = 75 if size < 1 else min(size, 1000)
    if by is None:
        return row_numbers(df, order, "_n").withColumn("batch", F.floor(F.col("_n") / size)).drop("_n")
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size))


def batch_calls(df: DataFrame, size: int = 75, by: str | None = None) -> DataFrame:
    """Rows and calls (batches of :func:`assign_batches`) of each value of ``by`` or of all."""
    size = 75 if size < 1 else min(size, 1000)
    return df.groupBy(*([by] if by else [])).agg(F.count("*").alias("rows"), F.ceil(F.count("*") / size).alias("calls"))


# -- chat logs --------------------------------------------------------------------------------------------------

def coalesce_turns(messages: DataFrame) -> DataFrame:
    """Consecutive assistant messages of a conversation as one: conv_id, turn (first), role, text; empty ones are skipped."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    begins = (F.col("role") != "assistant") | (F.coalesce(F.lag("role").over(w), F.lit("")) != "assistant")
    runs = messages.where("role <> 'assistant' OR coalesce(text, '') <> ''").withColumn("_new", begins.cast("int")).withColumn("_run", F.sum("_new").over(w))
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return runs.groupBy("conv_id", "_run").agg(F.min("turn").alias("turn"), F.first("role").alias("role"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text")).drop("_run")


def close_custom_events(messages: DataFrame) -> DataFrame:
    """Messages with done: a custom event that an assistant message or another custom event follows directly.  Empty assistant messages do not count."""
    after = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    counts = (F.col("role") != "assistant") | (F.coalesce("text", F.lit("")) != "")
    following = F.last(F.when(counts, F.col("role")), ignorenulls=True).over(after)
    return messages.withColumn("done", (F.col("role") == "custom_event") & F.coalesce(following.isin("assistant", "custom_event"), F.lit(False)))


# -- event tables (batch twins of the streams) ---------------------------------------------------------------------

def debounce_batch(events: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """The last event of every path before a quiet time longer than ``gap``."""
    w = Window.partitionBy("path").orderBy("ts", "event_id")
    later = F.lead("ts").over(w)
    return events.withColumn("_next", later).where(F.col("_next").isNull() | (F.col("_next") > F.col("ts") + F.expr(f"INTERVAL {gap}"))).drop("_next")


def event_windows(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Counts of each event type in tumbling or sliding windows; on a stream, give ``events`` a watermark first."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(window.alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def queue_batch(events: DataFrame) -> DataFrame:
    """The waiting work after a table of events: the latest add or change of every supported path, if neither an unlink of
    the path nor an unlinkDir of a folder above it followed."""
    last = events.where(scalars.is_supported_document(F.col("path")) & F.col("type").isin("add", "change", "unlink")).groupBy("path")
    waiting = last.agg(F.max_by(F.struct("event_id", "ts", "type"), F.struct("ts", "event_id")).alias("e")).select("path", "e.*").where("type <> 'unlink'")
    removed = events.where("type = 'unlinkDir'").groupBy(F.col("path").alias("folder")).agg(F.max(F.struct("ts", "event_id")).alias("removed"))
    parts = F.split("path", "/")
    above = waiting.select("path", F.struct("ts", "event_id").alias("since"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder"))
    gone = above.where("folder <> path").join(removed, "folder").where("removed > since").select("path").distinct()
    return waiting.join(gone, "path", "left_anti")
