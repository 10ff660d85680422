"""Change streams: reading, debouncing, settling, queueing, windowed counts and indexing."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from slideloom.functions import scalars
from slideloom.operators import chunks, embed, tables
from slideloom.sources import files, slide_store, watch
from slideloom.sources.shared import written

#: Keys over which the work that waits below one folder is spread.
SALTS = 16
SCHEMA = "event_id bigint, ts timestamp, type string, path string"


def read_file_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of change events from Parquet files in ``folder``, with '/' paths and without ignored ones."""
    events = spark.readStream.schema(SCHEMA).parquet(folder)
    return scalars.drop_ignored(events.withColumn("path", scalars.slashes(F.col("path"))))


def debounce_events(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """The last event of each path once it has been quiet for ``gap``; state is dropped when the watermark passes."""
    sessions = events.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap))
    return sessions.agg(F.max_by(F.struct("ts", "type", "event_id"), F.struct("ts", "event_id")).alias("last")).select("path", "last.*")


def window_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    return tables.event_windows(events.withWatermark("ts", late), size, slide)


def _folders_above(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")), lambda f: f != path)


def _released(events: DataFrame, delay: str) -> DataFrame:
    """:func:`process_queue` of a table, by sorts: its time does not grow with how many events share a key and a time, as a join's does.

    Work is released if the next event that takes it back comes after ``delay``.  That event is looked up by path and, for folders
    above, by folder and stretch of time: a removal stands in its own stretch of length ``delay`` and in the one before, under each
    of SALTS keys, so that no folder is one task's.  Events of one time are in order of event_id.
    """
    path, row = F.col("path"), ["path", "ts", "type", "event_id"]
    supported, unlinks = scalars.is_supported_document(path), F.col("type") == "unlink"
    is_work = supported & F.col("type").isin("add", "change")
    none = F.lit(None)
    own = events.where(is_work | unlinks).select(*row, path.alias("_key"), none.cast(events.schema["ts"].dataType).alias("_stretch"), none.cast("long").alias("_salt"), is_work.alias("_work"), F.lit(True).alias("_back"))
    placed = events.where(is_work | (F.col("type") == "unlinkDir")).withColumns({"_stretch": F.window("ts", delay)["start"], "_work": is_work})
    keys, stretches, salts = F.explode(_folders_above(path)), F.explode(F.array(F.col("_stretch"), F.col("_stretch") - F.expr(f"INTERVAL {delay}"))), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    waiting = placed.where("_work").select(*row, keys.alias("_key"), "_stretch", F.pmod(F.xxhash64("path"), F.lit(SALTS)).alias("_salt"), F.lit(True).alias("_work"), F.lit(False).alias("_back"))
    removed = placed.where("NOT _work").select(*row, path.alias("_key"), stretches.alias("_stretch")).select(*row, "_key", "_stretch", salts.alias("_salt"), F.lit(False).alias("_work"), F.lit(True).alias("_back"))
    by_key = Window.partitionBy("_key", "_stretch", "_salt")
    ranked = own.union(waiting).union(removed).withColumn("_nth", F.dense_rank().over(by_key.orderBy(F.desc("ts"), F.desc("event_id"))))
    following = F.min(F.when(F.col("_back"), F.col("ts"))).over(by_key.orderBy("_nth").rangeBetween(Window.unboundedPreceding, -1))
    taken = F.coalesce(following < F.col("ts") + F.expr(f"INTERVAL {delay}"), F.lit(False))
    return ranked.withColumn("_taken", taken).where("_work").groupBy(*row).agg(F.max("_taken").alias("_taken")).where("NOT _taken").drop("_taken")


def process_queue(events: DataFrame, delay: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """(path, ts, type, event_id) of the work that is released: adds and changes of supported paths that nothing takes back within ``delay``.

    A later add, change or unlink of the path takes it back, and so does an unlinkDir of a folder above.  All of these are
    one join by key and time: work waits under its path and under each folder above, what takes it back comes under its
    own path.  State is the work and the events of the last ``delay`` and ``late``, spread by path; waiting under a
    common folder is spread over SALTS keys, and the few folder removals are sent to each.  A batch table gives the same rows at
    once, by :func:`_released`.
    """
    if not events.isStreaming:
        return _released(events, delay)
    events = events.withWatermark("ts", late)
    path, salt = F.col("path"), F.pmod(F.xxhash64("path"), F.lit(SALTS))
    own_key = F.struct(F.lit(False).alias("folder"), path.alias("name"), F.lit(0).cast("long").alias("salt"))
    keys = F.concat(F.array(own_key), F.transform(_folders_above(path), lambda f: F.struct(F.lit(True).alias("folder"), f.alias("name"), salt.alias("salt"))))
    work = events.where(scalars.is_supported_document(path) & F.col("type").isin("add", "change"))
    work = work.select("path", "ts", "type", "event_id", F.explode(keys).alias("key")).alias("w")
    everywhere = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.struct(F.lit(True).alias("folder"), path.alias("name"), i.cast("long").alias("salt")))
    takes_back = F.when(F.col("type") == "unlinkDir", everywhere).when((F.col("type") == "unlink") | scalars.is_supported_document(path), F.array(own_key))
    back = events.where(F.col("type").isin("add", "change", "unlink", "unlinkDir"))
    back = back.select(F.col("ts").alias("back_ts"), F.col("event_id").alias("back_id"), F.explode(takes_back).alias("back_key")).alias("b")
    same = (F.col("key.folder") == F.col("back_key.folder")) & (F.col("key.name") == F.col("back_key.name")) & (F.col("key.salt") == F.col("back_key.salt"))
    soon = (F.col("back_ts") >= F.col("ts")) & (F.col("back_ts") < F.col("ts") + F.expr(f"INTERVAL {delay}")) & ((F.col("back_ts") > F.col("ts")) | (F.col("back_id") > F.col("event_id")))
    judged = work.join(back, same & soon, "left").groupBy("path", "ts", "type", "event_id").agg(F.count("back_id").alias("taken"))
    return judged.where("taken = 0").drop("taken")


def cache_stats_stream(log: DataFrame) -> DataFrame:
    """Hits, misses, total and hit rate so far of a log with ``hit``; for the update or complete mode."""
    return tables.cache_stats(log)


def settle_writes(polls: DataFrame, stable: str = "100 milliseconds", late: str = "10 minutes", keep: str = "1 hour") -> DataFrame:
    """(path, size, ts): a file once its size (path, size, ts) has stayed the same for ``stable``; again only after it has changed.

    Polls of a path are taken in order of event time; a file that gets no further poll settles when the watermark
    has passed.  The state of a path is its last size and since when; it is dropped ``keep`` after the file has settled.
    """
    gap, hold = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (stable, keep))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, since, told = state.get if state.exists else (None, None, False)
        watermark = state.getCurrentWatermarkMs()
        out = []
        if state.hasTimedOut:
            if told:
                state.remove()
                return
            out.append((key[0], size, since + gap))
            told = True
        for ts, now in sorted((row.ms, row.bytes) for frame in frames for row in frame.itertuples()):
            if now != size:
                size, since, told = int(now), int(ts), False
            elif not told and ts - since >= gap:
                told = True
                out.append((key[0], size, int(ts)))
        state.update((size, since, told))
        state.setTimeoutTimestamp(max(watermark + 1, since + (hold if told else gap)))
        yield pd.DataFrame(out, columns=["path", "size", "ms"])

    rows = polls.withWatermark("ts", late).select("path", F.col("size").cast("long").alias("bytes"), "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    out = rows.groupBy("path").applyInPandasWithState(run, "path string, size long, ms long", "size long, since long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("path", "size", F.timestamp_millis("ms").alias("ts"))


def _tree_events(state: DataFrame) -> DataFrame:
    """The state of a tree as events: the last one of each path, and the last removal of each folder."""
    removed = state.where("removed IS NOT NULL").select("file_path", F.lit("unlinkDir").alias("type"), "removed.ts", "removed.event_id")
    return state.select("file_path", "type", "ts", "event_id").union(removed).withColumnRenamed("file_path", "path")


def read_live_tree(spark: SparkSession, store: str) -> DataFrame:
    """(path, is_directory) of the tree that :func:`live_tree_stream` keeps in ``store``."""
    return chunks.live_tree(_tree_events(slide_store.read_slides(spark, store)))


def settle_batch(polls: DataFrame, stable: str = "100 milliseconds") -> DataFrame:
    """(path, size, ts) of a table of polls (path, size, ts), as :func:`settle_writes` has it of one batch: each time a file keeps its size for
    ``stable``, at the first poll that shows it; a file's last size needs no further poll.  Polls of a path at one time are ordered by size."""
    w = Window.partitionBy("path").orderBy("ts", "size")
    gap = F.expr(f"INTERVAL {stable}")
    changed = F.coalesce((F.lag("size").over(w) != F.col("size")).cast("int"), F.lit(1))
    runs = polls.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(w)).withColumn("_last", F.max("_run").over(Window.partitionBy("path")))
    since = F.min("ts").over(Window.partitionBy("path", "_run"))
    ended = runs.withColumn("_since", since).groupBy("path", "size", "_run", "_last", "_since").agg(F.min(F.when(F.col("ts") >= F.col("_since") + gap, F.col("ts"))).alias("_shown"))
    at = F.coalesce("_shown", F.when(F.col("_run") == F.col("_last"), F.col("_since") + gap))
    return ended.select("path", "size", at.alias("ts")).where("ts IS NOT NULL")


def live_tree_stream(events: DataFrame, store: str, checkpoint: str, late: str = "10 minutes", tidy_every: int = 10) -> StreamingQuery:
    """Keeps a tree of folders and files in ``store`` from a stream of events: :func:`read_live_tree` is the tree so far.

    The store has one row for each path: its last event and its last removal as a folder.  Both are maxima, so the order in which events
    come makes no difference.  A batch reads and writes the rows of its own paths and, if it removes folders, deletes the rows below
    them.  Every ``tidy_every`` batches what is older than ``late`` goes: marks of removals, and paths whose folders have not
    come; so the store is bounded by the live paths, and a late event is taken rightly within ``late``.
    """
    spark = events.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        stamp = F.struct("ts", "event_id")
        new = batch.groupBy(F.col("path").alias("file_path")).agg(F.max_by(F.struct("type", "ts", "event_id"), stamp).alias("e"), F.max(F.when(F.col("type") == "unlinkDir", stamp)).alias("removed"))
        new = written(new.select("file_path", "e.*", "removed"), "tree-events")
        if new.isEmpty():
            return
        known = slide_store.read_manifest(spark, store) is not None
        merged = new
        if known:
            old = slide_store.read_slides(spark, store).join(new.select("file_path"), "file_path", "left_semi")
            both = new.unionByName(old).groupBy("file_path").agg(F.max_by(F.struct("type", "ts", "event_id"), stamp).alias("e"), F.max("removed").alias("removed"))
            merged = both.select("file_path", "e.*", "removed")
        slide_store.write_slides(merged, store, 2 * number, checkpoint, keys=("file_path",))
        removed = new.where("removed IS NOT NULL").select(F.col("file_path").alias("folder"), F.col("removed").alias("last_removed"))
        gone = []
        if not removed.isEmpty():
            rows = slide_store.read_slides(spark, store).select("file_path", "type", stamp.alias("since"))
            below = rows.select("file_path", "since", F.explode(chunks._above("file_path")).alias("folder")).join(removed, "folder").where("last_removed > since")
            gone.append(below.select("file_path"))
        tidy = number % tidy_every == tidy_every - 1
        if tidy:
            rows = slide_store.read_slides(spark, store)
            horizon = rows.agg((F.max("ts") - F.expr(f"INTERVAL {late}")).alias("h")).first()["h"]  # one time
            shown = chunks.live_tree(_tree_events(rows)).select(F.col("path").alias("file_path"))
            gone.append(rows.where((F.col("ts") < F.lit(horizon)) & (F.col("removed").isNull() | (F.col("removed.ts") < F.lit(horizon)))).select("file_path").join(shown, "file_path", "left_anti"))
        if gone:
            slide_store.delete_slides(spark, store, gone[0] if len(gone) == 1 else gone[0].union(gone[1]), writer=checkpoint, batch=2 * number + 1)
        if tidy:
            slide_store.compact_slides(spark, store)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_batch(
    spark: SparkSession, number: int, slides: DataFrame, store: str, writer: str, embedder: embed.Embedder = embed.hashed_ngrams, text: str = "slide_text", files_gone: DataFrame | None = None,
    folders_gone: DataFrame | None = None, calls_per_minute: float | None = None, tasks: int = 8, batch_size: int = 75, attempts: int = 5, waits: tuple[float, ...] = (0.0, 60.0, 600.0),
) -> None:
    """One batch of changes to ``store``: files (file_path) and folders (folder) that are gone are deleted, then ``slides``, one row a key, are embedded and added.

    Rows that cannot be embedded go to ``store``-failures with the number of attempts and the time from which a later batch
    tries them again, ``waits`` seconds on; after ``attempts`` tries due is null and they stay there.  A row that
    is written anew, deleted or indexed leaves the failures.  All tasks together make at most ``calls_per_minute`` calls of
    the embedder.  Each write is a batch of ``writer`` in its store, so that a replay goes on where it broke off.
    """
    keys, failures = ["file_path", "slide_number"], f"{store.rstrip('/')}-failures"
    schema = slides.schema
    known = slide_store.read_manifest(spark, failures) is not None
    has_store = slide_store.read_manifest(spark, store) is not None
    for at in (store,) * has_store + (failures,) * known:
        if files_gone is not None or folders_gone is not None:
            slide_store.delete_slides(spark, at, files_gone, folders_gone, f"{writer}:deletes", number)
    todo = slides.withColumn("attempts", F.lit(0))
    if known:
        old = slide_store.read_slides(spark, failures).where("due <= current_timestamp()").join(slides.select(*keys), keys, "left_anti")
        todo = todo.unionByName(old.select(*schema.names, "attempts"))
    todo, paced = embed.paced(written(todo, "to-embed"), embedder, calls_per_minute, tasks)
    good, failed = embed.embed_slides(todo, paced, batch_size, (), text)
    slide_store.write_slides(good.drop("attempts"), store, number, f"{writer}:slides")
    wait = F.element_at(F.array(*[F.lit(float(w)) for w in waits]), F.least(F.col("attempts"), F.lit(len(waits))))
    tried = failed.withColumn("attempts", F.col("attempts") + 1)
    due = F.when(F.col("attempts") < attempts, F.timestamp_seconds(F.unix_micros(F.current_timestamp()) / 1e6 + wait))
    slide_store.write_slides(tried.withColumns({"due": due, "error": F.lit("no vector")}), failures, number, f"{writer}:slides")
    if known:
        slide_store.delete_keys(good.select(*keys), failures, f"{writer}:done", number)


def index_files(spark: SparkSession, folder: str, store: str, checkpoint: str, embedder: embed.Embedder = embed.hashed_ngrams, glob: str = "*.pptx") -> StreamingQuery:
    """Indexes the decks below ``folder``, new ones as they come: slides are taken out, embedded and added to ``store``.

    Decks that cannot be read go to ``store``-unread, slides without a vector to ``store``-failures (:func:`index_batch`), and the stream
    goes on.  For folders whose files change and go, :func:`index_folder`.
    """
    decks = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    decks = decks.option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)

    def add(batch: DataFrame, number: int) -> None:
        slides, failures = files.explode_deck_slides(batch)
        index_batch(spark, number, slides, store, checkpoint, embedder, "text")
        slide_store.write_slides(failures, f"{store.rstrip('/')}-unread", number, checkpoint)

    return decks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_folder(
    spark: SparkSession, root: str, state: str, store: str, checkpoint: str, embedder: embed.Embedder = embed.hashed_ngrams, glob: str = "*.pptx", initial: bool = True, **options,
) -> StreamingQuery:
    """Keeps ``store`` in step with the decks below ``root``: new and changed decks are indexed, and slides of files and folders that go are deleted.

    Events come from :func:`slideloom.sources.watch.watch_folder` with its folder ``state``; paths are relative to ``root``.  A changed deck's old slides go
    first.  Decks that cannot be read go to ``store``-unread; ``options`` are those of :func:`index_batch`.
    """
    name = scalars.base_name(F.col("path"))

    def add(batch: DataFrame, number: int) -> None:
        last = written(tables.last_of(batch, ("path",), "ts", "event_id"), "changes")
        gone = last.where("type IN ('unlink', 'change')").select(F.col("path").alias("file_path"))
        folders = last.where("type = 'unlinkDir'").select(F.col("path").alias("folder"))
        decks = last.where(F.col("type").isin("add", "change") & name.rlike(fnmatch.translate(glob)))
        read = watch.with_contents(decks.select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path")))
        read = written(read.withColumn("path", F.substring("path", len(root.rstrip("/")) + 2, 1 << 30)), "contents")
        slides, failures = files.explode_deck_slides(read.where("error IS NULL"))
        index_batch(spark, number, slides, store, checkpoint, embedder, "text", gone, folders, **options)
        lost = read.where("error IS NOT NULL").select(F.col("path").alias("file_path"), F.lit(None).cast("int").alias("slide_number"), "error")
        slide_store.write_slides(failures.union(lost), f"{store.rstrip('/')}-unread", number, checkpoint)

    events = watch.watch_folder(spark, root, state, initial)
    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(slides: DataFrame, store: str, checkpoint: str, embedder: embed.Embedder = embed.hashed_ngrams, text: str = "slide_text", order: str | None = None, **options) -> StreamingQuery:
    """Embeds a stream of slides (file_path, slide_number, ``text``) and adds each micro-batch to ``store``, the last row of a key by ``order`` (by text if there is none).

    With a column ``change``, rows with "delete" delete their file and rows with "delete_folder" the folder file_path; those of a batch come before its
    slides.  ``options`` are those of :func:`index_batch`; :func:`slideloom.sources.slide_store.read_slides` is the index.
    """
    spark = slides.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        gone = folders = None
        if "change" in batch.columns:
            gone = batch.where("change = 'delete'").select("file_path").distinct()
            folders = batch.where("change = 'delete_folder'").select(F.col("file_path").alias("folder")).distinct()
            batch = batch.where("change IS NULL OR change NOT IN ('delete', 'delete_folder')").drop("change")
        once = tables.last_of(batch, ("file_path", "slide_number"), order or text)
        index_batch(spark, number, once, store, checkpoint, embedder, text, gone, folders, **options)

    return slides.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
