"""Folders as tables and streams: listings of any names, contents of listed files, and change events from listings.

Spark's own file sources leave out names that begin with "_" or ".", so listings are data sources of their own.  A
listing is read in tasks, one for each folder near the root.  A stream of change events has listings as offsets: each is kept as
one Parquet file in a state folder, and the events between two of them are their difference, so that a batch that is
replayed has the same events.
"""

from __future__ import annotations

import fnmatch
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from slideloom.functions import scalars

EVENT_SCHEMA = "event_id bigint, ts timestamp, type string, path string"
#: Folders near the root that are listed by tasks of their own; the driver goes down until there are so many.
FOLDERS = 64
#: Tasks that compare two listings, each a share of the paths.
SHARES = 8


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    system, path = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root.removeprefix("file:"))
    return system, path.rstrip("/")


class _Folder(InputPartition):
    def __init__(self, path: str, recursive: bool) -> None:
        self.path, self.recursive = path, recursive


class _ListingReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[InputPartition]:
        """One part for each folder near the root, and one for the entries of every folder above these."""
        system, root = _opened(self.root)
        above, level = [], [root]
        while level and len(level) < FOLDERS:
            above += level
            level = [f.path for p in level for f in system.get_file_info(pafs.FileSelector(p)) if f.type == pafs.FileType.Directory]
        return [_Folder(p, False) for p in above] + [_Folder(p, True) for p in level]

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        system, root = _opened(self.root)
        found = system.get_file_info(pafs.FileSelector(partition.path, recursive=partition.recursive, allow_not_found=True))
        shown = self.root.rstrip("/")
        for at in range(0, len(found), 10_000):
            part = found[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([
                pa.array([shown + f.path[len(root) :] for f in part], pa.string()), pa.array([f.type == pafs.FileType.Directory for f in part], pa.bool_()),
                pa.array([f.size for f in part], pa.int64()), pa.array([f.mtime_ns // 1000 if f.mtime_ns is not None else None for f in part], pa.timestamp("us", "UTC")),
            ], ["path", "is_directory", "length", "mtime"])


class FolderListing(DataSource):
    """All entries below a folder, whatever their names."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "path string, is_directory boolean, length bigint, mtime timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"])


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, is_directory, length, mtime) of everything below ``root``; hidden names are listed too, contents are not read."""
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").load(root)


def scan_decks(spark: SparkSession, root: str, glob: str = "*.pptx") -> DataFrame:
    """(path, length, mtime) of all files below ``root`` whose names match ``glob``, also names and folders that begin with "_"."""
    name = scalars.base_name(F.col("path"))
    return scan_folder(spark, root).where(~F.col("is_directory") & name.rlike(fnmatch.translate(glob))).drop("is_directory")


def with_contents(files: DataFrame) -> DataFrame:
    """Listed files (path, ...) with ``content`` and ``error``: a file that cannot be read has the error and no content."""
    schema = files.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time
                content = error = None
                try:
                    system, path = _opened(batch.column("path")[i].as_py())
                    with system.open_input_file(path) as f:
                        content = f.read()
                except (OSError, AttributeError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], [*batch.schema.names, "content", "error"])

    return files.mapInArrow(run, f"{schema}, content binary, error string")


# -- change events ------------------------------------------------------------------------------------------------

class _Share(InputPartition):
    def __init__(self, start: int, end: int, share: int) -> None:
        self.start, self.end, self.share = start, end, share


_NOTHING = pa.table({"path": pa.array([], pa.string()), "is_dir": pa.array([], pa.bool_()), "size": pa.array([], pa.int64()), "mtime": pa.array([], pa.int64())})


class _EventReader(DataSourceStreamReader):
    def __init__(self, root: str, state: str, initial: bool) -> None:
        self.root, self.state, self.initial = root, state, initial

    def _kept(self) -> list[int]:
        system, folder = _opened(self.state)
        return sorted(int(f.base_name[:-8]) for f in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".parquet") and f.base_name[:-8].isdigit())

    def _load(self, n: int) -> pa.Table:
        if n < 0:
            return _NOTHING
        system, folder = _opened(self.state)
        return pq.read_table(f"{folder}/{n}.parquet", filesystem=system)

    def _keep(self, n: int, listing: pa.Table) -> None:
        """Written under another name first, so that a listing is there as a whole or not at all."""
        system, folder = _opened(self.state)
        system.create_dir(folder, recursive=True)
        own = f"{folder}/{uuid.uuid4().hex}.part"
        pq.write_table(listing.replace_schema_metadata({"taken": str(time.time_ns() // 1000)}), own, filesystem=system)
        system.move(own, f"{folder}/{n}.parquet")

    def _list(self) -> pa.Table:
        system, root = _opened(self.root)
        found = system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        rows = sorted((f.path[len(root) + 1 :], f.type == pafs.FileType.Directory, f.size or 0, f.mtime_ns or 0) for f in found)
        path, is_dir, size, mtime = zip(*rows, strict=True) if rows else ((), (), (), ())
        # times of folders change with their entries and mean nothing here
        mtime = [0 if d else m for d, m in zip(is_dir, mtime, strict=True)]
        return pa.table({"path": pa.array(path, pa.string()), "is_dir": pa.array(is_dir, pa.bool_()), "size": pa.array(size, pa.int64()), "mtime": pa.array(mtime, pa.int64())})

    def initialOffset(self) -> dict:
        """A new query begins with the entries of this moment, or with none if it is to see them as added."""
        if self.initial:
            return {"listing": -1}
        n = max(self._kept(), default=-1) + 1
        self._keep(n, self._list())
        return {"listing": n}

    def latestOffset(self) -> dict:
        kept = self._kept()
        now = self._list()
        if kept and self._load(kept[-1]).equals(now, check_metadata=False):
            return {"listing": kept[-1]}
        n = kept[-1] + 1 if kept else 0
        self._keep(n, now)
        return {"listing": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Share(start["listing"], end["listing"], s) for s in range(SHARES)] if start["listing"] < end["listing"] else []

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        """A share of the changes from one listing to a later one: what goes, the lower entries first, then what comes and changes, the upper ones first."""
        old, new = self._load(partition.start), self._load(partition.end)
        taken = int(new.schema.metadata[b"taken"])
        here = pc.index_in(new["path"], value_set=old["path"].combine_chunks())
        was = pc.index_in(old["path"], value_set=new["path"].combine_chunks())
        at, back = (np.asarray(pc.fill_null(x, -1)) for x in (here, was))
        o, n = ({c: t[c].to_numpy() for c in t.column_names if c != "path"} for t in (old, new))
        events = []
        gone = np.flatnonzero((back < 0) | ((back >= 0) & (o["is_dir"] != n["is_dir"][back] if len(new) else True)))
        for i in gone.tolist():
            events.append((len(old) - 1 - i, "unlinkDir" if o["is_dir"][i] else "unlink", old["path"][i].as_py()))
        same = (at >= 0) & (n["is_dir"] == o["is_dir"][at] if len(old) else False)
        changed = same & ~n["is_dir"] & ((n["size"] != o["size"][at]) | (n["mtime"] != o["mtime"][at])) if len(old) else same
        for i in np.flatnonzero(~same | changed).tolist():
            events.append((len(old) + i, "change" if same[i] else "addDir" if n["is_dir"][i] else "add", new["path"][i].as_py()))
        own = [e for e in events if e[0] % SHARES == partition.share]
        when = datetime.fromtimestamp(taken / 1e6, timezone.utc)
        yield pa.RecordBatch.from_arrays([
            pa.array([(partition.end << 32) + k for k, _, _ in own], pa.int64()), pa.array([when] * len(own), pa.timestamp("us", "UTC")),
            pa.array([t for _, t, _ in own], pa.string()), pa.array([p for _, _, p in own], pa.string()),
        ], ["event_id", "ts", "type", "path"])

    def commit(self, end: dict) -> None:
        """Listings before the last one that is done with are not needed again."""
        system, folder = _opened(self.state)
        for n in self._kept():
            if n < end["listing"]:
                system.delete_file(f"{folder}/{n}.parquet")


class FolderEvents(DataSource):
    """Changes below a folder, seen from listing to listing."""

    @classmethod
    def name(cls) -> str:
        return "folder_events"

    def schema(self) -> str:
        return EVENT_SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _EventReader(self.options["path"], self.options["state"], self.options.get("initial", "false") == "true")


def watch_folder(spark: SparkSession, root: str, state: str, initial: bool = False) -> DataFrame:
    """A stream of change events (event_id, ts, type, path) below ``root``: add, change, unlink, addDir, unlinkDir.

    Paths are relative, with '/'; ignored ones are left out, names that begin with "_" are not.  Entries that are there when the
    query begins are no events unless ``initial``.  ``state`` is a folder for the listings of this query alone, which the driver and all executors share.  Changes
    between two listings are seen as one; ts is the time of the listing.
    """
    spark.dataSource.register(FolderEvents)
    events = spark.readStream.format("folder_events").option("state", state).option("initial", str(initial).lower()).load(root)
    return scalars.drop_ignored(events)
