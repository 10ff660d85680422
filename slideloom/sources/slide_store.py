"""The slide store: Parquet rows in hash buckets of file_path, and a manifest that names the live folders.

A commit writes its rows into a new folder, one part for each bucket, and then one small manifest file with all live
parts.  A reader takes the latest manifest, so that a commit is seen as a whole or not at all, whatever a killed job leaves
behind.  Deletes are rows too, in the buckets of the files that go.  Compaction rewrites only buckets with several
parts; the parts it replaces stay until :func:`vacuum_store`, for readers that still use them.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slideloom.functions import scalars
from slideloom.operators import tables
from slideloom.sources.shared import written

KEYS = ("file_path", "slide_number")
#: Hash buckets of a new store; a large corpus wants more, so that a bucket is a few gigabytes.
BUCKETS = 16
_DELETED, _SEQ, _BUCKET = "_deleted", "_seq", "_bucket"


def _manifests(store: str) -> str:
    return f"{store.rstrip('/')}/manifest"


def read_manifest(spark: SparkSession, store: str) -> dict | None:
    """The latest state of a store: version, schema, keys, buckets, live parts as [bucket, folder], and the last batch of each writer."""
    try:
        rows = spark.read.option("wholetext", True).text(_manifests(store))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if "version" not in rows.columns:  # a killed first commit
        return None
    latest = rows.agg(F.max_by("value", "version")).first()[0]  # one small text
    return None if latest is None else json.loads(latest)


def _publish(spark: SparkSession, store: str, manifest: dict) -> None:
    """Makes ``manifest`` the state of the store: one file, which appears under its name when it is whole."""
    text = spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1)
    text.write.mode("overwrite").text(f"{_manifests(store)}/version={manifest['version']}")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("file_path"), F.lit(buckets)).cast("int")


def _write_parts(rows: DataFrame, store: str, manifest: dict) -> list[list]:
    """Writes ``rows`` (with _deleted and _seq) as a new folder; its parts as [bucket, folder]."""
    folder = f"data/{manifest['version']}-{uuid.uuid4().hex}"
    path = f"{store.rstrip('/')}/{folder}"
    # large buckets take several tasks
    rows.withColumn(_BUCKET, _bucket(manifest["buckets"])).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(path)
    try:
        own = rows.sparkSession.read.parquet(path)
    except AnalysisException as e:  # no rows, no part
        if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            raise
        return []
    if _BUCKET not in own.columns:
        return []
    return [[r[0], folder] for r in own.select(_BUCKET).distinct().orderBy(_BUCKET).collect()]  # as many as buckets


def _stored_schema(manifest: dict) -> T.StructType:
    columns = T.StructType.fromJson(manifest["schema"])
    return columns.add(_DELETED, T.BooleanType()).add(_SEQ, T.LongType())


def _rows(spark: SparkSession, store: str, manifest: dict, live: list[list]) -> DataFrame:
    schema = _stored_schema(manifest)
    if not live:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{store.rstrip('/')}/{folder}/{_BUCKET}={b}" for b, folder in live])


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key's latest commit that no later delete of its file follows; duplicates inside a commit stay."""
    rest = [k for k in keys if k != "file_path"]
    one = F.coalesce(*[F.col(k).isNotNull() for k in rest[:1]], F.lit(False)) & F.col(_DELETED)  # a delete of one key, not of a file
    deletes = rows.where(F.col(_DELETED) & ~one).groupBy("file_path").agg(F.max(_SEQ).alias("_gone"))
    newest = rows.where(~F.col(_DELETED) | one).groupBy(*keys).agg(F.max(_SEQ).alias(_SEQ), F.max_by(_DELETED, _SEQ).alias("_off")).where("NOT _off").drop("_off")
    same = F.col("k.file_path").eqNullSafe(F.col("d.file_path"))
    kept = newest.alias("k").join(deletes.alias("d"), same, "left").where(f"_gone IS NULL OR _gone < {_SEQ}").select(*[f"k.{k}" for k in keys], _SEQ).alias("k")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in (*keys, _SEQ)]
    return rows.where(f"NOT {_DELETED}").alias("r").join(kept, on, "left_semi")


def _split(manifest: dict) -> tuple[list[list], list[list]]:
    """(clean, other) live parts: a clean bucket has one part, without deletes."""
    count: dict[int, int] = {}
    for b, folder in manifest["live"]:
        count[b] = count.get(b, 0) + (1 if folder in manifest["clean"] else 2)
    return [p for p in manifest["live"] if count[p[0]] == 1], [p for p in manifest["live"] if count[p[0]] > 1]


def _live_rows(spark: SparkSession, store: str, manifest: dict, columns: list[str] | None = None) -> DataFrame:
    """All live rows with _seq; buckets with one part are read as they are, without a shuffle."""
    clean, other = _split(manifest)
    keys = manifest["keys"]
    wanted = [*(columns or T.StructType.fromJson(manifest["schema"]).names), _SEQ]
    plain = _rows(spark, store, manifest, clean).select(*wanted)
    return plain.unionByName(_latest(_rows(spark, store, manifest, other), keys).select(*wanted)) if other else plain


def read_slides(spark: SparkSession, store: str, keys: tuple[str, ...] | None = None) -> DataFrame:
    """The store's rows; of a key that several commits have, the rows of the latest.  ``keys`` are those of the store unless given."""
    manifest = _required(spark, store)
    if keys:
        manifest = manifest | {"keys": list(keys)}
    return _live_rows(spark, store, manifest).drop(_SEQ)


def _required(spark: SparkSession, store: str) -> dict:
    manifest = read_manifest(spark, store)
    if manifest is None:
        raise ValueError(f"there is no store in {store}")
    return manifest


def _commit(slides: DataFrame, store: str, manifest: dict | None, writer: str | None, batch: int | None, deleted: bool, keys: tuple[str, ...], buckets: int) -> None:
    spark = slides.sparkSession
    old = manifest or {"version": 0, "schema": T.StructType([T.StructField(f.name, f.dataType) for f in slides.schema.fields]).jsonValue(), "keys": list(keys), "buckets": buckets, "live": [], "clean": [], "writers": {}}
    new = old | {"version": old["version"] + 1}
    names = T.StructType.fromJson(old["schema"]).names
    parts = _write_parts(slides.select(*names).withColumns({_DELETED: F.lit(deleted), _SEQ: F.lit(new["version"]).cast("long")}), store, new)
    new["live"] = old["live"] + parts
    new["clean"] = old["clean"] + sorted({folder for _, folder in parts if not deleted})
    if writer is not None:
        new["writers"] = old["writers"] | {writer: batch}
    _publish(spark, store, new)


def write_slides(slides: DataFrame, store: str, batch: int, writer: str = "main", keys: tuple[str, ...] = KEYS, buckets: int = BUCKETS) -> None:
    """Adds ``slides`` to ``store``, which begins with the first batch, as batch ``batch`` of ``writer``; duplicates of a key inside a batch stay.

    A writer counts its batches up: one that is not above its last one has been written before and is skipped, so that a replay is
    harmless.  ``keys`` (file_path among them) and ``buckets`` hold for a new store only.
    """
    manifest = read_manifest(slides.sparkSession, store)
    if manifest is not None and manifest["writers"].get(writer, -1) >= batch:
        return
    _commit(slides, store, manifest, writer, batch, False, keys, buckets)


def upsert_slides(spark: SparkSession, new: DataFrame, store: str, dim: int, batch: int, order: str, vector: str = "embedding", writer: str = "main") -> None:
    """Adds ``new`` rows with vectors of ``dim`` numbers to ``store`` as batch ``batch`` of ``writer``; the last row of a key by ``order`` wins, within
    the batch here and over all batches in :func:`read_slides`."""
    good, _ = scalars.validate_vectors(new, dim, vector)
    write_slides(tables.last_of(good, KEYS, order), store, batch, writer)


def delete_slides(spark: SparkSession, store: str, paths: DataFrame | None = None, folders: DataFrame | None = None, writer: str | None = None, batch: int | None = None) -> int:
    """Deletes the slides of files (file_path) and below folders (folder); the number of slides deleted.

    Only key columns are read.  Deletes are written to the buckets of the files that go, and other buckets stay as they are.
    With ``writer`` and ``batch`` a replay is skipped, as in :func:`write_slides`.
    """
    manifest = _required(spark, store)
    if writer is not None and manifest["writers"].get(writer, -1) >= batch:
        return 0
    files = _live_rows(spark, store, manifest, manifest["keys"]).groupBy("file_path").agg(F.count("*").alias("_n"))
    parts = []
    if paths is not None:
        parts.append(files.join(paths.select("file_path").distinct(), "file_path", "left_semi"))
    if folders is not None:
        parts.append(files.join(tables.paths_below(files, folders), "file_path", "left_semi"))
    if not parts:
        return 0
    gone = parts[0] if len(parts) == 1 else parts[0].union(parts[1]).distinct()
    gone = written(gone, "deleted-files")
    count = gone.agg(F.sum("_n")).first()[0] or 0
    names = T.StructType.fromJson(manifest["schema"])
    marks = gone.select(*[F.col("file_path") if f.name == "file_path" else F.lit(None).cast(f.dataType).alias(f.name) for f in names])
    if count or writer is not None:
        _commit(marks, store, manifest, writer, batch, True, KEYS, BUCKETS)
    return count


def delete_keys(keys: DataFrame, store: str, writer: str, batch: int) -> None:
    """Deletes the rows of (file_path, slide_number), both not null, as batch ``batch`` of ``writer``; a replay is skipped."""
    spark = keys.sparkSession
    manifest = _required(spark, store)
    if manifest["writers"].get(writer, -1) >= batch:
        return
    names = T.StructType.fromJson(manifest["schema"])
    marks = keys.where(" AND ".join(f"{k} IS NOT NULL" for k in manifest["keys"])).distinct()
    marks = marks.select(*[F.col(f.name) if f.name in manifest["keys"] else F.lit(None).cast(f.dataType).alias(f.name) for f in names])
    _commit(marks, store, manifest, writer, batch, True, KEYS, BUCKETS)


def compact_slides(spark: SparkSession, store: str) -> int:
    """Rewrites the live rows of buckets with several parts or deletes as one part each; the number of buckets rewritten."""
    manifest = _required(spark, store)
    clean, other = _split(manifest)
    if not other:
        return 0
    new = manifest | {"version": manifest["version"] + 1}
    rows = _latest(_rows(spark, store, manifest, other), manifest["keys"])
    parts = _write_parts(rows, store, new)
    new["live"] = clean + parts
    new["clean"] = sorted({folder for _, folder in new["live"]})
    _publish(spark, store, new)
    return len({b for b, _ in other})


def clear_slides(spark: SparkSession, store: str) -> None:
    """Leaves an empty store of the same columns."""
    manifest = _required(spark, store)
    _publish(spark, store, manifest | {"version": manifest["version"] + 1, "live": [], "clean": []})


def vacuum_store(spark: SparkSession, store: str, keep: int = 2) -> int:
    """Deletes manifests but the last ``keep``, and data folders that these do not name; the number of folders deleted.

    Readers that began before the kept versions lose their files, and so does a commit that is being written.
    """
    rows = spark.read.option("wholetext", True).text(_manifests(store)).orderBy(F.desc("version")).limit(keep).collect()  # ``keep`` small texts
    versions = [r["version"] for r in rows]
    named = {folder for r in rows for _, folder in json.loads(r["value"])["live"]}
    root = spark._jvm.org.apache.hadoop.fs.Path(store)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    deleted = 0
    for kind, keeps in (("data", lambda n: f"data/{n}" in named), ("manifest", lambda n: n.startswith("version=") and int(n[8:]) >= min(versions))):
        folder = spark._jvm.org.apache.hadoop.fs.Path(root, kind)
        for status in system.listStatus(folder) if system.exists(folder) else []:
            if not keeps(status.getPath().getName()):
                system.delete(status.getPath(), True)
                deleted += kind == "data"
    return deleted
