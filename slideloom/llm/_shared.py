"""What several operators need: shared scratch tables and the columns of a document."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slideloom.sources.shared import written

from ._words import give_back


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back; lineage ends there.

    Unlike executor-local storage the files outlive any executor, and rows keep the generated keys they
    were written with.
    """
    out = written(df, name)
    give_back()
    return out


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """Fail early, on the driver, when an input column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """For each of ``wanted`` a column name that ``df`` does not have: the name itself, or with more underscores."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """The words of a text, [^\\x20\\x09-\\x0D]+, in order."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bit_sieve(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A table of ``bits`` bits with one bit set for each hash: a filter of fixed size before a join.

    At most bits / 64 rows come to the driver, whatever the number of hashes.
    """
    bit = F.pmod(F.col(column), F.lit(bits))
    found = (
        hashes.select(F.floor(bit / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    table = np.zeros(bits // 64, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint64)


def sieve_has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash (signed 64-bit) is set."""
    slot = (hashes % (len(table) * 64)).astype(np.uint64)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
