"""File names of one presentation across a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slideloom.functions import scalars
from slideloom.sources.shared import written


def _allowed(longer: Column) -> Column:
    """The most edits with which two names, the longer of this length, are more than 0.8 similar."""
    return F.floor((longer - 1) / 5).cast("int")


#: Pairs that one segment may bring together; names that meet in a larger one are compared by their rarest shorter segments.
COMMON = 1_000_000
_SIDES = ["short", "long"]
_TOKEN = [*_SIDES, "i", "segment"]


def _bases(names: DataFrame, column: str) -> DataFrame:
    name = F.col(column)
    bases = names.where(name.isNotNull()).select(F.lower(scalars.name_base(name)).alias("base"), scalars.name_version(name).isNotNull().alias("v")).distinct()
    return bases.groupBy("base").agg(F.max("v").alias("versioned"), F.max(~F.col("v")).alias("plain")).where("base <> ''").withColumn("n", F.length("base"))


def _cut(rows: DataFrame, more: bool) -> DataFrame:
    """Rows (short, long) for each of the segments of the shorter name: edits + 1 of them or, with ``more``, up to twice as many."""
    short, i = F.col("short"), F.col("i")
    k = rows.withColumn("edits", _allowed(F.col("long"))).withColumn("k", F.least(2 * (F.col("edits") + 1), short) if more else F.col("edits") + 1)
    start, past = F.floor(i * short / F.col("k")).cast("int"), F.floor((i + 1) * short / F.col("k")).cast("int")
    return k.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"start": start, "size": past - start})


def _short_tokens(rows: DataFrame, more: bool) -> DataFrame:
    """(short, long, i, segment, base_a, edits, k): the segments of shorter names (base_a, short, long)."""
    return _cut(rows, more).select(*_SIDES, "i", F.expr("substring(base_a, start + 1, size)").alias("segment"), "base_a", "edits", "k")


def _long_tokens(rows: DataFrame, more: bool) -> DataFrame:
    """(short, long, i, segment, base_b): what longer names (base_b, short, long) have where a segment may have moved to."""
    b, i, right = _cut(rows, more), F.col("i"), F.col("start") + F.col("long") - F.col("short")
    left_of, right_of = (F.col("edits"), F.col("edits")) if more else (i, F.col("k") - 1 - i)
    low = F.greatest(F.lit(0), F.col("start") - left_of, right - right_of)
    high = F.least(F.col("long") - F.col("size"), F.col("start") + left_of, right + right_of)
    b = b.withColumns({"low": low, "high": high}).withColumn("at", F.explode(F.sequence("low", F.greatest("low", "high")))).where("at <= high")
    return b.select(*_SIDES, "i", F.expr("substring(base_b, at + 1, size)").alias("segment"), "base_b").distinct()


def candidate_pairs(bases: DataFrame, common: int = COMMON) -> DataFrame:
    """(base_a, base_b) of names (base, n: its length) that may be within the edits allowed; none of these is lost.

    Two strings within k edits share one of k + 1 segments of the shorter, near its place.  A segment that would bring more than
    ``common`` pairs together is left out; names that meet in such a one share k + 1 of 2k + 2 segments at least, so each is
    compared by its k + 1 rarest of these.  A common word is then used only where nothing rarer is left.
    """
    n = F.col("n")
    a = bases.select(F.col("base").alias("base_a"), n.alias("short"), F.explode(F.sequence(n, F.greatest(n, F.ceil(n * 1.25).cast("int") - 1))).alias("long"))
    b = bases.select(F.col("base").alias("base_b"), F.explode(F.sequence(n - _allowed(n), n)).alias("short"), n.alias("long"))
    tokens_a, tokens_b = _short_tokens(a, False), _long_tokens(b, False)
    counts = tokens_a.groupBy(*_TOKEN).agg(F.count("*").alias("in_a")).join(tokens_b.groupBy(*_TOKEN).agg(F.count("*").alias("in_b")), _TOKEN)
    hot = written(counts.where(F.col("in_a") * F.col("in_b") > common).select(*_TOKEN), "common-segments")
    either = (F.col("base_a") != F.col("base_b")) & ((F.col("short") < F.col("long")) | (F.col("base_a") < F.col("base_b")))
    if hot.isEmpty():
        return tokens_a.join(tokens_b, _TOKEN).where(either).select("base_a", "base_b").distinct()
    found = tokens_a.join(hot, _TOKEN, "left_anti").join(tokens_b, _TOKEN).where(either).select("base_a", "base_b")
    more_a = _short_tokens(tokens_a.join(hot, _TOKEN, "left_semi").select("base_a", *_SIDES).distinct(), True)
    more_b = written(_long_tokens(tokens_b.join(hot, _TOKEN, "left_semi").select("base_b", *_SIDES).distinct(), True), "segments")
    rarity = more_b.groupBy(*_TOKEN).agg(F.count("*").alias("times"))
    w = Window.partitionBy("base_a", *_SIDES).orderBy(F.coalesce("times", F.lit(0)), "i")
    rarest = more_a.join(rarity, _TOKEN, "left").withColumn("nth", F.row_number().over(w)).where("nth <= edits + 1 AND times > 0")
    return found.union(rarest.join(more_b, _TOKEN).where(either).select("base_a", "base_b")).distinct()


def similar_name_pairs(names: DataFrame, column: str = "file_name", common: int = COMMON) -> DataFrame:
    """(base_a, base_b, similarity) of all different lower-case bases of which some names pass ``scalars.same_presentation``.

    Names with equal bases are one row here (membership follows from ``name_base``).  Only :func:`candidate_pairs` are compared.
    """
    bases = _bases(names, column)
    flags = bases.select(F.col("base").alias("base_a"), F.col("versioned").alias("va"), F.col("plain").alias("pa"))
    others = bases.select(F.col("base").alias("base_b"), F.col("versioned").alias("vb"), F.col("plain").alias("pb"))
    pairs = candidate_pairs(bases, common).withColumn("similarity", scalars.name_similarity(F.col("base_a"), F.col("base_b"))).where("similarity > 0.8")
    pairs = pairs.join(flags, "base_a").join(others, "base_b")
    fits = pairs.where("similarity > 0.8 AND va AND vb OR similarity > 0.9 AND (va AND pb OR pa AND vb)")
    return fits.select(F.least("base_a", "base_b").alias("base_a"), F.greatest("base_a", "base_b").alias("base_b"), "similarity")
