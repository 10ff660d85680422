"""Quality rules with host verdicts, in DataFrame functions only.

Each text is measured once.  Failures of each rule are aggregated by host, the hosts' failure rates are
shrunk towards the corpus with a beta prior that is estimated for each rule from all hosts, and the verdict
on a host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_names, materialize, require, words_of

#: A host is refused when its shrunken failure rate of any rule is above this.
MAX_HOST_RATE = 0.5
WINDOW = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(places: Column) -> Column:
    """Words in the runs of WINDOW words that begin at ``places`` (in order)."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("past"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct((p + WINDOW).alias("past"), (acc["n"] + p + WINDOW - F.greatest(acc["past"], p)).alias("n")),
        lambda acc: acc["n"],
    )


def _paired(grams: Column) -> Column:
    """:func:`_covered` by pairs of (hash, place): right for all hashes, but slow."""
    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    again = F.filter(ordered, lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]))
    return _covered(F.sort_array(F.transform(again, lambda x: x["i"])))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long).

    A null text has no words; repeated rows are measured each; columns named like a measure are replaced; an
    empty table gives an empty table.

    Windows of three words are hashed to 64 bits.  Only texts in which a hash occurs twice go on: the places
    replace the low bits of the hashes, so that one sort of plain numbers puts equal hashes side by side with
    their places.  Where hashes differ in the replaced bits alone, pairs of hash and place are sorted instead.
    """
    require(docs, ["text"])
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", *MEASURES)]
    text, words, lines, grams, low, packed, again = map(F.col, names := free_names(docs, "text_", "words_", "lines_", "grams_", "low_", "packed_", "again_"))
    plain = [F.col(m) for m in MEASURES[:4]]
    n = F.size(words)
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(*keep, whole.alias(names[0]), words_of(whole).alias(names[1]), F.split(whole, "\n", -1).alias(names[2]))
    filled = F.filter(lines, lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    hashed = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    out = out.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.when(F.size(F.array_distinct(lines)) == F.size(lines), F.lit(0)).otherwise(F.size(filled) - F.size(F.array_distinct(filled))).cast("long").alias("n_dup_lines"),
        F.when(n > WINDOW, hashed).otherwise(F.array().cast("array<bigint>")).alias(names[3]),
    )
    # null where no hash occurs twice
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(grams)))) - 1
    out = out.select(*keep, *plain, grams, F.when(F.size(F.array_distinct(grams)) < F.size(grams), bits).alias(names[4]))
    placed = F.transform(grams, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
    out = out.select(*keep, *plain, grams, low, F.when(low.isNotNull(), F.sort_array(placed)).alias(names[5]))
    same = lambda a, b: a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(low)) == 0
    near = F.filter(packed, lambda x, k: same(x, F.get(packed, k - 1)) | same(x, F.get(packed, k + 1)))
    out = out.select(*keep, *plain, grams, low, near.alias(names[6]))
    at = lambda x: F.get(grams, x.bitwiseAND(low).cast("int"))
    mixed = F.exists(F.transform(again, lambda x, k: F.coalesce(same(x, F.get(again, k - 1)) & (at(x) != at(F.get(again, k - 1))), F.lit(False))), lambda x: x)
    places = F.sort_array(F.transform(again, lambda x: x.bitwiseAND(low)))
    repeated = F.when(low.isNull(), F.lit(0).cast("long")).when(mixed, _paired(grams)).otherwise(_covered(places))
    return out.select(*keep, *plain, repeated.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failures() -> dict[str, Column]:
    """The rules whose failures are counted by host, over the columns of :func:`measure`."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "few_words": F.col("n_words") < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": F.col("n_symbols") > 0.25 * F.col("n_words"),
        "lines": F.col("n_dup_lines") > 0.3 * words,
        "word_length": ~(F.col("word_chars") / words).between(2, 20),
    }


def host_verdicts(measured: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE, key: str = "host") -> DataFrame:
    """(``key``, host_docs, host_rate, host_ok): failure rates of the rules by host, shrunk by empirical beta priors.

    A rule's prior has the mean m and the strength s of the hosts' rates by the method of moments; a host with k
    failures in n documents gets (k + m s) / (n + s).  host_rate is the largest of its rules' rates.  Documents
    without a host form one host.
    """
    rules = rule_failures()
    failures = [F.sum(F.when(failed, 1).otherwise(0)).alias(f"k_{rule}") for rule, failed in rules.items()]
    hosts = measured.groupBy(F.col(f"`{host}`").alias(key)).agg(F.count("*").alias("host_docs"), *failures)
    # moments over hosts, weighted by their documents: one row
    moments = [(F.sum("host_docs") / F.count("*")).alias("size")]
    rates = []
    for rule in rules:
        k, m = F.col(f"k_{rule}"), F.col(f"m_{rule}")
        moments.append(F.coalesce(F.sum(k) / F.sum("host_docs"), F.lit(0.0)).alias(f"m_{rule}"))
        moments.append(F.coalesce(F.sum(k * k / F.col("host_docs")) / F.sum("host_docs"), F.lit(0.0)).alias(f"m2_{rule}"))
        between = F.greatest(F.col(f"m2_{rule}") - m * m - m * (1 - m) / F.col("size"), F.lit(1e-6))
        strength = F.least(F.greatest(m * (1 - m) / between - 1, F.lit(1.0)), F.lit(1000.0))
        rates.append((k + m * strength) / (F.col("host_docs") + strength))
    worst = F.greatest(*rates)
    joined = hosts.join(F.broadcast(hosts.agg(*moments)))  # one row
    return joined.select(F.col(key), "host_docs", worst.alias("host_rate"), (worst <= max_rate).alias("host_ok"))


def apply_quality_rules(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row for each row of ``docs``: its columns without text, the measures, base_failed, host_docs, host_rate and kept.

    kept is false for a base failure, else the verdict on the host.  A null text has no words and fails; a null
    host is one host of its own; repeated rows are judged each; columns named like an added one are replaced; an
    empty table gives an empty table.
    """
    require(docs, ["text", host])
    added = ("base_failed", "kept", "host_docs", "host_rate", "host_ok")
    measured = materialize(measure(docs.drop(*[c for c in added if c != host])), "measures")
    (key,) = free_names(measured, "host_")
    verdicts = host_verdicts(measured, host, max_rate, key)
    joined = measured.join(verdicts, F.col(f"`{host}`").eqNullSafe(F.col(key)), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop(key, "host_ok")
