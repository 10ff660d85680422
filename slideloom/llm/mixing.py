"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token counts are summed once into cells (source, language, topic).  Every source, language and topic has a goal:
its target share of the sample's tokens or, where it has fewer, all it has, the rest going to the others.  The
cells' probabilities are raked in turn to the goals of each dimension, none above 1: what a full cell cannot
give is asked of the other cells of the same value.  Rounds end when all margins agree.  Each document is then
kept with the probability of its cell, by a hash of its id.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_names, materialize, require, words_of

#: Targets soften the corpus shares: share ** power, normalised.
POWERS = {"source": 0.7, "lang": 0.5, "topic": 0.7}
#: Raking stops when no margin is further from its goal than this share of the sample, or after so many rounds.
TOLERANCE = 1e-4
ROUNDS = 15
#: Steps in which the level is raised that values without enough tokens leave to the others.
LEVEL_STEPS = 8
#: Share of all tokens that the sample should hold.
BUDGET = 0.7
#: The factor of a value that gives all it has.
FULL = 1e12
#: Rows of a table of cells or values that one task takes.
ROWS_PER_TASK = 200_000
_NONE = "\0"


def topic_of(text: Column) -> Column:
    """A coarse content class of a text by fixed rules: empty, licensed, table, symbols, contact, short or prose."""
    size = F.length(text)
    return (
        F.when(text.isNull() | (size == 0), "empty")
        .when(F.regexp_count(text, F.lit(r"\|")) * 40 > size, "table")
        .when(F.regexp_count(text, F.lit("[#*$%&<>]")) * 25 > size, "symbols")
        .when(F.contains(text, F.lit("icensed under")) | F.contains(text, F.lit("ights reserved")), "licensed")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(size < 600, "short")
        .otherwise("prose")
    )


def _tasks(table: DataFrame) -> int:
    """Partitions for a written table of cells or values, by its size: a table that fits one task is summed and joined without a shuffle."""
    return max(1, -(-table.count() // ROWS_PER_TASK))


def goals(cells: DataFrame, powers: dict[str, float], targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """(dim, value, have, target, goal): tokens, target share and tokens to reach of every value of every dimension.

    ``targets`` (dimension -> its values, target) replaces the softened shares of the dimensions it names; values
    that it leaves out get nothing.  goal is the target share of the budget, raised to one level for all values
    that have enough tokens, as the others only give what they have.
    """
    cells, parts = cells.coalesce(_tasks(cells)), []
    for d, power in powers.items():
        have = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").cast("double").alias("have"))
        if targets and d in targets:
            own = targets[d].select(F.coalesce(F.col(d).cast("string"), F.lit(_NONE)).alias("value"), F.col("target").cast("double").alias("target"))
            have = have.join(own, "value", "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
        else:
            have = have.withColumn("target", F.pow("have", F.lit(power)))
        parts.append(have.select(F.lit(d).alias("dim"), "value", "have", "target"))
    values = materialize(functools.reduce(DataFrame.union, parts), "values")
    values = values.coalesce(_tasks(values))
    have, target, dim = F.col("have"), F.col("target"), F.col("dim")
    # one row for each dimension
    sums = values.groupBy("dim").agg(F.sum("target").alias("all"), F.sum("have").alias("have"), F.sum(F.when(target > 0, have).otherwise(0.0)).alias("can")).collect()
    all_targets = {r["dim"]: r["all"] if r["all"] > 0 else 1.0 for r in sums}
    most = {r["dim"]: min(budget * r["have"], r["can"]) for r in sums}

    def of_dim(numbers: dict[str, float]) -> Column:
        return functools.reduce(lambda case, d: case.when(dim == d, numbers[d]), numbers, F.when(F.lit(False), 0.0))

    values = values.withColumn("target", target / of_dim(all_targets))
    level = dict(most)
    for _ in range(LEVEL_STEPS):
        full = have <= of_dim(level) * target
        steps = values.groupBy("dim").agg(F.sum(F.when(full, have).otherwise(0.0)).alias("given"), F.sum(F.when(full, 0.0).otherwise(target)).alias("open")).collect()
        raised = {r["dim"]: (most[r["dim"]] - r["given"]) / r["open"] if r["open"] > 0 else level[r["dim"]] for r in steps}
        if raised == level:
            break
        level = raised
    return values.withColumn("goal", F.least("have", of_dim(level) * target))


def rake(cells: DataFrame, wanted: DataFrame, dims: list[str], budget: float = BUDGET, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (dims, tokens) with probability: the product of one factor for each dimension's value, at most 1, so
    that the expected tokens of every value reach its goal in ``wanted`` (:func:`goals`).

    A cell's weight is the product of the factors; a step multiplies it by the new factor of one dimension's value, so
    that it takes one sum and one join.  Weights are raised for the cells below 1 only.  Goals that cannot be met
    together (a value whose cells are all full) leave a gap, which :func:`margin_report` shows.
    """
    tokens, w, reached = F.col("tokens").cast("double"), F.col("w"), F.col("reached")
    # a value that gives all it has keeps its cells full, whatever the others do
    start = F.when(F.col("goal") >= F.col("have"), F.lit(FULL)).when(F.col("dim") == dims[0], F.lit(float(budget))).otherwise(1.0)
    wanted = wanted.select("dim", "value", "goal", start.alias("f"))
    n_tasks = _tasks(cells)
    rows = cells.coalesce(n_tasks).withColumn("w", F.lit(1.0))
    for d in dims:
        own = wanted.where(F.col("dim") == d).select(F.col("value").alias(d), F.col("goal").alias(f"goal_{d}"), "f")
        rows = rows.join(own, d).withColumns({"w": w * F.col("f"), f"gap_{d}": F.lit(0.0)}).drop("f")
    rows = materialize(rows, "raking").coalesce(n_tasks)
    whole = wanted.where(F.col("dim") == dims[0]).agg(F.sum("goal")).first()[0]  # one number
    for _ in range(rounds):
        for d in dims:
            goal = F.col(f"goal_{d}")
            sums = rows.groupBy(d).agg(
                F.sum(tokens * F.least(w, F.lit(1.0))).alias("reached"), F.sum(F.when(w >= 1, tokens).otherwise(0.0)).alias("full"), F.sum(F.when(w < 1, tokens * w).otherwise(0.0)).alias("open")
            )
            step = F.when(goal < reached, goal / reached).when(F.col("open") > 0, (goal - F.col("full")) / F.col("open")).otherwise(1.0)
            # a table for each step: plans stay small on the driver
            rows = materialize(rows.join(sums, d).withColumns({"w": w * step, f"gap_{d}": F.abs(goal - reached)}).drop("reached", "full", "open"), "raking").coalesce(n_tasks)
        gap = rows.agg(F.max(F.greatest(F.lit(0.0), *[F.col(f"gap_{d}") for d in dims]))).first()[0]  # one number
        if gap is None or gap <= tolerance * whole:
            break
    return rows.select(*dims, "tokens", F.least(w, F.lit(1.0)).alias("probability"))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of ``key``: the same in every run and on every engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _described(docs: DataFrame, topic: str, tokens: str) -> DataFrame:
    """``docs`` with the words of the text and, under another name than topic, its topic."""
    text = F.col("text").cast("string")
    count = F.when(text.isNull(), F.lit(0)).otherwise(F.size(words_of(text))).cast("long")
    return docs.withColumns({tokens: count} | ({} if topic == "topic" and "topic" in docs.columns else {topic: topic_of(text)}))


def _values(dims: dict[str, str]) -> dict[str, Column]:
    """The value of each dimension, from its column; a null is a value of its own."""
    return {d: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(_NONE)) for d, c in dims.items()}


def _cells(described: DataFrame, dims: dict[str, str], tokens: str) -> DataFrame:
    return materialize(described.groupBy(*[c.alias(d) for d, c in _values(dims).items()]).agg(F.sum(tokens).alias("tokens")), "cells")


def _probabilities(described: DataFrame, dims: dict[str, str], tokens: str, powers: dict[str, float], targets: dict[str, DataFrame] | None, budget: float) -> DataFrame:
    cells = _cells(described, dims, tokens)
    return materialize(rake(cells, goals(cells, powers, targets, budget), list(powers), budget), "weights")


def _judged(rows: DataFrame, weights: DataFrame, dims: dict[str, str], probability: str) -> DataFrame:
    """``rows`` with the probability of their cells; cells without tokens have 0."""
    names = free_names(rows, *[f"{d}_" for d in dims])
    weights = weights.select(*[F.col(d).alias(n) for d, n in zip(dims, names, strict=True)], F.when(F.col("tokens") > 0, F.col("probability")).otherwise(0.0).alias(probability))
    on = [c == F.col(n) for c, n in zip(_values(dims).values(), names, strict=True)]
    return rows.join(weights, on, "left").drop(*names)


def mix_sources(docs: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: str = "mix") -> DataFrame:
    """``docs`` without text, with tokens, topic, weight, probability and kept for every row.

    probability is that of the row's cell; weight is its ratio to ``budget``, so the share of the cell in the sample
    against its share in the corpus.  ``targets`` (dimension -> its values, target) replaces softened shares.
    tokens are the words of the text.  A null text has no tokens; a cell without tokens has probability 0 and is not
    kept; null sources and languages are values of their own; repeated rows share their fate; existing columns
    of the added names are replaced, except topic, which is used if there is one; an empty table gives an empty table.
    """
    require(docs, ["doc_id", "text", "source", "lang"])
    powers = powers or POWERS
    dims = {d: d for d in powers}
    rows = materialize(_described(docs.drop("tokens", "weight", "probability", "kept"), "topic", "tokens").drop("text"), "mixing")
    judged = _judged(rows, _probabilities(rows, dims, "tokens", powers, targets, budget), dims, "probability")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return judged.withColumn("weight", F.col("probability") / budget).withColumn("kept", draw(key, seed) < F.col("probability"))


def margin_report(mixed: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """(dim, value, have, target, goal, expected, drawn) of the rows of :func:`mix_sources`: the target share, and the
    tokens there are, asked for, expected by the probabilities and drawn."""
    powers = powers or POWERS
    cells = _cells(mixed, {d: d for d in powers}, "tokens")
    parts = []
    for d, value in _values({d: d for d in powers}).items():
        drawn = F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0))
        parts.append(mixed.groupBy(value.alias("value")).agg(F.sum(F.col("tokens") * F.col("probability")).alias("expected"), drawn.alias("drawn")).withColumn("dim", F.lit(d)))
    return goals(cells, powers, targets, budget).join(functools.reduce(DataFrame.unionByName, parts), ["dim", "value"])


def sample_mixture(docs: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: str = "mix") -> DataFrame:
    """The kept rows of ``docs`` with all their columns, by the rules of :func:`mix_sources`.

    Rows without a text, or with one without words, are not kept.  Columns of any name stay as they are.  Texts are
    read twice, for the cells and for the sample, and not shuffled while the cells are few.
    """
    require(docs, ["doc_id", "text", "source", "lang"])
    powers = powers or POWERS
    topic, tokens, probability = free_names(docs, "topic_", "tokens_", "probability_")
    dims = {d: topic if d == "topic" and "topic" not in docs.columns else d for d in powers}
    described = _described(docs, topic, tokens)
    weights = _probabilities(described, dims, tokens, powers, targets, budget)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return _judged(described, weights, dims, probability).where(draw(key, seed) < F.col(probability)).select(*[F.col(f"`{c}`") for c in docs.columns])
