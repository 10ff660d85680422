"""Texts with an inner form: cell specifications, event streams of answers, chat logs, token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_cell_specs(df: DataFrame, text: str = "text", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells, rejected) of lines ``worksheet name="S" | cell="A1" | key=value ...``, beside the other columns of ``df``.

    cells has sheet, cell and attrs (a map); rejected has line_no and line.  A line without sheet or cell, with
    a part that is no key=value, or with a key twice is rejected; ``strict`` makes it an error.  Blank lines count as none.
    """
    rest = [c for c in df.columns if c not in (text, "line_no", "line", "sheet", "cell", "attrs")]
    lines = df.select(*rest, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line")).where("trim(line) <> ''").withColumn("line_no", F.col("line_no") + 1)
    parts = F.split(F.trim("line"), r"\s*\|\s*")
    given = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    keys = F.transform(given, lambda x: F.trim(F.substring_index(x, "=", 1)))
    values = F.transform(given, lambda x: F.regexp_replace(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1), r'^\s*"?|"?\s*$', ""))
    sheet = F.regexp_extract(F.get(parts, F.lit(0)), r'^worksheet name="([^"]+)"$', 1)
    cell = F.regexp_extract(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r'^cell="([A-Za-z]+[0-9]+)"$', 1)
    good = (sheet != "") & (cell != "") & F.forall(given, lambda x: F.contains(x, F.lit("="))) & (F.size(F.array_distinct(keys)) == F.size(keys))
    judged = lines.withColumn("_good", good if not strict else F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("bad cell line: "), "line")).cast("boolean")))
    cells = judged.where("_good").select(*rest, sheet.alias("sheet"), cell.alias("cell"), F.when(good, F.map_from_arrays(keys, values)).alias("attrs"))
    return cells, judged.where("NOT _good").drop("_good")


def decode_sse(raw: Column) -> Column:
    """struct(answer, error) of the lines ``data: {...}`` of one answer.

    Chunks are joined until ``[DONE]`` or the first error; lines that are no JSON are skipped.
    """
    data = F.transform(F.filter(F.split(raw, r"\r?\n"), lambda x: F.startswith(x, F.lit("data: "))), lambda x: F.substring(x, 7, 1 << 30))
    stop = F.array_position(F.transform(data, F.trim), "[DONE]")
    live = F.when(stop > 0, F.slice(data, F.lit(1), (stop - 1).cast("int"))).otherwise(data)
    errors = F.transform(live, lambda x: F.get_json_object(x, "$.error"))
    first = F.array_position(F.transform(errors, lambda x: x.isNotNull()), True)
    heard = F.when(first > 0, F.slice(live, F.lit(1), (first - 1).cast("int"))).otherwise(live)
    answer = F.array_join(F.transform(heard, lambda x: F.coalesce(F.get_json_object(x, "$.chunk"), F.lit(""))), "")
    return F.struct(answer.alias("answer"), F.when(first > 0, F.get(errors, (first - 1).cast("int"))).alias("error"))


def match_tool_results(messages: DataFrame, results: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, content, request_id) with status and result.

    The first tool_call of a request gets the last result (conv_id, request_id, result, at), status completed and
    a content that begins with "Completed: "; results without such a call change nothing.
    """
    calls = messages.where("role = 'tool_call' AND request_id IS NOT NULL").groupBy("conv_id", "request_id").agg(F.min("turn").alias("turn"))
    last = results.groupBy("conv_id", "request_id").agg(F.max_by("result", "at").alias("result"))
    done = calls.join(last, ["conv_id", "request_id"]).select("conv_id", "turn", "result", F.lit("completed").alias("status"))
    content = F.when(F.col("status").isNotNull() & (F.col("role") == "tool_call"), F.concat(F.lit("Completed: "), F.coalesce("content", F.lit("")))).otherwise(F.col("content"))
    return messages.drop("status", "result").join(done, ["conv_id", "turn"], "left").withColumn("content", content)


def merge_timeline(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Messages (at_ms, text) and events (id, text) in order of time; an event's time is the second '-' field of its id."""
    at = F.expr("try_cast(split_part(id, '-', 2) AS BIGINT)")
    both = messages.select(F.col("at_ms").cast("long").alias("at_ms"), "text", F.lit("message").alias("kind")).unionByName(events.select(at.alias("at_ms"), "text", F.lit("event").alias("kind")))
    return both.orderBy("at_ms", "kind", "text")


#: Lines that are folded together before their chunks are put behind those of the lines before.
FOLDED_LINES = 256


def pack_by_tokens(df: DataFrame, key: str, text: str = "text", max_tokens: int = 18000) -> DataFrame:
    """(key, line_no, chunk, tokens): lines packed in order into chunks of at most ``max_tokens``; a longer line is a chunk of its own.

    A line's tokens are a quarter of its characters, rounded up.  A text is one row and is folded where it is, its lines in stretches, so
    that long texts take time in proportion; a null text has no lines.
    """
    # a column of its own, so that lambdas do not split the text again
    split = df.where(F.col(text).isNotNull()).select(F.col(key), F.transform(F.split(text, "\n"), lambda x: F.ceil(F.length(x) / 4)).alias("_tokens"))
    tokens = F.col("_tokens")
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / FOLDED_LINES).cast("int")), lambda i: F.slice(tokens, i * FOLDED_LINES + 1, F.lit(FOLDED_LINES)))
    named = lambda used, held, chunk, out: F.struct(used.alias("used"), held.alias("held"), chunk.alias("chunk"), out.alias("out"))
    none = F.array().cast("array<bigint>")

    def line(state: Column, n: Column) -> Column:
        full = state["held"] & (state["used"] + n > max_tokens)
        chunk = state["chunk"] + full.cast("long")
        return named(F.when(full, n).otherwise(state["used"] + n), F.lit(True), chunk, F.concat(state["out"], F.array(chunk)))

    def stretch(state: Column, ns: Column) -> Column:
        own = F.aggregate(ns, named(state["used"], state["held"], state["chunk"], none), line)
        # a list of one, so that the fold is done once
        return F.get(F.transform(F.array(own), lambda x: named(x["used"], x["held"], x["chunk"], F.concat(state["out"], F.array(x["out"])))), F.lit(0))

    start = named(F.lit(0).cast("long"), F.lit(False), F.lit(0).cast("long"), F.array().cast("array<array<bigint>>"))
    packed = split.select(key, "_tokens", F.flatten(F.aggregate(stretches, start, stretch)["out"]).alias("_chunks"))
    lines = packed.select(key, F.posexplode(F.arrays_zip("_chunks", "_tokens")).alias("_at", "_line"))
    return lines.select(key, (F.col("_at") + 1).cast("long").alias("line_no"), F.col("_line._chunks").alias("chunk"), F.col("_line._tokens").alias("tokens"))
