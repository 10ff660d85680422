"""Token counts of whole texts without token ids.

Pieces are counted once for each distinct pre-token of the corpus.  Per-document pre-token frequencies are
then joined to these counts and summed.  A pre-token is a maximal run of spaces with the characters up to
the next space: no piece of the vocabulary holds a word-begin mark behind another character, so no merge
crosses such a border and the sum equals the count for the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, require
from ._words import frugal, mix, slices, utf8

#: The word-begin mark of the vocabulary; in a text it reads like a space.
MARK = "▁"
_UNITS = re.compile(" +[^ ]*")
#: Pre-tokens with a share of at least 1 / HEAD of all occurrences are broadcast; there are at most HEAD.
HEAD = 1 << 21
#: Distinct pre-tokens that a task holds before it gives them out.
HELD_TOKENS = 1_000_000


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of one text, each without its first space.  '' stands for one lone space at the end."""
    if not text:
        return []
    return [u[1:] for u in _UNITS.findall(" " + text.replace(MARK, " "))]


def _split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of a column in order, and the row of each."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    lists = pc.split_pattern(column, " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    words = lists.flatten()
    rows = np.repeat(np.arange(len(column)), sizes)
    odd = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    marked = pc.match_substring(column, MARK).to_numpy(zero_copy_only=False)
    slow = np.unique(np.concatenate([rows[odd], np.flatnonzero(marked)]))
    if not len(slow):
        return words, rows
    fast = ~np.isin(rows, slow)
    texts = column.take(pa.array(slow)).to_pylist()
    own = [pre_tokens(t) for t in texts]
    more = pa.array([u for units in own for u in units], pa.large_string())
    more_rows = np.repeat(slow, [len(u) for u in own])
    return pa.concat_arrays([words.filter(pa.array(fast)), more]), np.concatenate([rows[fast], more_rows])


def _string_hashes(column: pa.Array) -> np.ndarray:
    """64-bit hashes of strings; their identity stands for that of the strings."""
    out = np.zeros(len(column), np.uint64)
    data, offsets = utf8(column)
    length = np.diff(offsets)
    todo = np.arange(len(column))
    at = 0
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out += length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    while True:  # eight bytes of every string at a time
        todo = todo[length[todo] > at] if at else todo
        if not len(todo):
            return mix(out)
        place = offsets[todo] + at
        left = np.minimum(8, length[todo] - at)
        word = np.zeros(len(todo), np.uint64)
        for i in range(8):
            byte = padded[np.minimum(place + i, len(padded) - 1)].astype(np.uint64)
            byte[left <= i] = 0
            word |= byte << np.uint64(8 * i)
        out[todo] = mix(out[todo] ^ word) + np.uint64(0x632BE59BD9B4E019)
        at += 8


def _local_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pre-tokens of a task with their counts; given out and begun anew when they are many."""
    held: pa.Table | None = None

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from table.cast(pa.schema([("token", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=50_000)

    for batch in slices(batches):
        words, _ = _split(batch.column("text"))
        seen = pc.value_counts(words)
        now = pa.table({"token": seen.field("values"), "n": seen.field("counts")})
        held = now if held is None else pa.concat_tables([held, now]).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])
        if held.num_rows > HELD_TOKENS:
            yield from flush(held)
            held = None
    if held is not None and held.num_rows:
        yield from flush(held)


def _piece_counter(vocabulary: str):
    """Counts pieces of pre-tokens with the library that the vocabulary file belongs to."""
    import public_tokenizers
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))

    def count(tokens: list[str]) -> np.ndarray:
        out = np.fromiter((len(x) for x in processor.encode(tokens, num_threads=1)), np.int64, len(tokens))
        return out + np.fromiter((t == "" for t in tokens), np.int64, len(tokens))

    return count


def pre_token_table(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(h, n, seen): hash of each distinct pre-token, its number of pieces, its occurrences in the corpus."""
    local = docs.select("text").mapInArrow(frugal(_local_tokens), "token string, n bigint")
    distinct = local.groupBy("token").agg(F.sum("n").alias("seen"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _piece_counter(vocabulary)
        for batch in batches:
            tokens = batch.column("token")
            yield pa.RecordBatch.from_arrays([pa.array(_string_hashes(tokens).view(np.int64)), pa.array(counter(tokens.to_pylist())), batch.column("seen")], ["h", "n", "seen"])

    return distinct.mapInArrow(frugal(count), "h bigint, n bigint, seen bigint")


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", limit: int = 4096, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text has no bytes and no tokens.  Repeated rows are counted each; a null doc_id stays null.
    An empty table gives an empty table.
    """
    require(docs, ["doc_id", "text"])
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = materialize(pre_token_table(docs, vocabulary), "pre-tokens")
    total = counts.agg(F.sum("seen")).first()[0] or 0
    # at most ``head`` rows can have so large a share of the total
    frequent = counts.where(F.col("seen") * F.lit(head) >= F.lit(total)).where(F.col("seen") > 8).select("h", "n").toPandas()
    order = np.argsort(frequent["h"].to_numpy(np.int64), kind="stable")
    known = docs.sparkSession.sparkContext.broadcast((
        frequent["h"].to_numpy(np.int64)[order],
        frequent["n"].to_numpy(np.int32)[order],
    ))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, pieces = known.value
        names = ["row", "doc_id", "n_bytes", "n", "h", "times"]
        for batch in slices(batches):
            texts = batch.column("text")
            words, rows = _split(texts)
            coded = words.dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False)
            hashes = _string_hashes(coded.dictionary).view(np.int64)
            place = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            is_known = keys[place] == hashes if len(keys) else np.zeros(len(hashes), bool)
            worth = np.where(is_known, pieces[place] if len(keys) else 0, 0)
            n_rows = batch.num_rows
            sums = np.bincount(rows, weights=worth[index], minlength=n_rows).astype(np.int64)
            rest = ~is_known[index]
            pairs, times = np.unique(rows[rest] * np.int64(max(1, len(hashes))) + index[rest], return_counts=True)
            row, token = np.divmod(pairs, max(1, len(hashes)))
            row_keys = batch.column("row")
            ids, none = batch.column("doc_id"), pa.nulls(len(row), pa.int64())
            yield pa.RecordBatch.from_arrays([
                row_keys, ids, pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).cast(pa.int64()),
                pa.array(sums), pa.nulls(n_rows, pa.int64()), pa.nulls(n_rows, pa.int64()),
            ], names)
            yield pa.RecordBatch.from_arrays([row_keys.take(pa.array(row)), pa.nulls(len(row), ids.type), none, none, pa.array(hashes[token]), pa.array(times.astype(np.int64))], names)

    postings = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        frugal(frequencies), f"row bigint, doc_id {kind}, n_bytes bigint, n bigint, h bigint, times bigint"
    )
    # rows with no rare pre-token take part in the join under keys of their own, spread over all partitions
    spread = F.coalesce("h", F.xxhash64("row"))
    rare = counts.where(~((F.col("seen") * F.lit(head) >= F.lit(total)) & (F.col("seen") > 8))).select(F.col("h").alias("key"), F.col("n").alias("pieces"))
    joined = postings.withColumn("key", spread).join(rare, "key", "left")
    worth = F.coalesce(F.col("n"), F.lit(0)) + F.when(F.col("h").isNotNull(), F.col("times") * F.col("pieces")).otherwise(F.lit(0))
    return (
        joined.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(worth).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
