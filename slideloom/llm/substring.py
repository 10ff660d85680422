"""Removal of repeated passages by sliding sentence spans.

A sentence goes if it lies in a run of consecutive sentences that has occurred before.  Runs count from two sentences and a
floor of words on; a single sentence counts from a higher floor on, an addition to the method for passages without a full stop.
For each sentence the shortest such run that begins with it and the shortest that ends with it are hashed and joined over the
whole corpus: a longer repeated run is covered by these, and each of them stands first no later than it does, so the
sentences that go are the same as with all runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bit_sieve, free_names, materialize, require, sieve_has
from ._words import SPACES, blocks, frugal, row_of, sequence_hashes, words

#: Floors of words: of a run of two or more sentences, and of a single one.  Without a floor (0) each pair of one-word sentences
#: that occurs twice by chance goes.  A passage of 50 words pasted behind an unfinished sentence loses its first
#: sentence and its last may be short, so the floors lie well below that.
RUN_WORDS = 12
LONG_WORDS = 25
SIEVE_BITS = 1 << 24
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


def _sentences(data: np.ndarray, offsets: np.ndarray):
    """Word hashes of a block; sentences as word positions (rows in order); sentence bounds of rows; word bytes.

    A sentence ends with a word that ends in . ! or ?, at a line break, and with the text.
    """
    hashes, bounds, starts, ends = words(data, offsets, SPACES)
    n = len(hashes)
    if not n:
        return hashes, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), starts, ends
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    last = _ENDS[data[ends - 1]]
    last[:-1] |= breaks[starts[1:]] != breaks[ends[:-1]]
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    cut = np.concatenate([[0], np.flatnonzero(last) + 1])
    return hashes, cut, np.searchsorted(cut[:-1], bounds), starts, ends


def _runs(cut: np.ndarray, rows: np.ndarray, run_words: int, long_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last sentence of every run, over all rows of a block, without repetition."""
    count = len(cut) - 1
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = row_of(rows)
    index = np.arange(count)
    # forwards: the smallest past with enough words, two sentences or one long one
    two = np.maximum(np.searchsorted(cut, cut[:-1] + run_words), index + 2)
    past = np.minimum(two, np.maximum(np.searchsorted(cut, cut[:-1] + long_words), index + 1))
    ok = past <= rows[owner + 1]
    first_f, past_f = index[ok], past[ok]
    # backwards: the largest first with enough words
    two = np.minimum(np.searchsorted(cut, cut[1:] - run_words, side="right") - 1, index - 1)
    first = np.maximum(two, np.minimum(np.searchsorted(cut, cut[1:] - long_words, side="right") - 1, index))
    ok = first >= rows[owner]
    pairs = np.unique(np.concatenate([first_f * (count + 1) + past_f, first[ok] * (count + 1) + index[ok] + 1]))
    return pairs // (count + 1), pairs % (count + 1)


def sentence_runs(docs: DataFrame, run_words: int = RUN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, text_hash, n_sentences, runs): runs are (h, first, past) of each text, sentences counted from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in blocks(batch.column("text")):
                hashes, cut, rows, _, _ = _sentences(data, offsets)
                first, past = _runs(cut, rows, run_words, long_words)
                h = sequence_hashes(hashes, cut[first], cut[past]).view(np.int64)
                owner = row_of(rows)
                row = owner[first] if len(first) else first
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row, np.arange(end - start + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(h), pa.array((first - rows[row]).astype(np.int32)), pa.array((past - rows[row]).astype(np.int32))], ["h", "first", "past"]),
                )
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(rows).astype(np.int64)), lists], ["doc_id", "text_hash", "n_sentences", "runs"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text_hash", "text").mapInArrow(frugal(run), f"doc_id {kind}, text_hash bigint, n_sentences bigint, runs array<struct<h:bigint,first:int,past:int>>")


def repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, text_hash, spans): the runs of each text that have occurred before, as sentence numbers (first, past).

    The first occurrence is the one with the smallest doc_id (null last), then text hash, then place.
    """
    table = materialize(sentence_runs(docs, run_words, long_words), "runs")
    kind = docs.schema["doc_id"].dataType
    # nulls come last
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1)) if isinstance(kind, T.LongType) else F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    every = table.select(order.alias("doc"), F.explode("runs.h").alias("h"))
    repeated = materialize(every.groupBy("h").agg(F.min("doc").alias("first_doc"), F.count("*").alias("n")).where("n > 1").select("h", "first_doc"), "repeated")
    sieve = docs.sparkSession.sparkContext.broadcast(bit_sieve(repeated, "h", SIEVE_BITS))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            flat = runs.flatten()
            row = np.repeat(np.arange(batch.num_rows), runs.value_lengths().to_numpy())
            h = flat.field("h").to_numpy()
            met = sieve_has(sieve.value, h)
            at = pa.array(row[met])
            ok = pa.array(met)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(h[met]), flat.field("first").filter(ok), flat.field("past").filter(ok)],
                ["doc_id", "text_hash", "h", "first", "past"],
            )

    seen = table.select("doc_id", "text_hash", "runs").mapInArrow(frugal(keep), f"doc_id {kind.simpleString()}, text_hash bigint, h bigint, first int, past int").withColumn("doc", order)
    met = materialize(seen.join(repeated, "h"), "met")
    # where in its first document a run stands first
    # a table of its own, so that the join below can split a run that very many texts share
    origin = materialize(met.where("doc = first_doc").groupBy("h").agg(F.min(F.struct("text_hash", "first")).alias("origin")), "origins")
    later = met.join(origin, "h").where((F.col("doc") != F.col("first_doc")) | (F.struct("text_hash", "first") != F.col("origin")))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "past")).alias("spans"))


def drop_repeats(docs: DataFrame, run_words: int = RUN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with repeated sentences cut out of text, and n_sentences, n_removed (sentences), n_removed_words added.

    The rest of a text keeps its bytes.  Null texts stay null with no sentences; texts shorter than a run never
    change; a row that is repeated with the same doc_id and text is one document and gets one result in each
    copy; existing columns of the added names are replaced; an empty table gives an empty table.
    """
    require(docs, ["doc_id", "text"])
    added = ["n_sentences", "n_removed", "n_removed_words"]
    docs = docs.drop(*added)
    fields = docs.schema.fields
    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("text_hash", F.xxhash64("text"))
    own_id, own_text, own_spans = free_names(docs, "id_", "hash_", "spans_")
    spans = repeated_runs(keyed, run_words, long_words).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_text), F.col("spans").alias(own_spans))
    own_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(F.col(own_id)) & (own_hash == F.col(own_text)), "left").drop(own_id, own_text)
    schema = T.StructType([*fields, *[T.StructField(x, T.LongType()) for x in added]])
    text_at = [f.name for f in fields].index("text")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in blocks(batch.column(text_at)):
                part = batch.slice(start, end - start)
                _, cut, rows, starts, ends = _sentences(data, offsets)
                removed, removed_words = np.zeros(end - start, np.int64), np.zeros(end - start, np.int64)
                texts = part.column(text_at)
                lists = part.column(len(fields))
                hit = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
                new: dict[int, str] = {}
                for r in hit:
                    gone = np.zeros(rows[r + 1] - rows[r] + 1, np.int64)
                    for span in lists[int(r)].as_py():
                        gone[span["first"]] += 1
                        gone[span["past"]] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    removed[r] = gone.sum()
                    kept, at = [], offsets[r]
                    for s in np.flatnonzero(gone):
                        first, past = cut[rows[r] + s], cut[rows[r] + s + 1]
                        removed_words[r] += past - first
                        kept.append(data[at : starts[first]].tobytes())
                        at = ends[past - 1]
                    kept.append(data[at : offsets[r + 1]].tobytes())
                    new[int(r)] = b"".join(kept).decode()
                if new:
                    texts = pa.array([new[i] if i in new else t for i, t in enumerate(texts.to_pylist())], texts.type)
                columns = [texts if i == text_at else part.column(i) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(rows)), pa.array(removed), pa.array(removed_words)], schema.fieldNames())

    return joined.mapInArrow(frugal(cut_out), schema)
