"""Language identification by prediction by partial matching.

For every language a variable-order tree of byte contexts (up to four bytes) is counted on labelled texts
and then frozen.  A byte costs its code length under the longest context that has seen it; every longer
context that was seen without this byte first costs its escape (method C: an escape weighs as many counts as
the context has distinct followers).  The language with the shortest code for the whole text wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import require
from ._words import STRETCH, blocks, frugal, give_back, mix

ORDER = 4
#: Labelled texts that the contexts are counted on, for each language (about: texts are chosen by hash).
SAMPLE_PER_LANGUAGE = 400
UNDETERMINED = "und"


def _pieces(data: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Some bytes at a time: the first position and, of each position, its row, its place in the row and its packed (context, byte)."""
    for low in range(0, len(data), STRETCH):
        high = min(len(data), low + STRETCH)
        before = min(low, order)
        part = data[low - before : high]
        key = part.astype(np.uint64)
        for i in range(1, order + 1):
            key[i:] |= part[:-i].astype(np.uint64) << np.uint64(8 * i)
        place = np.arange(low, high)
        row = np.searchsorted(offsets, place, side="right") - 1
        yield low, row, place - offsets[row], key[before:]


def context_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, depth, key, n): how often each byte follows each context of ``depth`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                own = batch.filter(pa.array(langs == lang))
                for _, _, data, offsets in blocks(own.column("text")):
                    for depth, (_, _, inside, key) in ((d, p) for d in range(order + 1) for p in _pieces(data, offsets, d)):
                        found, n = np.unique(key[inside >= depth], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(found), pa.string()), pa.array(np.full(len(found), depth, np.int32)), pa.array(found.view(np.int64)), pa.array(n)],
                            ["lang", "depth", "key", "n"],
                        )

    counted = labelled.select("lang", "text").mapInArrow(frugal(run), "lang string, depth int, key bigint, n bigint")
    return counted.groupBy("lang", "depth", "key").agg(F.sum("n").alias("n"))


class _Table:
    """Open addressing from 64-bit keys to rows of numbers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros((1 << self.bits, values.shape[1]), np.float32)
        self.probes = 0
        todo = np.arange(len(keys))
        while len(todo):
            slot = self._slots(keys[todo], self.probes)
            free = self.keys[slot] == np.iinfo(np.uint64).max
            _, one = np.unique(slot, return_index=True)
            take = np.zeros(len(todo), bool)
            take[one] = True
            take &= free
            self.keys[slot[take]] = keys[todo[take]]
            self.values[slot[take]] = values[todo[take]]
            todo = todo[~take]
            self.probes += 1

    def _slots(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((mix(keys + np.uint64(probe + 1)) >> np.uint64(64 - self.bits))).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key, or -1."""
        slot = self._slots(keys, 0)
        held = self.keys[slot]
        out = np.where(held == keys, slot, -1)
        todo = np.flatnonzero((held != keys) & (held != np.iinfo(np.uint64).max))
        for probe in range(1, self.probes):
            if not len(todo):
                break
            slot = self._slots(keys[todo], probe)
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = slot[hit]
            todo = todo[~hit & (held != np.iinfo(np.uint64).max)]
        return out


@dataclass
class PPM:
    """Frozen statistics: for each depth the code lengths of bytes, and the escape cost of contexts, in bits."""

    languages: list[str]
    bytes_: list[_Table]
    escapes: list[_Table]

    @classmethod
    def fit(cls, names: np.ndarray, lang: np.ndarray, depth: np.ndarray, key: np.ndarray, n: np.ndarray, order: int = ORDER) -> PPM:
        """From counts: ``lang`` holds places in ``names``."""
        languages = sorted(names)
        who = np.array([languages.index(x) for x in names], np.int64)[lang]
        count = len(languages)
        byte_tables: list[_Table] = []
        escape_tables: list[_Table] = []
        for d in range(order + 1):
            at = depth == d
            keys, inverse = np.unique(key[at], return_inverse=True)
            seen = np.zeros((len(keys), count), np.float32)
            seen[inverse, who[at]] = n[at]
            context, group = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(context), count)), np.zeros((len(context), count))
            np.add.at(total, group, seen)
            np.add.at(kinds, group, (seen > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                cost = -np.log2(seen / (total + kinds)[group])
            # a language that lacks the byte here escapes and pays at the next shorter context
            if d:
                shorter = cls._cost(keys & np.uint64((1 << (8 * d)) - 1), byte_tables, escape_tables, d - 1, count)
            else:
                shorter = np.full((len(keys), count), 8.0)
            cost = np.where(seen > 0, cost, escape[group] + shorter)
            byte_tables.append(_Table(keys, cost.astype(np.float32)))
            escape_tables.append(_Table(context, escape.astype(np.float32)))
        return cls(languages, byte_tables, escape_tables)

    @staticmethod
    def _cost(key: np.ndarray, byte_tables: list[_Table], escape_tables: list[_Table], depth: int, count: int, limit: np.ndarray | None = None) -> np.ndarray:
        """Bits of every (context, byte) in every language, from ``depth`` (or the row's own limit) down."""
        out = np.zeros((len(key), count), np.float32)
        todo = np.arange(len(key))
        for d in range(depth, -1, -1):
            mask = np.uint64((1 << (8 * (d + 1))) - 1)
            if limit is None:
                now, later = todo, None
            else:
                can = limit[todo] >= d
                now, later = todo[can], todo[~can]
            own = key[now] & mask
            slot = byte_tables[d].find(own)
            hit = slot >= 0
            out[now[hit]] += byte_tables[d].values[slot[hit]]
            miss = now[~hit]
            escape = escape_tables[d].find(own[~hit] >> np.uint64(8))
            known = escape >= 0
            out[miss[known]] += escape_tables[d].values[escape[known]]
            todo = miss if later is None else np.concatenate([miss, later])
            if not len(todo):
                return out
        out[todo] += 8.0
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of every row of a block in every language."""
        rows, count = len(offsets) - 1, len(self.languages)
        out = np.zeros((rows, count))
        if not len(data):
            return out
        depth = len(self.bytes_) - 1
        for low, row, inside, key in _pieces(data, offsets, depth):
            # the first bytes of a row have shorter contexts
            cost = self._cost(key, self.bytes_, self.escapes, depth, count, None if (inside >= depth).all() else np.minimum(inside, depth))
            own = np.unique(row)
            out[own] += np.add.reduceat(cost, np.maximum(offsets[own] - low, 0), axis=0, dtype=np.float64)
        return out


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, order: int = ORDER, seed: str = "ppm") -> PPM | None:
    """Count contexts on about ``per_language`` labelled texts of each language (doc_id, text, lang), chosen by a hash of doc_id.

    Only texts and labels that are not null are used; None if there are none.
    """
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    size = labelled.groupBy("lang").agg(F.count("*").alias("size"))
    if size.isEmpty():
        return None
    draw = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(""))), F.lit(1_000_000)) / 1_000_000
    sample = labelled.join(F.broadcast(size), "lang").where(draw * F.col("size") < per_language)  # one row per language
    rows = context_counts(sample, order).toArrow()  # bounded by the sample
    if not rows.num_rows:
        return None
    lang = rows["lang"].combine_chunks().dictionary_encode()
    names = np.array(lang.dictionary.to_pylist(), dtype=object)
    columns = [rows[c].combine_chunks().to_numpy() for c in ("depth", "key", "n")]
    del rows
    model = PPM.fit(names, lang.indices.to_numpy(), columns[0], columns[1].view(np.uint64), columns[2].astype(np.float32), order)
    del lang, columns
    give_back()
    return model


def identify(docs: DataFrame, model: PPM | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with lang_pred and score (``names``) added, in one pass; the prediction sees the whole text and nothing else.

    score is the chance of the language when the mean code lengths per byte, ten times sharpened, are read as
    log odds.  A null text or one without any letter gives ``und`` with score 0, as does any text without a model (no
    labelled text).  Repeated rows are read each; existing columns of these names are replaced; an empty table gives an
    empty table.
    """
    require(docs, ["text"])
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for start, end, data, offsets in blocks(batch.column("text")):
                part = batch.slice(start, end - start)
                letter = _has_letter(part.column(at), data, offsets)
                if ppm is None:
                    found, score = [UNDETERMINED] * (end - start), np.zeros(end - start)
                else:
                    bits = ppm.bits(data, offsets)
                    mean = bits / np.maximum(1, np.diff(offsets))[:, None]
                    odds = np.exp2(-10.0 * (mean - mean.min(axis=1, keepdims=True)))
                    best = bits.argmin(axis=1)
                    score = np.where(letter, 1.0 / odds.sum(axis=1), 0.0)
                    found = [ppm.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letter, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(score)], [*part.schema.names, *names])

    return docs.mapInArrow(frugal(run), schema)


def _has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = ((data | 0x20) >= ord("a")) & ((data | 0x20) <= ord("z"))
    out, filled = np.zeros(len(offsets) - 1, bool), np.flatnonzero(np.diff(offsets))
    if len(filled):
        out[filled] = np.logical_or.reduceat(ascii_letter, offsets[filled])
    for i in np.flatnonzero(~out):
        text = column[int(i)].as_py()
        out[i] = bool(text) and any(c.isalpha() for c in text)
    return out
