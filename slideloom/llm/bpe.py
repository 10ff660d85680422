"""Byte-level BPE by a table of distinct words: texts to ids and ids to texts, as the tokenizers library does.

Texts are split into words in Spark, by the vocabulary's own rules.  Every distinct word is encoded once; its ids come
back to the word's places by a join.  Words that tasks see often are sent to all tasks, in a table of bounded size;
all others meet their ids in a shuffle by word.  What a text keeps meanwhile is the list of its words' numbers.
Ids are decoded by a join with the table of pieces, which has a row for each id of the vocabulary and so fits every task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, require
from ._words import blocks, frugal, mix, slices, utf8

#: Postings of a word longer than Sizes.long_word are spread over so many tasks.
SALTS = 64


class Sizes(NamedTuple):
    """What tasks hold and give out; results do not depend on it."""

    #: A word is a candidate for the table that is sent to all tasks if some task has seen it so often.
    frequent: int = 3
    #: That table has the most frequent candidates, at most so many words and so many bytes of them; longer words are no candidates.
    sent_words: int = 1 << 19
    sent_bytes: int = 1 << 23
    long_word: int = 256
    #: Distinct words that a task holds before it gives out the frequent ones and begins anew.
    held_words: int = 1_000_000
    #: Distinct words of stretches that wait until they are added to those.
    merged: int = 300_000
    #: Bytes of text in a block, whose words' numbers are kept together, and in a stretch, which is split at once.
    block: int = 1 << 18
    stretch: int = 1 << 21
    #: Ids that a task gathers before it packs them by block.
    packed: int = 200_000


_SPACE, _LETTER, _NUMBER, _OTHER, _ADDED = range(5)


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str):
    """The library's tokenizer of a vocabulary file, with one thread."""
    import os

    import public_tokenizers
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = tokenizers.Tokenizer.from_file(public_tokenizers.path(vocabulary))
    split = found.pre_tokenizer
    if type(split).__name__ != "ByteLevel" or split.add_prefix_space or not split.use_regex or found.normalizer is not None:
        raise ValueError(f"{vocabulary} is not a plain byte-level vocabulary")
    found.no_truncation()
    found.no_padding()
    return found


def added_pattern(vocabulary: str) -> re.Pattern[bytes] | None:
    """The added tokens of a vocabulary, which are words wherever they stand in a text."""
    added = tokenizer(vocabulary).get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word for t in added):
        raise ValueError(f"{vocabulary} has added tokens with rules of their own")
    return re.compile(b"|".join(re.escape(t.content.encode()) for t in sorted(added, key=lambda t: -len(t.content)))) if added else None


def character_classes(vocabulary: str) -> np.ndarray:
    """Space, letter, number or other for every code point, as the library itself splits them.

    All code points but the space stand in one text; the library cuts it where the class changes, and each piece is
    classed by what it sticks to.
    """
    split = tokenizer(vocabulary).pre_tokenizer.pre_tokenize_str
    points = np.array([p for p in range(0x110000) if p != 0x20 and not 0xD800 <= p < 0xE000], "<u4")
    pieces = [span for _, span in split(points.tobytes().decode("utf-32-le"))]

    def class_of(c: str) -> int:
        begins = {span[0] for _, span in split(f"a{c}1!{c}!")}
        return _LETTER if 1 not in begins else _NUMBER if 2 not in begins else _OTHER if 4 not in begins else _SPACE

    table = np.full(0x110000, _OTHER, np.uint8)
    table[0x20] = _SPACE
    for first, past in pieces:
        table[points[first:past]] = class_of(chr(points[first]))
    return table


def word_starts(codes: np.ndarray, classes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Whether a word begins at each of ``codes`` (code points); ``edge`` marks where a text or an added token begins or ends.

    A word is a run of one class with one space before it, or 's 't 're 've 'm 'll 'd where a word begins, or a run of
    white space without the last one that other characters follow.
    """
    starts = edge.copy()
    starts[1:] |= classes[1:] != classes[:-1]
    starts[1:] &= edge[1:] | (classes[1:] != _ADDED)
    after = np.flatnonzero(starts[1:] & ~edge[1:] & (classes[:-1] == _SPACE) & (classes[1:] != _SPACE)) + 1
    starts[after - 1] = True
    starts[after[codes[after - 1] == 0x20]] = False
    ends = np.append(edge, True)
    mark = np.flatnonzero((codes == ord("'")) & starts & ~ends[1:])
    next1 = codes[mark + 1]
    short = np.isin(next1, [ord(c) for c in "stmd"])
    rest, next1 = mark[~short], next1[~short]
    inside = ~ends[rest + 2]
    rest, next1 = rest[inside], next1[inside]
    next2 = codes[rest + 2]
    long = np.zeros(len(rest), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (next1 == ord(a)) & (next2 == ord(b))
    for places, size in ((mark[short], 2), (rest[long], 3)):
        starts[places + 1] = False
        past = places + size
        starts[past[past < len(starts)]] = True
    return starts


class Splitter:
    """Splits text columns into words."""

    def __init__(self, classes: np.ndarray, added: re.Pattern[bytes] | None, sizes: Sizes = Sizes()) -> None:
        self.classes, self.added, self.sizes = classes, added, sizes

    def _cut(self, data: np.ndarray, at: int) -> int:
        """The end of the stretch of one text that begins at ``at``: between a letter or digit and a space with a letter behind."""
        stretch = self.sizes.stretch
        end = at + stretch
        while end + 1 < len(data):
            near = data[end - 1 : end + stretch]
            word = (near | 0x20) - ord("a") < 26
            cut = np.flatnonzero(word[:-2] & (near[1:-1] == 0x20) & word[2:])
            if len(cut):
                return end + int(cut[0])
            end += stretch
        return len(data)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Words of some texts (bytes, and rows + 1 offsets) in order, and the row of each; a very long text comes in stretches."""
        if len(offsets) > 2 or len(data) <= self.sizes.stretch:
            yield self._split(data, offsets)
            return
        at = 0
        while at < len(data):
            end = self._cut(data, at) if at + self.sizes.stretch < len(data) else len(data)
            yield self._split(data[at:end], np.array([0, end - at]))
            at = end

    def _split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        if not len(data):
            return pa.array([], pa.large_string()), np.zeros(0, np.int64)
        raw = data.tobytes()
        if data.max() < 0x80:
            codes, place = data, np.arange(len(data) + 1)
        else:
            codes = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
            place = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64), out=place[1:])
        edge = np.zeros(len(codes) + 1, bool)
        edge[np.searchsorted(place, offsets)] = True
        classes = self.classes[codes]
        if self.added and self.added.search(raw):
            for row in range(len(offsets) - 1):
                for m in self.added.finditer(raw[offsets[row] : offsets[row + 1]]):
                    first, past = np.searchsorted(place, offsets[row] + np.array(m.span()))
                    edge[[first, past]] = True
                    classes[first:past] = _ADDED
        starts = np.flatnonzero(word_starts(codes, classes, edge[:-1]))
        bounds = np.append(place[starts], len(data))
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw))
        return found, np.searchsorted(offsets, bounds[:-1], side="right") - 1


def _pieces_of(vocabulary: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of ids of each word, and all ids in order."""
    found = [e.ids for e in tokenizer(vocabulary).encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
    return np.fromiter(map(len, found), np.int32, len(found)), np.array([i for ids in found for i in ids], np.int32)


def _frequent_words(split: Callable[[], Splitter]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words that a task sees often, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        waiting: list[pa.Table] = []
        rows = 0
        splitter = split()
        sizes = splitter.sizes

        def merged() -> pa.Table:
            tables = waiting if held is None else [held, *waiting]
            return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            often = table.filter(pc.and_(pc.greater_equal(table["n"], sizes.frequent), pc.less_equal(pc.binary_length(table["word"]), sizes.long_word)))
            yield from often.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=50_000)

        for batch in slices(batches, limit=sizes.stretch):
            for words, _ in splitter.words(*utf8(batch.column("text"))):
                seen = pc.value_counts(words)
                now = pa.table({"word": seen.field("values"), "n": seen.field("counts")})
                waiting.append(now)
                rows += now.num_rows
                if rows > sizes.merged:
                    held, waiting, rows = merged(), [], 0
                    if held.num_rows > sizes.held_words:
                        yield from flush(held)
                        held = None
        if held is not None or waiting:
            yield from flush(merged())

    return run


def sent_words(docs: DataFrame, vocabulary: str, split: Callable[[], Splitter], limits: Sizes = Sizes()) -> pa.Table:
    """(word, ids) of the most frequent words of the corpus, each encoded once; within the limits."""
    often = materialize(docs.select("text").mapInArrow(frugal(_frequent_words(split)), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "frequent-words")
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = often.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes")).orderBy(F.desc("level")).collect()  # 8 rows for each doubling
    words = size = 0
    least = None
    for r in sizes:
        words, size = words + r["words"], size + r["bytes"]
        if words > limits.sent_words or size > limits.sent_bytes:
            break
        least = r["level"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids = _pieces_of(vocabulary, batch.column("word"))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), lists], ["word", "n", "ids"])

    kept = often.where(F.lit(False) if least is None else level >= least)
    table = kept.mapInArrow(frugal(encode), "word string, n bigint, ids array<int>").toArrow()
    return table.sort_by([("n", "descending"), ("word", "ascending")]).select(["word", "ids"]).combine_chunks()


class _Sent:
    """The words sent to all tasks: their number by word, and their ids by number."""

    def __init__(self, table: pa.Table) -> None:
        self.words = table["word"].combine_chunks().cast(pa.large_string())
        lists = table["ids"].combine_chunks()
        self.sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)

    def __len__(self) -> int:
        return len(self.words)


def _numbered(batches: Iterator[pa.RecordBatch], splitter: Splitter, sent: _Sent) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, pa.Array, np.ndarray]]:
    """Blocks of rows: key, rows, the row of each word, the block's distinct other words, and the number of each word.

    The number of a word in the table is its place there; other words are numbered on.
    The key comes from the block's first row number and its content.
    """
    for batch in slices(batches, limit=splitter.sizes.stretch):
        numbers, rows, dictionaries, size = [], [], [], 0
        for words, row in splitter.words(*utf8(batch.column("text"))):
            coded = words.dictionary_encode()
            place = pc.fill_null(pc.index_in(coded.dictionary, value_set=sent.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.where(place < 0, -1 - size - np.arange(len(place)), place)  # others by their place in the dictionaries, below zero
            numbers.append(place[coded.indices.to_numpy(zero_copy_only=False)])
            rows.append(row)
            dictionaries.append(coded.dictionary)
            size += len(place)
        if not rows:
            numbers, rows, dictionaries = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [pa.array([], pa.large_string())]
        number, row, dictionary = np.concatenate(numbers), np.concatenate(rows), pa.concat_arrays(dictionaries)
        for start, end, _, _ in blocks(batch.column("text"), splitter.sizes.block):
            part = batch.slice(start, end - start)
            first, past = np.searchsorted(row, [start, end])
            own = number[first:past].copy()
            other = np.flatnonzero(own < 0)
            codes, k = np.unique(-1 - own[other], return_inverse=True)
            own[other] = len(sent) + k
            seal = np.cumsum(mix(own.astype(np.uint64)), dtype=np.uint64)[-1:].sum(dtype=np.uint64) + np.uint64(part.column("row")[0].as_py())
            yield int(mix(np.array([seal], np.uint64)).view(np.int64)[0]), part, row[first:past] - start, dictionary.take(pa.array(codes)), own


def encode_texts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limits: Sizes = Sizes()) -> DataFrame:
    """(doc_id, ids) of each row of ``docs`` (doc_id, text; other columns are ignored): ids of the whole text, no special ones added.

    A null or empty text has no ids; the strings of added tokens in a text are such tokens, as the library has it by
    default.  Repeated rows are encoded each; a null doc_id stays null; an empty table gives an empty table.  ``docs`` is read
    three times and must give the same rows in the same order each time, like a table of files does; otherwise the job fails.
    """
    require(docs, ["doc_id", "text"])
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    context = docs.sparkSession.sparkContext
    rules = context.broadcast((character_classes(vocabulary), added_pattern(vocabulary)))
    split = lambda: Splitter(*rules.value, limits)
    table = context.broadcast(sent_words(docs, vocabulary, split, limits))
    numbered = docs.withColumn("row", F.monotonically_increasing_id())

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, rows, others, number in _numbered(batches, split(), _Sent(table.value)):
            bounds = np.searchsorted(rows, np.arange(part.num_rows + 1)).tolist()
            planes = np.ascontiguousarray(number.astype("<u4").view(np.uint8).reshape(-1, 4).T)
            packed = pa.compress(planes.tobytes(), codec="zstd", asbytes=True)
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array([key]), ids, pa.array([bounds], pa.list_(pa.int32())), pa.array([len(others)], pa.int32()), pa.array([packed], pa.binary())], ["block", "doc_ids", "bounds", "others", "numbers"])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, _, others, _ in _numbered(batches, split(), _Sent(table.value)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), key)), pa.array(np.arange(len(others), dtype=np.int32)), others.cast(pa.string())], ["block", "k", "word"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of each posting, packed by block; words come sorted, so that each is encoded once."""
        gathered: list[tuple[np.ndarray, ...]] = []
        last: tuple[str, np.ndarray] | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            block, k, size = (np.concatenate([g[i] for g in gathered]) for i in range(3))
            ids = np.concatenate([g[3] for g in gathered])
            first = np.cumsum(size) - size
            order = np.lexsort((k, block))
            edges = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
            sorted_ids = ids[np.repeat(first[order] - (np.cumsum(size[order]) - size[order]), size[order]) + np.arange(len(ids))]
            size_bounds = np.append(0, np.cumsum(size[order]))
            places = np.append(edges, len(order)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(block[order][edges]), pa.ListArray.from_arrays(pa.array(places), pa.array(k[order])), pa.ListArray.from_arrays(pa.array(places), pa.array(size[order].astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(size_bounds[places].astype(np.int32)), pa.array(sorted_ids)),
            ], ["block", "k", "sizes", "ids"])

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("word").dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False)
            known = last is not None and coded.dictionary[0].as_py() == last[0]
            sizes, ids = _pieces_of(vocabulary, coded.dictionary[1:] if known else coded.dictionary)
            if known:
                sizes, ids = np.append(np.int32(len(last[1])), sizes), np.concatenate([last[1], ids])
            firsts = np.cumsum(sizes) - sizes
            last = (coded.dictionary[-1].as_py(), ids[firsts[-1] :])
            size = sizes[index].astype(np.int64)
            spread = np.repeat(firsts[index] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            gathered.append((batch.column("block").to_numpy(), batch.column("k").to_numpy(), size, ids[spread]))
            held += int(size.sum())
            if held > limits.packed:
                yield from flush()
                gathered, held = [], 0
        if gathered:
            yield from flush()

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent(table.value)
        for batch in batches:
            for row in range(batch.num_rows):
                bounds = batch.column("bounds")[row].values.to_numpy(zero_copy_only=False)
                planes = np.frombuffer(pa.decompress(batch.column("numbers")[row].as_py(), decompressed_size=4 * int(bounds[-1]), codec="zstd"), np.uint8)
                number = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
                parts = batch.column("found")[row].values
                n_others = batch.column("others")[row].as_py()
                k, sizes, ids = ((np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in parts.field(f)]) if parts is not None and len(parts) else np.zeros(0, np.int32)) for f in ("k", "sizes", "ids"))
                if len(k) != n_others or not np.array_equal(np.sort(k), np.arange(n_others)):
                    raise RuntimeError("the documents came in another order when they were read again; write them as a table first")
                own_sizes, own_firsts = np.zeros(n_others, np.int64), np.zeros(n_others, np.int64)
                own_sizes[k], own_firsts[k] = sizes, np.cumsum(sizes) - sizes
                is_sent = number < len(sent)
                size, first = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
                size[is_sent], first[is_sent] = sent.sizes[number[is_sent]], sent.firsts[number[is_sent]]
                other = number[~is_sent] - len(sent)
                size[~is_sent], first[~is_sent] = own_sizes[other], own_firsts[other] + len(sent.ids)
                past = np.cumsum(size)
                all_ids = np.concatenate([sent.ids, ids])[np.repeat(first - (past - size), size) + np.arange(int(size.sum()))]
                edges = np.append(0, past)[bounds]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[row].values, pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(all_ids.astype(np.int32)))], ["doc_id", "ids"])

    kept = numbered.mapInArrow(frugal(lists), f"block bigint, doc_ids array<{kind}>, bounds array<int>, others int, numbers binary")
    salt = F.when(F.octet_length("word") > limits.long_word, F.pmod("block", F.lit(SALTS))).otherwise(0)
    wanted = numbered.mapInArrow(frugal(postings), "block bigint, k int, word string").withColumn("salt", salt)
    found = wanted.repartition("word", "salt").sortWithinPartitions("word").mapInArrow(frugal(look_up), "block bigint, k array<int>, sizes array<int>, ids array<int>")
    by_block = found.groupBy("block").agg(F.collect_list(F.struct("k", "sizes", "ids")).alias("found"))
    return kept.join(by_block, "block", "left").select("doc_ids", "bounds", "others", "numbers", "found").mapInArrow(frugal(restore), f"doc_id {kind}, ids array<int>")


@lru_cache(maxsize=2)
def piece_table(vocabulary: str) -> pa.Array:
    """The bytes of each id; null where there is none."""
    known = tokenizer(vocabulary)
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # these bytes stand for themselves in pieces
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}

    def piece(text: str | None) -> bytes | None:
        if text is None:
            return None
        return bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode()

    return pa.array([piece(known.id_to_token(i)) for i in range(max(known.get_vocab().values()) + 1)], pa.large_binary())


def decoded(ids: Column, vocabulary: str = "byte_bpe_50k.json") -> Column:
    """The text of an array of ids, as the library decodes it with special tokens; ids that are none have no piece, broken UTF-8 reads U+FFFD, null is null."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        table = piece_table(vocabulary)
        own = lists.flatten()
        at = np.append(0, np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)))
        is_id = pc.and_(pc.greater_equal(own, 0), pc.less(own, len(table)))
        joined = pc.fill_null(table.take(pc.if_else(is_id, own, pa.scalar(None, pa.int32()))), b"")
        data, offsets = utf8_of(joined)
        edges = offsets[at]
        raw = data.tobytes()
        try:
            raw.decode()
            whole = bool(np.all((data[edges[edges < len(data)]] & 0xC0) != 0x80)) if len(data) else True
        except UnicodeDecodeError:
            whole = False
        if whole and not lists.null_count and len(raw) < 1 << 31:
            return pa.StringArray.from_buffers(len(lists), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw))
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pc.if_else(lists.is_valid(), pa.array(texts, pa.string()), pa.scalar(None, pa.string()))

    return decode(ids)


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids_digest(ids: Column) -> Column:
    """SHA-256 of an array of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("string")
    def digest(lists: pa.Array) -> pa.Array:
        import hashlib

        own = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        at = np.append(0, np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)))
        return pa.array([hashlib.sha256(own[a:b]).hexdigest() if b > a else hashlib.sha256(b"").hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())

    return digest(ids)
