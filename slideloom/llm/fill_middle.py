"""Fill-in-middle: texts cut in three, the middle put last, over texts kept as seekable compressed frames.

A text is stored as independent zstandard frames of bounded size with the units and code points before each.  The
cuts are drawn in units, so each is found in the one frame that holds it; the rearranged text is made by streaming frames in
their new order into new frames.  Digests stream the frames of one text in order.  A task holds one frame at a time
beside the compressed ones of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import require
from ._words import frugal, utf8

FRAME_BYTES = 1 << 16
#: Prefix, suffix and middle begin with these in a rearranged text.
MARKERS = ("<P>", "<S>", "<M>")
_FRAMES = "frames array<binary>, sizes array<int>"


def _letters(data: np.ndarray) -> np.ndarray:
    return (data | np.uint8(0x20)) - np.uint8(ord("a")) < 26


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Whether a unit, a run of A-Z and a-z or any other code point, begins at each byte of a UTF-8 text."""
    letters = _letters(data)
    starts = letters | ((data & 0xC0) != 0x80)
    starts[1:] &= ~(letters[1:] & letters[:-1])
    return starts


class Writer:
    """Bytes in, frames out."""

    def __init__(self, size: int) -> None:
        import zstandard

        self.size, self.compressor = size, zstandard.ZstdCompressor(level=3)
        self.clear()

    def clear(self) -> None:
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.held = bytearray()

    def add(self, data: bytes | memoryview) -> None:
        self.held += data
        if len(self.held) >= self.size:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.frames.append(self.compressor.compress(bytes(self.held)))
            self.sizes.append(len(self.held))
            self.held = bytearray()

    def take(self) -> tuple[list[bytes], list[int]]:
        self.flush()
        out = self.frames, self.sizes
        self.clear()
        return out


class Reader:
    """The frames of one text: any byte range, one frame at a time."""

    def __init__(self, decompressor, frames: pa.Array, sizes: np.ndarray) -> None:
        self.decompressor, self.frames = decompressor, frames
        self.starts = np.append(0, np.cumsum(sizes))

    def frame(self, i: int) -> bytes:
        return self.decompressor.decompress(self.frames[i].as_buffer())

    def stream(self, first: int = 0, past: int | None = None) -> Iterator[memoryview]:
        """The bytes [first, past), frame by frame in order."""
        past = int(self.starts[-1]) if past is None else past
        if first >= past:
            return
        for i in range(int(np.searchsorted(self.starts, first, side="right")) - 1, int(np.searchsorted(self.starts, past, side="left"))):
            begin = int(self.starts[i])
            yield memoryview(self.frame(i))[max(first - begin, 0) : past - begin]


def _readers(batch: pa.RecordBatch, frames: str, sizes: str) -> Iterator[Reader]:
    import zstandard

    decompressor = zstandard.ZstdDecompressor()
    for f, s in zip(batch.column(frames), batch.column(sizes), strict=True):
        yield Reader(decompressor, f.values, s.values.to_numpy(zero_copy_only=False).astype(np.int64))


def _digest(parts: Iterator[memoryview]) -> str:
    out = hashlib.sha256()
    for part in parts:
        out.update(part)
    return out.hexdigest()


def _frame_ends(data: np.ndarray, size: int) -> list[int]:
    """Ends of pieces of at most ``size`` bytes (4 at least) that do not cut a code point."""
    ends, at = [], 0
    while at < len(data):
        end = min(at + max(size, 4), len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        ends.append(end)
        at = end
    return ends


def frame_store(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(doc_id, n, marked, frames, sizes, units, chars) of each row of ``docs`` (doc_id, text; other columns are ignored), to be written as a table.

    n counts the text's units; marked says whether it holds a marker; sizes are the bytes of each frame, units and chars
    the units and code points that begin before each.  A null or empty text has no frames.  Repeated rows are stored
    each; null ids stay null; a text of any length is one row of frames of at most ``frame_bytes``; an empty table gives an empty table.
    """
    require(docs, ["doc_id", "text"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = F.contains(text, F.lit(MARKERS[0])) | F.contains(text, F.lit(MARKERS[1])) | F.contains(text, F.lit(MARKERS[2]))
    rows = docs.select("doc_id", text.alias("text"), marked.alias("marked"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(1 << 62)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for start in range(0, batch.num_rows, 256):  # frames of so many texts are given out at once
                some = batch.slice(start, 256)
                made: list[tuple] = []
                for row in range(start, start + some.num_rows):
                    own = data[offsets[row] : offsets[row + 1]]
                    ends = _frame_ends(own, frame_bytes)
                    starts, points = unit_starts(own), (own & 0xC0) != 0x80
                    units, chars = [0], [0]
                    for at, end in zip([0, *ends], ends, strict=False):
                        writer.add(memoryview(own[at:end]))
                        writer.flush()
                        units.append(units[-1] + int(np.count_nonzero(starts[at:end])))
                        chars.append(chars[-1] + int(np.count_nonzero(points[at:end])))
                    made.append((units[-1], *writer.take(), units, chars))
                n, frames, sizes, units, chars = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([
                    some.column("doc_id"), pa.array(n, pa.int64()), some.column("marked"), pa.array(frames, pa.list_(pa.binary())),
                    pa.array(sizes, pa.list_(pa.int32())), pa.array(units, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int64())),
                ], ["doc_id", "n", "marked", "frames", "sizes", "units", "chars"])

    return rows.mapInArrow(frugal(run), f"doc_id {kind}, n bigint, marked boolean, {_FRAMES}, units array<bigint>, chars array<bigint>")


def drawn_cuts(store: DataFrame, seed: str = "1", percent: int = 90, suffix_first: int = 20) -> DataFrame:
    """``store`` with form (plain, psm or spm) and the units before the first and the second cut, drawn by a hash of ``seed`` and doc_id (null: empty).

    ``percent`` of the texts are cut and ``suffix_first`` percent of these become spm; a text that is empty or holds a marker stays plain.
    """
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= percent)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    return store.withColumns({"form": form, "first_cut": F.least(a, b), "second_cut": F.greatest(a, b)})


def _cut_place(reader: Reader, units: np.ndarray, chars: np.ndarray, cut: int) -> tuple[int, int]:
    """(bytes, code points) before unit ``cut`` of a text; only the frame in which it begins is read."""
    if cut >= units[-1]:
        return int(reader.starts[-1]), int(chars[-1])
    i = int(np.searchsorted(units, cut, side="right")) - 1
    data = np.frombuffer(reader.frame(i), np.uint8)
    starts = np.flatnonzero(unit_starts(data))
    if len(starts) > units[i + 1] - units[i]:  # the first letters go on with the frame before
        starts = starts[1:]
    at = int(starts[cut - units[i]])
    return int(reader.starts[i]) + at, int(chars[i]) + int(np.count_nonzero((data[:at] & 0xC0) != 0x80))


def rearranged(cut: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, frames, sizes) of the rows of :func:`drawn_cuts`: the frames of the rearranged text.

    psm is prefix, suffix, middle and spm is suffix, prefix, middle, each behind its marker; a plain text stays and has no chars.
    """
    kind = cut.schema["doc_id"].dataType.simpleString()
    p, s, m = (x.encode() for x in MARKERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(frame_bytes)
        for batch in batches:
            readers = _readers(batch, "frames", "sizes")
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                made: list[tuple] = []
                for form, first, second, units, chars in zip(*(some.column(c) for c in ("form", "first_cut", "second_cut", "units", "chars")), strict=True):
                    reader, form = next(readers), form.as_py()
                    if form == "plain":
                        order, counts = [(b"", 0, None)], (None, None)
                    else:
                        units, chars = (x.values.to_numpy(zero_copy_only=False) for x in (units, chars))
                        (a, a_chars), (b, b_chars) = (_cut_place(reader, units, chars, x.as_py()) for x in (first, second))
                        prefix, middle, suffix = (p, 0, a), (m, a, b), (s, b, None)
                        order, counts = [prefix, suffix, middle] if form == "psm" else [suffix, prefix, middle], (a_chars, b_chars - a_chars)
                    for marker, first_byte, past in order:
                        writer.add(marker)
                        for part in reader.stream(first_byte, past):
                            writer.add(part)
                    made.append((*counts, *writer.take()))
                prefix_chars, middle_chars, frames, sizes = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([
                    some.column("doc_id"), some.column("n"), some.column("form"), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()),
                    pa.array(frames, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32())),
                ], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames", "sizes"])

    return cut.mapInArrow(frugal(run), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, {_FRAMES}")


def fill_in_middle(store: DataFrame, seed: str = "1", percent: int = 90, suffix_first: int = 20, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The rearranged texts of a :func:`frame_store`, as frames; :func:`text_of` reads them."""
    return rearranged(drawn_cuts(store, seed, percent, suffix_first), frame_bytes)


def _marker_places(reader: Reader) -> list[int]:
    """The byte at which each of P, S and M begins in a rearranged text: frames are searched in order, with the end of the one before."""
    found: dict[bytes, int] = {}
    names, tail, at = [x.encode() for x in MARKERS], b"", 0
    for part in reader.stream():
        near = tail + bytes(part)
        for name in names:
            if name not in found and (i := near.find(name)) >= 0:
                found[name] = at - len(tail) + i
        at += len(part)
        tail = near[-2:]
    return [found[name] for name in names]


def original_parts(reader: Reader, form: str) -> Iterator[memoryview]:
    """The original text, frame by frame, from a rearranged one and its form alone."""
    if form == "plain":
        yield from reader.stream()
        return
    p, s, m = _marker_places(reader)
    size = len(MARKERS[0])
    yield from reader.stream(p + size, s if form == "psm" else m)
    yield from reader.stream(m + size)
    yield from reader.stream(s + size, m if form == "psm" else p)


def digests(frames: Column, sizes: Column, form: Column) -> Column:
    """SHA-256 of a rearranged text and of the original that is rebuilt from it and its form, as a struct of output and restored."""

    @F.arrow_udf("output string, restored string")
    def run(frames: pa.Array, sizes: pa.Array, form: pa.Array) -> pa.Array:
        readers = _readers(pa.RecordBatch.from_arrays([frames, sizes], ["frames", "sizes"]), "frames", "sizes")
        both = [(_digest(r.stream()), _digest(original_parts(r, f.as_py()))) for r, f in zip(readers, form, strict=True)]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in both], pa.string()) for i in (0, 1)], ["output", "restored"])

    return run(frames, sizes, form)


def text_of(frames: Column, sizes: Column) -> Column:
    """The whole text of frames."""

    @F.arrow_udf("string")
    def run(frames: pa.Array, sizes: pa.Array) -> pa.Array:
        readers = _readers(pa.RecordBatch.from_arrays([frames, sizes], ["frames", "sizes"]), "frames", "sizes")
        return pa.array([b"".join(r.stream()).decode() for r in readers], pa.string())

    return run(frames, sizes)


def original_of(frames: Column, sizes: Column, form: Column) -> Column:
    """The whole original text, rebuilt from the frames of a rearranged one and its form."""

    @F.arrow_udf("string")
    def run(frames: pa.Array, sizes: pa.Array, form: pa.Array) -> pa.Array:
        readers = _readers(pa.RecordBatch.from_arrays([frames, sizes], ["frames", "sizes"]), "frames", "sizes")
        return pa.array([b"".join(original_parts(r, f.as_py())).decode() for r, f in zip(readers, form, strict=True)], pa.string())

    return run(frames, sizes, form)
