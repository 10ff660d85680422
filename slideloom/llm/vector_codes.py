"""Vector codes: integer vectors cut into parts, each part named by the nearest entry of its position's codebook.

Everything is exact.  Components are integers, floor(scale * x).  Distances come from matrix products of float64 BLAS
that are made exact by limbs: an integer is cut into limbs so short that a product of two limb matrices, summed over a
part, stays below 2^53; the limb products are put together again in int64, and the first smallest distance wins.
A round of training is one pass over the rows: each task sums its rows by codebook entry, and only these sums, as
many as the codebooks have numbers, are grouped and brought to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, require
from ._words import frugal

#: Integer components lie below this: the squared distance of two vectors of up to 512 of them then fits into 64 bits.
COMPONENT_BITS = 26
#: Rows whose distances to a codebook are held at once.
BLOCK_ROWS = 4096
#: Sums of at most so many labels are sent to every task; those of more are joined by a shuffle.
LABELS_SENT = 100_000


def limb_bits(width: int) -> int:
    """The longest limbs of which ``width`` products add up to 2^53 at most."""
    return (53 - (max(1, width) - 1).bit_length()) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 matrices whose sum, each shifted by ``bits`` more than the one before, is ``values`` (int64)."""
    out, rest = [], values
    while rest.size and max(-int(rest.min()), int(rest.max())) > 1 << bits:
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*out, rest.astype(np.float64)]


def exact_products(a: list[np.ndarray], b: list[np.ndarray], bits: int) -> np.ndarray:
    """a times b transposed as int64, of matrices given by their limbs."""
    total = np.zeros((len(a[0]), len(b[0])), np.int64)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            total += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return total


class Codebook:
    """The entries of one part position (int64 matrix), ready for exact distances."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.bits = limb_bits(entries.shape[1])
        self.limbs = limbs(entries, self.bits)
        self.squares = (entries * entries).sum(axis=1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry to each row, of equal ones the first, and the squared distance."""
        distance = self.squares[None, :] - 2 * exact_products(limbs(rows, self.bits), self.limbs, self.bits)
        index = distance.argmin(axis=1)
        return index, distance[np.arange(len(rows)), index] + (rows * rows).sum(axis=1)


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, label, v) with v the integers floor(``scale`` * x) of each vector.

    Rows whose vector is null or empty, or holds a null, NaN or infinite component, are left out.  An integer of more than
    COMPONENT_BITS bits is an error, as distances would not fit into 64 bits.
    """
    require(vectors, ["vec_id", "embedding"])
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    numbers = F.col("embedding").cast("array<double>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: F.floor(x * F.lit(float(scale)))
    too_large = F.raise_error(F.lit(f"a component times {scale} has more than {COMPONENT_BITS} bits")).cast("long")
    whole = F.transform(numbers, lambda x: F.when(F.abs(x) * F.lit(float(scale)) < float(1 << COMPONENT_BITS), scaled(x)).otherwise(too_large))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite).select("vec_id", label.alias("label"), whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _assigned(batches: Iterator[pa.RecordBatch], books: list[Codebook]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Blocks of rows with their parts, the code of each part, and the error."""
    width = books[0].entries.shape[1]
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            whole = _matrix(part.column("v"), width * len(books))
            pieces = [np.ascontiguousarray(whole[:, i * width : (i + 1) * width]) for i in range(len(books))]
            found = [book.nearest(piece) for book, piece in zip(books, pieces, strict=True)]
            yield part, pieces, np.stack([f[0] for f in found], axis=1), np.sum([f[1] for f in found], axis=0)


def _entry_sums(books: Callable[[], list[Codebook]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books()
        entries, width = own[0].entries.shape
        totals = np.zeros((len(own), entries, width), np.int64)
        counts = np.zeros((len(own), entries), np.int64)
        columns = np.arange(width)
        for _, pieces, codes, _ in _assigned(batches, own):
            for i, piece in enumerate(pieces):
                code = codes[:, i]
                counts[i] += np.bincount(code, minlength=entries)
                # below 2^53: BLOCK_ROWS components of COMPONENT_BITS bits
                sums = np.bincount((code[:, None] * width + columns).ravel(), weights=piece.ravel().astype(np.float64), minlength=entries * width)
                totals[i] += sums.astype(np.int64).reshape(entries, width)
        part, entry = np.nonzero(counts)
        if len(part):
            slot = np.repeat((part * entries + entry) * width, width) + np.tile(columns, len(part))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(totals[part, entry].ravel()), pa.array(np.repeat(counts[part, entry], width))], ["slot", "total", "n"])

    return run


def fit_codebooks(numbers: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """A codebook (int64 matrix of at most ``entries`` rows) for each of ``parts`` positions of the vectors ``v`` of :func:`integer_vectors`.

    Codebooks begin with the parts of the vectors with the smallest vec_id (nulls last, equal ids by vector).  Each round
    assigns all rows and sets every entry to the floored mean of its parts; an unused entry stays.  The first of
    these vectors whose length ``parts`` divides sets the length; vectors of another one take no part.  Without rows there are no codebooks.
    """
    fit = numbers.where(F.size("v") % parts == 0)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    first = fit.orderBy(*order).limit(1).select(F.size("v").alias("n")).first()  # one row
    if first is None:
        return []
    width = first["n"] // parts
    fit = fit.where(F.size("v") == width * parts).select("vec_id", "v")
    start = _matrix(fit.orderBy(*order).limit(entries).select("v").toArrow()["v"].combine_chunks(), width * parts)  # at most ``entries`` rows
    books = [start[:, i * width : (i + 1) * width].copy() for i in range(parts)]
    context = numbers.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(books)
        sums = fit.select("v").mapInArrow(_entry_sums(lambda shared=shared: [Codebook(b) for b in shared.value]), "slot bigint, total bigint, n bigint")
        got = sums.groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()  # as many rows as the codebooks have numbers
        flat = np.stack(books).ravel()
        flat[got["slot"].to_numpy()] = got["total"].to_numpy() // got["n"].to_numpy()
        books = list(flat.reshape(parts, len(start), width))
        shared.unpersist()
    return books


def encode_vectors(numbers: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): the index of the nearest entry of every part, two hexadecimal digits each, and the sum of the squared distances.

    Vectors of another length than the codebooks' are left out; repeated rows are coded each; no codebooks, no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in numbers.schema.fields}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"
    if not books:
        return numbers.sparkSession.createDataFrame([], schema)
    shared = numbers.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, codes, error in _assigned(batches, [Codebook(b) for b in shared.value]):
            digits, step = codes.astype(np.uint8).tobytes().hex(), 2 * codes.shape[1]
            text = pa.array([digits[i : i + step] for i in range(0, len(digits), step)], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), text, pa.array(error)], ["vec_id", "label", "code", "error"])

    return numbers.where(F.size("v") == sum(b.shape[1] for b in books)).mapInArrow(frugal(run), schema)


def decode_vectors(coded: DataFrame, books: list[np.ndarray], scale: int = 1024) -> DataFrame:
    """``coded`` with ``approximation``, the entries that the code names, as numbers of the original scale; a null code has none."""
    width = books[0].shape[1] if books else 0
    table = F.array(*[F.array(*[F.array(*[F.lit(x / scale) for x in entry.tolist()]) for entry in book]) for book in books])
    place = lambda i: F.conv(F.substring("code", 2 * i + 1, 2), 16, 10).cast("int")
    parts = [F.get(F.get(table, F.lit(i)), place(i)) for i in range(len(books))]
    return coded.withColumn("approximation", F.concat(*parts) if width else F.array().cast("array<double>"))


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) of all vectors (vec_id, embedding, and label if there is one), and their codebooks.

    label_error is the error summed over the rows with the same label; null labels count as one.  What is left out:
    see :func:`integer_vectors` and :func:`encode_vectors`.  Other columns are ignored; an empty table gives an empty table.
    """
    numbers = materialize(integer_vectors(vectors, scale), "integers")
    books = fit_codebooks(numbers, parts, entries, rounds)
    coded = materialize(encode_vectors(numbers, books), "codes")
    sums = materialize(coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error")), "label-errors")
    few = sums.count() <= LABELS_SENT
    return coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("own"))).drop("own"), books
