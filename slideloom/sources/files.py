"""Files as tables: manifests, image records and headers, and slides of decks."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slideloom.functions import scalars

SLIDE_SCHEMA = "file_path string, file_name string, slide_number int, text string, error string"
#: Slides, and bytes of their text, that a task gives on at a time.
SLIDES_OUT = 10_000
SLIDE_BYTES = 1 << 23


def load_image_records(files: DataFrame) -> DataFrame:
    """Files (path, content) with image_base64 (no line breaks), file_name and source_type in place of content."""
    text = F.translate(F.base64("content"), "\r\n", "")
    return files.withColumns({"image_base64": text, "file_name": scalars.base_name(F.col("path")), "source_type": F.lit("image_file")}).drop("content")


def file_manifest(files: DataFrame, bits: int = 512) -> DataFrame:
    """Files (path, content) with ``sha`` (SHA-2 in hexadecimal digits) and ``bytes`` in place of content."""
    return files.withColumns({"sha": F.sha2("content", bits), "bytes": F.length("content").cast("long")}).drop("content")


def _image_header(data: bytes | None) -> tuple[str | None, int | None, int | None]:
    """Format, width and height from the first bytes of a PNG, JPEG or WebP file."""
    none = (None, None, None)
    if not data:
        return none
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        return ("PNG", *struct.unpack(">II", data[16:24]))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return "WEBP", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return "WEBP", w & 0x3FFF, h & 0x3FFF
        if kind == b"VP8L":
            packed = int.from_bytes(data[21:25], "little")
            return "WEBP", 1 + (packed & 0x3FFF), 1 + (packed >> 14 & 0x3FFF)
        return none
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            marker = data[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "JPEG", w, h
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return none


def check_image_headers(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid with format, width and height, invalid) of files (path, content); content is dropped."""

    @F.pandas_udf("format string, width int, height int")
    def header(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_image_header(x) for x in content], columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    judged = files.withColumn("_h", header("content")).drop("content").select("*", "_h.*").drop("_h")
    return judged.where("format IS NOT NULL"), judged.where("format IS NULL").drop("format", "width", "height")


def deck_texts(content: bytes) -> Iterator[tuple[int, str | None, str | None]]:
    """(slide number, text, error) of each slide part of a presentation package."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
        for number, name in sorted(parts):
            try:
                tree = ElementTree.fromstring(z.read(name))
            except (ElementTree.ParseError, zipfile.BadZipFile, KeyError) as e:
                yield number, None, str(e)
                continue
            yield number, "\n".join("".join([t.text or "" for t in p.iter() if t.tag.endswith("}t")]) for p in tree.iter() if p.tag.endswith("}p")), None


def explode_deck_slides(decks: DataFrame, extractor: Callable[[bytes], Iterator] = deck_texts) -> tuple[DataFrame, DataFrame]:
    """(slides, failures) of decks (path, content): a bad slide or a bad deck is a row of failures, the others stay.

    Slides of many small decks go on together, about SLIDES_OUT at a time or SLIDE_BYTES of text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decks = ((path.as_py(), content.as_py()) for batch in batches for path, content in zip(batch.column("path"), batch.column("content"), strict=True))
        return _slide_batches(decks, extractor)

    out = decks.select("path", "content").mapInArrow(run, SLIDE_SCHEMA)
    return out.where("error IS NULL").drop("error"), out.where("error IS NOT NULL").select("file_path", "slide_number", "error")


def _slide_batches(decks: Iterator[tuple[str, bytes]], extractor: Callable[[bytes], Iterator], rows_out: int = SLIDES_OUT, bytes_out: int = SLIDE_BYTES) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for path, content in decks:
        name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
        try:
            own = [(path, name, n, text, error) for n, text, error in extractor(content)]
        except Exception as e:  # any extractor may be passed in
            own = [(path, name, None, None, f"{type(e).__name__}: {e}")]
        rows += own
        size += sum(len(r[3] or "") for r in own)
        if len(rows) >= rows_out or size >= bytes_out:
            yield _slide_batch(rows)
            rows, size = [], 0
    if rows:
        yield _slide_batch(rows)


def _slide_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file_path", "file_name", "slide_number", "text", "error"])
