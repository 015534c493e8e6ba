"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that separate words in the ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` rule, after lower-casing A-Z.
_SEPARATORS = [b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)]
_TO_SPACE = bytes(0x20 if b in set(_SEPARATORS) else b for b in range(256))


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus`` (null keys: null)."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus))


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """True for rows kept out of training; rows without a key are training rows."""
    return F.coalesce(fold(key, modulus) == remainder, F.lit(False))


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of digits, letters a-z and non-ASCII characters."""
    return [] if text is None else text.encode().lower().translate(_TO_SPACE).split()


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs without space, tab, line feed, vertical tab, form feed, carriage return."""
    return [] if text is None else text.encode().lower().split()


def give_back() -> None:
    """Return freed memory to the system, so that a reused worker does not keep the peak of its earlier work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def boxed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all other columns as one struct ``_row``, so that no name of theirs can clash."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("_row"))


def unboxed(rows: DataFrame, columns: list[str], text: Column, doc_id: Column | None = None) -> list[Column]:
    """The columns ``columns`` of boxed ``rows``, with this text."""
    own = {"doc_id": F.col("doc_id") if doc_id is None else doc_id, "text": text}
    return [(own[c] if c in own else F.col("_row").getField(c)).alias(c) for c in columns]


def with_text(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str, list[T.StructField]]:
    """(columns ``keep`` and the text, its name there, fields of ``keep``); a string text that is kept travels once."""
    kept = docs.select(*keep)
    if "text" in keep and isinstance(kept.schema["text"].dataType, T.StringType):
        return kept, "text", kept.schema.fields
    return docs.select(*keep, F.col("text").cast("string").alias("_text")), "_text", kept.schema.fields


def carried(source: DataFrame, more: str) -> T.StructType:
    """Result type: the columns of ``source`` but the last, then those of the DDL text ``more``."""
    return T.StructType([*source.schema.fields[:-1], *T.StructType.fromDDL(more).fields])


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of one text column over the whole table."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def pieces(total: int, size: int) -> int:
    """Number of parts of about ``size``; at least one."""
    return max(1, math.ceil(total / size))


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """(start, rows, texts) pieces of an Arrow batch with at most ``limit`` bytes of text, or one row."""
    sizes = batch.column(column).cast(pa.large_string())
    offsets = memoryview(sizes.buffers()[1]).cast("q") if len(sizes) else []
    base, start = sizes.offset, 0
    while start < len(sizes):
        stop = start + 1
        while stop < len(sizes) and offsets[base + stop + 1] - offsets[base + start] <= limit:
            stop += 1
        yield start, stop - start, sizes.slice(start, stop - start).to_pylist()
        start = stop
    give_back()
