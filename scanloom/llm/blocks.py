"""Documents in blocks of bounded size, and mail between blocks and shards.

Several operators ask a question about every word or passage of a document that
only the whole corpus can answer.  They send one message per (block, shard),
distinct within the block, so that a passage found everywhere costs one entry
per block; the shard answers in the order of the question, and the answers meet
the documents of the block again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import give_back

_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def squeeze(table: pa.Table | pa.RecordBatch) -> bytes:
    """One Arrow table as compressed bytes."""
    table = table if isinstance(table, pa.Table) else pa.Table.from_batches([table])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_OPTIONS) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unsqueeze(data: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def pack_arrays(**arrays: np.ndarray) -> bytes:
    """Equally long arrays as compressed bytes."""
    return squeeze(pa.table({k: pa.array(v) if v.ndim == 1 else pa.FixedSizeBinaryArray.from_buffers(pa.binary(v.shape[1]), len(v), [None, pa.py_buffer(np.ascontiguousarray(v))]) for k, v in arrays.items()}))


def unpack_arrays(data: pa.BinaryScalar) -> dict[str, np.ndarray]:
    out = {}
    for name, column in zip((t := unsqueeze(data)).column_names, t.columns, strict=True):
        flat = column.combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        if pa.types.is_fixed_size_binary(flat.type):
            width = flat.type.byte_width
            out[name] = np.frombuffer(flat.buffers()[1], np.uint8, len(flat) * width, flat.offset * width).reshape(-1, width) if len(flat) else np.empty((0, width), np.uint8)
        else:
            out[name] = flat.to_numpy(zero_copy_only=False)
    return out


def with_block(docs: DataFrame, blocks: int, keep: list[str] | None = None) -> DataFrame:
    """``_block``, ``_id`` (long), ``_text`` and the columns ``keep``.

    The block depends on id and text, so rows without an id spread as well.
    """
    key, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.pmod(F.xxhash64(key, text), F.lit(blocks)).cast("int").alias("_block"), key.alias("_id"), text.alias("_text"), *(keep or []))


def packed(placed: DataFrame) -> DataFrame:
    """(block, data): the documents of ``with_block`` in compressed pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("_block").to_numpy()
            order = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0]).tolist() + [len(order)]
            names = [n for n in batch.schema.names if n != "_block"]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.select(names).take(pa.array(order[a:b]))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block[order[a]]], pa.int32()), "data": [squeeze(part)]})

    return placed.mapInArrow(run, "block int, data binary")


def unpacked(table: pa.Table) -> pa.Table | None:
    """The documents of one block in an order that does not depend on arrival; None if there are none."""
    give_back()
    parts = [unsqueeze(d) for d in table.column("data")]
    if not parts:
        return None
    docs = pa.concat_tables(parts)
    plain = docs.select(["_id", "_text"])
    order = pc.sort_indices(plain.append_column("_n", pc.binary_length(plain.column("_text"))), sort_keys=[("_id", "ascending"), ("_n", "ascending"), ("_text", "ascending")])
    return docs.take(order)


def text_arrays(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(all text bytes, offsets of the documents); null texts are empty."""
    texts = pc.fill_null(docs.column("_text"), "").cast(pa.large_binary()).combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_by(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, row numbers in their order) of every shard that occurs."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(shard[order].astype(np.int64)) != 0])
    for a, b in zip(edges, np.r_[edges[1:], len(order)], strict=True):
        yield int(shard[order[a]]), order[a:b]
