"""Ranked lexical search: Block-Max MaxScore over a sharded inverted index.

The index is a table of posting lists, one row per (shard, term), plus one row
per shard for its documents.  A list is cut into blocks of 128 postings, each
packed by itself, with the last document of the block and, for every term
frequency in it, the shortest document that has it: the best score of a block
follows from these pairs exactly, whatever the corpus statistics are, so shards
can be added without building the others again.

A search goes through the shards of a task with one heap per query.  Lists whose
bounds together stay below the heap's threshold are non-essential: only
documents of the other lists are candidates.  On non-essential lists the maximum
of the block that could hold a candidate decides whether that block is unpacked
at all.  The heaps of the tasks are merged at the end.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import alnum_words, give_back, pieces, slices, text_bytes
from scanloom.session import scratch_path

BLOCK = 128
#: Text bytes of a shard, and of the queries asked together.
SHARD_BYTES, QUERY_BYTES = 16 << 20, 4 << 20
#: Documents scored together: the first window is small, so that a threshold is there early.
FIRST_WINDOW, LAST_WINDOW = 512, 8192
NO_ID = np.iinfo(np.int64).max

INDEX = "shard long, term string, df int, terms long, post binary, last binary, width binary, pair_n binary, pairs binary"


def _column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value per row from all bytes and the rows' ends in bytes."""
    offsets = np.r_[0, ends].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _shard(shard: int, ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
    """The index rows of some documents; ordinals follow ``doc_id`` (rows without one last)."""
    order = sorted(range(len(ids)), key=lambda i: NO_ID if ids[i] is None else ids[i])
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    found = []
    for i in order:
        words = alnum_words(texts[i])
        found.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    n = np.fromiter(map(len, found), np.int64, len(found))
    names = list(number)
    by_name = np.argsort(np.array(names, object)) if names else np.empty(0, np.int64)
    rank = np.empty(len(names), np.int64)
    rank[by_name] = np.arange(len(names))
    docs = max(1, len(order))
    key, tf = np.unique(rank[np.concatenate(found)] * docs + np.repeat(np.arange(len(n)), n) if len(names) else np.empty(0, np.int64), return_counts=True)
    term, doc = key // docs, key % docs
    df = np.bincount(term, minlength=len(names))
    first = np.cumsum(df) - df  # where each list begins
    place = np.arange(len(key)) - np.repeat(first, df)
    per_list = -(-df // BLOCK)
    block = np.repeat(np.cumsum(per_list) - per_list, df) + place // BLOCK
    n_blocks = int(per_list.sum())
    start = np.flatnonzero(place % BLOCK == 0)
    gap = np.diff(doc, prepend=0)
    gap[start] = doc[start]  # a block is read by itself

    def wide(values: np.ndarray) -> np.ndarray:  # bytes that the largest value of each block takes
        top = np.maximum.reduceat(values, start) if len(start) else np.empty(0, np.int64)
        return 1 + (top > 0xFF).astype(np.int64) + (top > 0xFFFF) + (top > 0xFFFFFF)

    gap_width, tf_width = wide(gap), wide(tf)
    step = (gap_width + tf_width)[block]
    at = np.cumsum(step) - step
    post = np.zeros(int(step.sum()), np.uint8)
    for k in range(4):
        for values, width, shift in ((gap, gap_width, 0), (tf, tf_width, gap_width)):
            on = (width > k)[block]
            post[(at + k + (shift if isinstance(shift, int) else shift[block]))[on]] = (values[on] >> (8 * k)) & 0xFF
    # per block and frequency the shortest document
    pair, inverse = np.unique(block << 32 | tf, return_inverse=True)
    shortest = np.full(len(pair), NO_ID)
    np.minimum.at(shortest, inverse.ravel(), n[doc])
    pair_n = np.bincount(pair >> 32, minlength=n_blocks)
    pairs = np.stack([pair & 0xFFFFFFFF, shortest], 1).astype("<u4")
    last = doc[np.r_[start[1:], len(doc)] - 1].astype("<u4") if len(start) else np.empty(0, "<u4")
    blocks_end = np.cumsum(per_list)
    pair_end = np.r_[0, np.cumsum(pair_n)][blocks_end]
    post_end = np.r_[0, np.cumsum(step)][first + df]
    rows = pa.RecordBatch.from_arrays([
        pa.array(np.full(len(names), shard)), pa.array([names[i].decode() for i in by_name.tolist()], pa.string()), pa.array(df, pa.int32()),
        pa.array(np.add.reduceat(tf, first) if len(names) else np.empty(0, np.int64), pa.int64()), _column(post, post_end), _column(last.view(np.uint8), blocks_end * 4),
        _column((gap_width << 4 | tf_width).astype(np.uint8), blocks_end), _column(pair_n.astype(np.uint8), blocks_end), _column(pairs.reshape(-1).view(np.uint8), pair_end * 8),
    ], names=["shard", "term", "df", "terms", "post", "last", "width", "pair_n", "pairs"])
    own = np.array([NO_ID if ids[i] is None else ids[i] for i in order], np.int64)
    head = pa.RecordBatch.from_pydict({
        "shard": pa.array([shard], pa.int64()), "term": [""], "df": pa.array([int((n > 0).sum())], pa.int32()), "terms": pa.array([int(n.sum())], pa.int64()),
        "post": [own.tobytes()], "last": [n.astype("<u4").tobytes()], "width": [b""], "pair_n": [b""], "pairs": [b""]})
    return pa.Table.from_batches([head, rows]).combine_chunks().to_batches()[0]


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of ``doc_id`` and ``text``, written to the shared folder; shards are cut inside the input's partitions.

    The row of a shard with the empty term holds its documents: ``df`` with at
    least one term, ``terms`` with repeats, ids and lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, ids, texts = TaskContext.get().partitionId() << 24, 0, [], []
        for batch in batches:
            own = batch.column("_id")
            for at, n, part in slices(batch, "_text", 1 << 20):
                ids += own.slice(at, n).to_pylist()
                texts += part
                size += sum(len(t) for t in part if t)
                if size >= shard_bytes:
                    yield from _cut(_shard(shard, ids, texts))
                    shard, size, ids, texts = shard + 1, 0, [], []
                    give_back()
        if ids:
            yield from _cut(_shard(shard, ids, texts))
        give_back()

    def _cut(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, rows.num_rows, 1 << 14):
            yield rows.slice(at, 1 << 14)

    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "lexical-index")
    docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).mapInArrow(run, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score, but for its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Postings:
    """One list of one shard; blocks are unpacked on demand."""

    def __init__(self, row: dict[str, bytes], df: int, damp):
        self.raw = np.frombuffer(row["post"], np.uint8)
        self.last = np.frombuffer(row["last"], "<u4").astype(np.int64)
        width = np.frombuffer(row["width"], np.uint8).astype(np.int64)
        self.gap_width, self.tf_width = width >> 4, width & 15
        self.count = np.full(len(width), BLOCK)
        self.count[-1] = df - BLOCK * (len(width) - 1)
        size = self.count * (self.gap_width + self.tf_width)
        self.at = np.cumsum(size) - size
        pair_n, pairs = np.frombuffer(row["pair_n"], np.uint8).astype(np.int64), np.frombuffer(row["pairs"], "<u4").astype(np.int64).reshape(-1, 2)
        self.best = np.maximum.reduceat(impact(pairs[:, 0], damp(pairs[:, 1])), np.cumsum(pair_n) - pair_n)
        self.top = int(self.best.max())
        self.unpacked = 0

    def unpack(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ordinals, frequencies) of some blocks, ascending."""
        self.unpacked += len(blocks)
        n, gw, tw = self.count[blocks], self.gap_width[blocks], self.tf_width[blocks]
        end = np.cumsum(n)
        inside = np.arange(end[-1]) - np.repeat(end - n, n)
        at = np.repeat(self.at[blocks], n) + inside * np.repeat(gw + tw, n)
        out = []
        for begin, width in ((at, gw), (at + np.repeat(gw, n), tw)):
            value = self.raw[begin].astype(np.int64)
            for k in range(1, int(width.max())):
                on = np.repeat(width > k, n)
                value[on] |= self.raw[begin[on] + k].astype(np.int64) << (8 * k)
            out.append(value)
        run = np.cumsum(out[0])
        first = end - n
        return run - np.repeat(run[first] - out[0][first], n), out[1]


class Heaps:
    """The best documents of each query so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = [np.empty(0, np.int64)] * items
        self.doc = [np.empty(0, np.int64)] * items

    def threshold(self, i: int) -> int:
        """Scores below this are not wanted any more; equal ones may still win by their id."""
        return int(self.score[i][-1]) if len(self.score[i]) == self.k else 1

    def add(self, i: int, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.r_[self.score[i], score], np.r_[self.doc[i], doc]
        order = np.lexsort((doc, -score))[: self.k]
        self.score[i], self.doc[i] = score[order], doc[order]


def search_shard(lists: dict[str, Postings], ids: np.ndarray, n: np.ndarray, damp, items: list[list[tuple[str, int]]], heaps: Heaps) -> None:
    """Add the best documents of one shard to the heaps; ``items`` are (term, weight times repeats) lists."""
    m = damp(n)
    for i, terms in enumerate(items):
        mine = sorted(((weight * lists[t].top, weight, lists[t]) for t, weight in terms if t in lists), key=lambda x: x[0])
        mine = [x for x in mine if x[0] > 0]
        if not mine:
            continue
        below = np.cumsum([x[0] for x in mine]).tolist()  # what the lists up to each one can add at most
        low, width = 0, FIRST_WINDOW
        while low < len(ids):
            high, width = min(len(ids), low + width), min(LAST_WINDOW, width * 4)
            limit = heaps.threshold(i)
            if below[-1] < limit:
                break
            split = next(j for j, b in enumerate(below) if b >= limit)  # lists from here on are essential
            total, seen = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
            for _, weight, part in mine[split:]:
                a, b = np.searchsorted(part.last, [low, high])
                if a < len(part.last):
                    at, tf = part.unpack(np.arange(a, min(b + 1, len(part.last))))
                    on = slice(*np.searchsorted(at, [low, high]))
                    at = at[on]
                    total[at - low] += weight * impact(tf[on], m[at])
                    seen[at - low] = True
            found = np.flatnonzero(seen & (total + (below[split - 1] if split else 0) >= limit))
            score, found = total[found], found + low
            for j in range(split - 1, -1, -1):
                _, weight, part = mine[j]
                rest = below[j - 1] if j else 0
                block = np.searchsorted(part.last, found)
                inside = block < len(part.last)
                most = np.where(inside, weight * part.best[np.minimum(block, len(part.last) - 1)], 0)
                on = score + most + rest >= limit
                found, score, block, inside = found[on], score[on], block[on], inside[on]
                if not len(found):
                    break
                if inside.any():
                    at, tf = part.unpack(np.unique(block[inside]))
                    p = np.minimum(np.searchsorted(at, found), len(at) - 1)
                    hit = at[p] == found
                    score[hit] += weight * impact(tf[p[hit]], m[found[hit]])
            on = score >= limit
            if on.any():
                heaps.add(i, score[on], ids[found[on]])
            low = high


def _query_rows(queries: DataFrame) -> DataFrame:
    """(item_id, term, n) of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, size, texts in slices(batch, "_text"):
                counts = [Counter(alnum_words(t)) for t in texts]
                items = batch.column("item_id").slice(at, size).take(pa.array(np.repeat(np.arange(size), [len(c) for c in counts])))
                yield pa.RecordBatch.from_arrays([items, pa.array([t.decode() for c in counts for t in c], pa.string()), pa.array([v for c in counts for v in c.values()], pa.int64())], names=["item_id", "term", "n"])

    source = queries.filter("item_id is not null").select("item_id", F.col("text").cast("string").alias("_text"))
    kind = source.schema["item_id"].dataType.simpleString()
    return source.mapInArrow(run, f"item_id {kind}, term string, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def search(index: DataFrame, queries: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item with a score above 0.

    ``index`` is a table of ``build_index``, ``queries`` has ``item_id`` and
    ``text``.  Rows of one item are asked together, rows without an item not at
    all; null and empty texts find nothing.  Null and empty documents have no
    terms.  Documents without an id are found too and lose ties; repeated rows
    are found each.  An empty table gives an empty result.  Queries are asked
    in blocks of ``query_bytes`` of text, each against all shards.
    """
    spark = index.sparkSession
    asked = _query_rows(queries)
    kind = asked.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    whole = index.filter("term = ''").agg(F.sum("df"), F.sum("terms")).first()
    n_docs, n_terms = whole[0] or 0, whole[1] or 0
    blocks = pieces(text_bytes(queries.filter("item_id is not null")), query_bytes)
    for number in range(blocks if n_terms else 0):
        part = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        found = found.unionByName(_search_block(index, part, n_docs, n_terms, k, kind))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(index: DataFrame, asked: DataFrame, n_docs: int, n_terms: int, k: int, kind: str) -> DataFrame:
    spark = index.sparkSession
    rows = asked.collect()  # one block of queries, bounded by its bytes
    terms = sorted({r.term for r in rows})
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in [*terms, ""]], "term string"))  # no more terms than the block of queries has
    lists = index.join(wanted, "term")
    df = {r.term: r.df for r in lists.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms if t in df}
    by_item: dict = defaultdict(list)
    for r in rows:
        if r.term in weight:
            by_item[r.item_id].append((r.term, weight[r.term] * r.n))
    names = list(by_item)
    shared = spark.sparkContext.broadcast([by_item[i] for i in names])
    name_type = pa.array(names).type if names else pa.int64()

    def damp(n: np.ndarray) -> np.ndarray:
        return 25 + 75 * n * n_docs // n_terms

    def one(heaps: Heaps, parts: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(parts)
        lists, ids, n = {}, np.empty(0, np.int64), np.empty(0, np.int64)
        columns = {c: table.column(c) for c in ("post", "last", "width", "pair_n", "pairs")}
        for r, (term, count) in enumerate(zip(table.column("term").to_pylist(), table.column("df").to_pylist(), strict=True)):
            row = {c: columns[c][r].as_buffer() for c in columns}
            if term:
                lists[term] = Postings(row, count, damp)
            else:
                ids, n = np.frombuffer(row["post"], np.int64), np.frombuffer(row["last"], "<u4").astype(np.int64)
        search_shard(lists, ids, n, damp, shared.value, heaps)
        give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, parts, shard = Heaps(len(names), k), [], None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if parts and numbers[a] != shard:
                    one(heaps, parts)
                    parts = []
                shard = numbers[a]
                parts.append(batch.slice(a, b - a))
        if parts:
            one(heaps, parts)
        size = [len(s) for s in heaps.score]
        if sum(size):
            doc = np.concatenate(heaps.doc)
            item = pa.array(names, name_type).take(pa.array(np.repeat(np.arange(len(names)), size)))
            yield pa.RecordBatch.from_arrays([item, pa.array(doc, mask=doc == NO_ID), pa.array(np.concatenate(heaps.score))], names=["item_id", "doc_id", "score"])

    placed = lists.repartition("shard").sortWithinPartitions("shard")
    return placed.mapInArrow(run, f"item_id {kind}, doc_id long, score long")
