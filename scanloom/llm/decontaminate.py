"""Benchmark decontamination with one FM-index per training shard.

A shard (a bounded run of documents) is turned into word numbers of the
benchmark's vocabulary.  Its Burrows-Wheeler transform is kept in a wavelet
matrix; all test phrases are searched backwards at once, their places come from
sampled suffix positions, and overlapping places merge into removal spans.

Words outside the benchmark's vocabulary cannot lie in an occurrence, so only
runs of known words at least as long as the shortest phrase enter the index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm.common import alnum_words, slices, text_bytes

WINDOW = 10
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class FMIndex:
    """Burrows-Wheeler index over numbers >= 1; 0 ends the sequence."""

    def __init__(self, sequence: np.ndarray, sample: int = 8):
        text = np.append(sequence, 0).astype(np.int64)
        order = self._suffixes(text)
        self.size = len(text)
        last = text[order - 1]  # the number before each suffix
        self.levels = max(1, int(text.max()).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.levels))])
        self.zeros, self.ranks = [], []
        for level in range(self.levels - 1, -1, -1):  # wavelet matrix, highest bit first
            bit = (last >> level) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        self.sampled = order % sample == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling until all suffixes differ (the end mark is unique, so they will)."""
        rank, step, n = np.unique(text, return_inverse=True)[1].astype(np.int64), 1, len(text)
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
            rank, step = new, step * 2
            if rank[order[-1]] == n - 1 or step >= 2 * n:
                return order

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        low, high = np.zeros_like(at), at
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            ones, one = self.ranks[i], (symbol >> level) & 1 == 1
            low = np.where(one, self.zeros[i] + ones[low], low - ones[low])
            high = np.where(one, self.zeros[i] + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The transform's symbol at each place."""
        value = np.zeros_like(at)
        for i in range(self.levels):
            ones = self.ranks[i]
            bit = ones[at + 1] - ones[at]
            value = value * 2 + bit
            at = np.where(bit == 1, self.zeros[i] + ones[at], at - ones[at])
        return value

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of every phrase; all phrases of one length, one per row, searched backwards."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, column]
            known = (symbol < 1 << self.levels) & (high > low)
            symbol = np.where(known, symbol, 0)
            start = self.before[symbol]
            low, high = np.where(known, start + self.rank(symbol, low), 0), np.where(known, start + self.rank(symbol, high), 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffix rows: step back to a sampled row, then add the steps."""
        place, steps, open_ = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            done = self.sampled[rows[open_]]
            hit = open_[done]
            place[hit] = self.samples[self.sample_rank[rows[hit]]] + steps[hit]
            open_ = open_[~done]
            symbol = self.access(rows[open_])
            rows[open_] = self.before[symbol] + self.rank(symbol, rows[open_])
            steps[open_] += 1
        return place


@dataclass(frozen=True)
class Phrases:
    """Benchmark windows: word numbers per length, and the items of each window."""

    vocabulary: dict[bytes, int]
    windows: dict[int, np.ndarray]
    items: dict[int, list[list[int]]]


def phrases_of(rows: list[tuple[int, str | None]], window: int = WINDOW) -> Phrases:
    """Distinct windows of ``window`` words; a shorter item that has words is one window."""
    vocabulary: dict[bytes, int] = {}
    found: dict[int, dict[tuple, set]] = {}
    for item, text in rows:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in alnum_words(text)]  # 1 separates runs
        for i in range(max(1, len(ids) - window + 1)) if ids else ():
            part = tuple(ids[i : i + window])
            found.setdefault(len(part), {}).setdefault(part, set()).add(item)
    return Phrases(vocabulary, {n: np.array(list(w), np.int64) for n, w in found.items()}, {n: [sorted(i, key=str) for i in w.values()] for n, w in found.items()})


def shard_hits(phrases: Phrases, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """(words, hit word spans, item ids) of every text of one shard."""
    shortest = min(phrases.windows, default=0)
    get, counts, runs, starts, owners, total = phrases.vocabulary.get, [], [], [], [], 0
    for doc, text in enumerate(texts):
        words = alnum_words(text)
        counts.append(len(words))
        if not shortest or len(words) < shortest:
            continue
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.r_[0, ids != 0, 0]))
        for a, b in edges.reshape(-1, 2):
            if b - a >= shortest:
                runs += [ids[a:b], [1]]
                starts.append((total, int(a)))
                owners.append(doc)
                total += b - a + 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    if runs:
        index = FMIndex(np.concatenate(runs))
        begin, own = np.array(starts, np.int64), np.array(owners)
        for n, windows in phrases.windows.items():
            low, high = index.find(windows)
            number = np.repeat(np.arange(len(windows)), high - low)
            if not len(number):
                continue
            rows = np.arange(len(number)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[number]
            place = index.locate(rows)
            run = np.searchsorted(begin[:, 0], place, side="right") - 1
            doc, word = own[run], begin[run, 1] + place - begin[run, 0]
            for d, w, k in zip(doc.tolist(), word.tolist(), number.tolist(), strict=True):
                spans[d].append((w, w + n))
                items[d].update(phrases.items[n][k])
    return [(c, merged(s), sorted(i, key=str)) for c, s, i in zip(counts, spans, items, strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


FIELDS = "_n_words long, _spans array<struct<start:long,stop:long>>, _items array<long>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW,
                       block_bytes: int = 4 << 20, shard_bytes: int = 8 << 20, cut: bool = False) -> DataFrame:
    """Columns ``keep`` of every document with ``_n_words``, ``_spans`` (hit words) and ``_items``.

    The benchmark is broadcast in blocks of about ``block_bytes`` of text; with
    more than one block each document carries its findings from block to block,
    so the size of the benchmark is no limit.  With ``cut`` a column ``_clean``
    holds the text without the spans.  Null texts have no words; items with
    null ids or texts are left out; repeated rows give repeated results.
    """
    keep = keep or ["doc_id"]
    bench = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").filter("item_id is not null and text is not null").distinct()
    blocks = max(1, -(-text_bytes(bench) // block_bytes))
    source = docs.select(*keep, F.col("text").cast("string").alias("_text"), F.lit(None).cast("long").alias("_n_words"),
                         F.array().cast("array<struct<start:long,stop:long>>").alias("_spans"), F.array().cast("array<long>").alias("_items"))
    fields = source.schema.fields
    schema, final_schema = (T.StructType([*fields[: len(keep)], T.StructField(name, T.StringType()), *fields[len(keep) + 1 :]]) for name in ("_text", "_clean"))
    for block in range(blocks):
        rows = bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()  # bounded by block_bytes
        pairs = list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True))
        shared = docs.sparkSession.sparkContext.broadcast(phrases_of(pairs, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, final=block == blocks - 1) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, n, texts in slices(batch, "_text", shard_bytes):
                    part = batch.slice(start, n)
                    hits = shard_hits(shared.value, texts)
                    spans = [merged([(s["start"], s["stop"]) for s in old] + new) for old, (_, new, _) in zip(part.column("_spans").to_pylist(), hits, strict=True)]
                    items = [sorted({*old, *new}, key=str) for old, (_, _, new) in zip(part.column("_items").to_pylist(), hits, strict=True)]
                    columns = [*(part.column(c) for c in keep), part.column("_text"), pa.array([h[0] for h in hits], pa.int64()),
                               pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], _SPANS), pa.array(items, pa.list_(pa.int64()))]
                    names = [*keep, "_text", "_n_words", "_spans", "_items"]
                    if final:
                        clean = [cut_words(t, s) if cut and s else t if cut else None for t, s in zip(texts, spans, strict=True)]
                        columns[len(keep)], names[len(keep)] = pa.array(clean, pa.string()), "_clean"
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        source = source.mapInArrow(run, final_schema if block == blocks - 1 else schema)
    return source if cut else source.drop("_clean")
