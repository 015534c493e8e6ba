"""SimHash near-duplicates through deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits are cut into two
32-bit segments; one segment then differs in at most one bit.  Every distinct
fingerprint is indexed under each segment with each single bit deleted, equal
keys are joined, and the full distance is verified inside each key.  A key
hands on a spanning forest of its links, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import boxed, carried, slices, space_words, unboxed
from scanloom.operators.graph import connected_components, fold
from scanloom.session import checkpointed

SEGMENTS, WIDTH = 2, 32
#: Keys with more members are searched by listing neighbours (about 6,000 each) instead of comparing members.
DIRECT = 1 << 16
#: Linked pairs in memory before they are folded into the forest.
FOLD = 1 << 20


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the XXH64 hashes of the word shingles, repeats included; 0 without words."""
    if not words:
        return 0
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    n = max(1, len(words) - shingle + 1)
    for at in range(0, n, 1 << 16):  # bounded scratch for very long texts
        part = words[at : min(at + (1 << 16), n) + shingle - 1]
        if shingle == 3 and len(part) >= 3:
            hashes = [digest(b"%b %b %b" % w, seed) for w in zip(part, part[1:], part[2:], strict=False)]
        else:
            hashes = [digest(b" ".join(part[i : i + shingle]), seed) for i in range(max(1, len(part) - shingle + 1))]
        ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default ``doc_id`` as long) and the fingerprint ``fp`` as a signed long; a null text has no words."""
    source = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) _text") if keep is None else docs.select(*keep, F.col("text").cast("string").alias("_text"))
    names = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, texts in slices(batch, "_text"):
                part = batch.slice(start, n)
                fp = np.array([fingerprint(space_words(t), shingle, seed) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(fp)], names=[*names, "fp"])

    return source.mapInArrow(run, carried(source, "fp long"))


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint): both segments of each fingerprint with each bit deleted in turn.

    A key packs segment number, deleted place and the 31 bits that are left.
    """
    keys = []
    for segment in range(SEGMENTS):
        value = (fps >> np.uint64(WIDTH * segment)) & np.uint64((1 << WIDTH) - 1)
        for bit in range(WIDTH):
            low = value & np.uint64((1 << bit) - 1)
            high = (value >> np.uint64(bit + 1)) << np.uint64(bit)
            keys.append((np.uint64(segment * WIDTH + bit) << np.uint64(WIDTH - 1)) | high | low)
    return np.concatenate(keys), np.tile(fps, SEGMENTS * WIDTH)


def _pairs(key: np.ndarray, fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked members of equal keys, step by step; ``key`` is sorted."""
    a, step = np.arange(len(key)), 1
    while len(a):
        a = a[a + step < len(key)]
        a = a[key[a + step] == key[a]]
        near = a[np.bitwise_count(fps[a] ^ fps[a + step]) <= bits]
        yield near, near + step
        step += 1


def _neighbours(fps: np.ndarray, bits: int, free: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs inside one crowded key, by looking up every fingerprint at
    the given distance: linear in the members.  ``free`` are the bits in which
    members can differ at all."""
    order = np.argsort(fps)
    sorted_fps = fps[order]
    for size in range(1, bits + 1):
        for flips in combinations(free, size):
            wanted = fps ^ np.uint64(sum(1 << b for b in flips))
            at = np.minimum(np.searchsorted(sorted_fps, wanted), len(fps) - 1)
            hit = np.flatnonzero(sorted_fps[at] == wanted)
            if len(hit):
                yield hit, order[at[hit]]


def _forest(members: int, linked: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root (smallest member number) of every member; links are folded in as they come, so few are held."""
    root, left, right, held = np.arange(members), [], [], 0
    for a, b in linked:
        left.append(a)
        right.append(b)
        held += len(a)
        if held > FOLD:
            fold(root, np.concatenate(left), np.concatenate(right))
            left, right, held = [], [], 0
    if held:
        fold(root, np.concatenate(left), np.concatenate(right))
    return root


def links(distinct: DataFrame, bits: int = 3, parts: int | None = None) -> DataFrame:
    """Edges (u, v) that connect all fingerprints within ``bits`` bits, possibly repeated.

    ``bits`` may be up to 3: with two segments, one differs by at most one bit.
    """
    if not 0 <= bits <= 2 * SEGMENTS - 1:
        raise ValueError("two segments with one deleted bit find distances up to 3")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 1 << 14):
                key, fp = variants(fps[at : at + (1 << 14)])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def settle(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            first = np.r_[True, key[1:] != key[:-1]]
            size = np.diff(np.r_[np.flatnonzero(first), len(key)])[np.cumsum(first) - 1]
            crowded = size > DIRECT

            def linked() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                pick = np.flatnonzero((size > 1) & ~crowded)
                for a, b in _pairs(key[pick], fps[pick], bits):
                    yield pick[a], pick[b]
                for k in np.unique(key[crowded]):
                    at = np.flatnonzero(key == k)
                    base = int(k) >> (WIDTH - 1)  # segment * WIDTH + deleted place
                    free = [b for b in range(64) if b // WIDTH != base // WIDTH or b == base]
                    for a, b in _neighbours(fps[at], bits, free):
                        yield at[a], at[b]

            root = _forest(len(key), linked())
            child = np.flatnonzero(root != np.arange(len(key)))
            return pa.RecordBatch.from_arrays([pa.array(fps[child].view(np.int64)), pa.array(fps[root[child]].view(np.int64))], names=["u", "v"])

        for batch in batches:  # sorted by key; the last key may go on in the next batch
            key = np.concatenate([rest_key, batch.column("key").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([rest_fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            rest_key, rest_fp = key[cut:], fps[cut:]
            if cut:
                yield settle(key[:cut], fps[:cut])
        if len(rest_key):
            yield settle(rest_key, rest_fp)

    spread = distinct.mapInArrow(index, "key long, fp long")
    spread = spread.repartition(parts, "key") if parts else spread.repartition("key")
    return spread.sortWithinPartitions("key").mapInArrow(verify, "u long, v long")


def _classes(own: DataFrame, bits: int) -> DataFrame:
    """(fp, low, component) of every distinct fingerprint of ``own`` (doc_id, fp): its smallest doc_id, its component."""
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("low"))
    labels = connected_components(distinct.select(F.col("fp").alias("id")), links(distinct.select("fp"), bits))
    return distinct.join(labels.withColumnRenamed("id", "fp"), "fp")


def near_duplicates(docs: DataFrame, bits: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprint as 16 hex digits, component = smallest reachable doc_id.

    Equal fingerprints link too; a text without words (null, empty, blank) has
    fingerprint zero.  Rows without a doc_id are returned with the component of
    their fingerprint, and never name one; it is null if no member has an id.
    Repeated rows give repeated results; an empty table gives an empty result.
    """
    own = checkpointed(fingerprints(docs, shingle, seed))
    classes = _classes(own, bits)
    lowest = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "component").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, bits: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id.

    Rows without an id stay only where no member has one; of repeated rows, and
    of rows with one id and fingerprint, any one stays.
    """
    own = checkpointed(fingerprints(docs, shingle, seed))
    best = _classes(own, bits).groupBy("component").agg(F.min(F.struct(F.col("low").isNull().alias("none"), F.col("low"), F.col("fp"))).alias("b"))
    stay = best.select(F.col("b.none").alias("_none"), F.coalesce("b.low", F.lit(0)).alias("_low"), F.col("b.fp").alias("fp"))
    rows = fingerprints(boxed(docs), shingle, seed, keep=["doc_id", "text", "_row"])
    key = F.col("doc_id").cast("long")
    rows = rows.withColumns({"_none": key.isNull(), "_low": F.coalesce(key, F.lit(0))})
    one = rows.join(stay, ["_none", "_low", "fp"]).dropDuplicates(["_none", "_low", "fp"])
    return one.select(*unboxed(one, docs.columns, F.col("text")))
