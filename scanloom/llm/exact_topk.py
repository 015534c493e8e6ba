"""Exact top-k inner-product search by distributed histogram selection.

Everything is scored, block against block.  Global histograms of the scores
close in on each query's k-th value, one base-256 digit per round; then only
rows at or above that value are kept and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import pieces
from scanloom.session import checkpointed

DIGIT = 8
BINS = 1 << DIGIT
#: Queries scored at once in a task, and pairs of blocks that a task gets on average.
SLICE, PAIRS = 256, 4


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """(id, dim, q): floor(scale * x) of every usable vector.

    Null vectors, vectors with null, NaN or infinite components and rows
    without an id take no part.
    """
    v = F.col(vector_column).cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"), usable.alias("ok")).filter("id is not null and ok")
    return rows.select("id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("q"))


def _packed(table: pa.Table | pa.RecordBatch, kind: type) -> tuple[bytes, bytes]:
    ids = np.asarray(table.column("id").to_numpy(), np.int64)
    flat = table.column("q")
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return ids.tobytes(), flat.flatten().to_numpy().astype(kind).tobytes()


def _own(q_ids: np.ndarray, c_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, candidate) where a query meets its own id."""
    at = np.flatnonzero(np.isin(c_ids, q_ids))
    i, j = np.nonzero(q_ids[:, None] == c_ids[None, at])
    return i, at[j]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query, or all if fewer.

    Both inputs are (id, dim, q) as from ``quantised``.  Rows with the query's
    own id are no candidates, vectors of another length neither.  Repeated
    candidate rows count each; of repeated query ids the lowest vector asks.
    Empty inputs give an empty result.  Inner products must fit a long.

    Work is (query block, candidate block), a few pairs a task, scored ``SLICE``
    queries at a time, so that no task grows with the tables.  Blocks are packed in the
    smallest integers that hold the components.  Beside them only counts and rows at or above a
    k-th value are shuffled, so ties of any number cost k rows per block.
    """
    queries = queries.groupBy("id").agg(F.min(F.struct("dim", "q")).alias("v")).select("id", "v.dim", "v.q")
    stats = rows.agg(F.count("*"), F.max("dim"), F.max(F.array_max(F.transform("q", F.abs)))).first()
    n_queries = queries.count()
    n_rows, dim, largest = stats[0], stats[1] or 0, stats[2] or 0
    bound = dim * largest * largest + 1
    if bound >= 1 << 62:
        raise ValueError("inner products do not fit a long")
    rounds = -(-(2 * bound + 1).bit_length() // DIGIT)
    kind = next(t for t in (np.int16, np.int32, np.int64) if largest <= np.iinfo(t).max)
    # inner products are whole numbers, which floats hold exactly below 2^24 and doubles below 2^53
    kept_in, number = (np.float32, np.int32) if bound < 1 << 24 and rounds <= 3 else (np.float64, np.int64) if bound < 1 << 53 else (np.int64, np.int64)
    query_blocks, row_blocks = pieces(n_queries, 4 * block), pieces(n_rows, block)
    tasks = max(pieces(query_blocks * row_blocks, PAIRS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                size = -(-part.num_rows // pieces(part.num_rows, block))
                for at in range(0, part.num_rows, size):
                    ids, flat = _packed(part.slice(at, size), kind)
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "c_ids": [ids], "c_flat": [flat]})

    packed = checkpointed(rows.mapInArrow(pack_rows, "dim int, c_ids binary, c_flat binary"))
    spread = packed.select("*", F.pmod(F.xxhash64("c_ids"), F.lit(row_blocks)).alias("cb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    spread = spread.repartition(tasks, "qb", "cb", "dim")

    def pack_queries(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, flat = _packed(table, kind)
        low, need = (np.asarray(table.column(c).to_numpy(), np.int64).tobytes() for c in ("low", "need"))
        return pa.table({"qb": table.column("qb")[:1], "dim": table.column("dim")[:1], "q_ids": [ids], "q_flat": [flat], "low": [low], "need": [need]})

    def paired(state: DataFrame) -> DataFrame:
        """One row per query block and candidate block."""
        asked = queries.join(state, "id").withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))
        asked = asked.groupBy("qb", "dim").applyInArrow(pack_queries, "qb int, dim int, q_ids binary, q_flat binary, low binary, need binary")
        asked = asked.withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
        return spread.join(asked.repartition(tasks, "qb", "cb", "dim"), ["qb", "cb", "dim"])

    def each(batches: Iterator[pa.RecordBatch]):
        """(query ids, candidate ids, scores, low, need, places of the queries' own ids) of some queries and a block."""
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, t=np.int64: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: B023, E731
                d, q_ids, c_ids, low, need = batch.column("dim")[r].as_py(), get("q_ids"), get("c_ids"), get("low"), get("need")
                q, c = get("q_flat", kind).reshape(len(q_ids), d), get("c_flat", kind).reshape(len(c_ids), d).astype(kept_in).T
                for at in range(0, len(q_ids), SLICE):
                    some = slice(at, at + SLICE)
                    yield q_ids[some], c_ids, (q[some].astype(kept_in) @ c).astype(number, copy=False), low[some], need[some], _own(q_ids[some], c_ids)

    state = queries.select("id", F.lit(-(1 << (DIGIT * rounds - 1))).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))
    for shift in range(DIGIT * (rounds - 1), -1, -DIGIT):

        def count(batches: Iterator[pa.RecordBatch], shift: int = shift) -> Iterator[pa.RecordBatch]:
            for q_ids, _, scores, low, _, own in each(batches):
                digit = (scores - low[:, None].astype(number)) >> shift
                digit[own] = -1
                near = (digit >= 0) & (digit < BINS)
                n = np.bincount((digit + np.arange(0, len(q_ids) * BINS, BINS, dtype=number)[:, None])[near], minlength=len(q_ids) * BINS)
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[hit // BINS]), pa.array(hit % BINS), pa.array(n[hit])], names=["id", "digit", "n"])

        histogram = paired(state).mapInArrow(count, "id long, digit long, n long").groupBy("id", "digit").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("id").orderBy(F.desc("digit")).rowsBetween(Window.unboundedPreceding, 0)  # at most 256 rows each
        reached = histogram.withColumn("total", F.sum("n").over(down)).join(state, "id").filter("total >= need")
        found = reached.groupBy("id").agg(F.max(F.struct("digit", (F.col("total") - F.col("n")).alias("above"))).alias("f"))
        state = checkpointed(state.join(found, "id", "left").select(
            "id", (F.col("low") + F.coalesce(F.col("f.digit"), F.lit(0)) * (1 << shift)).alias("low"), (F.col("need") - F.coalesce(F.col("f.above"), F.lit(0))).alias("need")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, c_ids, scores, low, need, own in each(batches):
            least = low[:, None].astype(number)
            above, tied = scores > least, scores == least
            above[own] = tied[own] = False
            q, c = np.nonzero(above)
            found = [(q, c)]
            for i in np.flatnonzero(tied.any(1)):  # only the smallest ids among equals can be wanted
                at = np.flatnonzero(tied[i])
                at = at[np.argsort(c_ids[at], kind="stable")[: need[i]]]
                found.append((np.full(len(at), i), at))
            q, c = (np.concatenate([f[j] for f in found]) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(c_ids[c]), pa.array(scores[q, c].astype(np.int64))], names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kept = paired(state).mapInArrow(keep, "query_id long, vec_id long, score long")
    return kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
