"""Ordered work that survives hot keys.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  The
helpers here cut a key into chunks (time buckets or rank buckets), work inside
the chunks, and carry one summary row per chunk.  Only the summaries are ever
ordered per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.numeric import half_away
from scanloom.session import checkpointed

DAY_US = 86_400_000_000


#: Estimated bytes up to which a whole table may lie in one chunk, and rows that a chunk may hold beyond.
SMALL_BYTES, CHUNK_ROWS = 64 << 20, 1 << 20


def _estimated_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, as the optimizer estimates them after pruning."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def with_chunk(df: DataFrame, keys: list[str], order: list[str], width_us: int = DAY_US) -> DataFrame:
    """Column ``_chunk``, ascending in ``order`` within a key; no chunk of a key is large.

    Chunks are stretches of ``width_us`` of the time ``order[0]``, which needs no
    shuffle, unless some stretch of some key is crowded; then they are range
    partitions, which hold equal numbers of rows whatever the times are.  The
    placement is materialised, as a range sample taken again could differ.
    """
    stretch = F.floor(F.col(order[0]) / width_us)
    if _estimated_bytes(df) > SMALL_BYTES:
        crowd = df.groupBy(*keys, stretch.alias("_chunk")).count().agg(F.max("count"), F.sum("count")).first()
        if (crowd[0] or 0) > CHUNK_ROWS:
            parts = -(-crowd[1] // CHUNK_ROWS) * 2
            return checkpointed(df.repartitionByRange(parts, *keys, *order).withColumn("_chunk", F.spark_partition_id().cast("long")))
    return df.withColumn("_chunk", stretch)


def keys_fit(df: DataFrame, keys: list[str]) -> bool:
    """Whether every key has so few rows that one task may order them: nothing has to be carried then."""
    if _estimated_bytes(df) <= SMALL_BYTES >> 3:
        return True
    return (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= CHUNK_ROWS


def previous_row(df: DataFrame, keys: list[str], order: list[str], cols: list[str], width_us: int = DAY_US,
                 into: str = "prev") -> DataFrame:
    """Struct of ``cols`` from the row before, across chunk borders.
    ``order[0]`` is the time in microseconds."""
    d = with_chunk(df, keys, order, width_us)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    last = d.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    last = last.select(*keys, "_chunk", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry"))
    return (
        d.withColumn("_local", F.lag(F.struct(*cols)).over(inside))
        .join(last, [*keys, "_chunk"], "left")
        .withColumn(into, F.coalesce("_local", "_carry"))
        .drop("_local", "_carry", "_chunk")
    )


def running(df: DataFrame, keys: list[str], order: list[str], aggs: dict[str, tuple[str, Column]],
            width_us: int = DAY_US) -> DataFrame:
    """Running ``sum`` / ``max`` / ``min`` per key up to and including each row."""
    fn = {"sum": F.sum, "max": F.max, "min": F.min}
    join = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}
    d = with_chunk(df, keys, order, width_us).withColumns({f"_v_{n}": c for n, (_, c) in aggs.items()})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "_chunk").agg(*[fn[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in aggs.items()])
    carry = totals.select(*keys, "_chunk", *[fn[k](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (k, _) in aggs.items()])
    d = d.withColumns({f"_r_{n}": fn[k](f"_v_{n}").over(inside) for n, (k, _) in aggs.items()}).join(carry, [*keys, "_chunk"], "left")
    out = {n: F.coalesce(join[k](F.col(f"_r_{n}"), F.col(f"_c_{n}")), F.col(f"_r_{n}"), F.col(f"_c_{n}")) for n, (k, _) in aggs.items()}
    return d.withColumns(out).drop("_chunk", *[f"_{p}_{n}" for n in aggs for p in "vrc"])


def with_halo(df: DataFrame, index: str, size: int, reach: int) -> DataFrame:
    """Copy rows near a bucket border into the neighbouring bucket, so frames of
    up to ``reach`` rows can be evaluated bucket by bucket.  ``own`` marks the
    row's home bucket (``_bucket``)."""
    i = F.col(index)
    home = F.floor(i / size)
    buckets = F.sequence(F.floor((i - reach) / size), F.floor((i + reach) / size))
    return df.withColumn("_bucket", F.explode(buckets)).withColumn("own", F.col("_bucket") == home)


def indexed(df: DataFrame, order: list, partitions: int | None = None, into: str = "idx") -> DataFrame:
    """Dense index from zero over the whole table in ``order``.

    Range partitions are balanced whatever the key distribution; only one
    count per partition is summed to get the offsets.  The placement is
    materialised, as a recomputed range sample could place rows differently.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # one row per partition
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(
        Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (placed.withColumn("_p", part).join(F.broadcast(offsets), "_p")
            .withColumn(into, F.col("_off") + row).drop("_p", "_m", "_off"))


def ranked_within(df: DataFrame, keys: list[str], order: list, into: str = "rank0") -> DataFrame:
    """Zero-based rank inside each key without putting a key into one task."""
    d = indexed(df, [*keys, *order], into="_idx")
    first = d.groupBy(*keys).agg(F.min("_idx").alias("_first"), F.count("*").alias("group_size"))
    return d.join(first, keys).withColumn(into, F.col("_idx") - F.col("_first")).drop("_idx", "_first")


RULES: dict[str, Callable[[Column, float], Column]] = {
    "nearest": lambda n, p: half_away((n - 1) * F.lit(p)),
    "floor": lambda n, p: F.floor((n - 1) * F.lit(p)),
    "scaled": lambda n, p: F.least(F.floor(n * F.lit(p)), n - 1),
    "upper_median": lambda n, p: F.floor(n / 2),
    "lower_median": lambda n, p: F.floor((n - 1) / 2),
}


def join_groups(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", rows: str = "n") -> DataFrame:
    """``df`` with the columns of ``groups``, which has one row per key and its number of ``rows``.

    Groups of more than CHUNK_ROWS rows are so few that they are broadcast, and no
    task gets one of them whole; the rest is shuffled.  ``groups`` is read three
    times, so it should be materialised.
    """
    large = F.col(rows) > CHUNK_ROWS
    many, few = groups.agg(F.count_if(large), F.count_if(~large)).first()
    if not many:
        return df.join(groups, keys, how)
    hot = groups.filter(large)  # at most one for every CHUNK_ROWS rows
    if not few:
        return df.join(F.broadcast(hot), keys, how)
    rest = df.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.filter(~large), keys, how)
    return df.join(F.broadcast(hot), keys).unionByName(rest)


def order_stats(df: DataFrame, keys: list[str], value: str, picks: dict[str, tuple[str, float]],
                accuracy: int = 10_000) -> DataFrame:
    """Exact values at the picked ranks, per key, plus the row count ``n``.

    Approximate quantiles bracket every pick; one more pass counts the rows below
    the brackets and the distinct values inside them, which settles the rank.
    Groups of any size cost two reads and a tiny ordered step.
    """
    v = F.col(value)
    df = df.filter(v.isNotNull()).withColumn(value, v.cast("double"))
    names = list(picks)
    slack = 2.0 / accuracy
    centre = {n: (0.5 if "median" in r else p) for n, (r, p) in picks.items()}
    edges = [q for n in names for q in (max(centre[n] - slack, 0.0), min(centre[n] + slack, 1.0))]
    key_cols = keys or ["_all"]
    if not keys:
        df = df.withColumn("_all", F.lit(0))
    br = df.groupBy(*key_cols).agg(
        F.count(v).alias("n"), F.min(v).alias("_min"), F.max(v).alias("_max"),
        F.percentile_approx(v, F.array(*[F.lit(q) for q in edges]), F.lit(accuracy)).alias("_q"))
    small = 1.0 / slack  # below this many rows a bracket spans the neighbours, so widen it to the group
    for i, n in enumerate(names):
        lo_open = F.lit(centre[n] - slack <= 0) | (F.col("n") <= small)
        hi_open = F.lit(centre[n] + slack >= 1) | (F.col("n") <= small)
        br = br.withColumns({
            f"_lo{i}": F.when(lo_open, F.col("_min")).otherwise(F.col("_q")[2 * i]),
            f"_hi{i}": F.when(hi_open, F.col("_max")).otherwise(F.col("_q")[2 * i + 1]),
            f"_k{i}": RULES[picks[n][0]](F.col("n"), picks[n][1]).cast("long"),
        })
    br = checkpointed(br.drop("_q", "_min", "_max"))  # one row per key
    d = join_groups(df.select(*key_cols, value), br.drop(*[f"_k{i}" for i in range(len(names))]), key_cols)
    inside = F.lit(False)
    for i in range(len(names)):
        inside = inside | v.between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
    # one more read: values inside a bracket by value, all others by the brackets they lie below
    under = sum(((v < F.col(f"_lo{i}")).cast("long") * (1 << i) for i in range(len(names))), F.lit(0).cast("long"))
    counted = d.groupBy(*key_cols, under.alias("_under"), F.when(inside, v).alias("_v")).agg(F.count("*").alias("_c"))
    below = counted.groupBy(*key_cols).agg(*[F.sum(F.when(F.col("_under").bitwiseAND(1 << i) > 0, F.col("_c")).otherwise(0)).alias(f"_b{i}") for i in range(len(names))])
    near = counted.filter("_v is not null").groupBy(*key_cols, "_v").agg(F.sum("_c").alias("_c"))
    base = br.join(below, key_cols)
    pick = F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), F.col(f"_lo{i}").alias("lo"), F.col(f"_hi{i}").alias("hi"),
        (F.col(f"_k{i}") - F.col(f"_b{i}")).alias("k")) for i in range(len(names))])).alias("p")
    near = near.join(base.select(*key_cols, pick), key_cols).filter(F.col("_v").between(F.col("p.lo"), F.col("p.hi")))
    w = Window.partitionBy(*key_cols, "p.i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hit = near.withColumn("_cum", F.sum("_c").over(w)).groupBy(*key_cols).agg(*[
        F.min(F.when((F.col("p.i") == i) & (F.col("p.k") >= 0) & (F.col("_cum") > F.col("p.k")), F.col("_v"))).alias(n) for i, n in enumerate(names)])
    checked = [F.coalesce(n, F.raise_error(F.lit(f"rank bracket missed {n}")).cast("double")).alias(n) for n in names]
    return base.join(hit, key_cols).select(*keys, "n", *checked)


def median(df: DataFrame, keys: list[str], value: str, into: str = "median") -> DataFrame:
    """Mean of the two middle values for even counts."""
    s = order_stats(df, keys, value, {"_a": ("lower_median", 0.5), "_b": ("upper_median", 0.5)})
    return s.withColumn(into, (F.col("_a") + F.col("_b")) / 2).drop("_a", "_b")


def affine_scan(factor: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor and offset of the first 1, 2, ... n steps v -> factor * v + offset, composed by doubling."""
    factor, offset, step = factor.astype(float), offset.astype(float), 1
    while step < len(factor):
        offset = np.r_[offset[:step], factor[step:] * offset[:-step] + offset[step:]]
        factor = np.r_[factor[:step], factor[step:] * factor[:-step]]
        step *= 2
    return factor, offset


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object],
                 step: Callable[[object, object], Iterable[tuple]], schema: str) -> DataFrame:
    """Sequential fold per key over sorted rows, streamed in Arrow batches.

    The state is carried from batch to batch, so memory does not grow with the
    key.  Keys run in parallel; pass keys that include a segment number where
    the state is known to restart.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches):
        key, state = None, None
        for pdf in batches:
            out = []
            for rec in pdf.itertuples(index=False):
                now = tuple(getattr(rec, k) for k in keys)
                if now != key:
                    key, state = now, start()
                out.extend(step(state, rec))
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
