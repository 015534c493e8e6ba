"""Ordered scans: gap groups, smoothing, paths, run lengths, hash chains."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.operators.ordering import (DAY_US, affine_scan, indexed, join_groups, keys_fit, order_stats, ordered_fold, previous_row, running,
                                         with_chunk, with_halo)
from scanloom.session import checkpointed


def gap_groups(df: DataFrame, keys: list[str], us: str, tie: str, gap_us: int, width_us: int = DAY_US) -> DataFrame:
    """Number rows into groups; a gap strictly longer than ``gap_us`` starts a new one."""
    d = previous_row(df, keys, [us, tie], [us], width_us)
    starts = (F.col("prev").isNull() | (F.col(us) - F.col(f"prev.{us}") > gap_us)).cast("long")
    return running(d.withColumn("_start", starts).drop("prev"), keys, [us, tie], {"group_no": ("sum", F.col("_start"))}, width_us).drop("_start")


def exponential_smoothing(df: DataFrame, keys: list[str], us: str, tie: str, value: str, alpha: float,
                          width_us: int = 3650 * DAY_US) -> DataFrame:
    """v = v(1-a) + x*a from zero.  Every row is an affine step, and such steps
    compose: chunks are scanned side by side, and the chunks of a key once more."""
    d = df.select(*keys, us, tie, value)
    fit = width_us >= 3650 * DAY_US and keys_fit(d, keys)
    d = d.withColumn("_chunk", F.lit(0)) if fit else with_chunk(d, keys, [us, tie], width_us)
    names = d.columns
    types = {f.name: f.dataType for f in d.schema}

    def local(found: pa.Table) -> pa.Table:
        found = found.select(names).sort_by([(us, "ascending"), (tie, "ascending")])
        x = found.column(value).cast(pa.float64()).to_numpy()
        factor, offset = affine_scan(np.full(len(x), 1 - alpha), alpha * x)
        return found.append_column("_factor", pa.array(factor)).append_column("_offset", pa.array(offset))

    smooth = d.groupBy(*keys, "_chunk").applyInArrow(local, T.StructType([*d.schema, *T.StructType.fromDDL("_factor double, _offset double")]))
    if fit:
        return smooth.withColumnRenamed("_offset", "smoothed").drop("_factor", "_chunk")
    last = F.struct(us, tie)
    ends = smooth.groupBy(*keys, "_chunk").agg(F.max_by("_factor", last).alias("f"), F.max_by("_offset", last).alias("o"))

    def chain(found: pa.Table) -> pa.Table:
        found = found.sort_by("_chunk")
        before = affine_scan(found.column("f").to_numpy(), found.column("o").to_numpy())[1]
        return found.select([*keys, "_chunk"]).append_column("_carry", pa.array(np.r_[0.0, before[:-1]]))

    carry = ends.groupBy(*keys).applyInArrow(chain, T.StructType([*(T.StructField(k, types[k]) for k in [*keys, "_chunk"]), T.StructField("_carry", T.DoubleType())]))  # one row per chunk
    return smooth.join(carry, [*keys, "_chunk"]).withColumn("smoothed", F.col("_offset") + F.col("_factor") * F.col("_carry")).drop("_offset", "_factor", "_carry", "_chunk")


def stable_for(df: DataFrame, keys: list[str], us: str, tie: str, value: str, frames: int, below: float,
               width_us: int = DAY_US) -> DataFrame:
    """True when the last ``frames`` values are all below the threshold."""
    if width_us >= DAY_US and keys_fit(df.select(*keys), keys):
        whole = Window.partitionBy(*keys).orderBy(us, tie)
        calm = F.count_if(~F.coalesce(F.col(value) >= below, F.lit(False))).over(whole.rowsBetween(1 - frames, 0))
        return df.withColumns({"seq": F.row_number().over(whole).cast("long"), "stable": calm == frames})
    d = running(df, keys, [us, tie], {"seq": ("sum", F.lit(1).cast("long"))}, width_us)
    d = running(d, keys, [us, tie], {"_hit": ("max", F.when(F.col(value) >= below, F.col("seq")))}, width_us)
    return d.withColumn("stable", (F.col("seq") >= frames) & (F.col("seq") - F.coalesce("_hit", F.lit(0)) >= frames)).drop("_hit")


def camera_path(df: DataFrame, keys: list[str], us: str, tie: str, moves: list[str], scale: str, window: int, strength: float,
                bucket: int = 4096, width_us: int = DAY_US) -> DataFrame:
    """Integrated path, its centred moving average over rows [-w/2, w/2), the
    blend and the correction.  Frames are evaluated on index buckets with a halo."""
    half = window // 2
    sums = {f"p_{m}": ("sum", F.col(m)) for m in moves}
    sums |= {"_ln": ("sum", F.log(F.col(scale))), "seq": ("sum", F.lit(1).cast("long"))}
    path = running(df, keys, [us, tie], sums, width_us).withColumn("p_scale", F.exp("_ln")).drop("_ln")
    w = Window.partitionBy(*keys, "_bucket").orderBy("seq").rowsBetween(-half, half - 1)
    path = with_halo(path, "seq", bucket, half).withColumns({f"_m_{m}": F.avg(f"p_{m}").over(w) for m in moves}).filter("own")
    for m in moves:
        blend = F.col(f"p_{m}") * (1 - strength) + F.col(f"_m_{m}") * strength
        path = path.withColumns({f"s_{m}": blend, f"c_{m}": blend - F.col(f"p_{m}")})
    return path.drop("own", "_bucket", *[f"_m_{m}" for m in moves])


def change_runs(df: DataFrame, keys: list[str], us: str, tie: str, value: str, scale: float, below: float,
                width_us: int = DAY_US) -> DataFrame:
    """Length of the current run of small changes; any larger change resets it."""
    d = previous_row(df, keys, [us, tie], [value], width_us)
    share = F.abs(F.col(value) - F.col(f"prev.{value}")) / scale
    d = d.withColumn("small", F.coalesce((share < below), F.lit(False)).cast("long")).drop("prev")
    d = running(d, keys, [us, tie], {"_cum": ("sum", F.col("small"))}, width_us)
    d = running(d, keys, [us, tie], {"_base": ("max", F.when(F.col("small") == 0, F.col("_cum")))}, width_us)
    return d.withColumn("run", F.col("_cum") - F.coalesce("_base", F.lit(0))).drop("_cum", "_base", "small")


def percentile_grades(df: DataFrame, keys: list[str], value: str, foreground: str, a: float = 0.60, b: float = 0.35) -> DataFrame:
    """A, B or C for foreground rows by thresholds at truncated ranks; D for background."""
    marks = order_stats(df.filter(F.col(foreground)), keys, value, {"_ta": ("floor", a), "_tb": ("floor", b)}).drop("n")
    marks = checkpointed(df.groupBy(*keys).agg(F.count("*").alias("_rows")).join(marks, keys, "left"))  # one row per key
    v = F.col(value)
    grade = (F.when(~F.col(foreground), "D").when(v >= F.col("_ta"), "A").when(v >= F.col("_tb"), "B")
             .when(F.col("_ta").isNull(), "D").otherwise("C"))
    return join_groups(df, marks, keys, "left", "_rows").withColumn("grade", grade).drop("_ta", "_tb", "_rows")


def match_distribution(source: DataFrame, reference: DataFrame, value: str, order: list[str]) -> DataFrame:
    """The i-th smallest source value becomes the reference value at rank
    round(i/(n-1)*(m-1)); both ranks come from balanced range partitions."""
    s, r = indexed(source, [value, *order], into="i"), indexed(reference.select(F.col(value).alias("matched")), ["matched"], into="j")
    sizes = s.agg(F.count("*").alias("n")).crossJoin(r.agg(F.count("*").alias("m")))  # one row
    rank = F.floor(F.col("i") / (F.col("n") - 1) * (F.col("m") - 1) + 0.5)
    return s.crossJoin(F.broadcast(sizes)).withColumn("j", rank).join(r, "j").drop("i", "j", "n", "m")


def histogram_match(source: DataFrame, reference: DataFrame, bin_col: str, keys: list[str]) -> DataFrame:
    """256-level lookup table per key: nearest cumulative share, lowest level on ties."""
    levels = source.sparkSession.range(256).select(F.col("id").cast("int").alias("level"))

    def cdf(df, name):
        h = df.groupBy(*keys, F.col(bin_col).alias("level")).agg(F.count("*").alias("c"))
        full = h.select(*keys).distinct().crossJoin(F.broadcast(levels)).join(h, [*keys, "level"], "left")  # 256 levels
        up = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
        total = Window.partitionBy(*keys)
        return full.select(*keys, "level", (F.sum(F.coalesce("c", F.lit(0))).over(up) / F.sum(F.coalesce("c", F.lit(0))).over(total)).alias(name))

    ref = cdf(reference, "q").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level", "q"))).alias("ref"))  # 256 entries
    src = cdf(source, "p")
    best = F.array_min(F.transform("ref", lambda r: F.struct(F.abs(r.q - F.col("p")).alias("d"), r.level.alias("level"))))
    return src.join(ref, keys).select(*keys, "level", best.getField("level").alias("matched"))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rebuild_chain(records: DataFrame, log: str, order: list[str], payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Hash chain per log: each hash covers the previous hash and the payload.
    A chain is sequential by definition; logs run in parallel in constant memory.
    Columns to ``keep`` stand beside the chain and are in no hash."""
    types = dict(records.dtypes)

    def step(state, row):
        state["seq"] += 1
        prev = state["hash"]
        state["hash"] = sha(f"{prev}|{getattr(row, payload)}")
        return [(getattr(row, log), state["seq"], getattr(row, payload), prev, state["hash"], *[getattr(row, c) for c in keep])]

    return ordered_fold(records.select(log, *order, payload, *keep), [log], order, lambda: {"seq": 0, "hash": "genesis"}, step,
                        ", ".join([f"{log} {types[log]}, seq long, payload string, prev_hash string, hash string", *[f"{c} {types[c]}" for c in keep]]))


def verify_chain(chain: DataFrame, log: str) -> DataFrame:
    """Per log: intact or not, and the first bad sequence number.  The link
    check is an equi-join on (log, seq), so one huge log spreads over tasks."""
    before = chain.select(log, (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_want"))
    d = chain.join(before, [log, "seq"], "left")
    linked = F.col("prev_hash") == F.when(F.col("seq") == 1, F.lit("genesis")).otherwise(F.col("_want"))
    hashed = F.col("hash") == F.sha2(F.concat_ws("|", "prev_hash", "payload"), 256)
    bad = ~F.coalesce(linked & hashed, F.lit(False))
    return d.groupBy(log).agg(F.count("*").alias("records"), F.min(F.when(bad, F.col("seq"))).alias("first_bad")).withColumn(
        "valid", F.col("first_bad").isNull())


def focus_pattern(groups: DataFrame, shutters: str, tolerance: float = 1e-4) -> DataFrame:
    """Exposures per plane, plane count and representative frames of each capture
    group; ``shutters`` is the bounded array of one group in time order."""
    s = F.col(shutters)
    kept = F.aggregate(F.array_sort(s), F.array().cast("array<double>"), lambda acc, v: F.when(
        (F.size(acc) > 0) & (F.abs(v - F.element_at(acc, -1)) < tolerance), acc).otherwise(F.array_append(acc, v)))
    n = F.size(s)
    d = groups.withColumn("distinct_exposures", F.when(n > 0, F.size(kept)).otherwise(0))
    u = F.col("distinct_exposures")
    repeats = F.forall(F.transform(s, lambda v, i: (i + u >= n) | (F.abs(v - F.get(s, i + u)) <= tolerance)), lambda ok: ok)
    period = F.when(n < 2, 1).when(u.between(2, 5) & repeats, u).otherwise(F.least(u, F.lit(3)))
    d = d.withColumn("exposures_per_plane", period)
    d = d.withColumn("planes", F.ceil(n / F.col("exposures_per_plane")).cast("int"))
    mid = F.floor(F.col("exposures_per_plane") / 2).cast("int")
    reps = F.filter(F.transform(F.sequence(F.lit(0), F.col("planes") - 1), lambda p: p * F.col("exposures_per_plane") + mid), lambda i: i < n)
    return d.withColumn("representatives", reps)


def reference_index(exposures, ref_exposure, ref_focus):
    """ref_focus * exposures + first exposure within .01 of the reference, else the middle one."""
    n = F.size(exposures)
    near = F.get(F.filter(F.transform(exposures, lambda e, i: F.when(F.abs(e - ref_exposure) < 0.01, i)), lambda i: i.isNotNull()), F.lit(0))
    return ref_focus * n + F.coalesce(near, F.floor(n / 2))
