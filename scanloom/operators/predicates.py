"""Row predicates and rule catalogues: pure column expressions, no shuffle
unless a rule needs a per-key aggregate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_confidence(points: DataFrame, threshold: float) -> DataFrame:
    return points.filter(F.col("confidence") >= threshold)


def inside_box(lo: Iterable[float], hi: Iterable[float], axes=("x", "y", "z")) -> Column:
    """All bounds inclusive."""
    test = F.lit(True)
    for a, low, high in zip(axes, lo, hi):
        test = test & F.col(a).between(low, high)
    return test


def apply_edits(splats: DataFrame, edits: Iterable[tuple]) -> DataFrame:
    """Edits in list order: ("opacity", min), ("box", lo, hi),
    ("sphere", centre, radius), ("density", target)."""
    for kind, *args in edits:
        if kind == "opacity":
            splats = splats.filter(F.col("alpha") >= args[0])
        elif kind == "box":
            splats = splats.filter(inside_box(*args))
        elif kind == "sphere":
            centre, radius = args
            d2 = sum((F.col(a) - c) * (F.col(a) - c) for a, c in zip("xyz", centre))
            splats = splats.filter(d2 <= radius * radius)
        elif kind == "density":
            splats = splats.orderBy(F.desc("alpha"), "splat_id").limit(args[0])
        else:
            raise ValueError(f"unknown edit {kind}")
    return splats


def first_failure(reasons: Mapping[str, Column]) -> Column:
    """Name of the first failing rule in mapping order, else null."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, failed in reasons.items():
        chain = chain.when(failed, F.lit(name))
    return chain


def failed_rules(rules: Mapping[str, Column]) -> Column:
    """Array of the names of rules whose condition does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))


def messages(conditions: Mapping[str, Column]) -> Column:
    """Array of the names of conditions that hold."""
    return F.array_compact(F.array(*[F.when(hit, F.lit(n)) for n, hit in conditions.items()]))


def quality_reason(sharpness: Column, mean: Column, blockiness: Column,
                   min_sharpness=100.0, dark=20.0, bright=240.0, max_score=35.0) -> Column:
    return first_failure({
        "too_blurry": sharpness < min_sharpness,
        "underexposed": mean < dark,
        "overexposed": mean > bright,
        "low_perceptual_quality": blockiness > max_score,
    })


def bad_path(path: Column) -> Column:
    """Absolute paths and parent steps are not allowed."""
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def manifest_group_failures() -> Column:
    """Rules over (group_id, paths, focus_steps, exposures, bursts, frame_order)."""
    steps = F.greatest(F.col("focus_steps"), F.lit(1))
    order = F.col("frame_order")
    return failed_rules({
        "id_not_sha256": F.col("group_id").rlike("^[0-9a-fA-F]{64}$"),
        "no_frames": F.size("paths") > 0,
        "frames_not_divisible": F.size("paths") % steps == 0,
        "order_size": F.size(order) == F.size("paths"),
        "order_not_contiguous": F.forall(
            F.transform(order, lambda o, i: (o.frame_index == i) & (o.focus_index < steps)
                        & (o.exposure_index < F.greatest(F.col("exposures"), F.lit(1)))
                        & (o.burst_index < F.greatest(F.col("bursts"), F.lit(1)))), lambda ok: ok),
        "reference_count": F.size(F.filter(order, lambda o: o.sequence_reference)) == 1,
        "path_traversal": ~F.exists("paths", bad_path),
    })


def expired(created: Column, now: Column, limit_days: Column) -> Column:
    """Whole 24-hour days older than the limit; a limit of zero keeps for ever."""
    age = F.floor((F.unix_micros(now) - F.unix_micros(created)) / F.lit(86_400_000_000))
    return (limit_days > 0) & (age > limit_days)


def gate_failures(current: DataFrame, baseline: DataFrame, keys: list[str], tolerances: DataFrame) -> DataFrame:
    """Metrics in long form (keys, metric, value) against tolerances
    (metric, direction, tolerance); direction -1 fails on a drop, +1 on a rise."""
    joined = (
        current.withColumnRenamed("value", "current_value")
        .join(baseline.withColumnRenamed("value", "baseline_value"), [*keys, "metric"], "full_outer")
        .join(F.broadcast(tolerances), "metric")  # eight fixed rows
    )
    delta = F.col("current_value") - F.col("baseline_value")
    return joined.withColumn("delta", delta).filter(F.col("direction") * delta > F.col("tolerance"))


def chroma_foreground(key: tuple[int, int, int], tolerance: float) -> Column:
    d2 = sum((F.col(c).cast("double") - k) * (F.col(c).cast("double") - k) for c, k in zip("rgb", key))
    return F.sqrt(d2) > tolerance * 441.6


def difference_foreground(threshold: int) -> Column:
    """Sum of channel differences from the clean plate (columns pr, pg, pb)."""
    return sum(F.abs(F.col(c) - F.col("p" + c)) for c in "rgb") > threshold


def temporal_weight(t: float | Column) -> Column:
    dt = F.lit(t) - F.col("centre_t")
    return F.exp(-0.5 * dt * dt / F.col("var_t"))


def visible_at(splats: DataFrame, t: float, floor: float = 0.01) -> DataFrame:
    """Rows alive at ``t`` with their moved position and faded opacity."""
    dt = F.lit(t) - F.col("centre_t")
    return (
        splats.filter(F.lit(t).between(F.col("t0"), F.col("t1")))
        .withColumn("weight", temporal_weight(t))
        .filter(F.col("weight") >= floor)
        .select("splat_id", *[(F.col(a) + F.col("v" + a) * dt).alias(a) for a in "xyz"],
                (F.col("opacity") * F.col("weight")).alias("opacity"), "weight")
    )


def lifespan_prune(observations: DataFrame, current_frame: int, min_lifespan=10, max_inactive=30,
                   min_average=0.01, min_ratio=0.1, active_over=0.005) -> DataFrame:
    """One row per splat with its prune decision, from (splat_id, frame, opacity)."""
    active = F.col("opacity") > active_over
    s = observations.groupBy("splat_id").agg(
        F.min("frame").alias("birth"),
        F.max(F.when(active, F.col("frame"))).alias("last_seen"),
        F.count_if(active).alias("active_frames"),
        F.coalesce(F.sum(F.when(active, F.col("opacity"))), F.lit(0.0)).alias("total"),
    ).withColumn("last_active", F.coalesce("last_seen", "birth"))
    average = F.col("total") / F.greatest(F.col("active_frames"), F.lit(1))
    ratio = F.col("active_frames") / (F.lit(current_frame) - F.col("birth") + 1)
    prune = (
        (F.col("last_active") - F.col("birth") + 1 < min_lifespan)
        | (F.lit(current_frame) - F.col("last_active") > max_inactive)
        | (average < min_average) | (ratio < min_ratio)
    )
    return s.select("splat_id", "birth", "last_active", "active_frames", average.alias("average"),
                    ratio.alias("ratio"), prune.alias("prune"))


def tagged(catalogue: DataFrame, tag: str, fields: Iterable[str]) -> DataFrame:
    """Case-insensitive substring match in any of the fields."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.lower(F.col(f)).contains(tag.lower()), F.lit(False))
    return catalogue.filter(hit)
