"""Set-shaped operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.operators.ordering import ordered_fold, previous_row, running


def upsert(existing: DataFrame, fresh: DataFrame, key: str, merge: bool = True) -> DataFrame:
    """New rows win on equal keys; without merge they replace everything."""
    if not merge:
        return fresh
    both = existing.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    cols = [c for c in existing.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), "_new").alias("_s")).select(key, "_s.*")


def tolerance_distinct(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Sorted values within the tolerance of the last kept one collapse.

    A gap of at least the tolerance always starts afresh, so the fold runs
    independently inside each gap-free island."""
    types = dict(df.dtypes)
    distinct = df.select(*keys, F.col(value).alias("v")).distinct()
    width = tolerance * 4096  # values per chunk of one key
    d = previous_row(distinct, keys, ["v"], ["v"], width)
    cut = F.coalesce(F.col("v") - F.col("prev.v") >= tolerance, F.lit(True)).cast("long")
    islands = running(d.withColumn("_cut", cut).drop("prev"), keys, ["v"], {"island": ("sum", F.col("_cut"))}, width).drop("_cut")

    def step(state, row):
        if state["kept"] is not None and row.v - state["kept"] < tolerance:
            return []
        state["kept"] = row.v
        return [(*[getattr(row, k) for k in keys], row.v)]

    return ordered_fold(islands, [*keys, "island"], ["v"], lambda: {"kept": None}, step,
                        ", ".join(f"{k} {types[k]}" for k in keys) + f", {value} double")


def unmatched(detections: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Detections without a track and tracks without a detection."""
    lost = tracks.join(detections.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("track"))
    new = detections.join(tracks.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("detection"))
    return new.unionByName(lost)
