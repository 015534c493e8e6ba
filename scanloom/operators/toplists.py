"""Sorts, limits and best-per-key picks.

Per-key limits are written as ``row_number() <= k`` so that Spark cuts each
key to k rows before the shuffle, which also tames hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.ordering import indexed


def newest(df: DataFrame, by: str, tie: str, limit: int = 500) -> DataFrame:
    """The newest ``limit`` rows, at least one."""
    return df.orderBy(F.desc(by), tie).limit(max(1, limit))


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, into: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(into, F.row_number().over(w)).filter(F.col(into) <= k)


def pending_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin("pending", "running"))


def retryable_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter((F.col("status") == "failed") & (F.col("attempt_count") < F.col("max_attempts")))


def next_best_bins(cells: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, bin, coverage, uncertainty) to the k highest-scored bins."""
    score = (F.coalesce("uncertainty", F.lit(0.0)) + 0.15) / (F.greatest(F.col("coverage"), F.lit(0.0)) + 1.0)
    return top_per_key(cells.withColumn("score", score), keys, [F.desc("score"), F.col("bin")], k)


def best_candidate(utilities: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """Highest utility per ms above the information floor; ties prefer lower ISO,
    then shorter shutter, then lower focus."""
    eligible = utilities.filter((F.col("hdr_nats") >= floor) | (F.col("focus_nats") >= floor))
    order = F.struct("utility_per_ms", (-F.col("iso")).alias("i"), (-F.col("shutter")).alias("s"), (-F.col("focus")).alias("f"))
    return eligible.groupBy(*keys).agg(F.max_by(F.struct("candidate_id", "utility_per_ms", "iso"), order).alias("best")).select(*keys, "best.*")


def reference_source(sources: DataFrame, keys: list[str]) -> DataFrame:
    """Source with audio of highest rank per job: official 100, professional 80, else its quality."""
    rank = F.when(F.col("kind") == "official", 100.0).when(F.col("kind") == "professional", 80.0).otherwise(F.col("quality"))
    return top_per_key(sources.filter("has_audio").withColumn("score", rank), keys, [F.desc("score"), F.col("source_id")], 1).drop("rank")


def top_features(features: DataFrame, per_image: int, border: int, width: int, height: int) -> DataFrame:
    """Strongest features per image, then those too near the border are dropped."""
    kept = top_per_key(features, ["image_id"], [F.desc("response"), F.col("kp_id")], per_image)
    inside = F.col("x").between(border, width - border - 1) & F.col("y").between(border, height - border - 1)
    return kept.filter(inside)


def spectral_peaks(spectrum: DataFrame, keys: list[str], k: int = 6) -> DataFrame:
    """Bins strictly above their two neighbours on both sides, k strongest per chunk.
    Neighbours are found by shifting the bin number, so one aggregate suffices.
    Chunks without a key and neighbours without a magnitude count for nothing."""
    near = spectrum.dropna(subset=keys).select(*keys, F.explode(F.array(*[F.struct((F.col("bin") + d).alias("bin"), F.lit(d).alias("d"), F.col("magnitude").alias("m")) for d in (-2, -1, 0, 1, 2)])).alias("n"))
    around = near.groupBy(*keys, F.col("n.bin").alias("bin")).agg(
        F.max(F.when(F.col("n.d") == 0, F.col("n.m"))).alias("magnitude"),
        F.count(F.when(F.col("n.d") != 0, F.col("n.m"))).alias("c"), F.max(F.when(F.col("n.d") != 0, F.col("n.m"))).alias("best"))
    peaks = around.filter((F.col("c") == 4) & (F.col("magnitude") > F.col("best"))).drop("c", "best")
    return top_per_key(peaks, keys, [F.desc("magnitude"), F.col("bin")], k)


def stride_sample(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Every step-th row of the ordered table, step = ceil(n / limit)."""
    d = indexed(df, order, into="_i")
    n = d.agg(F.count("*").alias("_n"))  # one row
    return d.crossJoin(F.broadcast(n)).filter(F.col("_i") % F.ceil(F.col("_n") / limit) == 0).drop("_n").withColumnRenamed("_i", "row_index")


def best_of_burst(frames: DataFrame, keys: list[str], order: str, dark: float = 20.0, bright: float = 240.0) -> DataFrame:
    """Marks the best frame of each burst; the others stay listed."""
    b = F.col("brightness")
    penalty = F.when(b < dark, (dark - b) * 0.5).when(b > bright, (b - bright) * 0.5).otherwise(F.lit(0.0))
    d = frames.withColumn("score", F.greatest(F.col("sharpness") - penalty, F.lit(0.0)))
    best = d.groupBy(*keys).agg(F.max_by(order, F.struct("score", (-F.col(order)).alias("o"))).alias("_best"))
    return d.join(best, keys).withColumn("keep", F.col(order) == F.col("_best")).drop("_best")


def recent(df: DataFrame, by: str, tie: str, limit: int = 50) -> DataFrame:
    return df.orderBy(F.desc(by), F.desc(tie)).limit(limit).orderBy(by, tie)
