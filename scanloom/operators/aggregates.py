"""Algebraic aggregates: partial sums before every shuffle, one row per group after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.ordering import join_groups, order_stats
from scanloom.operators.toplists import top_per_key
from scanloom.session import checkpointed


def scope_timings(df: DataFrame, run: str, label: str, value: str) -> DataFrame:
    """Per run and label: min, mean, max, sample deviation, count, mean as % of the run total."""
    g = df.groupBy(run, label).agg(
        F.min(value).alias("min_ms"), F.avg(value).alias("mean_ms"), F.max(value).alias("max_ms"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_ms"), F.count(value).alias("count"), F.sum(value).alias("_s"))
    total = F.sum("_s").over(Window.partitionBy(run))  # one row per label
    return g.withColumn("pct_total", F.when(total > 0, F.col("mean_ms") / total * 100).otherwise(F.lit(0.0))).drop("_s")


def combine_timings(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Merge (count, mean, min, max) rows: count-weighted mean, min of mins, max of maxes."""
    return parts.groupBy(*keys).agg(
        F.sum("count").alias("count"), (F.sum(F.col("mean_ms") * F.col("count")) / F.sum("count")).alias("mean_ms"),
        F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"))


def channel_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    s = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return s.withColumn("stops", F.log2(F.col("max") / F.greatest(F.col("min"), F.lit(1e-6))))


def histogram(df: DataFrame, keys: list[str], value: Column, bins: int = 256) -> DataFrame:
    b = F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def channel_covariance(df: DataFrame, keys: list[str], cols: tuple[str, str, str]) -> DataFrame:
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    return df.groupBy(*keys).agg(*[F.covar_samp(cols[i], cols[j]).alias(f"c{i}{j}") for i, j in pairs])


def voxel(size, axes=("x", "y", "z")) -> list[Column]:
    size = size if isinstance(size, Column) else F.lit(size)
    return [F.floor(F.col(a) / size).cast("int").alias("v" + a) for a in axes]


VOX = ["vx", "vy", "vz"]


def voxel_downsample(points: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Mean position, truncated mean colour and mean confidence per voxel."""
    return points.groupBy(*keys, *voxel(size)).agg(
        *[F.avg(a).alias(a) for a in "xyz"], *[F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"],
        F.avg("confidence").alias("confidence"), F.count("*").alias("points"))


def voxel_counts(points: DataFrame, keys: list[str], size: float) -> DataFrame:
    return points.groupBy(*keys, *voxel(size)).agg(F.count("*").alias("n"))


# Lower ratio bound, class, colour.
DENSITY = ((0.8, "excellent", (0, 255, 0)), (0.6, "good", (128, 255, 0)), (0.4, "medium", (255, 255, 0)),
           (0.2, "low", (255, 128, 0)), (0.0, "very_low", (255, 0, 0)))
NO_DATA = ("none", (128, 128, 128))


def density_class(count: Column, largest: Column) -> Column:
    chain = F.when(F.coalesce(count, F.lit(0)) == 0, NO_DATA[0])
    for bound, name, _ in DENSITY[:-1]:
        chain = chain.when(count / largest >= bound, name)
    return chain.otherwise("very_low")


def density_colour(name: Column) -> Column:
    def arr(c):
        return F.array(*[F.lit(v) for v in c])

    chain = F.when(name == NO_DATA[0], arr(NO_DATA[1]))
    for _, n, c in DENSITY:
        chain = chain.when(name == n, arr(c))
    return chain


def with_largest(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Largest voxel count per cloud: an aggregate joined back, so that a cloud
    with very many voxels is not ordered in one task."""
    return counts.join(counts.groupBy(*keys).agg(F.max("n").alias("largest")), keys)


def coverage_statistics(points: DataFrame, keys: list[str], size: float) -> DataFrame:
    d = with_largest(voxel_counts(points, keys, size), keys).withColumn("class", density_class(F.col("n"), F.col("largest")))
    names = [n for _, n, _ in DENSITY]
    s = d.groupBy(*keys).agg(F.count("*").alias("voxels"), F.max("n").alias("max_density"),
                             *[F.count_if(F.col("class") == n).alias(n) for n in names])
    return s.withColumns({"good_pct": (F.col("good") + F.col("excellent")) / F.col("voxels") * 100,
                          "poor_pct": (F.col("low") + F.col("very_low")) / F.col("voxels") * 100})


def heatmap_colours(targets: DataFrame, points: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Colour rows (points or vertices) by the class of the voxel they fall in."""
    counts = with_largest(voxel_counts(points, keys, size), keys)
    d = targets.select("*", *voxel(size)).join(counts, [*keys, *VOX], "left")
    return d.withColumn("class", density_class(F.col("n"), F.col("largest"))).withColumn("colour", density_colour(F.col("class"))).drop(*VOX, "n", "largest")


FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def coverage_uniformity(points: DataFrame, keys: list[str], size: float = 0.05) -> DataFrame:
    """Evenness of voxel counts, and whether a filled voxel has more than three empty face neighbours."""
    c = voxel_counts(points, keys, size)
    shifted = c.select(*keys, F.explode(F.array(*[F.struct((F.col("vx") + a).alias("vx"), (F.col("vy") + b).alias("vy"), (F.col("vz") + d).alias("vz")) for a, b, d in FACES])).alias("v"))
    beside = shifted.groupBy(*keys, "v.vx", "v.vy", "v.vz").agg(F.count("*").alias("filled"))
    d = c.join(beside, [*keys, *VOX], "left")
    gap = (F.col("n") >= 2) & (6 - F.coalesce("filled", F.lit(0)) > 3)
    s = d.groupBy(*keys).agg(F.count("*").alias("voxels"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.max(gap).alias("has_gaps"))
    return s.select(*keys, "voxels", (F.col("mean") / 100).alias("avg_density"),
                    F.greatest(1 - F.least(F.col("std") / F.col("mean"), F.lit(1.0)), F.lit(0.0)).alias("uniformity"), "has_gaps")


def guidance_direction(points: DataFrame, keys: list[str]) -> DataFrame:
    n = F.count("*")
    s = points.groupBy(*keys).agg((F.count_if(F.col("x") < 0) / n).alias("left"), (F.count_if(F.col("y") < 0) / n).alias("bottom"))
    left, right, bottom, top = F.col("left"), 1 - F.col("left"), F.col("bottom"), 1 - F.col("bottom")
    turn = (F.when((bottom < 0.15) & (top > 0.4), "flip")
            .when((F.least(left, right) < 0.25) & (left < right), "right").when(F.least(left, right) < 0.25, "left")
            .when((F.least(top, bottom) < 0.25) & (top < bottom), "down").when(F.least(top, bottom) < 0.25, "up").otherwise("any"))
    return s.withColumn("direction", turn)


def bin_coverage(steps: DataFrame, keys: list[str], azimuth_bins: int, elevation_bins: int) -> DataFrame:
    """Coverage per (azimuth, elevation) cell: 1 on the hit bin, .3 on both wrapped
    neighbours; then share of cells at .9 and mean of cells capped at 1.
    Weights are whole tenths, so that three neighbours reach .9 exactly."""
    angle = F.pmod(F.col("angle"), F.lit(360.0))
    hit = F.floor(angle / 360.0 * azimuth_bins).cast("int") % azimuth_bins
    cells = F.array(F.struct(hit.alias("bin"), F.lit(10).alias("w")),
                    F.struct(((hit + azimuth_bins - 1) % azimuth_bins).alias("bin"), F.lit(3).alias("w")),
                    F.struct(((hit + 1) % azimuth_bins).alias("bin"), F.lit(3).alias("w")))
    grid = steps.select(*keys, "elevation", F.explode(cells).alias("c")).groupBy(*keys, "elevation", F.col("c.bin").alias("bin")).agg(F.sum("c.w").alias("v"))
    total = azimuth_bins * elevation_bins  # cells never hit count as zero
    return grid.groupBy(*keys).agg((F.count_if(F.col("v") >= 9) / total).alias("score"), (F.sum(F.least(F.col("v"), F.lit(10))) / 10 / total).alias("density"))


def imu_diagnostics(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples (keys, t seconds, accel, gyro arrays)."""
    def length(c):
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v))

    d = samples.withColumns({"_a": length(F.col("accel")), "_g": length(F.col("gyro"))})
    s = d.groupBy(*keys).agg(
        F.count("*").alias("samples"), (F.max("t") - F.min("t")).alias("duration"),
        *[f.alias(f"{n}_{p}") for p, c in (("accel", "_a"), ("gyro", "_g")) for n, f in
          (("mean", F.avg(c)), ("rms", F.sqrt(F.avg(F.col(c) * F.col(c)))), ("peak", F.max(c)))])
    rate = F.when(F.col("duration") > 0, (F.col("samples") - 1) / F.col("duration")).otherwise(F.lit(0.0))
    warn = F.array_compact(F.array(F.when(F.col("samples") < 10, "few_samples"), F.when(F.col("duration") <= 0, "zero_duration"),
                                   F.when((F.col("duration") > 0) & (rate < 30), "low_rate")))
    return s.withColumns({"rate": rate, "warnings": warn})


def error_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    picks = order_stats(df, keys, value, {"_lo": ("lower_median", 0.5), "_hi": ("upper_median", 0.5), "p90": ("nearest", 0.9)})
    base = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    return picks.join(base, keys).select(*keys, "n", "mean", ((F.col("_lo") + F.col("_hi")) / 2).alias("median"), "p90", "max")


def track_statistics(observations: DataFrame, keys: list[str], point: str) -> DataFrame:
    return observations.groupBy(*keys, point).agg(F.count("*").alias("_l")).groupBy(*keys).agg(
        F.count("*").alias("points"), F.avg("_l").alias("mean_track"), F.max("_l").alias("max_track"),
        F.count_if(F.col("_l") >= 2).alias("two_views"), F.count_if(F.col("_l") >= 3).alias("three_views"))


def median_stack(pixels: DataFrame, pixel: list[str], value: str) -> DataFrame:
    """Upper median across frames.  Values are 8-bit, so each pixel has at most
    256 counted levels whatever the number of frames."""
    c = pixels.groupBy(*pixel, value).agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*pixel).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"_cum": F.sum("_c").over(up), "_n": F.sum("_c").over(Window.partitionBy(*pixel))})
    return c.filter(F.col("_cum") > F.floor(F.col("_n") / 2)).groupBy(*pixel).agg(F.min(value).alias("median"), F.max("_n").alias("frames"))


def gain_map(pixels: DataFrame, keys: list[str], pixel: list[str], value: str) -> DataFrame:
    m = pixels.groupBy(*keys, *pixel).agg(F.avg(value).alias("mean"))
    top = m.groupBy(*keys).agg(F.max("mean").alias("_top"))
    return m.join(top, keys).withColumn("gain", F.when(F.col("mean") <= 1, F.lit(1.0)).otherwise(F.col("_top") / F.col("mean"))).drop("_top")


def apply_gain(pixels: DataFrame, gains: DataFrame, on: list[str], value: str) -> DataFrame:
    return pixels.join(gains.drop("mean"), on).withColumn("corrected", F.least(F.col(value) * F.col("gain"), F.lit(255.0)))


def grey_world(pixels: DataFrame, keys: list[str]) -> DataFrame:
    s = pixels.groupBy(*keys).agg(*[F.avg(c).alias("m" + c) for c in "rgb"])
    grey = (F.col("mr") + F.col("mg") + F.col("mb")) / 3
    return s.select(*keys, *[F.when(F.col("m" + c) > 0, grey / F.col("m" + c)).otherwise(F.lit(1.0)).alias("gain_" + c) for c in "rgb"])


def robust_sigma(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, scaled MAD, then the root mean square of samples within six of it;
    second_moment repeats the cut on the raw values."""
    centre = checkpointed(order_stats(df, keys, value, {"centre": ("nearest", 0.5)}))  # one row per key
    d = join_groups(df.select(*keys, value), centre, keys).drop("n").withColumn("_dev", F.abs(F.col(value) - F.col("centre")))
    mad = checkpointed(order_stats(d, keys, "_dev", {"mad": ("nearest", 0.5)}))
    d = join_groups(d, mad, keys).drop("n").withColumn("_init", F.greatest(F.col("mad") / 0.67448974, F.lit(1e-6)))
    kept = F.col("_dev") <= 6 * F.col("_init")
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), F.first("centre").alias("centre"), F.first("mad").alias("mad"), F.first("_init").alias("_init"),
                             F.count_if(kept).alias("kept"), F.sqrt(F.avg(F.when(kept, F.col("_dev") * F.col("_dev")))).alias("_rms"))
    s = s.withColumn("sigma", F.when(F.col("kept") < 2, F.col("_init")).otherwise(F.col("_rms"))).drop("_init", "_rms")
    s, v = checkpointed(s), F.col(value)
    m = join_groups(df.select(*keys, value), s.select(*keys, "n", "sigma"), keys).groupBy(*keys).agg(
        F.avg(F.when(F.abs(v) <= 6 * F.col("sigma"), v * v)).alias("second_moment"))
    return s.join(m, keys)


def share_analytics(access: DataFrame, key: str) -> DataFrame:
    totals = access.groupBy(key).agg(
        F.count_if(F.col("event") == "meta").alias("views"), F.count_if(F.col("event") == "asset").alias("assets"),
        F.count_if("download").alias("downloads"), F.count_if("embed").alias("embeds"), F.max("accessed_at").alias("last_access"))
    refs = access.filter(F.col("referrer") != "").groupBy(key, "referrer").agg(F.count("*").alias("hits"))
    top = top_per_key(refs, [key], [F.desc("hits"), F.col("referrer")], 5).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "referrer", "hits"))).alias("top"))  # five entries
    return totals.join(top, key, "left").withColumn("top_referrers", F.array_join(F.transform("top", lambda r: F.concat_ws(":", r.referrer, r.hits)), ",")).drop("top")


def predict_duration(history: DataFrame, requests: DataFrame, phase: str, similar: Column) -> DataFrame:
    """Mean time per item over similar systems times the requested items; null without history."""
    per = history.filter(similar).groupBy(phase).agg(F.sum("duration").alias("_d"), F.sum("items").alias("_i"))
    return requests.join(per, phase, "left").withColumn("predicted", F.when(F.col("_i") > 0, F.col("_d") / F.col("_i") * F.col("wanted"))).drop("_d", "_i")


def telemetry_window(snapshots: DataFrame, keys: list[str], order: list[str], counters: list[str], peaks: list[str], state: str) -> DataFrame:
    """First against last snapshot: saturating counter deltas, null-skipping peaks and states."""
    cols = F.struct(*counters, *peaks, state)
    s = snapshots.groupBy(*keys).agg(F.min_by(cols, F.struct(*order)).alias("a"), F.max_by(cols, F.struct(*order)).alias("b"))
    return s.select(*keys, *[F.greatest(F.col(f"b.{c}") - F.col(f"a.{c}"), F.lit(0)).alias(f"d_{c}") for c in counters],
                    F.greatest(*[F.col(f"{e}.{p}") for e in "ab" for p in peaks]).alias("peak"), F.greatest(f"a.{state}", f"b.{state}").alias("max_state"))


def motion_scores(rows: DataFrame, keys: list[str], frame: str, limits=(1.0, 1.0, 1.0), weights=(0.5, 0.3, 0.2)) -> DataFrame:
    """Frame against the frame before: centroid shift over all rows, colour and
    shape change over rows with equal index; .5 when a side is empty."""
    c = rows.groupBy(*keys, frame).agg(*[F.avg(a).alias("m" + a) for a in "xyz"])
    before = c.select(*keys, (F.col(frame) + 1).alias(frame), *[F.col("m" + a).alias("p" + a) for a in "xyz"])
    c = c.join(before, [*keys, frame], "left").withColumn("_shift", F.sqrt(sum((F.col("m" + a) - F.col("p" + a)) ** 2 for a in "xyz")))
    prev = rows.select(*keys, (F.col(frame) + 1).alias(frame), "idx", *[F.col(k).alias("p" + k) for k in ("r", "g", "b", "shape")])
    pair = rows.join(prev, [*keys, frame, "idx"]).groupBy(*keys, frame).agg(
        F.avg(sum(F.abs(F.col(k) - F.col("p" + k)) for k in "rgb") / 3).alias("_colour"),
        F.avg(F.sqrt(F.aggregate(F.zip_with("shape", "pshape", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))).alias("_shape"))
    d = c.join(pair, [*keys, frame], "left")
    score = sum(w * F.least(F.col(n) / m, F.lit(1.0)) for w, n, m in zip(weights, ("_shift", "_colour", "_shape"), limits))
    return d.select(*keys, frame, F.when(F.col("_shift").isNull(), F.lit(0.5)).otherwise(F.least(score, F.lit(1.0))).alias("score"))


def quality_scores(defects: DataFrame, keys: list[str], thresholds: DataFrame) -> DataFrame:
    """Defect rows (keys, defect, score) against (defect, threshold, low_is_bad, action)."""
    d = defects.join(F.broadcast(thresholds), "defect")  # a fixed handful of defect kinds
    over = F.when(F.col("low_is_bad"), F.col("threshold") - F.col("score")).otherwise(F.col("score") - F.col("threshold"))
    badness = F.when(F.col("threshold") > 0, F.greatest(over / F.col("threshold"), F.lit(0.0))).otherwise(F.lit(0.0))
    bad = over > 0
    return d.groupBy(*keys).agg(
        F.greatest(1 - F.sum(F.when(bad, 0.2 * F.least(badness, F.lit(1.0))).otherwise(F.lit(0.0))), F.lit(0.0)).alias("score"),
        F.count_if(bad).alias("bad"), F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("action")))), ",").alias("actions"))


def batch_digest(files: DataFrame, keys: list[str], order: str, content: Column, expected: Column) -> DataFrame:
    """SHA-256 per file, then over the hex digests of one bounded batch in list order."""
    d = files.select(*keys, order, F.sha2(content, 256).alias("h"))
    s = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "h"))).alias("f"))
    return s.select(*keys, F.sha2(F.array_join(F.transform("f", lambda f: f.h), ""), 256).alias("digest"), F.size("f").alias("verified"), expected.alias("expected"))


def accumulate_voxels(points: DataFrame, keys: list[str], size: float, spec: dict[str, Column]) -> DataFrame:
    """Payload per voxel from an aggregate spec (name -> aggregate expression)."""
    return points.groupBy(*keys, *voxel(size)).agg(*[c.alias(n) for n, c in spec.items()])


def sample_trilinear(queries: DataFrame, grid: DataFrame, keys: list[str], size: float, value: str) -> DataFrame:
    """Trilinear reading at query points: eight corners exploded, equi-joined, weighted; absent voxels read zero."""
    d = queries.withColumns({"_f" + a: F.col(a) / size - F.floor(F.col(a) / size) for a in "xyz"}).select("*", *voxel(size))
    corners = F.array(*[F.struct(*[(F.col("v" + a) + o).alias("v" + a) for a, o in zip("xyz", off)],
                                 (_w("x", off[0]) * _w("y", off[1]) * _w("z", off[2])).alias("_wt"))
                        for off in [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]])
    c = d.select(*keys, "query_id", F.explode(corners).alias("c")).select(*keys, "query_id", "c.*")
    return c.join(grid.select(*keys, *VOX, value), [*keys, *VOX], "left").groupBy(*keys, "query_id").agg(
        F.sum(F.col("_wt") * F.coalesce(value, F.lit(0.0))).alias("value"))


def _w(axis: str, offset: int) -> Column:
    return F.col("_f" + axis) if offset else 1 - F.col("_f" + axis)
