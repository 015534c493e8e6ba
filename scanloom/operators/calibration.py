"""Sensor, lens and colour calibration over tables of measurements.

All heavy parts are grouped aggregates; loops run over at most 32 bins or a
handful of knots per camera.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import colour
from scanloom.functions.numeric import clamp
from scanloom.operators.aggregates import robust_sigma
from scanloom.operators.ordering import median, order_stats, ordered_fold
from scanloom.session import checkpointed


def stride_pixels(pairs: DataFrame, keys: list[str], width: int, height: int, maximum: int | None = None) -> DataFrame:
    """CFA site of every pixel; with ``maximum``, thinned per site to every
    stride-th pixel when a site has more pixels than that."""
    site = (F.col("y") % 2) * 2 + F.col("x") % 2
    sw, sh = F.floor((width + 1 - F.col("x") % 2) / 2), F.floor((height + 1 - F.col("y") % 2) / 2)
    if maximum is None:
        return pairs.withColumn("site", site.cast("int"))
    stride = F.greatest(F.ceil(sw * sh / maximum), F.lit(1))
    linear = F.floor(F.col("y") / 2) * sw + F.floor(F.col("x") / 2)
    return pairs.withColumn("site", site.cast("int")).filter(linear % stride == 0)


def trimmed_mean(values: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """Mean without a twentieth at either end.  Sensor values are 16-bit, so each
    key has a bounded list of counted levels."""
    c = values.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"_cum": F.sum("_c").over(up), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    trim = F.least(F.floor(F.col("_n") / 20), F.floor((F.col("_n") - 1) / 2))
    kept = F.greatest(F.least(F.col("_cum"), F.col("_n") - trim) - F.greatest(F.col("_cum") - F.col("_c"), trim), F.lit(0))
    return c.groupBy(*keys).agg((F.sum(F.col("_v") * kept) / F.sum(kept)).alias(into), F.max("_n").alias("samples"))


def dark_evidence(pairs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(centres, residual rows) of dark pairs (keys, site, y, x, first, second)."""
    k = [*keys, "site"]
    c = trimmed_mean(pairs, k, "first", "centre1").join(trimmed_mean(pairs, k, "second", "centre2").drop("samples"), k)
    d = pairs.join(c, k)
    a, b = F.col("first") - F.col("centre1"), F.col("second") - F.col("centre2")
    return c, d.select(*k, "y", "x", ((a - b) / F.sqrt(F.lit(2.0))).alias("residual"), ((a + b) * 0.5).alias("pattern"), F.lit(0.0).alias("signal"))


def flat_evidence(pairs: DataFrame, keys: list[str], black: float, white: float, ceiling: float) -> tuple[DataFrame, DataFrame]:
    """(centres with mismatch and peak, residual rows) of flat pairs; residuals are
    scaled to a common mean and divided by the norm of both scales."""
    k = [*keys, "site"]
    p = pairs.withColumns({"s1": F.greatest(F.col("first") - black, F.lit(0.0)), "s2": F.greatest(F.col("second") - black, F.lit(0.0))})
    c = trimmed_mean(p, k, "s1", "centre1").join(trimmed_mean(p, k, "s2", "centre2").drop("samples"), k)
    target = (F.col("centre1") + F.col("centre2")) * 0.5
    c = c.withColumns({"target": target, "mismatch": F.abs(F.col("centre1") - F.col("centre2")) / F.greatest(target, F.lit(1.0))})
    c = checkpointed(c)  # one row per pair and site
    d = p.join(c, k)
    k1, k2 = F.col("target") / F.greatest("centre1", F.lit(1.0)), F.col("target") / F.greatest("centre2", F.lit(1.0))
    n1, n2 = k1 * F.col("s1"), k2 * F.col("s2")
    d = d.withColumns({"signal": (n1 + n2) * 0.5, "residual": (n1 - n2) / F.sqrt(k1 * k1 + k2 * k2)})
    peak = order_stats(d, k, "signal", {"peak": ("nearest", 0.999)}).drop("n")
    ok = (F.col("first") < white) & (F.col("second") < white) & (F.col("signal") <= (white - black) * ceiling)
    return c.join(peak, k), d.filter(ok).select(*k, "y", "x", "residual", "signal")


def variance_bins(samples: DataFrame, keys: list[str], ceiling: float, minimum: int = 256, bins: int = 32) -> DataFrame:
    """Mean signal and robust variance per signal bin with enough samples."""
    s = samples.filter((F.col("signal") > 0) & (F.col("signal") <= ceiling))
    s = s.withColumn("bin", F.least(F.floor(F.col("signal") / ceiling * bins), F.lit(bins - 1)).cast("int"))
    k = [*keys, "bin"]
    m = s.groupBy(*k).agg(F.avg("signal").alias("signal"), F.count("*").alias("count")).filter(F.col("count") >= minimum)
    s = s.join(m.select(*k), k, "left_semi")
    return m.join(robust_sigma(s, k, "residual").select(*k, F.col("second_moment").alias("variance")), k)


def shot_slope(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Slope of variance over signal (columns signal, variance, count, base): weighted
    median ratio, then eight Huber re-weightings.  At most 32 rows per key."""
    types = dict(bins.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", slope double, bins int"

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("signal")
        x, v, n, base = (p[c].to_numpy(float) for c in ("signal", "variance", "count", "base"))
        ok = (v > base) & (x > 0)
        slope = np.nan
        if ok.any():
            ratio, w = (v - base)[ok] / x[ok], n[ok]
            o = np.argsort(ratio, kind="stable")
            slope = ratio[o][np.searchsorted(np.cumsum(w[o]) * 2, w.sum())]
            for _ in range(8):
                pred = base + slope * x
                rel = np.abs(v - pred) / np.maximum(pred, 1e-6)
                weight = np.where(rel <= 0.10, 1.0, 0.10 / np.maximum(rel, 1e-300)) * n
                den = (weight * x * x).sum()
                if den > 0:
                    slope = (weight * x * np.maximum(v - base, 0)).sum() / den
        return pd.DataFrame({**{k: [p[k].iloc[0]] for k in keys}, "slope": [slope], "bins": [len(p)]})

    return bins.groupBy(*keys).applyInPandas(fit, schema)


# Two-sided normal quantiles.
NORMAL_90, NORMAL_95 = 1.6448536, 1.959964


def evaluate_iso(dark: DataFrame, flat: DataFrame, black: float, white: float, ceiling: float = 0.8, min_dark: int = 2, min_flat: int = 2, min_levels: int = 3,
                 max_error: float = 0.2, coverage_tolerance: float = 0.03, min_peak: float = 0.3, min_bin: int = 256) -> DataFrame:
    """Noise model per (iso, site) from the fit split, judged on the holdout split.

    ``dark`` is (iso, split, pair_id, site, y, x, first, second), ``flat`` adds level.
    Failures are listed by name; an ISO has a profile only when nothing fails."""
    key = ["iso", "site"]
    dc, dr = dark_evidence(dark, ["iso", "split", "pair_id"])
    fc, fr = flat_evidence(flat, ["iso", "split", "pair_id", "level"], black, white, ceiling)
    dr, fr = checkpointed(dr), checkpointed(fr)

    def part(df, split):
        return df.filter(F.col("split") == split)

    read = robust_sigma(part(dr, "fit"), key, "residual").select(*key, F.col("sigma").alias("read"))
    centres = part(dc, "fit").select(*key, F.explode(F.array("centre1", "centre2")).alias("c"))
    drift = robust_sigma(centres, key, "c").select(*key, F.col("sigma").alias("frame_drift"))
    hold = robust_sigma(part(dr, "holdout"), key, "residual").select(*key, F.col("second_moment").alias("dark_var"))
    pairs = dark.groupBy("iso").agg(F.count_distinct(F.when(F.col("split") == "fit", F.col("pair_id"))).alias("fit_dark"), F.count_distinct(F.when(F.col("split") == "holdout", F.col("pair_id"))).alias("hold_dark"))

    def pattern(split, into):
        mean = part(dr, split).groupBy(*key, "y", "x").agg(F.avg("pattern").alias("p"))
        return robust_sigma(mean, key, "p").select(*key, F.col("second_moment").alias(into))

    s = read.join(drift, key).join(hold, key, "left").join(pattern("fit", "fit_pat"), key, "left").join(pattern("holdout", "hold_pat"), key, "left").join(pairs, "iso")
    s = s.withColumn("read", F.greatest("read", F.lit(1e-6)))
    r2 = F.col("read") * F.col("read")
    s = s.withColumns({"fixed_var": F.greatest(F.col("fit_pat") - r2 / (2 * F.greatest("fit_dark", F.lit(1))), F.lit(0.0)), "hold_fixed": F.greatest(F.col("hold_pat") - r2 / (2 * F.greatest("hold_dark", F.lit(1))), F.lit(0.0))})
    s = checkpointed(s.withColumn("black_drift", F.sqrt(F.col("fixed_var") + F.col("frame_drift") ** 2)))
    limit = (white - black) * ceiling
    base = s.select(*key, r2.alias("base"))
    fit_bins = checkpointed(variance_bins(part(fr, "fit"), key, limit, min_bin).join(base, key))
    hold_bins = variance_bins(part(fr, "holdout"), key, limit, min_bin)
    slope = checkpointed(shot_slope(fit_bins, key))
    pred = F.col("base") + F.col("slope") * F.col("signal")
    error = hold_bins.join(base, key).join(slope.select(*key, "slope"), key).groupBy(*key).agg(F.max(F.abs(F.col("variance") - pred) / F.greatest(pred, F.lit(1e-6))).alias("hold_error"))
    rows = part(dr, "holdout").select(*key, "residual", "signal").unionByName(part(fr, "holdout").select(*key, "residual", "signal")).join(base, key).join(slope.select(*key, "slope"), key)
    z = F.abs("residual") / F.sqrt(F.greatest(F.col("base") + F.when(F.col("signal") > 0, F.col("slope") * F.col("signal")).otherwise(F.lit(0.0)), F.lit(1e-9)))
    cover = rows.groupBy(*key).agg(F.avg((z <= NORMAL_90).cast("double")).alias("c90"), F.avg((z <= NORMAL_95).cast("double")).alias("c95"))
    levels = flat.groupBy("iso", "level").agg(F.count_distinct(F.when(F.col("split") == "fit", F.col("pair_id"))).alias("f"), F.count_distinct(F.when(F.col("split") == "holdout", F.col("pair_id"))).alias("h"))
    lv = levels.groupBy("iso").agg(F.count_if(F.col("f") > 0).alias("fit_levels"), F.count_if(F.col("h") > 0).alias("hold_levels"), F.count_if((F.col("f") < min_flat) | (F.col("h") < min_flat)).alias("thin_levels"))
    peak = fc.groupBy("iso").agg((F.max("peak") / (white - black)).alias("peak"))
    d = s.join(slope.select(*key, "slope"), key, "left").join(error, key, "left").join(cover, key, "left").join(lv, "iso", "left").join(peak, "iso", "left")
    rel = F.abs(F.col("dark_var") - r2) / F.greatest(r2, F.lit(1e-6))
    fixed = F.abs(F.col("hold_fixed") - F.col("fixed_var")) / F.greatest(r2 + F.col("fixed_var"), F.lit(1e-6))

    def bad(cond):
        return F.coalesce(cond, F.lit(True))  # missing evidence fails

    named = {
        "dark_pairs": bad((F.col("fit_dark") < min_dark) | (F.col("hold_dark") < min_dark)), "flat_levels": bad((F.col("fit_levels") < min_levels) | (F.col("hold_levels") < min_levels)),
        "flat_pairs": bad(F.col("thin_levels") > 0), "peak_signal": bad(F.col("peak") < min_peak), "slope": bad(F.isnan("slope") | (F.col("slope") <= 0)),
        "dark_variance": bad(rel > max_error), "fixed_pattern": bad(fixed > max_error), "holdout_variance": bad(F.col("hold_error") > max_error),
        "coverage_90": bad(F.abs(F.col("c90") - 0.90) > coverage_tolerance), "coverage_95": bad(F.abs(F.col("c95") - 0.95) > coverage_tolerance)}
    d = d.withColumn("failures", F.array_compact(F.array(*[F.when(c, n) for n, c in named.items()])))
    passed = d.groupBy("iso").agg(F.max(F.size("failures")).alias("_worst"))
    return d.join(passed, "iso").select(*key, "read", "black_drift", (1 / F.greatest("slope", F.lit(1e-9))).alias("electrons_per_dn"), "c90", "c95", "failures", (F.col("_worst") == 0).alias("profile"))


def grid_response(pairs: DataFrame, keys: list[str], width: int, height: int, gw: int, gh: int, black: float, white: float) -> DataFrame:
    """Relative response per pair, grid cell and CFA site; the site target is the
    median of the middle cells."""
    gy, gx = F.floor(F.col("y") * gh / height).cast("int"), F.floor(F.col("x") * gw / width).cast("int")
    s = (F.greatest(F.col("first") - black, F.lit(0.0)) + F.greatest(F.col("second") - black, F.lit(0.0))) * 0.5
    p = pairs.withColumns({"gy": gy, "gx": gx, "site": ((F.col("y") % 2) * 2 + F.col("x") % 2).cast("int"), "_s": s})
    r = p.filter((F.col("_s") > 0) & (F.col("_s") < (white - black) * 0.95)).groupBy(*keys, "gy", "gx", "site").agg(F.avg("_s").alias("response"))
    mid = F.col("gy").between(gh // 3, gh * 2 // 3 - 1) & F.col("gx").between(gw // 3, gw * 2 // 3 - 1)
    values = r.filter(mid).groupBy(*keys, "site").agg(F.array_sort(F.collect_list("response")).alias("_r"))  # grid cells
    n = F.size("_r")
    target = values.select(*keys, "site", F.get("_r", F.floor((n - 1) * 0.5 + 0.5).cast("int")).alias("target"))
    return r.join(target, [*keys, "site"]).withColumn("response", F.col("response") / F.col("target"))


def response_gains(response: DataFrame, keys: list[str]) -> DataFrame:
    """gain = exp(-mean log response); safe inside [.25, 4]."""
    g = response.groupBy(*keys, "gy", "gx", "site").agg(F.exp(-F.avg(F.log("response"))).alias("gain"), F.count("*").alias("pairs"))
    return g.withColumn("safe", F.col("gain").between(0.25, 4.0))


def persistent_defects(pairs: DataFrame, response: DataFrame, keys: list[str], pair: str, width: int, height: int, gw: int, gh: int, black: float, white: float,
                       low: float, high: float, disagreement: float, share: float) -> DataFrame:
    """Pixels off their expected response in at least ceil(pairs * share) pairs."""
    gy, gx = F.floor(F.col("y") * gh / height).cast("int"), F.floor(F.col("x") * gw / width).cast("int")
    p = pairs.withColumns({"gy": gy, "gx": gx, "site": ((F.col("y") % 2) * 2 + F.col("x") % 2).cast("int")})
    d = p.join(response, [*keys, pair, "gy", "gx", "site"])
    a, b = F.greatest(F.col("first") - black, F.lit(0.0)), F.greatest(F.col("second") - black, F.lit(0.0))
    want = F.col("target") * F.col("response")
    ratio, off = (a + b) * 0.5 / F.greatest(want, F.lit(1.0)), F.abs(a - b) / F.greatest(want, F.lit(1.0))
    hit = (want >= (white - black) * 0.01) & (off <= disagreement) & ((ratio <= low) | (ratio >= high))
    n = pairs.groupBy(*keys).agg(F.count_distinct(pair).alias("_n"))
    hits = d.filter(hit).groupBy(*keys, "y", "x").agg(F.count("*").alias("hits"))
    return hits.join(n, keys).filter(F.col("hits") >= F.ceil(F.col("_n") * share)).drop("_n")


def defocus(focal_mm: Column, pupil_mm: Column, focus_m: Column, subject_m: Column) -> Column:
    """Blur circle of a thin lens on the sensor, in millimetres."""
    s, d = focus_m * 1000.0, subject_m * 1000.0
    si, di = focal_mm * s / (s - focal_mm), focal_mm * d / (d - focal_mm)
    return pupil_mm * F.abs(si - di) / di


def focus_groups(measurements: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Fit focus distances that differ by more than the relative tolerance."""
    types = dict(measurements.dtypes)
    d = measurements.filter("split = 'fit'").select(*keys, F.col("focus_m").alias("focus")).distinct()

    def step(s, r):
        if s["last"] is not None and abs(r.focus - s["last"]) <= max(abs(s["last"]), abs(r.focus)) * tolerance:
            return []
        s["last"] = r.focus
        return [(*[getattr(r, k) for k in keys], r.focus)]

    return ordered_fold(d, keys, ["focus"], lambda: {"last": None}, step, ", ".join(f"{k} {types[k]}" for k in keys) + ", focus double")


def _lerp(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def optics_at(profile: Column, knots: list[float], focus_m: Column, radius: Column) -> dict[str, Column]:
    """Focal length, pupil scale and radial scale of a lens at any focus and radius.

    ``profile`` is an array of (focus, focal, scales), sorted by focus.  Between two focus
    groups all three are linear in dioptres, between radius knots in the radius; outside
    they stay as at the end.  The pupil scale is the blur scale on the axis."""
    n = F.size(profile)
    high = F.greatest(F.least(F.size(F.filter(profile, lambda k: k["focus"] < focus_m)), n - 1), F.lit(1))
    lower, upper = F.get(profile, high - 1), F.get(profile, F.least(high, n - 1))
    share = (1 / focus_m - 1 / lower["focus"]) / (1 / upper["focus"] - 1 / lower["focus"])
    share = F.when(n == 1, F.lit(0.0)).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    r = F.least(F.greatest(radius, F.lit(knots[0])), F.lit(knots[-1]))
    lo = sum(((r >= k).cast("int") for k in knots[1:-1]), F.lit(0))
    known = F.array(*map(F.lit, knots))
    between = (r - F.get(known, lo)) / (F.get(known, lo + 1) - F.get(known, lo))

    def radial(k: Column) -> Column:
        return _lerp(F.get(k["scales"], lo), F.get(k["scales"], lo + 1), between) / F.greatest(F.get(k["scales"], F.lit(0)), F.lit(1e-8))

    axis = lambda k: F.get(k["scales"], F.lit(0))
    return {"focal": _lerp(lower["focal"], upper["focal"], share), "pupil": _lerp(axis(lower), axis(upper), share), "radial": _lerp(radial(lower), radial(upper), share)}


def lens_psf(measurements: DataFrame, keys: list[str], knots: list[float], nominal_mm: float, aperture: float, tolerance: float = 0.02,
             min_samples: int = 3, max_p95: float = 0.2, min_reduction: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(focus x radius table, report) per lens: median focal length per focus group,
    median observed / ideal blur per nearest knot, and the p95 error of all holdout
    rows before and after, read from the profile between its knots (``optics_at``)."""
    pupil = F.lit(nominal_mm / aperture)
    g = focus_groups(measurements, keys, tolerance)
    near = F.abs(F.col("focus_m") - F.col("focus")) <= F.greatest(F.abs("focus_m"), F.abs("focus")) * tolerance
    knot = F.array_min(F.array(*[F.struct(F.abs(F.col("radius") - k).alias("d"), F.lit(i).alias("i")) for i, k in enumerate(knots)])).getField("i")
    measured = measurements.withColumns({"knot": knot, "observed": F.col("blur_px") * F.col("pitch_um") * 0.001})
    fit = checkpointed(measured.filter("split = 'fit'").join(g, keys).filter(near))  # a few groups per lens
    focal = median(fit, [*keys, "focus"], "focal_mm", "focal").drop("n")
    fit = fit.join(focal, [*keys, "focus"]).withColumn("ideal", defocus(F.col("focal"), pupil, F.col("focus_m"), F.col("subject_m")))
    cell = median(fit.filter("ideal > 1e-8").withColumn("ratio", F.col("observed") / F.col("ideal")), [*keys, "focus", "knot"], "ratio", "scale").withColumnRenamed("n", "samples")
    table = checkpointed(cell.join(focal, [*keys, "focus"]).withColumn("scale", F.when(F.col("samples") < min_samples, F.lit(1.0)).otherwise(F.col("scale"))))
    scales = table.groupBy(*keys, "focus", "focal").agg(F.map_from_entries(F.collect_list(F.struct("knot", "scale"))).alias("_s"), F.min("samples").alias("_min"), F.count("*").alias("_cells"))
    at = scales.select(*keys, F.struct("focus", "focal", F.array(*[F.coalesce(F.element_at("_s", i), F.lit(1.0)) for i in range(len(knots))]).alias("scales")).alias("k"))
    profile = at.groupBy(*keys).agg(F.array_sort(F.collect_list("k")).alias("profile"))  # the focus groups of one lens
    hold = measured.filter("split = 'holdout'").join(profile, keys)
    ideal = defocus(F.lit(nominal_mm), pupil, F.col("focus_m"), F.col("subject_m"))
    lens = optics_at(F.col("profile"), knots, F.col("focus_m"), F.col("radius"))
    model = defocus(lens["focal"], pupil * lens["pupil"], F.col("focus_m"), F.col("subject_m")) * lens["radial"]
    den = F.greatest("observed", F.lit(1e-8))
    hold = checkpointed(hold.select(*keys, (F.abs(ideal - F.col("observed")) / den).alias("e0"), (F.abs(model - F.col("observed")) / den).alias("e1")))
    rep = order_stats(hold, keys, "e0", {"ideal_p95": ("nearest", 0.95)}).join(order_stats(hold, keys, "e1", {"calibrated_p95": ("nearest", 0.95)}).drop("n"), keys)
    rep = rep.join(scales.groupBy(*keys).agg(F.count("*").alias("focus_knots"), F.min("_min").alias("thinnest"), F.min("_cells").alias("_cells")), keys)
    cut = F.when(F.col("ideal_p95") > 1e-8, 1 - F.col("calibrated_p95") / F.col("ideal_p95")).otherwise(F.lit(0.0))
    fails = F.array_compact(F.array(F.when(F.col("focus_knots") < 2, "focus_groups"), F.when((F.col("thinnest") < min_samples) | (F.col("_cells") < len(knots)), "fit_samples"),
                                    F.when(F.col("calibrated_p95") > max_p95, "holdout_p95"), F.when(cut < min_reduction, "reduction")))
    return table, rep.select(*keys, F.col("n").alias("holdout"), "focus_knots", "ideal_p95", "calibrated_p95", cut.alias("reduction"), fails.alias("failures"))


def fit_colour_matrix(patches: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares 3x3 matrix from at least six patch pairs in linear RGB (normal
    equations, solved in columns) and the mean colour difference after it.
    Observed o_r o_g o_b, reference t_r t_g t_b, in 0..1."""
    lin = patches.select(*keys, *[colour.linear(F.col(f"{p}_{c}")).alias(p + c) for p in "ot" for c in "rgb"])
    sums = [F.sum(F.col("o" + a) * F.col("o" + b)).alias(f"s{a}{b}") for i, a in enumerate("rgb") for b in "rgb"[i:]] + [F.sum(F.col("o" + a) * F.col("t" + b)).alias(f"q{a}{b}") for a in "rgb" for b in "rgb"]
    s = lin.groupBy(*keys).agg(F.count("*").alias("patches"), *sums).filter("patches >= 6")
    a = {(x, y): F.col("s" + "".join(sorted((x, y), key="rgb".index))) for x in "rgb" for y in "rgb"}

    def minor(i, j):
        rows, cols = [c for c in "rgb" if c != i], [c for c in "rgb" if c != j]
        return a[rows[0], cols[0]] * a[rows[1], cols[1]] - a[rows[0], cols[1]] * a[rows[1], cols[0]]

    def cof(i, j):
        return minor(i, j) * (1 if ("rgb".index(i) + "rgb".index(j)) % 2 == 0 else -1)

    det = sum(a["r", c] * cof("r", c) for c in "rgb")
    s = s.withColumn("_det", det).filter(F.abs("_det") > 1e-300)
    m = s.select(*keys, "patches", *[(sum(cof(k, i) * F.col(f"q{k}{j}") for k in "rgb") / F.col("_det")).alias(f"m{i}{j}") for i in "rgb" for j in "rgb"])
    # corrected = rows of the matrix times the observed colour, as stored
    d = lin.join(m, keys)
    fixed = tuple(clamp(sum(F.col(f"m{i}{j}") * F.col("o" + j) for j in "rgb"), 0.0, 1.0) for i in "rgb")
    d = d.withColumns({f"f{c}": v for c, v in zip("rgb", fixed)})
    lab1, lab2 = colour.lab(colour.xyz(tuple(F.col("f" + c) for c in "rgb"))), colour.lab(colour.xyz(tuple(F.col("t" + c) for c in "rgb")))
    err = d.groupBy(*keys).agg(F.avg(colour.delta_e(lab1, lab2)).alias("delta_e"))
    return m.join(err, keys)
