"""Image statistics and fusion on row and pixel tables.

Rows are (frame_id, y, px ARRAY); pixels are exploded rows.  Stencils read the
neighbouring rows inside y-blocks with a one-row halo, so a large image spreads
over tasks and nothing crosses a shuffle but whole rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.operators.ordering import with_halo

AROUND = ["nw", "n", "ne", "w", "e", "sw", "s", "se"]


def stencil(rows: DataFrame, keys: list[str], px: str = "px", block: int = 256) -> DataFrame:
    """One row per pixel: y, x, v and its eight neighbours (null outside the image)."""
    extra = [c for c in rows.columns if c not in (*keys, "y", px)]
    w = Window.partitionBy(*keys, "_bucket").orderBy("y")
    d = with_halo(rows, "y", block, 1).withColumns({"_up": F.lag(px).over(w), "_dn": F.lead(px).over(w)}).filter("own")
    d = d.select(*keys, "y", *extra, px, "_up", "_dn", F.posexplode(px).alias("x", "v"))
    at = {"nw": ("_up", -1), "n": ("_up", 0), "ne": ("_up", 1), "w": (px, -1), "e": (px, 1), "sw": ("_dn", -1), "s": ("_dn", 0), "se": ("_dn", 1)}
    return d.select(*keys, "y", "x", "v", *extra, *[F.get(F.col(c), F.col("x") + o).alias(n) for n, (c, o) in at.items()])


def interior() -> Column:
    return F.col("nw").isNotNull() & F.col("se").isNotNull() & F.col("ne").isNotNull() & F.col("sw").isNotNull()


def laplacian() -> Column:
    return F.col("n") + F.col("s") + F.col("w") + F.col("e") - 4 * F.col("v")


def sharpness(st: DataFrame, keys: list[str]) -> DataFrame:
    """Variance of the Laplacian over interior pixels, and over all pixels with a
    zero border; zero when a side is under three."""
    lap = F.when(interior(), laplacian().cast("double"))
    d = st.withColumn("_l", lap).groupBy(*keys).agg(F.count("*").alias("_n"), F.count("_l").alias("_i"), F.sum("_l").alias("_s"), F.sum(F.col("_l") * F.col("_l")).alias("_q"), F.avg("v").alias("mean"))
    inner = F.when(F.col("_i") > 0, F.col("_q") / F.col("_i") - F.pow(F.col("_s") / F.col("_i"), F.lit(2))).otherwise(F.lit(0.0))
    whole = F.when(F.col("_i") > 0, F.col("_q") / F.col("_n") - F.pow(F.col("_s") / F.col("_n"), F.lit(2))).otherwise(F.lit(0.0))
    return d.select(*keys, "mean", inner.alias("sharpness"), whole.alias("sharpness_all"))


def value_at_rank(counts: DataFrame, keys: list[str], value: str, rank: Column, into: str) -> DataFrame:
    """Value at a rank from (keys, value, c) counts of a small value domain; ``rank`` may use ``n``."""
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    d = counts.withColumns({"_cum": F.sum("c").over(up), "n": F.sum("c").over(Window.partitionBy(*keys))})
    return d.filter(F.col("_cum") > rank).groupBy(*keys).agg(F.min(value).alias(into))


def blockiness(st: DataFrame, keys: list[str]) -> DataFrame:
    """Block edges against inner differences (8 pixels), median residual noise and
    contrast, weighted 50/30/20; 100 for images under 16 pixels.  The residual
    |9v - sum| is a whole number, so its median comes from counted levels."""
    h, v = F.abs(F.col("v") - F.col("w")), F.abs(F.col("v") - F.col("n"))
    xb, yb = F.col("x") % 8 == 0, F.col("y") % 8 == 0

    def part(x_side, y_side):
        s = F.coalesce(F.sum(F.when(x_side, h)), F.lit(0)) + F.coalesce(F.sum(F.when(y_side, v)), F.lit(0))
        n = F.count(F.when(x_side, h)) + F.count(F.when(y_side, v))
        return s / F.greatest(n, F.lit(1))

    g = F.col("v") / 255.0
    s = st.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"), part(xb, yb).alias("_b"), part(~xb, ~yb).alias("_i"), F.avg(g).alias("_m"), F.avg(g * g).alias("_q"))
    res = F.abs(9 * F.col("v") - (F.col("v") + sum(F.col(c) for c in AROUND)))
    counts = st.filter(interior()).groupBy(*keys, res.alias("_r")).agg(F.count("*").alias("c"))
    mid = value_at_rank(counts, keys, "_r", F.floor(F.col("n") / 2), "_mid")
    d = s.join(mid, keys, "left")
    block = F.least(F.least(F.col("_b") / (F.col("_i") + 1e-3), F.lit(5.0)) / 3.0, F.lit(1.0))
    noise = F.least(F.least(F.col("_mid") / 9.0 / 255.0 / 0.6745, F.lit(1.0)) / 0.15, F.lit(1.0))
    contrast = F.least(F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0))), F.lit(1.0))
    score = F.when((F.col("_h") < 16) | (F.col("_w") < 16), F.lit(100.0)).otherwise(100.0 * (0.5 * block + 0.3 * noise + 0.2 * (1 - contrast)))
    return d.select(*keys, score.alias("score"))


def otsu(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Threshold of maximum between-class variance over 256 bins: the first
    maximum, and the middle of its plateau (empty bins share the value)."""
    h = pixels.groupBy(*keys, F.col(value).cast("int").alias("t")).agg(F.count("*").alias("c"))
    up = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    h = h.withColumns({"wb": F.sum("c").over(up), "sb": F.sum(F.col("c") * F.col("t")).over(up), "n": F.sum("c").over(every), "s": F.sum(F.col("c") * F.col("t")).over(every),
                       "nxt": F.lead("t").over(Window.partitionBy(*keys).orderBy("t"))})
    wf = F.col("n") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / wf
    h = h.withColumn("between", F.when(wf > 0, F.col("wb").cast("double") * wf * gap * gap))
    h = h.withColumn("_top", F.max("between").over(every)).filter(F.col("between") == F.col("_top"))
    s = h.groupBy(*keys).agg(F.min("t").alias("first"), F.max(F.coalesce(F.col("nxt") - 1, F.lit(255))).alias("_last"))
    return s.select(*keys, "first", F.floor((F.col("first") + F.col("_last")) / 2).cast("int").alias("middle"))


def hull_points(points) -> list[tuple]:
    """Counter-clockwise hull of a small set of integer or real points."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(seq):
        out = []
        for p in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1])


HULL = T.StructType([T.StructField("area", T.DoubleType()), T.StructField("perimeter", T.DoubleType()), T.StructField("corners", T.IntegerType())])


@F.pandas_udf(HULL)
def hull_measure(points: pd.Series) -> pd.DataFrame:
    """Area and perimeter of the hull of a bounded list of (x, y)."""
    out = []
    for pts in points:
        h = hull_points([(p["x"], p["y"]) for p in pts]) if pts is not None else []
        nxt = h[1:] + h[:1]
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(h, nxt))) / 2 if len(h) >= 3 else 0.0
        out.append((float(area), float(sum(np.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(h, nxt))), len(h)))
    return pd.DataFrame(out, columns=["area", "perimeter", "corners"])


def row_hull(points: DataFrame, keys: list[str]) -> DataFrame:
    """Hull per key: only the two outermost points of each scan line can lie on it."""
    ends = points.groupBy(*keys, "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    h = ends.groupBy(*keys).agg(line_ends("a", "b").alias("_p"))
    return h.withColumn("_h", hull_measure("_p")).select(*keys, "_h.area", "_h.perimeter", "_h.corners")


def line_ends(a: str, b: str) -> Column:
    """The outermost points of scan lines ``y`` as one list; lines without any count for nothing."""
    ends = F.array(*[F.struct(F.col(c).cast("double").alias("x"), F.col("y").cast("double").alias("y")) for c in (a, b)])
    return F.flatten(F.collect_list(F.when(F.col(a).isNotNull(), ends)))


def _kurtosis(c: str) -> Column:
    m, q, t, f = (F.sum(f"{c}{i}") / F.sum(f"{c}0") for i in (1, 2, 3, 4))
    var = q - m * m
    return F.when(var <= 1e-12, F.lit(0.0)).otherwise((f - 4 * m * t + 6 * m * m * q - 3 * m * m * m * m) / (var * var))


def _padded(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as the rows of a matrix, missing values as nan, with one empty column on either side."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(int)
    out = np.full((len(size), width + 2), np.nan)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, at + 1] = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out


def _row_sums(px: dict[str, np.ndarray], y, h, w, side, rim_step: int = 1) -> dict[str, np.ndarray]:
    """What one image row adds to the defect scores of its image: sums of powers of the
    gradients and the Laplacian, counts on the border and the ends of the mask's rim."""
    def around(c):
        up, v, dn = px[c + "_up"], px[c], px[c + "_dn"]
        return dict(zip(AROUND, (up[:, :-2], up[:, 1:-1], up[:, 2:], v[:, :-2], v[:, 2:], dn[:, :-2], dn[:, 1:-1], dn[:, 2:]))), v[:, 1:-1]

    n, v = around("l")
    there = np.arange(v.shape[1])[None, :] < px["n"][:, None]
    inside = ~np.isnan(n["nw"] + n["se"] + n["ne"] + n["sw"])
    out = {}
    for name, value in (("gx", n["ne"] + 2 * n["e"] + n["se"] - n["nw"] - 2 * n["w"] - n["sw"]),
                        ("gy", n["sw"] + 2 * n["s"] + n["se"] - n["nw"] - 2 * n["n"] - n["ne"]),
                        ("lap", n["n"] + n["s"] + n["w"] + n["e"] - 4 * v)):
        value = np.where(there, np.where(inside, value, 0.0), np.nan)
        out[name + "0"] = (~np.isnan(value)).sum(axis=1)
        value = np.nan_to_num(value)
        square = value * value
        out[name + "1"], out[name + "2"] = value.sum(axis=1), square.sum(axis=1)
        if name != "lap":
            out[name + "3"], out[name + "4"] = (square * value).sum(axis=1), (square * square).sum(axis=1)
    n, v = around("m")
    x, y, h, w, side = np.arange(v.shape[1])[None, :], y[:, None], h[:, None], w[:, None], side[:, None]
    on = v > 0
    border = there & ((y < side) | (y + side >= h) | (x < side) | (x + side >= w))
    least = np.ones(v.shape)
    for c in n.values():
        least = np.fmin(least, c)  # a missing neighbour counts as one
    rim = on & (least == 0) & ((x + y) % rim_step == 0)
    out |= {"border": border.sum(axis=1), "border_on": (border & on).sum(axis=1), "on": on.sum(axis=1), "rim": rim.sum(axis=1),
            "a": np.where(rim.any(axis=1), rim.argmax(axis=1), -1), "b": v.shape[1] - 1 - rim[:, ::-1].argmax(axis=1), "n": px["n"]}
    r, g, b = (px[c][:, 1:-1] for c in "rgb")
    out |= {"over": sum((c >= 254).sum(axis=1) for c in (r, g, b)), "dark": (on & (r + g + b < 30)).sum(axis=1)}
    for name, c in zip("rgb", (r, g, b)):
        out |= {name + "0": (~np.isnan(c)).sum(axis=1), name + "1": np.nansum(c, axis=1)}
    return out


_SUMS = ([f"{c}{i} {'long' if i == 0 else 'double'}" for c, top in (("gx", 4), ("gy", 4), ("lap", 2), ("r", 1), ("g", 1), ("b", 1)) for i in range(top + 1)]
         + [f"{c} long" for c in ("border", "border_on", "on", "rim", "a", "b", "n", "over", "dark")])


def defects(rows: DataFrame, keys: list[str], block: int = 256, rim_step: int = 1) -> DataFrame:
    """Seven defect scores per image from rows (keys, y, px) of pixel structs (r, g, b, l luma, m mask).

    A row of pixels is summed up in one go, with the rows beside it from its y-block
    and a halo of one row, so pixels are never rows of a table.  The whole rim of the
    mask counts, unless ``rim_step`` asks for the places where x + y is a multiple of it."""
    size = rows.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), F.max(F.size("px")).alias("_w"))
    shortest = F.least("_h", "_w")
    size = size.withColumn("_side", F.least(F.greatest(F.floor(shortest * 0.05 + 0.5), F.lit(2)), shortest - 1))
    w = Window.partitionBy(*keys, "_bucket").orderBy("y")
    d = with_halo(rows.join(size, keys).select(*keys, "y", "_h", "_w", "_side", *[F.col("px." + c).alias(c) for c in "rgblm"]), "y", block, 1)
    d = d.withColumns({c + name: f(c).over(w) for c in "lm" for name, f in (("_up", F.lag), ("_dn", F.lead))}).filter("own").drop("own", "_bucket")
    types = dict(d.dtypes)

    def add_up(batches):
        for batch in batches:
            n = pc.fill_null(pc.list_value_length(batch["m"]), 0).to_numpy(zero_copy_only=False).astype(int)
            wide = int(n.max(initial=0)) + 1
            px = {c: _padded(pc.list_slice(batch[c], 0, wide), wide) for c in [*"rgblm", "l_up", "l_dn", "m_up", "m_dn"]}
            found = _row_sums({**px, "n": n}, *[batch[c].to_numpy(zero_copy_only=False).astype(int) for c in ("y", "_h", "_w", "_side")], rim_step)
            cols = {c: batch[c] for c in (*keys, "y")}
            for c in _SUMS:
                name, kind = c.split()
                cols[name] = pa.array(found[name].astype(np.int64 if kind == "long" else float))
            yield pa.RecordBatch.from_pydict(cols)

    sums = d.mapInArrow(add_up, ", ".join([*(f"{c} {types[c]}" for c in (*keys, "y")), *_SUMS]))
    sums = sums.withColumns({"a": F.when(F.col("rim") > 0, F.col("a")), "over": F.col("over")})

    def mean(c):
        return F.sum(c + "1") / F.sum(c + "0")

    s = sums.groupBy(*keys).agg(
        (_kurtosis("gx") + _kurtosis("gy")).alias("edge_banding"), (F.sum("lap2") / F.sum("lap0") - mean("lap") * mean("lap")).alias("blur"),
        (F.sum("border_on") / F.greatest(F.sum("border"), F.lit(1))).alias("background_leak"), F.sum("on").alias("_area"), F.sum("rim").alias("_rim"),
        line_ends("a", "b").alias("_p"), (F.sum("over") / (3 * F.sum("n"))).alias("overexposure"),
        F.sqrt(F.pow(mean("r") - mean("g"), F.lit(2)) + F.pow(mean("b") - mean("g"), F.lit(2))).alias("colour_cast"),
        (F.sum("dark") / F.greatest(F.sum("on"), F.lit(1))).alias("black_dots"))
    s = s.withColumn("area", hull_measure("_p").getField("area"))
    erosion = (F.when(F.col("_area") == 0, F.lit(0.0)).when(F.col("_rim") < 3, F.lit(1.0)).when(F.col("area") <= 1e-6, F.lit(1.0))
               .otherwise(F.col("_area") / F.greatest(F.col("area"), F.lit(1.0))))
    return s.select(*keys, "edge_banding", "background_leak", erosion.alias("erosion"), "blur", "overexposure", "colour_cast", "black_dots")


# Defect, threshold, low values are bad, corrective action.
DEFECT_RULES = (("edge_banding", 3.0, False, "align"), ("background_leak", 0.1, False, "background"), ("erosion", 0.8, True, "mask"), ("blur", 100.0, True, "refocus"),
                ("overexposure", 0.05, False, "exposure"), ("colour_cast", 15.0, False, "white_balance"), ("black_dots", 0.01, False, "refocus"))


def pair_images(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two image pixel tables (r, g, b, mask) side by side; the second gets a q prefix."""
    second = b.select(*keys, "y", "x", *[F.col(c).alias("q" + c) for c in ("r", "g", "b", "mask")], F.lit(1).alias("_qb"))
    return a.withColumn("_pa", F.lit(1)).join(second, [*keys, "y", "x"], "full_outer")


def pair_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """PSNR, SSIM, IoU, Dice, change, motion and parallax; null when sizes differ."""
    la = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    lb = 0.299 * F.col("qr") + 0.587 * F.col("qg") + 0.114 * F.col("qb")
    se = sum((F.col(c) - F.col("q" + c)) * (F.col(c) - F.col("q" + c)) for c in "rgb")
    ad = sum(F.abs(F.col(c) - F.col("q" + c)) for c in "rgb")
    on, qon = F.col("mask") > 0, F.col("qmask") > 0
    at4, at6, at10 = ((F.col("x") % s == 0) & (F.col("y") % s == 0) for s in (4, 6, 10))
    s = pairs.withColumns({"_la": la, "_lb": lb}).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.count("_pa").alias("_a"), F.count("_qb").alias("_b"), (F.avg(se) / 3).alias("mse"),
        F.avg("_la").alias("mx"), F.avg("_lb").alias("my"), F.var_pop("_la").alias("vx"), F.var_pop("_lb").alias("vy"), F.covar_pop("_la", "_lb").alias("cxy"),
        F.count_if(on & qon).alias("_i"), F.count_if(on | qon).alias("_u"), F.count_if(on).alias("_ma"), F.count_if(qon).alias("_mb"),
        F.coalesce(F.avg(F.when(at10, (ad > 30).cast("double"))), F.lit(0.0)).alias("change"),
        F.coalesce(F.avg(F.when(at4 & on, F.least(ad / 765.0, F.lit(1.0)))), F.lit(0.0)).alias("motion"),
        F.coalesce(F.avg(F.when(at6 & on, F.least(F.abs(la - lb) / 255.0, F.lit(1.0)))), F.lit(0.0)).alias("parallax"))
    same = (F.col("_n") == F.col("_a")) & (F.col("_n") == F.col("_b"))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ssim = (2 * F.col("mx") * F.col("my") + c1) * (2 * F.col("cxy") + c2) / ((F.col("mx") ** 2 + F.col("my") ** 2 + c1) * (F.col("vx") + F.col("vy") + c2))
    psnr = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(255.0 * 255.0) / F.col("mse")))
    return s.select(*keys, F.when(same, psnr).alias("psnr"), F.when(same, ssim).alias("ssim"), F.when(same & (F.col("_u") > 0), F.col("_i") / F.col("_u")).alias("iou"),
                    F.when(same & (F.col("_ma") + F.col("_mb") > 0), 2 * F.col("_i") / (F.col("_ma") + F.col("_mb"))).alias("dice"),
                    F.when(same, F.col("change")).otherwise(F.lit(1.0)).alias("change"), F.when(same, F.col("motion")).otherwise(F.lit(0.0)).alias("motion"),
                    F.when(same, F.col("parallax")).otherwise(F.lit(0.0)).alias("parallax"))


EPS8 = 1e-6  # guards truncation to 8 bits against the last bit of a weighted sum


def to_byte(c: Column) -> Column:
    return F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255 + EPS8).cast("int")


def fuse_exposures(pixels: DataFrame, stack: list[str], frame: str, exposure: Column | None = None, step: int = 8) -> DataFrame:
    """Well-exposedness weight per image from strided luma, then the weighted mean per pixel."""
    luma = (0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")) / 255.0
    at = (F.col("x") % step == 0) & (F.col("y") % step == 0)
    ev = F.lit(None).cast("double") if exposure is None else exposure
    w = pixels.groupBy(*stack, frame).agg(F.coalesce(F.avg(F.when(at, luma)), F.lit(0.5)).alias("_m"), F.first(ev).alias("_ev"))
    w = w.withColumn("_w", F.greatest(F.exp(-((F.col("_m") - 0.5) * (F.col("_m") - 0.5)) / 0.125) * F.coalesce(F.exp(-F.col("_ev") * F.col("_ev") / 2), F.lit(1.0)), F.lit(1e-4)))
    d = pixels.join(w.select(*stack, frame, "_w"), [*stack, frame])
    out = [F.floor(F.sum(F.col(c) * F.col("_w")) / F.sum("_w") + 0.5).cast("int").alias(c) for c in "rgb"]
    return d.groupBy(*stack, "y", "x").agg(*out)


def mertens(st: DataFrame, stack: list[str]) -> DataFrame:
    """Contrast, saturation and exposedness weights, normalised across the stack.
    Pixels are structs (r, g, b, l) in 0..1 with their stencil neighbours."""
    def dev(c):
        return F.exp(-(F.col("v." + c) - 0.5) * (F.col("v." + c) - 0.5) / 0.08)

    mean = (F.col("v.r") + F.col("v.g") + F.col("v.b")) / 3
    sat = F.sqrt(sum((F.col("v." + c) - mean) * (F.col("v." + c) - mean) for c in "rgb")) / F.sqrt(F.lit(3.0))
    con = F.when(interior(), F.abs(F.col("v.l") - (F.col("n.l") + F.col("s.l") + F.col("w.l") + F.col("e.l")) / 4)).otherwise(F.lit(0.0))
    d = st.withColumn("_w", (con + 0.001) * (sat + 0.001) * (dev("r") * dev("g") * dev("b") + 0.001))
    total = F.greatest(F.sum("_w"), F.lit(1e-6))
    return d.groupBy(*stack, "y", "x").agg(*[to_byte(F.sum(F.col("v." + c) * F.col("_w")) / total).alias(c) for c in "rgb"])


def debevec(pixels: DataFrame, stack: list[str], ev: Column, gamma: float = 2.2) -> DataFrame:
    """Hat-weighted radiance, then x/(1+x) and gamma to 8 bits."""
    def merged(c):
        z = F.col(c)
        w = F.greatest(F.when(z <= 127, z / 127.0).otherwise((255 - z) / 128.0), F.lit(0.01))
        hdr = F.sum(w * (z / 255.0 / F.pow(F.lit(2.0), -ev))) / F.sum(w)
        return to_byte(F.pow(hdr / (1 + hdr), F.lit(1 / gamma))).alias(c)

    return pixels.groupBy(*stack, "y", "x").agg(*[merged(c) for c in "rgb"])


def focus_stack(rows: DataFrame, stack: list[str], slice_col: str, window: int = 4, block: int = 256) -> DataFrame:
    """Per pixel the slice of highest focus measure (first wins), smoothed weights,
    weighted grey value.  One group is a y-block of one stack with the halo the
    two smoothing passes need, so it is bounded for any image height."""
    half, r = window // 2, 2
    reach = 1 + half + 2 * r
    height = rows.groupBy(*stack).agg((F.max("y") + 1).alias("_h"), (F.max(slice_col) + 1).alias("_n"))
    d = with_halo(rows, "y", block, reach).filter("_bucket >= 0").join(height, stack)
    schema = ", ".join(f"{k} {t}" for k, t in rows.dtypes if k in stack) + ", y int, px array<int>, best array<int>"
    kernel = np.exp(-(np.arange(-r, r + 1)[:, None] ** 2 + np.arange(-r, r + 1)[None] ** 2) / 8.0)
    kernel /= kernel.sum()

    def shift(a, dy, dx, n, m):
        return a[..., r + dy:r + dy + n, r + dx:r + dx + m]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ys = np.sort(pdf["y"].unique())
        y0, h, n = int(ys[0]), int(pdf["_h"].iloc[0]), int(pdf["_n"].iloc[0])
        w = len(pdf["px"].iloc[0])
        img = np.zeros((n, len(ys), w))
        there = np.zeros((n, len(ys) + 2), dtype=bool)  # rows a slice really has
        for y, s, px in zip(pdf["y"], pdf[slice_col], pdf["px"]):
            img[int(s), int(y) - y0] = px
            there[int(s), int(y) - y0 + 1] = True
        absolute = ys.astype(int)
        pad = np.pad(img, ((0, 0), (1, 1), (1, 1)))
        lap = pad[:, :-2, 1:-1] + pad[:, 2:, 1:-1] + pad[:, 1:-1, :-2] + pad[:, 1:-1, 2:] - 4 * img
        lap[:, (absolute < 1) | (absolute >= h - 1)] = 0
        lap[~(there[:, :-2] & there[:, 1:-1] & there[:, 2:])] = 0
        lap[:, :, [0, -1]] = 0
        sq = np.pad(lap * lap, ((0, 0), (half, half), (half, half)))
        box = sum(sq[:, half + dy:half + dy + len(ys), half + dx:half + dx + w] for dy in range(-half, half) for dx in range(-half, half)) / (4 * half * half)
        box[~there[:, 1:-1]] = 0
        box[:, (absolute < half) | (absolute >= h - half)] = 0
        box[:, :, :half] = 0
        box[:, :, w - half:] = 0
        best = box.argmax(axis=0)
        weights = np.stack([(best == i) for i in range(n)]).astype(float)
        inner = ((absolute >= r) & (absolute < h - r))[:, None] & ((np.arange(w) >= r) & (np.arange(w) < w - r))[None]
        for _ in range(2):
            p = np.pad(weights, ((0, 0), (r, r), (r, r)))
            smooth = sum(kernel[dy + r, dx + r] * shift(p, dy, dx, len(ys), w) for dy in range(-r, r + 1) for dx in range(-r, r + 1))
            weights = np.where(inner, smooth, weights)
        weights /= np.maximum(weights.sum(axis=0), 1e-12)
        weights[weights <= 0.001] = 0
        out = np.floor(np.clip((weights * img).sum(axis=0), 0, 255) + EPS8).astype(int)
        own = set(pdf.loc[pdf["own"], "y"])
        keep = [i for i, y in enumerate(ys) if y in own]
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in stack}, "y": ys[keep].astype("int32"), "px": pd.Series([out[i].tolist() for i in keep], dtype=object), "best": pd.Series([best[i].tolist() for i in keep], dtype=object)})

    return d.groupBy(*stack, "_bucket").applyInPandas(run, schema)


def depth_from_focus(metrics: Column, distances: Column) -> dict[str, Column]:
    """Arg-max plane (first wins), log-parabola offset, interpolated distance and
    confidence, from the ordered focus measures of one pixel."""
    n = F.size(metrics)
    top = F.array_max(metrics)
    i = F.array_position(metrics, top).cast("int") - 1

    def ln(k):
        return F.log(F.greatest(F.get(metrics, k), F.lit(1e-6)))

    v0, v1, v2 = ln(i - 1), ln(i), ln(i + 1)
    den = 2.0 * (v0 - 2.0 * v1 + v2)
    at = F.when((i > 0) & (i < n - 1) & (F.abs(den) > 1e-5), i + (v0 - v2) / den).otherwise(i.cast("double"))
    lo = F.floor(at).cast("int")
    a = at - lo
    d0, d1 = F.get(distances, lo), F.get(distances, F.least(lo + 1, n - 1))
    return {"plane": at, "distance": d0 * (1 - a) + d1 * a, "confidence": top}


def robust_combine(samples: DataFrame, keys: list[str], strength: float = 1.0) -> DataFrame:
    """Tukey / variance weighted value of a bounded exposure set per key (value,
    variance, frame): median and MAD scale with a noise floor, dominant source,
    inflated uncertainty.  Two joined aggregates instead of collected groups."""
    cutoff = 4.685 / max(strength, 1e-3)
    s = samples.withColumn("variance", F.greatest("variance", F.lit(1e-16)))
    c = s.groupBy(*keys).agg(F.median("value").alias("_c"), F.avg(F.sqrt("variance")).alias("_noise"))
    s = s.join(c, keys)
    m = s.groupBy(*keys).agg(F.median(F.abs(F.col("value") - F.col("_c"))).alias("_mad"))
    s = s.join(m, keys)
    scale = F.greatest(1.4826 * F.col("_mad"), 2.5 * F.col("_noise"), F.lit(2e-6))
    r = (F.col("value") - F.col("_c")) / (cutoff * scale)
    s = s.withColumn("_f", F.when(F.abs(r) < 1, F.pow(1 - r * r, F.lit(2))).otherwise(F.lit(0.0)))
    s = s.withColumn("_w", F.col("_f") / F.col("variance")).filter("_w > 0")
    g = s.groupBy(*keys).agg(F.sum("_w").alias("_sw"), (F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value"), F.count("*").alias("contributors"),
                             F.max_by("frame", F.struct("_w", (-F.col("frame")).alias("o"))).alias("source"),
                             F.sum(F.col("_w") * F.col("value") * F.col("value")).alias("_q"))
    spread = F.greatest(F.col("_q") - F.col("_sw") * F.col("value") * F.col("value"), F.lit(0.0))
    inflation = F.when(F.col("contributors") > 1, F.sqrt(F.greatest(spread / (F.col("contributors") - 1), F.lit(1.0)))).otherwise(F.lit(1.0))
    return g.select(*keys, "value", (inflation / F.sqrt("_sw")).alias("uncertainty"), "contributors", "source")


def cfa_site() -> Column:
    return (F.col("y") % 2) * 2 + F.col("x") % 2


def radiance_tiles(pixels: DataFrame, keys: list[str], tile: int, black: float, range_dn: float, saturation: float, read: float, electrons: float,
                   exposure_ratio: float, minimum: int) -> DataFrame:
    """Mean radiance and its variance over unsaturated samples per tile and CFA
    site; only a lower bound when every sample is saturated."""
    signal = F.greatest((F.col("v") - black) / range_dn, F.lit(0.0))
    ok = signal < saturation
    var = (read * read + signal * range_dn / electrons) / (range_dn * range_dn)
    d = pixels.groupBy(*keys, F.floor(F.col("y") / tile).cast("int").alias("tile_y"), F.floor(F.col("x") / tile).cast("int").alias("tile_x"), cfa_site().alias("site")).agg(
        F.count_if(ok).alias("valid"), F.count_if(~ok).alias("censored"), F.sum(F.when(ok, signal)).alias("_s"), F.sum(F.when(ok, var)).alias("_v"))
    enough = F.col("valid") >= minimum
    return d.withColumns({"mean": F.when(enough, F.col("_s") / F.col("valid") / exposure_ratio), "variance": F.when(enough, F.col("_v") / (F.col("valid") * F.col("valid")) / exposure_ratio ** 2),
                          "lower_bound": F.when((F.col("valid") == 0) & (F.col("censored") > 0), F.lit(saturation / exposure_ratio))}).drop("_s", "_v")


def apply_gain_grid(pixels: DataFrame, grid: DataFrame, defects: DataFrame, width: int, height: int, gw: int, gh: int) -> DataFrame:
    """Bilinear per-site gain at the pixel centre, clamped at the edge; defective
    coordinates are flagged.  The grid is one row per cell and site."""
    gx = F.least(F.greatest((F.col("x") + 0.5) / width * gw - 0.5, F.lit(0.0)), F.lit(gw - 1.0))
    gy = F.least(F.greatest((F.col("y") + 0.5) / height * gh - 0.5, F.lit(0.0)), F.lit(gh - 1.0))
    cells = grid.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct((F.col("gy") * gw + F.col("gx")).cast("int"), "gain"))).alias("_g"))  # gw x gh cells
    d = pixels.withColumns({"site": cfa_site(), "_gx": gx, "_gy": gy}).join(F.broadcast(cells), "site")  # four sites
    x0, y0 = F.floor("_gx").cast("int"), F.floor("_gy").cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(gw - 1)), F.least(y0 + 1, F.lit(gh - 1))
    tx, ty = F.col("_gx") - x0, F.col("_gy") - y0

    def at(yy, xx):
        return F.element_at("_g", (yy * gw + xx).cast("int"))

    top = at(y0, x0) + (at(y0, x1) - at(y0, x0)) * tx
    low = at(y1, x0) + (at(y1, x1) - at(y1, x0)) * tx
    d = d.withColumn("gain", top + (low - top) * ty).drop("_g", "_gx", "_gy")
    return d.join(defects.select("y", "x", F.lit(True).alias("defect")).distinct(), ["y", "x"], "left").fillna(False, ["defect"])


def uncertainty_map(st: DataFrame) -> DataFrame:
    """255 outside the mask, else the inverse of the right and down colour steps."""
    def step(n):
        return sum(F.coalesce(F.abs(F.col("v." + c) - F.col(f"{n}.{c}")), F.lit(0)) for c in "rgb")

    share = F.least((step("e") + step("s")) / (3.0 * 255.0 * 2.0), F.lit(1.0))
    return st.withColumn("u", F.when(F.col("v.m") > 0, F.floor((1 - share) * 255 + 1e-9)).otherwise(F.lit(255)).cast("int"))


def uncertainty_bins(u: DataFrame, keys: list[str], width: int, bins: int) -> DataFrame:
    v = F.col("u") / 255.0
    b = F.least(F.floor(F.col("x") / float(width) * bins), F.lit(bins - 1)).cast("int")
    return u.filter(v >= 0.05).groupBy(*keys, b.alias("bin")).agg(F.sum(v).alias("uncertainty"))


def split_specular(pairs: DataFrame) -> DataFrame:
    return pairs.select("*", *[F.col("q" + c).alias("diffuse_" + c) for c in "rgb"], *[F.greatest(F.col(c) - F.col("q" + c), F.lit(0)).alias("specular_" + c) for c in "rgb"])


def mask_components(rows: DataFrame, keys: list[str], mask: Column) -> DataFrame:
    """4-connected regions: runs per scan line, linked to overlapping runs of the
    next line, then connected components over runs (not pixels)."""
    from scanloom.operators.graph import connected_components
    from scanloom.session import checkpointed

    on = F.transform(mask, lambda m, i: F.when(m, i).otherwise(F.lit(-1)))
    starts = F.filter(F.transform(on, lambda i: F.when((i >= 0) & ((i == 0) | (F.get(on, i - 1) < 0)), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(on, lambda i: F.when((i >= 0) & ((i == F.size(on) - 1) | (F.get(on, i + 1) < 0)), i)), lambda i: i.isNotNull())
    runs = rows.select(*keys, "y", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("r")).select(*keys, "y", F.col("r.a").cast("int").alias("a"), F.col("r.b").cast("int").alias("b"))
    runs = checkpointed(runs.withColumn("run", F.struct(*keys, "y", "a")))
    below = runs.select(*keys, (F.col("y") - 1).alias("y"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("run").alias("v"))
    edges = runs.join(below, [*keys, "y"]).filter((F.col("a") <= F.col("b2")) & (F.col("a2") <= F.col("b"))).select(F.col("run").alias("u"), "v")
    comp = connected_components(runs.select(F.col("run").alias("id")), edges)
    d = runs.join(comp, runs.run == comp.id)
    return d.groupBy(*keys, "component").agg(F.min("a").alias("min_x"), F.max("b").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.sum(F.col("b") - F.col("a") + 1).alias("area"))


def main_component(components: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Best candidate region: area share within [.001, .6], score .4 size + .4 centre
    + .2 shape, the first in scan order on ties."""
    d = components.join(sizes, keys)
    share = F.col("area") / (F.col("w") * F.col("h"))
    off = F.sqrt(F.pow((F.col("min_x") + F.col("max_x")) / 2 - F.col("w") / 2, F.lit(2)) + F.pow((F.col("min_y") + F.col("max_y")) / 2 - F.col("h") / 2, F.lit(2)))
    centre = 1 - F.least(off / ((F.col("w") + F.col("h")) / 4), F.lit(1.0))
    aspect = (F.col("max_x") - F.col("min_x") + 1) / (F.col("max_y") - F.col("min_y") + 1)
    shape = F.when((aspect > 0.2) & (aspect < 5), 1.0).otherwise(0.7)
    size = F.when((share > 0.01) & (share < 0.3), 1.0).otherwise(0.8)
    d = d.filter(share.between(0.001, 0.6)).withColumn("score", F.round(size * 0.4 + centre * 0.4 + shape * 0.2, 9))
    best = F.min_by(F.struct("min_x", "min_y", "max_x", "max_y", "area", "score"), F.struct((-F.col("score")).alias("s"), "component"))
    return d.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
