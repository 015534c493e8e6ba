"""Cameras, depth maps, masks and voxel fields.  Cameras join pixels by scene,
then pixels meet pixels by an equi-join on (scene, view, y, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import geometry as G
from scanloom.session import checkpointed

CAM = ["qw", "qx", "qy", "qz", "tx", "ty", "tz", "fx", "fy", "cx", "cy"]


#: Parts into which the points of a scene are dealt when they meet rows of their scene.
SPREAD = 64


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is always shuffled.  Rows made by ``explode`` are far more than
    Spark estimates from the files behind them; such a side must not be collected for a broadcast."""
    return df.hint("merge")


def with_scene(many: DataFrame, few: DataFrame, place: list[str]) -> DataFrame:
    """Every row of ``many`` with every row of ``few`` of its scene.  A large scene
    is dealt over SPREAD parts by ``place``; the few rows go to each part."""
    part = F.pmod(F.xxhash64(*place), F.lit(SPREAD)).cast("int")
    copies = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return many.withColumn("_part", part).join(dealt(copies), ["scene", "_part"]).drop("_part")


#: Cells per axis of a scene's points, from coarse to fine: boxes are tested against cameras level by level.
LEVELS = (2, 8)
_EDGE = 1e-9


def boxes(points: DataFrame, place: tuple[str, str, str]) -> tuple[DataFrame, DataFrame]:
    """``points`` with ``_block``, a cell of their scene, and per block its box: centre ``_mid<axis>``
    and half sizes ``_half<axis>``, with the cell ``_top`` of the coarse level that holds it."""
    lims = points.groupBy("scene").agg(*[f(c).alias(f"_{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a, c in zip("xyz", place)])  # one row per scene
    d = with_scene(points, lims, list(place))

    def cell(n: int):
        at = [F.least(F.floor((F.col(c) - F.col("_lo" + a)) / F.greatest(F.col("_hi" + a) - F.col("_lo" + a), F.lit(1e-300)) * n), F.lit(n - 1)) for a, c in zip("xyz", place)]
        return (at[0] * n + at[1]) * n + at[2]

    d = d.withColumns({"_block": cell(LEVELS[1]), "_top": cell(LEVELS[0])}).drop(*[f"_{n}{a}" for n in ("lo", "hi") for a in "xyz"])
    size = d.groupBy("scene", "_block").agg(F.min("_top").alias("_top"), *[f.alias(n + a) for a, c in zip("xyz", place) for n, f in (("_mid", (F.min(c) + F.max(c)) / 2), ("_half", (F.max(c) - F.min(c)) / 2))])
    return d.drop("_top"), size


#: A scene of up to this many pairs of a point and a camera forms them in one task, without boxes.
SCENE_PAIRS = 1 << 15
#: Rows of such scenes that one task is given.
TASK_ROWS = 1 << 19


def by_scene(df: DataFrame, tasks: int) -> DataFrame:
    """Whole scenes in a number of tasks that adaptive plans leave alone: rows made by ``explode`` are
    packed so well that tasks merged by their bytes would hold far too many of them."""
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), "scene")


def with_visible(points: DataFrame, cameras: DataFrame, place: tuple[str, str, str], may_see, placed: bool = False) -> DataFrame:
    """Every point with the cameras of its scene that may see its block.

    ``may_see()`` is a condition over a camera's columns and a box (``_midx`` ... ``_halfz``) that is
    true wherever the camera sees any place of the box.  Points of small scenes meet all cameras of
    their scene; ``placed`` says that all scenes are small and the points dealt by scene already."""
    if placed:
        return points.join(dealt(cameras), "scene")
    views = cameras.groupBy("scene").agg(F.count("*").alias("_views"))
    sizes = checkpointed(points.groupBy("scene").agg(F.count("*").alias("_n")).join(dealt(views), "scene"))  # one row per scene
    crowded = F.col("_n") * F.col("_views") > SCENE_PAIRS
    large, small, rows = sizes.agg(F.count_if(crowded), F.count_if(~crowded), F.sum(F.when(~crowded, F.col("_n")))).first()
    if not small:
        return _with_boxes(points, cameras, place, may_see)
    tasks = -(-rows // TASK_ROWS)
    if not large:
        return by_scene(points, tasks).join(dealt(cameras), "scene")
    big = F.broadcast(sizes.filter(crowded).select("scene"))  # at most one for every SCENE_PAIRS pairs
    met = by_scene(points.join(big, "scene", "left_anti"), tasks).join(dealt(cameras), "scene")
    return met.unionByName(_with_boxes(points.join(big, "scene", "left_semi"), cameras, place, may_see))


def _with_boxes(points: DataFrame, cameras: DataFrame, place: tuple[str, str, str], may_see) -> DataFrame:
    """Coarse boxes meet the cameras first, their blocks only the cameras
    that are left, and points only those of their block."""
    d, fine = boxes(points, place)
    low, high = ({a: f(F.col("_mid" + a) + sign * F.col("_half" + a)) for a in "xyz"} for f, sign in ((F.min, -1), (F.max, 1)))
    coarse = fine.groupBy("scene", "_top").agg(*[f.alias(n + a) for a in "xyz" for n, f in (("_mid", (low[a] + high[a]) / 2), ("_half", (high[a] - low[a]) / 2))])
    some = coarse.join(dealt(cameras), "scene").filter(may_see()).drop(*[n + a for n in ("_mid", "_half") for a in "xyz"])
    seen = fine.join(dealt(some), ["scene", "_top"]).filter(may_see()).drop("_top", *[n + a for n in ("_mid", "_half") for a in "xyz"])
    return d.join(dealt(seen), ["scene", "_block"]).drop("_block")


def _radius():
    """Of the ball around a box, a little enlarged."""
    return F.sqrt(sum(F.col("_half" + a) * F.col("_half" + a) for a in "xyz")) * (1 + _EDGE) + _EDGE


def frustum(frame: tuple | None = None, pre: str = "_"):
    """Whether a box may reach into the pyramid of a pinhole camera (columns ``pre`` + ``CAM``).

    ``frame`` is (u0, u1, v0, v1), numbers or columns; without it only the side in front counts."""
    def may_see():
        x, y, z = G.world_to_camera(*_pose(pre), (F.col("_midx"), F.col("_midy"), F.col("_midz")))
        r = _radius()
        ok = z + r > 0
        if frame is not None:
            for p, f, c, low, high in ((x, "fx", "cx", *frame[:2]), (y, "fy", "cy", *frame[2:])):
                f, c = F.col(pre + f), F.col(pre + c)
                for n, k in ((f, c - low), (-f, high - c)):  # a half space n * p + k * z >= 0
                    ok = ok & (n * p + k * z + F.sqrt(n * n + k * k) * r >= 0)
        return ok

    return may_see


def _pose(pre: str = "") -> tuple[tuple, tuple]:
    return tuple(F.col(pre + c) for c in ("qw", "qx", "qy", "qz")), tuple(F.col(pre + c) for c in ("tx", "ty", "tz"))


def to_world(pixels: DataFrame, cameras: DataFrame) -> DataFrame:
    d = pixels.join(dealt(cameras), ["scene", "view"])
    cam = G.back_project(F.col("x"), F.col("y"), F.col("depth"), *[F.col(c) for c in ("fx", "fy", "cx", "cy")])
    w = G.camera_to_world(*_pose(), cam)
    return d.select(*pixels.columns, *[c.alias(n) for n, c in zip(("wx", "wy", "wz"), w)])


def in_view(points: DataFrame, cameras: DataFrame, view: str = "src", frame: tuple | None = None, placed: bool = False) -> DataFrame:
    """Points (wx, wy, wz) in front of the cameras of their scene, with the exact pixel
    position (u, v) and depth z.  Pairs certainly outside ``frame`` (u0, u1, v0, v1) are
    left out; ``cameras`` may bring its sides as columns."""
    own = [c for c in frame or () if isinstance(c, str)]
    c = cameras.select("scene", F.col("view").alias(view), *[F.col(n).alias("_" + n) for n in CAM], *own)
    sides = tuple(F.col(c) if isinstance(c, str) else F.lit(c) for c in frame) if frame else None
    d = with_visible(points, c, ("wx", "wy", "wz"), frustum(sides), placed).drop(*own)
    p = G.world_to_camera(*_pose("_"), (F.col("wx"), F.col("wy"), F.col("wz")))
    d = d.withColumns({"_px": p[0], "_py": p[1], "z": p[2]}).filter("z > 0")
    u, v = G.project((F.col("_px"), F.col("_py"), F.col("z")), F.col("_fx"), F.col("_fy"), F.col("_cx"), F.col("_cy"))
    return d.withColumns({"u": u, "v": v}).drop("_px", "_py", *["_" + n for n in CAM])


def with_frames(cameras: DataFrame, depth: DataFrame) -> DataFrame:
    """Cameras with the size of their depth maps, a pixel wider on every side: ``_right`` and ``_below``."""
    size = depth.groupBy("scene", "view").agg((F.max("x") + 2.0).alias("_right"), (F.max("y") + 2.0).alias("_below"))
    return cameras.join(dealt(size), ["scene", "view"])


FRAME = (-1.0, "_right", -1.0, "_below")


def fuse_depth(depth: DataFrame, cameras: DataFrame, threshold: float, min_views: int) -> DataFrame:
    """World points of depth pixels that enough other views confirm.  The pixel
    position is truncated; positions left of or above the image are rejected."""
    ref = to_world(depth.filter((F.col("depth") > 0) & (F.col("confidence") >= 0.5)), cameras)
    key = ["scene", "view", "y", "x"]
    seen = in_view(ref.select(*key, "wx", "wy", "wz"), with_frames(cameras, depth), frame=FRAME).filter("src <> view AND u >= 0 AND v >= 0")
    seen = seen.withColumns({"sx": F.floor("u").cast("int"), "sy": F.floor("v").cast("int")})
    other = depth.select("scene", F.col("view").alias("src"), F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("depth").alias("sd"), F.col("confidence").alias("sc"))
    agree = seen.join(dealt(other), ["scene", "src", "sy", "sx"]).filter((F.col("sc") > 0.5) & (F.abs(F.col("sd") - F.col("z")) < threshold))
    n = agree.groupBy(*key).agg(F.count("*").alias("_n"))
    d = ref.join(dealt(n), key, "left").withColumn("views", F.coalesce("_n", F.lit(0)) + 1)
    return d.filter(F.col("views") >= min_views).select(*key, "wx", "wy", "wz", "views")


def voxel_grid(scenes: DataFrame, lo: tuple, hi: tuple, size: float) -> DataFrame:
    """Lattice from lo (inclusive) to hi (exclusive) for each scene; its layers are
    dealt out before they are filled, so a large lattice comes from many tasks."""
    d = scenes
    for a, low, high in zip("xyz", lo, hi):
        if a == "y":
            d = d.repartition("scene", "ix")
        n = int(-(-(high - low) // size))
        d = d.withColumn("i" + a, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(a, F.lit(float(low)) + F.col("i" + a) * size)
    return d


def carve(voxels: DataFrame, cameras: DataFrame, masks: DataFrame, width: int, height: int) -> DataFrame:
    """Voxels that no view sees outside the mask and at least one view sees inside.
    Cameras carry a 4x4 matrix ``mvp`` (row by row); behind and off-frame views are ignored."""
    def row(i, pre=""):
        return sum(F.get("mvp", F.lit(4 * i + j)) * F.col(pre + a) for j, a in enumerate("xyz")) + F.get("mvp", F.lit(4 * i + 3))

    def may_see():
        """Sides of the clip space that a box lies outside of as a whole."""
        ok = F.lit(True)
        for parts in (((3, 1),), ((3, 1), (0, 1)), ((3, 1), (0, -1)), ((3, 1), (1, 1)), ((3, 1), (1, -1))):
            reach = sum(F.abs(sum(F.get("mvp", F.lit(4 * i + j)) * sign for i, sign in parts)) * F.col("_half" + a) for j, a in enumerate("xyz"))
            ok = ok & (sum(row(i, "_mid") * sign for i, sign in parts) + reach * (1 + _EDGE) + _EDGE >= 0)
        return ok

    d = with_visible(voxels, cameras, ("x", "y", "z"), may_see)

    d = d.withColumns({"_px": row(0), "_py": row(1), "_pw": row(3)}).filter("_pw > 0")
    u, v = (F.col("_px") / F.col("_pw") * 0.5 + 0.5) * width, (1 - F.col("_py") / F.col("_pw")) * 0.5 * height
    d = d.withColumns({"u": u, "v": v}).filter((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))
    d = d.select("scene", "view", "ix", "iy", "iz", F.floor("v").cast("int").alias("y"), F.floor("u").cast("int").alias("x"))
    hit = d.join(dealt(masks), ["scene", "view", "y", "x"])
    s = hit.groupBy("scene", "ix", "iy", "iz").agg(F.count("*").alias("views"), F.min(F.col("mask") >= 128).alias("_in"))
    return s.filter("_in").drop("_in")


def colour_points(points: DataFrame, cameras: DataFrame, pixels: DataFrame, width: int, height: int, max_views: int | None = None, default=(180, 180, 180)) -> DataFrame:
    """Colour of the first view, in view order, whose rounded projection is in frame."""
    seen = in_view(points, cameras if max_views is None else cameras.filter(F.col("view") < max_views), frame=(-1.0, width + 1.0, -1.0, height + 1.0))
    rx, ry = F.floor(F.col("u") + 0.5).cast("int"), F.floor(F.col("v") + 0.5).cast("int")
    seen = seen.withColumns({"x": rx, "y": ry}).filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height))
    first = seen.groupBy("scene", "point_id").agg(F.min_by(F.struct("src", "y", "x"), "src").alias("_f")).select("scene", "point_id", F.col("_f.src").alias("view"), "_f.y", "_f.x")
    c = first.join(dealt(pixels.select("scene", "view", "y", "x", "r", "g", "b")), ["scene", "view", "y", "x"]).select("scene", "point_id", "view", "r", "g", "b")
    d = points.join(dealt(c), ["scene", "point_id"], "left")
    return d.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in zip("rgb", default)})


def integrate_tsdf(depth: DataFrame, cameras: DataFrame, size: float, truncation: float, spread: int = 1, cap: int = 100) -> DataFrame:
    """Truncated signed distances of the voxels around depth samples.

    The running mean with a capped weight is a fixed weighting by order: up to
    the cap all observations count alike, later ones fade the earlier ones."""
    near = to_world(depth.filter("depth > 0"), cameras)
    for a in "xyz":
        b = F.floor(F.col("w" + a) / size).cast("int")
        near = near.withColumn("v" + a, b)
    sizes = depth.groupBy("scene", "view").agg(F.count("*").alias("n")).groupBy("scene").agg(F.sum("n").alias("n"), F.count("*").alias("views"))
    most, pixels = sizes.agg(F.max(F.col("n") * F.col("views")), F.sum("n")).first()
    near, fits = near.select("scene", "vx", "vy", "vz"), (most or 0) * (2 * spread + 1) ** 3 <= SCENE_PAIRS
    if fits:  # every scene's voxels are found where its samples are
        near = by_scene(near, -(-(pixels or 0) // (TASK_ROWS >> 3)))
    cells = near.distinct()
    for a in "xyz":
        cells = cells.withColumn("v" + a, F.explode(F.sequence(F.col("v" + a) - spread, F.col("v" + a) + spread)))
    cells = cells.distinct().select("*", *[((F.col("v" + a) + 0.5) * size).alias("w" + a) for a in "xyz"])
    seen = in_view(cells, with_frames(cameras, depth), frame=FRAME, placed=fits).withColumns({"x": F.floor(F.col("u") + 0.5).cast("int"), "y": F.floor(F.col("v") + 0.5).cast("int")})
    d = seen.join(dealt(depth.filter("depth > 0").select("scene", F.col("view").alias("src"), "y", "x", "depth")), ["scene", "src", "y", "x"])
    d = d.withColumn("s", F.col("depth") - F.col("z")).filter(F.col("s") >= -truncation).withColumn("s", F.least("s", F.lit(truncation)) / truncation)
    vox = ["scene", "vx", "vy", "vz"]
    w = Window.partitionBy(*vox)  # one row per view that sees the voxel
    d = d.withColumns({"_j": F.row_number().over(w.orderBy("src")), "_n": F.count("*").over(w)})
    fade = F.pow(F.lit(cap / (cap + 1.0)), F.greatest(F.col("_n") - F.greatest(F.col("_j"), F.lit(cap)), F.lit(0)))
    weight = F.when(F.col("_n") <= cap, 1 / F.col("_n")).when(F.col("_j") <= cap, fade / cap).otherwise(fade / (cap + 1))
    return d.groupBy(*vox).agg(F.sum(F.col("s") * weight).alias("sdf"), F.least(F.count("*"), F.lit(cap)).alias("weight"))


def confidence_field(voxels: DataFrame, views: DataFrame, fov: float, time_step: float) -> DataFrame:
    """Weight x distance weight x angular weight of the views looking at a voxel in
    the same time bucket, divided by the largest value of the scene."""
    import math

    cos_half = math.cos(fov / 2)
    v = views.withColumn("t_idx", F.floor(F.col("time") / time_step).cast("int"))

    def may_see():
        """Whether the cone of a view may touch the ball around a box."""
        gap = [F.col("_mid" + a) - F.col("c" + a) for a in "xyz"]
        far, r = F.sqrt(sum(g * g for g in gap)), _radius()
        along = sum(g * F.col("d" + a) for g, a in zip(gap, "xyz")) / far
        off = F.acos(F.least(F.greatest(along, F.lit(-1.0)), F.lit(1.0))) - F.asin(F.least(r / far, F.lit(1.0)))
        return F.when(far <= r, True).otherwise(off <= fov / 2 + 1e-6)

    d = with_visible(voxels, v, ("x", "y", "z"), may_see)
    gap = {a: F.col(a) - F.col("c" + a) for a in "xyz"}
    dist = F.sqrt(sum(g * g for g in gap.values()))
    d = d.withColumns({"_d": dist, "_c": sum(gap[a] * F.col("d" + a) for a in "xyz") / dist}).filter(F.col("_c") > cos_half)
    value = F.col("weight") * F.least(1.0 / (1.0 + F.col("_d") * 0.1), F.lit(1.0)) * (F.col("_c") - cos_half) / (1.0 - cos_half)
    s = d.groupBy("scene", "t_idx", "ix", "iy", "iz").agg(F.sum(value).alias("value"))
    top = s.groupBy("scene").agg(F.max("value").alias("_top"))
    return s.join(top, "scene").withColumn("value", F.when(F.col("_top") > 0, F.col("value") / F.col("_top")).otherwise(F.col("value"))).drop("_top")
