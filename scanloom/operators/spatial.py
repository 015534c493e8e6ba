"""Neighbour search on point tables.

``knn`` cuts both sides into balanced blocks along a space-filling curve, so a
dense region becomes more blocks instead of a hot cell.  Distances are computed
in numpy between one block of queries and one block of targets; pairs are never
shuffled.  Copies of a position are counted once and weighted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.session import checkpointed

XYZ = ["x", "y", "z"]


def curve_code(dims: list[str]) -> Column:
    """Interleaved 16-bit codes of coordinates scaled by columns _lo*/_hi*."""
    code = F.lit(0).cast("long")
    masks = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
    for i, d in enumerate(dims):
        span = F.greatest(F.col(f"_hi{d}") - F.col(f"_lo{d}"), F.lit(1e-300))
        q = F.floor(F.least(F.greatest((F.col(d) - F.col(f"_lo{d}")) / span, F.lit(0.0)), F.lit(1.0)) * 65535).cast("long")
        for shift, mask in masks:
            q = q.bitwiseOR(F.shiftleft(q, shift)).bitwiseAND(F.lit(mask).cast("long"))
        code = code.bitwiseOR(F.shiftleft(q, i))
    return code


#: Distances that a Python worker holds at a time.
STEP = 500_000


def _distances(q: np.ndarray, tx: np.ndarray) -> np.ndarray:
    """Between all rows of both, axis by axis: only two matrices of this size are held."""
    total = np.zeros((len(q), len(tx)))
    for a, b in zip(q.T, tx.T):
        gap = np.subtract.outer(a, b)
        gap *= gap
        total += gap
    return np.sqrt(total, out=total)


def _nearest(q, tx, mult, tid, k, exclude, ties=False):
    """Flat arrays (query row, target row, distance, weight) of the nearest positions;
    with ``ties`` up to k positions of every distance at which fewer than k targets are closer."""
    keep = min(k + (1 if exclude else 0), len(tx))
    rows, cols, dist = [], [], []
    step = max(1, STEP // max(len(tx), 1))
    for s in range(0, len(q), step):
        d = _distances(q[s:s + step], tx)
        if keep < len(tx):
            kth = np.partition(d, keep - 1, axis=1)[:, keep - 1:keep]
            r, c = np.nonzero(d <= kth)
        else:
            r, c = np.nonzero(np.ones_like(d, dtype=bool))
        rows.append(r + s)
        cols.append(c)
        dist.append(d[r, c])
    r, c, d = (np.concatenate(a) if a else np.empty(0) for a in (rows, cols, dist))
    r, c = r.astype(int), c.astype(int)
    w = mult[c] - ((d == 0) if exclude else 0)
    ok = w > 0
    r, c, d, w = r[ok], c[ok], d[ok], w[ok]
    order = np.lexsort((tid[c], d, r))
    r, c, d, w = r[order], c[order], d[order], w[order]
    if len(r):
        first = np.r_[True, r[1:] != r[:-1]]
        before = np.cumsum(w) - w
        base = np.maximum.accumulate(np.where(first, before, 0))
        ok = before - base < k  # cut once the weights before already reach k
        if ties:
            group = first | np.r_[True, d[1:] != d[:-1]]
            at = np.arange(len(r))
            closer = np.maximum.accumulate(np.where(group, before, 0)) - base
            ok = (closer < k) & (at - np.maximum.accumulate(np.where(group, at, 0)) < k)
        r, c, d, w = r[ok], c[ok], d[ok], w[ok]
    return r, c, d, w


def knn(queries: DataFrame, targets: DataFrame, keys: list[str], query_id: str, target_id: str, k: int, exclude_self: bool = False,
        dims: list[str] | None = None, rows_per_block: int = 4096, fan: int = 64, top_boxes: int = 4096, ties: bool = False) -> DataFrame:
    """The k nearest targets of each query within its key, as an array of
    (d, id, weight, x, y, z) sorted by distance; weights add up to at most k.
    Targets at one position are one entry with their smallest id; ``knn_ids`` tells
    them apart.  With ``ties`` entries are left whole and positions as far as the last one stay.

    Pass one answers inside the home block and bounds the radius; pass two asks
    only the blocks whose box lies within that radius.  Blocks stand in curve
    order, so runs of ``fan`` blocks form the nodes of a tree of boxes: at most
    about ``top_boxes`` nodes are broadcast, the levels below are joined.
    """
    dims = dims or XYZ
    spark = queries.sparkSession
    key_types = dict(queries.dtypes)
    id_type = dict(targets.dtypes)[target_id]
    t = targets.groupBy(*keys, *dims).agg(F.count("*").alias("mult"), F.min(target_id).alias("tid"))
    q = queries.select(*keys, *dims).distinct()
    both = q.select(*keys, *dims, F.lit(True).alias("ask")).join(t, [*keys, *dims], "full_outer").fillna(False, ["ask"])
    n = max(1, math.ceil((queries.count() + targets.count()) / rows_per_block))
    lim = targets.agg(*[f(d).alias(f"_{p}{d}") for d in dims for p, f in (("lo", F.min), ("hi", F.max))])  # one row
    code = both.crossJoin(F.broadcast(lim)).withColumn("_code", curve_code(dims)).drop(*[f"_{p}{d}" for d in dims for p in ("lo", "hi")])
    placed = checkpointed(code.repartitionByRange(n, *keys, "_code", *dims).withColumn("_block", F.spark_partition_id()).drop("_code"))
    has = F.col("mult").isNotNull()
    pieces = placed.groupBy("_block", *keys).agg(*[f(F.when(has, F.col(d))).alias(f"{p}{d}") for d in dims for p, f in (("lo", F.min), ("hi", F.max))], F.count("mult").alias("cnt"))
    spanning = pieces.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    pieces = pieces.join(spanning, keys).filter("cnt > 0")

    def level(up: int) -> DataFrame:
        """Boxes of runs of fan^up blocks, by key."""
        node = F.floor(F.col("_block") / fan**up).cast("int").alias("_node")
        return pieces.groupBy(node, *keys).agg(*[f(f"{p}{d}").alias(f"{p}{d}") for d in dims for p, f in (("lo", F.min), ("hi", F.max))])

    top, all_ask, boxes = 0, False, pd.DataFrame(columns=[*keys, "_node"])
    if n > 1:
        pieces = checkpointed(pieces)
        count = pieces.count()
        while count > top_boxes and n > fan**top:
            top += 1
            count = level(top).count()
        all_ask = count > top_boxes  # too many keys even with one node each: every query starts at the root of its key
        boxes = boxes if all_ask else level(top).toPandas()
    by_key = {kk if isinstance(kk, tuple) else (kk,): (g["_node"].to_numpy(), g[[f"lo{d}" for d in dims]].to_numpy(float), g[[f"hi{d}" for d in dims]].to_numpy(float))
              for kk, g in boxes.groupby(keys, dropna=False)} if len(boxes) else {}
    shared = spark.sparkContext.broadcast(by_key)
    nd = len(dims)

    def flat(pdf_q, r, kind, d, tid, w, coords, keyvals):
        out = {kk: [v] * len(r) for kk, v in zip(keys, keyvals)}
        for i, name in enumerate(dims):
            out["q" + name] = pdf_q[r, i]
        out |= {"kind": kind, "d": d, "tid": tid, "w": w}
        for i, name in enumerate(dims):
            out["t" + name] = coords[:, i]
        return pd.DataFrame(out)

    schema = (", ".join(f"{kk} {key_types[kk]}" for kk in keys) + "".join(f", q{d} double" for d in dims)
              + f", kind int, d double, tid {id_type}, w long" + "".join(f", t{d} double" for d in dims))

    def home(pdf: pd.DataFrame) -> pd.DataFrame:
        keyvals = tuple(pdf[kk].iloc[0] for kk in keys)
        block = pdf["_block"].iloc[0]
        ask = pdf[pdf["ask"]]
        tar = pdf[pdf["mult"].notna()]
        qx, tx = ask[dims].to_numpy(float), tar[dims].to_numpy(float)
        mult, tid = tar["mult"].to_numpy(float), tar["tid"].to_numpy()
        radius = np.full(len(qx), np.inf)
        if len(tx):
            r, c, d, w = _nearest(qx, tx, mult, tid, k, exclude_self, ties)
            got = np.bincount(r, weights=w, minlength=len(qx)) if len(r) else np.zeros(len(qx))
            far = np.zeros(len(qx))
            np.maximum.at(far, r, d)
            radius = np.where(got >= k, far, np.inf)
            parts = [flat(qx, r, 0, d, tid[c], w.astype("int64"), tx[c], keyvals)]
        else:
            parts = []
        ids, lo, hi = shared.value.get(keyvals, (np.empty(0, int), np.empty((0, nd)), np.empty((0, nd))))
        if all_ask:
            ids, lo, hi = np.zeros(1, int), np.full((1, nd), -np.inf), np.full((1, nd), np.inf)
        if not top:
            other = ids != block
            ids, lo, hi = ids[other], lo[other], hi[other]
        step = max(1, STEP // max(len(ids), 1))
        for s in range(0, len(qx) if len(ids) else 0, step):
            p = qx[s:s + step, None, :]
            gap = np.sqrt((np.maximum(np.maximum(lo[None] - p, p - hi[None]), 0) ** 2).sum(axis=2))
            r, c = np.nonzero(gap <= radius[s:s + step, None])
            if len(r):
                parts.append(flat(qx, r + s, 1, radius[r + s], ids[c], np.full(len(r), block, "int64"), np.zeros((len(r), nd)), keyvals))
        return pd.concat(parts) if parts else pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})

    first = placed.groupBy("_block", *keys).applyInPandas(home, schema)
    found = first.filter("kind = 0")
    if n > 1:
        first = checkpointed(first)
        found = first.filter("kind = 0")
        probes = first.filter("kind = 1").select(F.col("tid").cast("int").alias("_block"), *keys, *["q" + d for d in dims], F.col("d").alias("reach"), F.col("w").alias("_home"))
        for up in range(top - 1, -1, -1):  # down the tree: only boxes within reach are asked further
            below = level(up).withColumn("_block", F.floor(F.col("_node") / fan).cast("int"))
            gap = sum(F.greatest(F.col(f"lo{d}") - F.col(f"q{d}"), F.col(f"q{d}") - F.col(f"hi{d}"), F.lit(0.0)) ** 2 for d in dims)
            probes = probes.join(below, ["_block", *keys]).filter(F.sqrt(gap) <= F.col("reach"))
            probes = probes.select(F.col("_node").alias("_block"), *keys, *["q" + d for d in dims], "reach", "_home")
        probes = checkpointed(probes.filter("_block <> _home").drop("_home"))
        # A block asked by very many queries is answered by several tasks.
        salts = probes.groupBy("_block", *keys).agg(F.ceil(F.count("*") / (4 * rows_per_block)).cast("int").alias("_salts"))
        probes = probes.join(salts, ["_block", *keys]).withColumn("_salt", F.pmod(F.xxhash64(*["q" + d for d in dims]), F.col("_salts")).cast("int")).drop("_salts")
        asked = placed.filter(has).join(salts, ["_block", *keys]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts", "ask")

        def away(ask: pd.DataFrame, tar: pd.DataFrame) -> pd.DataFrame:
            keyvals = tuple(ask[kk].iloc[0] for kk in keys) if len(ask) else None
            if not len(ask) or not len(tar):
                return pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})
            qx, tx = ask[["q" + d for d in dims]].to_numpy(float), tar[dims].to_numpy(float)
            tid = tar["tid"].to_numpy()
            r, c, d, w = _nearest(qx, tx, tar["mult"].to_numpy(float), tid, k, exclude_self, ties)
            ok = d <= ask["reach"].to_numpy()[r]
            return flat(qx, r[ok], 0, d[ok], tid[c[ok]], w[ok].astype("int64"), tx[c[ok]], keyvals)

        group = ["_block", *keys, "_salt"]
        asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # fresh column ids for the cogroup
        found = found.unionByName(probes.groupBy(*group).cogroup(asked.groupBy(*group)).applyInPandas(away, schema))
    entry = F.struct("d", F.col("tid").alias("id"), F.col("w").alias("weight"), *[F.col("t" + d).alias(d) for d in dims])
    merged = found.groupBy(*keys, *[F.col("q" + d).alias(d) for d in dims]).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    merged = merged.withColumn("neighbours", F.col("_all") if ties else _clip("_all", k)).drop("_all")
    return queries.select(*keys, query_id, *dims).join(merged, [*keys, *dims], "left")


def _clip(col: str, k: int) -> Column:
    """Keep sorted neighbours until their weights add up to k; the last is cut."""
    before = F.transform(F.col(col), lambda e, i: F.aggregate(F.slice(F.col(col), F.lit(1), i), F.lit(0).cast("long"), lambda s, v: s + v.weight))
    kept = F.filter(F.arrays_zip(F.col(col).alias("e"), before.alias("b")), lambda z: z.b < k)
    return F.transform(kept, lambda z: z.e.withField("weight", F.least(z.e.weight, F.lit(k) - z.b)))


def knn_ids(queries: DataFrame, targets: DataFrame, keys: list[str], query_id: str, target_id: str, k: int, exclude_self: bool = False,
            dims: list[str] | None = None, **kw) -> DataFrame:
    """The k nearest targets of each query within its key, each by its own id: an array of
    (d, id) sorted by both, null without a target.  ``exclude_self`` leaves out the target with the query's id."""
    dims = dims or XYZ
    places = queries.select(*keys, *dims).distinct().withColumn("_at", F.lit(0))
    found = knn(places, targets, keys, "_at", target_id, k, exclude_self, dims, ties=True, **kw)
    found = found.select(*keys, *dims, F.explode("neighbours").alias("e")).select(*keys, *dims, "e.d", *[F.col("e." + c).alias("t" + c) for c in dims])
    own = Window.partitionBy(*keys, *dims).orderBy(target_id)
    first = targets.select(*keys, *dims, target_id).withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k + 1)  # one may be the query itself
    first = first.select(*keys, *[F.col(c).alias("t" + c) for c in dims], F.col(target_id).alias("id"))
    pairs = found.join(first, [*keys, *["t" + c for c in dims]])
    best = Window.partitionBy(*keys, *dims).orderBy("d", "id")
    pairs = pairs.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1)
    lists = pairs.groupBy(*keys, *dims).agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("_all"))  # k + 1 entries
    d = queries.select(*keys, query_id, *dims).join(lists, [*keys, *dims], "left")
    others = F.filter("_all", lambda e: e.id != F.col(query_id)) if exclude_self else F.col("_all")
    return d.withColumn("neighbours", F.slice(others, 1, k)).drop("_all")


def nearest(queries: DataFrame, targets: DataFrame, keys: list[str], query_id: str, target_id: str, **kw) -> DataFrame:
    d = knn(queries, targets, keys, query_id, target_id, 1, **kw)
    return d.select(*keys, query_id, F.get("neighbours", F.lit(0)).d.alias("distance"), F.get("neighbours", F.lit(0)).id.alias("nearest_id"))


def mean_neighbour_distance(points: DataFrame, keys: list[str], point_id: str, k: int, **kw) -> DataFrame:
    d = knn(points, points, keys, point_id, point_id, k, exclude_self=True, **kw)
    total = F.aggregate("neighbours", F.lit(0.0), lambda s, e: s + e.d * e.weight)
    count = F.aggregate("neighbours", F.lit(0).cast("long"), lambda s, e: s + e.weight)
    return d.select(*keys, point_id, (total / count).alias("mean_distance"))


def remove_statistical_outliers(points: DataFrame, keys: list[str], point_id: str, k: int, sigmas: float, **kw) -> DataFrame:
    """Drop points whose mean distance to k others reaches mean + sigmas * population
    deviation; a cloud with fewer than k points stays whole."""
    m = mean_neighbour_distance(points, keys, point_id, k, **kw)
    s = m.groupBy(*keys).agg(F.count("*").alias("_n"), (F.avg("mean_distance") + sigmas * F.stddev_pop("mean_distance")).alias("_cut"))
    keep = (F.col("_n") < k) | (F.col("mean_distance") < F.col("_cut"))
    return m.join(s, keys).filter(keep).drop("_n", "_cut")


def estimate_normals(points: DataFrame, keys: list[str], point_id: str, k: int, **kw) -> DataFrame:
    """Smallest principal direction of the k nearest (the point included);
    (0,0,1) under three neighbours.  Six sums per point, eigenvectors in batches."""
    d = knn(points, points, keys, point_id, point_id, max(k, 3), **kw)

    def total(f):
        return F.aggregate("neighbours", F.lit(0.0), lambda s, e: s + e.weight * f(e))

    n = total(lambda e: F.lit(1.0))
    sums = {f"s{a}": total(lambda e, a=a: e[a]) for a in XYZ}
    sums |= {f"s{a}{b}": total(lambda e, a=a, b=b: (e[a] - F.col(a)) * (e[b] - F.col(b))) for i, a in enumerate(XYZ) for b in XYZ[i:]}
    sums |= {f"c{a}": total(lambda e, a=a: e[a] - F.col(a)) for a in XYZ}
    s = d.select(*keys, point_id, n.alias("n"), *[c.alias(m) for m, c in sums.items()])
    types = dict(s.dtypes)
    out = ", ".join(f"{c} {types[c]}" for c in (*keys, point_id)) + ", nx double, ny double, nz double"

    def solve(batches):
        for p in batches:
            m = np.zeros((len(p), 3, 3))
            cnt = p["n"].to_numpy()
            for i, a in enumerate(XYZ):
                for j, b in enumerate(XYZ):
                    lo, hi = (a, b) if i <= j else (b, a)
                    m[:, i, j] = p[f"s{lo}{hi}"] - p[f"c{a}"] * p[f"c{b}"] / np.maximum(cnt, 1)
            vec = np.linalg.eigh(m)[1][:, :, 0] if len(p) else np.zeros((0, 3))
            vec[cnt < 3] = (0.0, 0.0, 1.0)
            yield pd.DataFrame({**{c: p[c] for c in (*keys, point_id)}, "nx": vec[:, 0], "ny": vec[:, 1], "nz": vec[:, 2]})

    return s.mapInPandas(solve, out)


def geometry_metrics(pred: DataFrame, truth: DataFrame, keys: list[str], point_id: str, threshold: float, normal_k: int = 0, **kw) -> DataFrame:
    """Chamfer, Hausdorff, precision, recall, F-score and normal consistency per key.
    All points are used; thin the inputs with the stride sample for parity with a limit."""
    a, b = nearest(pred, truth, keys, point_id, point_id, **kw), nearest(truth, pred, keys, point_id, point_id, **kw)

    def side(d, p):
        return d.groupBy(*keys).agg(F.avg("distance").alias("mean_" + p), F.max("distance").alias("max_" + p), F.avg((F.col("distance") <= threshold).cast("double")).alias(p))

    s = side(a, "precision").join(side(b, "recall"), keys)
    pr = F.col("precision") + F.col("recall")
    out = s.select(*keys, ((F.col("mean_precision") + F.col("mean_recall")) * 0.5).alias("chamfer"), F.greatest("max_precision", "max_recall").alias("hausdorff"),
                   "precision", "recall", F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / pr).alias("fscore"))
    if normal_k:
        na, nb = estimate_normals(pred, keys, point_id, normal_k, **kw), estimate_normals(truth, keys, point_id, normal_k, **kw)
        nb = nb.select(*keys, F.col(point_id).alias("nearest_id"), *[F.col("n" + c).alias("m" + c) for c in XYZ])
        dots = na.join(a.select(*keys, point_id, "nearest_id"), [*keys, point_id]).join(nb, [*keys, "nearest_id"])
        out = out.join(dots.groupBy(*keys).agg(F.avg(F.abs(sum(F.col("n" + c) * F.col("m" + c) for c in XYZ))).alias("normal_consistency")), keys)
    return out


def cells(size: float, dims=XYZ) -> list[Column]:
    return [F.floor(F.col(d) / size).cast("long").alias("c" + d) for d in dims]


CELL = ["cx", "cy", "cz"]


def _offsets(reach: int, half: bool = False) -> list[tuple[int, int, int]]:
    r = range(-reach, reach + 1)
    every = [(i, j, m) for i in r for j in r for m in r if (i, j, m) != (0, 0, 0)]
    return [o for o in every if o > (0, 0, 0)] if half else every


def _shifted(offsets) -> Column:
    return F.explode(F.array(*[F.struct(*[(F.col(c) + v).alias("o" + c) for c, v in zip(CELL, o)]) for o in offsets]))


def remove_radius_outliers(points: DataFrame, keys: list[str], point_id: str, radius: float, min_neighbours: int) -> DataFrame:
    """Keep points with enough others at 0 < distance < radius.

    In a cell with a diagonal below the radius, all points at other positions are
    in reach: where they are enough, no pairs are formed.  Only points of thinner
    cells probe their surroundings, so the work stays linear in dense regions.
    Copies are no neighbours of each other, yet each counts for the others.
    """
    side = radius / math.sqrt(3) * (1 - 1e-9)
    pos = points.groupBy(*keys, *XYZ).agg(F.count("*").alias("copies")).select("*", *cells(side))
    stat = pos.groupBy(*keys, *CELL).agg(F.sum("copies").alias("total"))
    pos = pos.join(stat, [*keys, *CELL])
    proven = F.col("total") - F.col("copies") >= min_neighbours
    sparse = pos.filter(~proven)
    probe = sparse.select(*keys, *XYZ, "copies", _shifted([(0, 0, 0), *_offsets(2)]).alias("o")).select(*keys, *XYZ, *[F.col(f"o.o{c}").alias(c) for c in CELL])
    other = pos.select(*keys, *CELL, *[F.col(d).alias("t" + d) for d in XYZ], F.col("copies").alias("tc"))
    d2 = sum((F.col(d) - F.col("t" + d)) * (F.col(d) - F.col("t" + d)) for d in XYZ)
    hits = probe.join(other, [*keys, *CELL]).withColumn("d2", d2).filter((F.col("d2") > 0) & (F.col("d2") < radius * radius))
    enough = hits.groupBy(*keys, *XYZ).agg(F.sum("tc").alias("n")).filter(F.col("n") >= min_neighbours).select(*keys, *XYZ)
    keep = pos.filter(proven).select(*keys, *XYZ).unionByName(enough)
    return points.join(keep, [*keys, *XYZ], "left_semi")


def coverage_gaps(points: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Corners of the padded box lattice that lie in an empty or sparse voxel and
    have a point closer than two cells.  Candidates are generated around points
    only, never over the whole box."""
    box = points.groupBy(*keys).agg(*[F.min(d).alias("_lo" + d) for d in XYZ], *[F.max(d).alias("_hi" + d) for d in XYZ])
    p = points.select(*keys, *XYZ).distinct().join(box, keys)
    p = p.withColumns({"_b" + d: F.col("_lo" + d) - size for d in XYZ} | {"_n" + d: F.ceil((F.col("_hi" + d) - F.col("_lo" + d) + 2 * size) / size) for d in XYZ})
    for d in XYZ:
        at = (F.col(d) - F.col("_b" + d)) / size
        p = p.withColumn("i" + d, F.explode(F.sequence(F.greatest(F.floor(at) - 1, F.lit(0)).cast("long"), F.least(F.floor(at) + 2, F.col("_n" + d) - 1).cast("long"))))
    near = sum((F.col("_b" + d) + F.col("i" + d) * size - F.col(d)) ** 2 for d in XYZ) < (2 * size) ** 2
    corners = p.filter(near).select(*keys, *["i" + d for d in XYZ], *[(F.col("_b" + d) + F.col("i" + d) * size).alias(d) for d in XYZ]).distinct()
    counts = points.groupBy(*keys, *cells(size)).agg(F.count("*").alias("n"))
    counts = counts.join(counts.groupBy(*keys).agg(F.max("n").alias("most")), keys)
    dense = counts.filter(F.col("n") / F.col("most") >= 0.2).select(*keys, *CELL)
    return corners.select("*", *cells(size)).join(dense, [*keys, *CELL], "left_anti").drop(*CELL)


def signed_distance(points: DataFrame, keys: list[str], resolution: int, reach: int = 3) -> DataFrame:
    """Lattice cells within ``reach`` of a point, each keeping the value of the
    smallest distance, signed by the side of the normal (nx, ny, nz)."""
    box = points.groupBy(*keys).agg(*[F.min(d).alias("_lo" + d) for d in XYZ], *[F.max(d).alias("_hi" + d) for d in XYZ])
    pad = F.sqrt(sum((F.col("_hi" + d) - F.col("_lo" + d)) ** 2 for d in XYZ)) * 0.05
    box = box.withColumn("_pad", pad).withColumns({"_b" + d: F.col("_lo" + d) - F.col("_pad") for d in XYZ} | {"_e" + d: F.col("_hi" + d) - F.col("_lo" + d) + 2 * F.col("_pad") for d in XYZ})
    box = box.withColumn("voxel", F.greatest(*["_e" + d for d in XYZ]) / resolution)
    box = box.withColumns({"_n" + d: F.ceil(F.col("_e" + d) / F.col("voxel")) + 1 for d in XYZ}).drop("_pad", *[f"_{p}{d}" for p in ("lo", "hi", "e") for d in XYZ])
    p = points.join(box, keys)
    for d in XYZ:
        at = F.floor((F.col(d) - F.col("_b" + d)) / F.col("voxel")).cast("int")
        p = p.withColumns({"_a" + d: F.greatest(at - reach, F.lit(0)), "_z" + d: F.least(at + reach, (F.col("_n" + d) - 1).cast("int"))}).filter(F.col(d).isNotNull() & F.col("_z" + d).isNotNull())
    known = F.concat(*[F.col("n" + d).cast("string") for d in XYZ]).isNotNull()
    p = p.select(*keys, "point_id", "voxel", *[c.cast("double").alias(n) for d in XYZ for n, c in ((d, F.col(d)), ("_b" + d, F.col("_b" + d)), ("n" + d, F.when(known, F.col("n" + d)).otherwise(F.lit(0.0))))], *[f"_{n}{d}" for d in XYZ for n in "az"])
    schema = T.StructType([*(p.schema[k] for k in keys), *(T.StructField("v" + d, T.IntegerType()) for d in XYZ), T.StructField("_d", T.DoubleType()), p.schema["point_id"], T.StructField("_s", T.DoubleType())])

    def nearest(batches):
        """Of some points at a time the nearest per cell, so that the cells of single points are never sorted or shuffled."""
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                c = {n: part.column(n).to_numpy(zero_copy_only=False) for n in part.schema.names if n != "point_id"}
                size = [(c["_z" + d] - c["_a" + d] + 1).astype(np.int64) for d in XYZ]
                cells_of = size[0] * size[1] * size[2]
                w = np.repeat(np.arange(part.num_rows), cells_of)
                i = np.arange(len(w)) - np.repeat(np.cumsum(cells_of) - cells_of, cells_of)
                step = (i // (size[1] * size[2])[w], i // size[2][w] % size[1][w], i % size[2][w])
                v = [c["_a" + d][w] + n for d, n in zip(XYZ, step)]
                gap = [c["_b" + d][w] + n * c["voxel"][w] - c[d][w] for d, n in zip(XYZ, v)]
                dist = np.sqrt(sum(g * g for g in gap))
                side = sum(g * c["n" + d][w] for d, g in zip(XYZ, gap))
                tie = pc.rank(part.column("point_id"), null_placement="at_start", tiebreaker="dense").to_numpy()[w]
                group = [np.unique(c[k], return_inverse=True)[1][w] for k in keys]
                order = np.lexsort((tie, dist, *v, *group))
                cell = np.stack([*v, *group])[:, order]
                best = order[np.r_[True, (cell[:, 1:] != cell[:, :-1]).any(axis=0)]] if len(order) else order
                at = pa.array(w[best])
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in keys), *(pa.array(n[best].astype(np.int32)) for n in v), pa.array(dist[best]), part.column("point_id").take(at),
                                                  pa.array(np.where((side > 0) | np.isnan(side), dist, -dist)[best])], names=schema.names)

    found = p.mapInArrow(nearest, schema)
    return found.groupBy(*keys, "vx", "vy", "vz").agg(F.min_by("_s", F.struct("_d", "point_id")).alias("sdf"))


def cluster(points: DataFrame, keys: list[str], point_id: str, eps: float, min_size: int, max_objects: int | None = None) -> DataFrame:
    """Connected components of the graph "closer than eps", as boxes; with
    ``max_objects``, that many of each key.

    Cells with a diagonal below eps are the nodes.  Two cells are linked if their
    point boxes prove it; only undecided pairs are refined by sub-cells and, if
    still open, by points."""
    from scanloom.operators.graph import connected_components
    from scanloom.operators.toplists import top_per_key

    side = eps / math.sqrt(3) * (1 - 1e-9)
    p = points.select(*keys, point_id, *XYZ, *cells(side))
    spans = [f(d).alias(n + d) for d in XYZ for n, f in (("lo", F.min), ("hi", F.max))]
    nodes = checkpointed(p.groupBy(*keys, *CELL).agg(F.min(point_id).alias("node"), F.count("*").alias("n"), *spans))

    def links(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        """Pairs with the least and greatest possible distance of their boxes."""
        lo = sum(F.greatest(F.col("blo" + d) - F.col("ahi" + d), F.col("alo" + d) - F.col("bhi" + d), F.lit(0.0)) ** 2 for d in XYZ)
        hi = sum(F.greatest(F.col("bhi" + d) - F.col("alo" + d), F.col("ahi" + d) - F.col("blo" + d)) ** 2 for d in XYZ)
        j = a.join(b, on).withColumns({"_lo": F.sqrt(lo), "_hi": F.sqrt(hi)}).filter(F.col("_lo") < eps)
        return j.withColumn("sure", F.col("_hi") < eps)

    def named(pre):
        return [F.col(f"{e}{d}").alias(f"{pre}{e}{d}") for e in ("lo", "hi") for d in XYZ]

    a = nodes.select(*keys, F.col("node").alias("u"), *named("a"), _shifted(_offsets(2, half=True)).alias("o")).select("*", *[F.col(f"o.o{c}").alias(c) for c in CELL]).drop("o")
    pairs = checkpointed(links(a, nodes.select(*keys, *CELL, F.col("node").alias("v"), *named("b")), [*keys, *CELL]).select(*keys, "u", "v", "sure"))
    sure = pairs.filter("sure").select(*keys, "u", "v")
    open_ = pairs.filter("NOT sure").select(*keys, "u", "v")
    cellnode = nodes.select(*keys, *CELL, "node")
    sub = p.join(cellnode, [*keys, *CELL]).groupBy(*keys, "node", *[F.floor(F.col(d) / (side / 4)).cast("long").alias("s" + d) for d in XYZ]).agg(*spans)
    left = open_.join(sub.select(*keys, F.col("node").alias("u"), *[F.col("s" + d).alias("us" + d) for d in XYZ], *named("a")), [*keys, "u"])
    right = sub.select(*keys, F.col("node").alias("v"), *[F.col("s" + d).alias("vs" + d) for d in XYZ], *named("b"))
    fine = checkpointed(links(left, right, [*keys, "v"]).select(*keys, "u", "v", "sure", *["us" + d for d in XYZ], *["vs" + d for d in XYZ]))
    agreed = fine.filter("sure").select(*keys, "u", "v").distinct()
    rest = fine.filter("NOT sure").join(agreed, [*keys, "u", "v"], "left_anti")
    pts = p.join(cellnode, [*keys, *CELL]).select(*keys, "node", *XYZ, *[F.floor(F.col(d) / (side / 4)).cast("long").alias("s" + d) for d in XYZ]).distinct()
    pu = pts.select(*keys, F.col("node").alias("u"), *[F.col("s" + d).alias("us" + d) for d in XYZ], *[F.col(d).alias("u" + d) for d in XYZ])
    pv = pts.select(*keys, F.col("node").alias("v"), *[F.col("s" + d).alias("vs" + d) for d in XYZ], *[F.col(d).alias("v" + d) for d in XYZ])
    met = rest.join(pu, [*keys, "u", *["us" + d for d in XYZ]]).join(pv, [*keys, "v", *["vs" + d for d in XYZ]]).filter(
        F.sqrt(sum((F.col("u" + d) - F.col("v" + d)) ** 2 for d in XYZ)) < eps).select(*keys, "u", "v").distinct()
    edges = sure.unionByName(agreed).unionByName(met).select("u", "v")
    comp = connected_components(nodes.select(F.col("node").alias("id")), edges)
    c = nodes.join(comp, nodes.node == comp.id).groupBy(*keys, "component").agg(F.sum("n").alias("points"), *[F.min("lo" + d).alias("lo" + d) for d in XYZ], *[F.max("hi" + d).alias("hi" + d) for d in XYZ])
    large = c.filter(F.col("points") >= min_size)
    return top_per_key(large, keys, [F.col("component")], max_objects) if max_objects else large


def suppress_weaker(keypoints: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Drop keypoints with a stronger one within three pixels (5 x 5 window).
    Probes ask the maximum per pixel, so copies cost one row."""
    px = keypoints.groupBy(*keys, "px", "py").agg(F.max("response").alias("top"))
    ring = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j < 9]
    around = px.select(*keys, F.explode(F.array(*[F.struct((F.col("px") + i).alias("px"), (F.col("py") + j).alias("py"), F.col("top").alias("t")) for i, j in ring])).alias("o"))
    best = around.select(*keys, "o.px", "o.py", "o.t").groupBy(*keys, "px", "py").agg(F.max("t").alias("best"))
    return keypoints.join(best, [*keys, "px", "py"]).filter(F.col("best") <= F.col("response")).drop("best")
