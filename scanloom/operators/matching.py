"""Descriptor matching, robust models and triangulation over many image pairs.

Features of an image are cut into chunks; one task compares one left chunk with
one right chunk in numpy and keeps only the two nearest per feature, so the
size of an image never decides the size of a task.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.ordering import order_stats
from scanloom.session import checkpointed


def image_pairs(images: DataFrame, scene: str) -> DataFrame:
    """Every pair i < j of the images of one scene."""
    a = images.select(scene, F.col("image_id").alias("image1"))
    b = images.select(scene, F.col("image_id").alias("image2"))
    return a.join(b, scene).filter("image1 < image2")


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "hamming":  # packed 64-bit words
        x = a[:, None, :] ^ b[None, :, :]
        return np.unpackbits(x.view(np.uint8).reshape(len(a), len(b), -1), axis=2).sum(axis=2).astype(float)
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def two_nearest(features: DataFrame, pairs: DataFrame, scene: str, metric: str = "l2", chunk: int = 1024) -> DataFrame:
    """Best and second-best distance of each feature in the other image, both ways:
    (scene, image1, image2, forward, kp, best, d1, d2)."""
    types = dict(features.dtypes)
    f = features.select(scene, "image_id", "kp_id", "descriptor").withColumn("_c", F.pmod(F.xxhash64("kp_id"), F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy(scene, "image_id")) / chunk))).cast("int"))
    chunks = f.select(scene, "image_id", "_c").distinct()
    plan = (pairs.join(chunks.select(scene, F.col("image_id").alias("image1"), F.col("_c").alias("c1")), [scene, "image1"])
            .join(chunks.select(scene, F.col("image_id").alias("image2"), F.col("_c").alias("c2")), [scene, "image2"]))
    group = [scene, "image1", "image2", "c1", "c2"]
    left = plan.join(f.select(scene, F.col("image_id").alias("image1"), F.col("_c").alias("c1"), "kp_id", "descriptor"), [scene, "image1", "c1"])
    right = plan.join(f.select(scene, F.col("image_id").alias("image2"), F.col("_c").alias("c2"), "kp_id", "descriptor"), [scene, "image2", "c2"])
    dtype = np.int64 if metric == "hamming" else float
    schema = f"{scene} {types[scene]}, image1 {types['image_id']}, image2 {types['image_id']}, forward boolean, kp {types['kp_id']}, best {types['kp_id']}, d1 double, d2 double"

    def side(d, kp, other, forward, head):
        order = np.lexsort((np.broadcast_to(other, d.shape), d), axis=1)
        first = order[:, 0]
        rows = np.arange(len(d))
        second = d[rows, order[:, 1]] if d.shape[1] > 1 else np.full(len(d), np.inf)
        return pd.DataFrame({**head, "forward": forward, "kp": kp, "best": other[first], "d1": d[rows, first], "d2": second})

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(a["descriptor"].tolist(), dtype=dtype), np.array(b["descriptor"].tolist(), dtype=dtype)
        d = _distances(x, y, metric)
        head = {c: a[c].iloc[0] for c in (scene, "image1", "image2")}
        ka, kb = a["kp_id"].to_numpy(), b["kp_id"].to_numpy()
        return pd.concat([side(d, ka, kb, True, head), side(d.T, kb, ka, False, head)])

    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # fresh column ids for the cogroup
    part = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(run, schema)
    keys = [scene, "image1", "image2", "forward", "kp"]
    both = F.flatten(F.collect_list(F.array("d1", "d2")))  # two entries per chunk of the other image
    merged = part.groupBy(*keys).agg(F.min_by("best", F.struct("d1", "best")).alias("best"), F.array_sort(both).alias("_d"))
    return merged.select(*keys, "best", F.get("_d", F.lit(0)).alias("d1"), F.get("_d", F.lit(1)).alias("d2"))


def match_all_pairs(near: DataFrame, scene: str, ratio: float, minimum: int) -> DataFrame:
    """Forward ratio test; pairs with too few matches are dropped."""
    m = near.filter("forward").filter(F.col("d1") < ratio * F.col("d2"))
    w = Window.partitionBy(scene, "image1", "image2")  # at most one row per feature of an image
    return m.withColumn("matches", F.count("*").over(w)).filter(F.col("matches") >= minimum).drop("forward", "d2")


def mutual_matches(near: DataFrame, scene: str, ratio: float, zero_limit: float = 64.0) -> DataFrame:
    """Ratio test both ways, then only pairs that agree; with a zero second-best
    the best distance itself must stay under the limit."""
    ok = F.when(F.col("d2") > 0, F.col("d1") / F.col("d2") < ratio).otherwise(F.col("d1") < zero_limit)
    n = near.filter(ok)
    pair = [scene, "image1", "image2"]
    a = n.filter("forward").select(*pair, F.col("kp").alias("kp1"), F.col("best").alias("kp2"), F.col("d1").alias("distance"))
    b = n.filter("NOT forward").select(*pair, F.col("kp").alias("kp2"), F.col("best").alias("kp1"))
    return a.join(b, [*pair, "kp1", "kp2"])


def consistent_matches(matches: DataFrame, keypoints: DataFrame, scene: str, limit: float = 50.0) -> DataFrame:
    """With four or more matches, drop those far from the upper median motion."""
    pair = [scene, "image1", "image2"]
    k = keypoints.select(scene, "image_id", "kp_id", "x", "y")
    m = (matches.join(k.select(scene, F.col("image_id").alias("image1"), F.col("kp_id").alias("kp1"), F.col("x").alias("x1"), F.col("y").alias("y1")), [scene, "image1", "kp1"])
         .join(k.select(scene, F.col("image_id").alias("image2"), F.col("kp_id").alias("kp2"), F.col("x").alias("x2"), F.col("y").alias("y2")), [scene, "image2", "kp2"])
         .withColumns({"dx": F.col("x2") - F.col("x1"), "dy": F.col("y2") - F.col("y1")}))
    m = checkpointed(m)  # read by both medians and the final cut
    med = order_stats(m, pair, "dx", {"mdx": ("upper_median", 0.5)}).join(order_stats(m, pair, "dy", {"mdy": ("upper_median", 0.5)}).drop("n"), pair)
    error = F.sqrt((F.col("dx") - F.col("mdx")) ** 2 + (F.col("dy") - F.col("mdy")) ** 2)
    return m.join(med, pair).filter((F.col("n") < 4) | (error < limit)).select(*pair, "kp1", "kp2", "distance")


class Estimator(Protocol):
    """A model for random-sample consensus over point pairs (n, 4): x1 y1 x2 y2."""

    min_samples: int

    def estimate(self, sample: np.ndarray) -> np.ndarray | None: ...

    def residual(self, model: np.ndarray, data: np.ndarray) -> np.ndarray: ...


class Homography:
    min_samples = 4

    def estimate(self, s):
        x, y, u, v = s.T
        z, o = np.zeros_like(x), np.ones_like(x)
        a = np.array([[-x, -y, -o, z, z, z, u * x, u * y, u], [z, z, z, -x, -y, -o, v * x, v * y, v]]).transpose(0, 2, 1).reshape(-1, 9)
        h = np.linalg.svd(a)[2][-1].reshape(3, 3)
        return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None

    def residual(self, h, d):
        one = np.ones((len(d), 3))
        one[:, :2] = d[:, :2]
        p = one @ h.T
        w = np.where(np.abs(p[:, 2]) > 1e-10, p[:, 2], np.nan)
        r = np.minimum(np.hypot(p[:, 0] / w - d[:, 2], p[:, 1] / w - d[:, 3]), np.finfo(float).max)
        r[np.isnan(r)] = np.inf
        return r


class Essential:
    """Eight-point essential matrix on normalised coordinates, Sampson error."""

    min_samples = 8

    def estimate(self, s):
        x, y, u, v = s.T
        a = np.stack([u * x, u * y, u, v * x, v * y, v, x, y, np.ones_like(x)], 1)
        e = np.linalg.svd(a)[2][-1].reshape(3, 3)
        p, w, q = np.linalg.svd(e)
        m = (w[0] + w[1]) / 2
        return p @ np.diag([m, m, 0.0]) @ q

    def residual(self, e, d):
        a, b = np.c_[d[:, :2], np.ones(len(d))], np.c_[d[:, 2:], np.ones(len(d))]
        ea, eb = a @ e.T, b @ e
        den = ea[:, 0] ** 2 + ea[:, 1] ** 2 + eb[:, 0] ** 2 + eb[:, 1] ** 2
        return (b * ea).sum(axis=1) ** 2 / np.maximum(den, 1e-15)


def consensus(model: Estimator, data: np.ndarray, threshold: float, min_ratio: float, confidence: float, iterations: int, seed: int, min_inliers: int = 0):
    """Strictly more inliers win; the iteration limit adapts to the best share.
    A model with fewer than ``min_inliers`` rows, or a smaller share, is none."""
    n, best, inliers = len(data), None, np.zeros(len(data), bool)
    if n < model.min_samples:
        return None, inliers
    rng = np.random.default_rng(seed)
    done, limit = 0, iterations
    while done < limit:
        done += 1
        m = model.estimate(data[rng.choice(n, model.min_samples, replace=False)])
        if m is None:
            continue
        hit = model.residual(m, data) < threshold
        if hit.sum() > inliers.sum():
            best, inliers = m, hit
            share = hit.mean()
            if share > min_ratio:
                miss = 1 - share ** model.min_samples
                need = 1 if miss <= 1e-12 else int(np.ceil(np.log(1 - confidence) / np.log(miss)))
                limit = min(limit, max(need, done))
    if inliers.mean() < min_ratio or inliers.sum() < min_inliers:
        return None, np.zeros(n, bool)
    return best, inliers


def soft_weights(residuals: np.ndarray, sigmas: np.ndarray) -> np.ndarray:
    """Mean over noise levels of exp(-r2 / 2 s2) where r2 < 3.84 s2."""
    r2, s2 = residuals[:, None] ** 2, sigmas[None, :] ** 2
    return np.where(r2 < 3.84 * s2, np.exp(-r2 / (2 * s2)), 0.0).mean(axis=1)


def pair_seed(values: list[np.ndarray]) -> int:
    """The seed of a pair from its id columns: ``pandas.util.hash_pandas_object`` of their first row, without a frame."""
    out, mult = 0x345678, 1000003
    for i, v in enumerate(values):
        out = (out ^ int(pd.util.hash_array(v[:1])[0])) * mult % 2**64
        mult += 82520 + 2 * (len(values) - i)
    return (out + 97531) % 2**32


def robust_pairs(correspondences: DataFrame, pair: list[str], row_id: str, model: Estimator, threshold: float, min_ratio: float = 0.3,
                 confidence: float = 0.999, iterations: int = 1000, sigma_max: float | None = None, min_inliers: int = 0) -> DataFrame:
    """Inlier rows (and soft weights) of every image pair.  A pair holds at most
    the features of one image; the seed comes from the pair id, so reruns agree."""
    types = dict(correspondences.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in (*pair, row_id)) + ", inlier boolean, weight double"
    levels = np.linspace(threshold / 10, sigma_max or threshold, 10)

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column(row_id).to_numpy())))
        data = np.column_stack([rows.column(c).to_numpy().astype(float) for c in ("x1", "y1", "x2", "y2")])
        seed = pair_seed([rows.column(k).slice(0, 1).to_numpy() for k in pair])
        m, inl = consensus(model, data, threshold, min_ratio, confidence, iterations, seed, min_inliers)
        w = soft_weights(model.residual(m, data), levels) if m is not None else np.zeros(len(data))
        return pa.table({**{k: rows.column(k) for k in (*pair, row_id)}, "inlier": inl, "weight": w})

    return correspondences.select(*pair, row_id, "x1", "y1", "x2", "y2").groupBy(*pair).applyInArrow(fit, schema)


def triangulate(matches: DataFrame, id_cols: list[str]) -> DataFrame:
    """Linear two-view triangulation, batched: rows carry u1 v1 u2 v2 and the
    projection matrices p1, p2 (twelve values each)."""
    types = dict(matches.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in id_cols) + ", x double, y double, z double"

    def solve(batches):
        for b in batches:
            p1, p2 = (np.array(b[c].tolist()).reshape(-1, 3, 4) for c in ("p1", "p2"))
            row = [b[c].to_numpy()[:, None] for c in ("u1", "v1", "u2", "v2")]
            a = np.stack([row[0] * p1[:, 2] - p1[:, 0], row[1] * p1[:, 2] - p1[:, 1], row[2] * p2[:, 2] - p2[:, 0], row[3] * p2[:, 2] - p2[:, 1]], 1)
            h = np.linalg.svd(a)[2][:, 3] if len(b) else np.zeros((0, 4))
            ok = np.abs(h[:, 3]) >= 1e-10
            xyz = h[ok, :3] / h[ok, 3:]
            yield pd.DataFrame({**{c: b[c].to_numpy()[ok] for c in id_cols}, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return matches.select(*id_cols, "u1", "v1", "u2", "v2", "p1", "p2").mapInPandas(solve, schema)
