"""Planted truth and brute force, where SQL cannot judge or blocks must be many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanloom.operators import calibration as C
from scanloom.operators import imaging as I
from scanloom.operators import matching as M
from scanloom.operators import mesh as X
from scanloom.operators import spatial as S
from scanloom.operators import views as V
from scanloom.operators import audio, joins, ordering, windows
from scanloom.operators.graph import connected_components
from scanloom.operators.ordering import indexed, order_stats, previous_row, running


@pytest.fixture(scope="module")
def cloud(spark):
    """One cloud holds a third of all points in one tiny spot, with many copies."""
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, (240, 3))
    hot = np.r_[rng.normal(0.3, 0.01, (80, 3)), np.repeat([[0.3, 0.3, 0.3]], 60, axis=0)]
    pdf = pd.DataFrame(np.r_[a, hot], columns=["x", "y", "z"])
    pdf["cloud_id"] = np.r_[np.arange(240) % 3, np.zeros(140, int)]
    pdf["point_id"] = np.arange(len(pdf))
    return pdf, spark.createDataFrame(pdf)


def brute(pdf, k, exclude):
    out = {}
    for c, g in pdf.groupby("cloud_id"):
        p, ids = g[["x", "y", "z"]].to_numpy(), g["point_id"].to_numpy()
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
        if exclude:
            np.fill_diagonal(d, np.inf)
        for i, row in zip(ids, np.sort(d, axis=1)[:, :k]):
            out[i] = row
    return out


@pytest.mark.parametrize("exclude", [True, False])
@pytest.mark.parametrize("rows, fan, top", [(25, 64, 4096), (25, 3, 6), (25, 2, 0), (5000, 64, 4096)])
def test_knn_blocks_match_brute_force(cloud, exclude, rows, fan, top):
    pdf, df = cloud
    got = S.knn(df, df, ["cloud_id"], "point_id", "point_id", 7, exclude_self=exclude, rows_per_block=rows, fan=fan, top_boxes=top).toPandas()
    want = brute(pdf, 7, exclude)
    assert len(got) == len(pdf)
    for pid, nb in zip(got["point_id"], got["neighbours"]):
        d = np.concatenate([[e["d"]] * e["weight"] for e in nb])
        np.testing.assert_allclose(d, want[pid], atol=1e-9)


@pytest.mark.parametrize("rows", [7, 5000])
@pytest.mark.parametrize("exclude", [True, False])
def test_knn_ids_tells_copies_and_equal_distances_apart(spark, rows, exclude):
    places = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (5.0, 5.0, 5.0)]
    points = [(0, i, *places[i * 7 % 11 % 5]) for i in range(40)] + [(1, 99, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(points, "c int, id long, x double, y double, z double")
    got = {r.id: [(e.d, e.id) for e in r.neighbours or []] for r in S.knn_ids(df, df, ["c"], "id", "id", 4, exclude_self=exclude, rows_per_block=rows).collect()}
    for c, i, *p in points:
        assert got[i] == sorted((float(np.sqrt(((np.array(p) - q) ** 2).sum())), j) for b, j, *q in points if b == c and not (exclude and i == j))[:4]


def test_nearest_between_clouds_over_blocks(cloud):
    pdf, df = cloud
    a, b = df.filter("point_id % 2 = 0"), df.filter("point_id % 2 = 1")
    got = S.nearest(a, b, ["cloud_id"], "point_id", "point_id", rows_per_block=30).toPandas().set_index("point_id")
    pa, pb = pdf[pdf.point_id % 2 == 0], pdf[pdf.point_id % 2 == 1]
    for r in pa.itertuples():
        t = pb[pb.cloud_id == r.cloud_id]
        d = np.sqrt(((t[["x", "y", "z"]] - [r.x, r.y, r.z]) ** 2).sum(axis=1)).min()
        assert got.loc[r.point_id, "distance"] == pytest.approx(d, abs=1e-9)


def test_radius_outliers_with_hot_spot(cloud):
    pdf, df = cloud
    got = {r.point_id for r in S.remove_radius_outliers(df, ["cloud_id"], "point_id", 0.4, 5).select("point_id").collect()}
    want = set()
    for _, g in pdf.groupby("cloud_id"):
        p = g[["x", "y", "z"]].to_numpy()
        d2 = ((p[:, None] - p[None]) ** 2).sum(2)
        want |= set(g["point_id"].to_numpy()[((d2 > 0) & (d2 < 0.16)).sum(1) >= 5])
    assert got == want


def test_clusters_with_hot_spot(cloud):
    pdf, df = cloud
    got = {(r.cloud_id, r.component, r.points) for r in S.cluster(df, ["cloud_id"], "point_id", 0.45, 2, 1000).collect()}
    want = set()
    for c, g in pdf.groupby("cloud_id"):
        p, ids = g[["x", "y", "z"]].to_numpy(), g["point_id"].to_numpy()
        near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) < 0.45
        label = np.arange(len(p))
        while True:
            new = np.array([label[near[i]].min() for i in range(len(p))])
            if (new == label).all():
                break
            label = new
        for v in np.unique(label):
            n = (label == v).sum()
            if n >= 2:
                want.add((c, ids[label == v].min(), n))
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    e = spark.createDataFrame(edges, "u long, v long")
    n = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 130), 500]], "id long")
    got = {r.id: r.component for r in connected_components(n, e).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[500] == 500


def test_order_stats_on_a_hot_key_with_copies(spark):
    rng = np.random.default_rng(1)
    v = np.r_[rng.normal(0, 1, 30000), np.zeros(15000)]
    df = spark.createDataFrame(pd.DataFrame({"k": np.r_[np.zeros(44000, int), np.ones(1000, int)], "v": v}))
    got = {r.k: r for r in order_stats(df, ["k"], "v", {"p90": ("nearest", 0.9), "med": ("upper_median", 0.5), "low": ("floor", 0.001)}).collect()}
    for k in (0, 1):
        s = np.sort(v[:44000] if k == 0 else v[44000:])
        n = len(s)
        assert got[k].p90 == s[int(np.floor((n - 1) * 0.9 + 0.5))] and got[k].med == s[n // 2] and got[k].low == s[int((n - 1) * 0.001)]


def test_chunked_scans_cross_chunk_borders(spark):
    pdf = pd.DataFrame({"k": 0, "us": np.arange(500) * 7, "id": np.arange(500), "v": np.arange(500) % 13})
    df = spark.createDataFrame(pdf)
    p = previous_row(df, ["k"], ["us", "id"], ["v"], width_us=50).orderBy("id").toPandas()
    assert [None if x is None else x["v"] for x in p["prev"]] == [None, *pdf["v"][:-1]]
    r = running(df, ["k"], ["us", "id"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, width_us=50).orderBy("id").toPandas()
    assert list(r["s"]) == list(pdf["v"].cumsum()) and list(r["m"]) == list(pdf["v"].cummax())


def test_dense_index(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": np.random.default_rng(0).permutation(1000) % 100, "b": np.arange(1000)}))
    got = indexed(df, ["a", "b"], partitions=7).orderBy("idx").toPandas()
    assert list(got["idx"]) == list(range(1000)) and got[["a", "b"]].equals(got[["a", "b"]].sort_values(["a", "b"]).reset_index(drop=True))


def test_isosurface_of_a_ball_is_closed(spark):
    r = range(9)
    vox = spark.createDataFrame([(0, x, y, z, 3.2 - ((x - 4) ** 2 + (y - 4) ** 2 + (z - 4.2) ** 2) ** 0.5) for x in r for y in r for z in r], "grid_id int, vx int, vy int, vz int, density double")
    v, tri = X.marching_cubes(vox, 0.0)
    rows = tri.collect()
    seen = {}
    for t in rows:
        for a, b in ((t.e0, t.e1), (t.e1, t.e2), (t.e2, t.e0)):
            seen[(a, b)] = seen.get((a, b), 0) + 1
    assert rows and all(n == 1 and seen.get((b, a)) == 1 for (a, b), n in seen.items())  # every edge once each way
    corners = {p for k in seen for p in k}
    assert len(corners) == v.count() and len(corners) - len(seen) // 2 + len(rows) == 2  # one sphere


def test_all_cube_cases_use_exactly_the_crossed_edges():
    for case, tris in enumerate(X.cube_cases()):
        crossed = {i for i, (a, b) in enumerate(X.CUBE_EDGES) if (case >> a & 1) != (case >> b & 1)}
        assert {e for t in tris for e in t} == crossed


def test_descriptor_chunks_agree_with_one_chunk(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"scene": 0, "image_id": np.repeat([0, 1, 2], 40), "kp_id": np.arange(120), "descriptor": list(rng.normal(size=(120, 8)).tolist())})
    f = spark.createDataFrame(pdf)
    pairs = M.image_pairs(f.select("scene", "image_id").distinct(), "scene")
    one, many = (sorted(map(tuple, M.two_nearest(f, pairs, "scene", chunk=c).collect())) for c in (1000, 9))
    assert len(one) == 240 and one == many


def test_essential_inliers(spark):
    rng = np.random.default_rng(2)
    p = np.c_[rng.uniform(-1, 1, (80, 2)), rng.uniform(3, 6, 80)]
    c, s = np.cos(0.1), np.sin(0.1)
    q = p @ np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]).T + [0.4, 0.05, 0.1]
    d = np.c_[p[:, :2] / p[:, 2:], q[:, :2] / q[:, 2:]]
    d[::5, 2:] += rng.uniform(0.2, 0.5, (16, 2))
    pdf = pd.DataFrame(d, columns=["x1", "y1", "x2", "y2"]).assign(pair=0, row_id=range(80))
    out = M.robust_pairs(spark.createDataFrame(pdf), ["pair"], "row_id", M.Essential(), 1e-6).orderBy("row_id").toPandas()
    assert out["inlier"][~(np.arange(80) % 5 == 0)].all() and out["inlier"][::5].sum() <= 2


def test_focus_stack_blocks_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(0, s, y, [int(v) for v in rng.integers(0, 256, 30)]) for s in range(3) for y in range(40)]
    df = spark.createDataFrame(rows, "stack_id int, slice int, y int, px array<int>")
    one, many = (sorted(map(tuple, I.focus_stack(df, ["stack_id"], "slice", block=b).select("y", F.to_json("px"), F.to_json("best")).collect())) for b in (256, 8))
    assert len(one) == 40 and one == many


def test_planted_sensor_noise_is_recovered(spark):
    rng = np.random.default_rng(7)
    read, gain, rows_d, rows_f = 4.0, 2.0, [], []
    for split in ("fit", "holdout"):
        for pair in range(3):
            for site in range(2):
                n = 900
                yx = np.arange(n)
                a, b = rng.normal(64, read, (2, n))
                rows_d.append(pd.DataFrame({"iso": 100, "split": split, "pair_id": pair, "site": site, "y": yx, "x": 0, "first": a, "second": b}))
                for level in (80, 200, 400, 700):
                    sd = np.sqrt(read ** 2 + level / gain)
                    a, b = rng.normal(64 + level, sd, (2, n))
                    rows_f.append(pd.DataFrame({"iso": 100, "split": split, "pair_id": pair, "site": site, "y": yx, "x": 0, "first": a, "second": b, "level": level}))
    out = C.evaluate_iso(spark.createDataFrame(pd.concat(rows_d)), spark.createDataFrame(pd.concat(rows_f)), 64.0, 1023.0, max_error=0.25).toPandas()
    assert len(out) == 2 and np.allclose(out["read"], read, rtol=0.08) and np.allclose(out["electrons_per_dn"], gain, rtol=0.12)
    assert all(len(f) == 0 for f in out["failures"]) and out["profile"].all()
    thin = spark.createDataFrame(pd.concat(rows_f[:4]))
    bad = C.evaluate_iso(spark.createDataFrame(pd.concat(rows_d)), thin, 64.0, 1023.0).toPandas()
    assert not bad["profile"].any()


def test_planted_lens_growth_is_recovered(spark):
    from scanloom.plans import QUERIES

    out = QUERIES["lens_blur_calibration"].run(spark, "/root/testdata/sf0.01").toPandas()
    assert (out["calibrated_p95"] < 0.1).all() and (out["reduction"] > 0.6).all()


def plane(rng, cloud, normal, n=120, shift=0.0):
    a = np.cross(normal, [1.0, 0.3, 0.2])
    a /= np.linalg.norm(a)
    p = rng.uniform(-1, 1, (n, 2)) @ np.array([a, np.cross(normal, a)]) + np.multiply(normal, shift)
    return pd.DataFrame({"cloud_id": cloud, "point_id": np.arange(n) + 1000 * cloud, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})


def test_normals_of_a_plane(spark):
    rng = np.random.default_rng(3)
    normals = {0: np.array([0.0, 0.0, 1.0]), 1: np.array([0.6, 0.0, 0.8]), 2: np.array([2, -1, 2]) / 3}
    df = spark.createDataFrame(pd.concat(plane(rng, c, n) for c, n in normals.items()))
    for r in S.estimate_normals(df, ["cloud_id"], "point_id", 8, rows_per_block=50).collect():
        assert abs(abs(np.dot([r.nx, r.ny, r.nz], normals[r.cloud_id])) - 1) < 1e-9


def test_normal_consistency_of_tilted_planes(spark):
    rng = np.random.default_rng(3)
    up, tilted = np.array([0.0, 0.0, 1.0]), np.array([0.0, 0.6, 0.8])
    pred = pd.concat([plane(rng, 0, up), plane(rng, 1, up)])
    truth = pd.concat([plane(rng, 0, up, shift=0.01), plane(rng, 1, tilted)])
    out = S.geometry_metrics(spark.createDataFrame(pred), spark.createDataFrame(truth), ["cloud_id"], "point_id", 0.5, normal_k=8).toPandas().set_index("cloud_id")
    assert out.loc[0, "normal_consistency"] == pytest.approx(1.0) and out.loc[1, "normal_consistency"] == pytest.approx(0.8)


@pytest.fixture()
def crowded(monkeypatch):
    """Every table counts as large and every chunk as crowded."""
    monkeypatch.setattr(ordering, "SMALL_BYTES", 0)
    monkeypatch.setattr(ordering, "CHUNK_ROWS", 50)


def burst(spark, n=1000):
    """One key, all rows within one second of one day."""
    return spark.createDataFrame([(1, (i * 7919) % 1_000_000, i, float(i % 13)) for i in range(n)], "k long, us long, id long, value double")


def test_a_burst_inside_one_day_spreads_over_tasks(spark, crowded):
    d = burst(spark)
    chunks = ordering.with_chunk(d, ["k"], ["us", "id"]).groupBy("_chunk").count().collect()
    assert len(chunks) > 20 and max(r["count"] for r in chunks) < 200
    rows = sorted(d.collect(), key=lambda r: (r.us, r.id))
    before = {b.id: a.value for a, b in zip(rows, rows[1:])}
    got = ordering.previous_row(d, ["k"], ["us", "id"], ["value"]).collect()
    assert {r.id: r.prev.value for r in got if r.prev} == before
    total, sums = 0.0, {}
    for r in rows:
        total += r.value
        sums[r.id] = total
    assert {r.id: r.s for r in ordering.running(d, ["k"], ["us", "id"], {"s": ("sum", F.col("value"))}).collect()} == sums


def test_crowded_chunks_do_not_change_smoothing_and_joins(spark, crowded):
    d = burst(spark)
    v, want = 0.0, {}
    for r in sorted(d.collect(), key=lambda r: (r.us, r.id)):
        v = v * 0.7 + r.value * 0.3
        want[r.id] = v
    got = {r.id: r.smoothed for r in windows.exponential_smoothing(d, ["k"], "us", "id", "value", 0.3).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    left = d.filter("id % 5 = 0").select("k", F.col("us").alias("us"), F.col("id").alias("lid"))
    right = d.filter("id % 5 = 1").select("k", "us", F.col("id").alias("rid"))
    near = {r.lid: r.distance_us for r in joins.asof_nearest(left, right, ["k"], "lid", ["rid"]).collect()}
    times = [r.us for r in right.collect()]
    assert near == {r.lid: min(abs(r.us - t) for t in times) for r in left.collect()}


def test_affine_steps_compose():
    rng = np.random.default_rng(0)
    f, o, v = rng.normal(size=77), rng.normal(size=77), 0.4
    for i, (factor, offset) in enumerate(zip(*ordering.affine_scan(f, o))):
        v = f[i] * v + o[i]
        assert abs(factor * 0.4 + offset - v) < 1e-9


def test_planted_shift_is_found_without_hashes(spark):
    """The track is a stretch of the reference; blocks of the correlation are smaller than the shift."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=4000)
    tracks = {1: np.r_[rng.normal(size=333) * 0.1, a[:3000]], 2: a[257:], 3: np.zeros(500), 4: a[:10]}
    rows = spark.createDataFrame([(k, i, float(x)) for k, t in tracks.items() for i, x in enumerate(t)], "track long, i long, value double")
    reference = spark.createDataFrame([(i, float(x)) for i, x in enumerate(a)], "i long, value double")

    def plain(b):
        n, best = min(len(a), len(b)), (0, 0.0)
        for lag in range(-(n // 4), n // 4):
            at = [i for i in range(0, n, 16) if 0 <= i + lag < len(b)]
            if at and (mean := sum(a[i] * b[i + lag] for i in at) / len(at)) > best[1] + 1e-12:
                best = (lag, mean)
        return best

    for block in (1 << 15, 64):
        got = {r.track: (r.lag, r.correlation) for r in audio.cross_correlate(rows, reference, ["track"], block).collect()}
        assert got[1][0] == 333 and got[2][0] == -257 and got[3] == (0, 0.0)
        for k, b in tracks.items():
            lag, mean = plain(b)
            assert got[k][0] == lag and abs(got[k][1] - mean) < 1e-9
    hashes = spark.createDataFrame([(1, "h", 5)], "track long, hash string, time long")
    both = audio.align_tracks(hashes, hashes.select("hash", F.lit(9).cast("long").alias("time")), rows, reference, ["track"], 20, 1000.0).collect()
    assert {r.track: r.method for r in both} == {1: "fingerprint", 2: "correlation", 3: "correlation", 4: "correlation"}
    assert {r.track: r.offset_s for r in both}[2] == -257 * 16 / 1000


def test_lens_profile_between_its_knots(spark):
    """Focal length, pupil and growth change with the dioptres; every holdout row counts, none is on a knot."""
    rng = np.random.default_rng(7)

    def truth(f, r):
        share = (1 / f - 1 / 4) / (1 - 1 / 4)  # of the way from 4 m to 1 m
        return 50 + share, 1.1 + 0.2 * share, 1 + (0.3 + 0.4 * share) * r

    rows = []
    for split, distances in (("fit", (1.0, 4.0)), ("holdout", (1.3, 1.9, 2.7))):
        for f in distances:
            for i in range(60):
                r, d = (i % 3) / 2 if split == "fit" else float(rng.uniform()), f * 1.2
                focal, pupil, growth = truth(f, r)
                si, di = (focal * x * 1000 / (x * 1000 - focal) for x in (f, d))
                rows.append((0, split, f, d, r, focal, 50 / 2 * pupil * abs(si - di) / di * growth / 0.005, 5.0))
    m = spark.createDataFrame(rows, "lens int, split string, focus_m double, subject_m double, radius double, focal_mm double, blur_px double, pitch_um double")
    (rep,) = C.lens_psf(m, ["lens"], [0.0, 0.5, 1.0], 50.0, 2.0)[1].collect()
    assert rep.holdout == 180 and rep.focus_knots == 2 and rep.calibrated_p95 < 1e-6 and rep.ideal_p95 > 0.2 and rep.failures == []


def test_cameras_meet_only_blocks_they_may_see(spark):
    """Cameras around a cloud: same pairs as point by point, from far fewer candidates."""
    rng = np.random.default_rng(5)
    pts = rng.uniform(-5, 5, (3000, 3))
    cams = []
    for i in range(12):
        q = rng.normal(size=4)
        q /= np.linalg.norm(q)
        cams.append((0, i, *map(float, q), *map(float, rng.uniform(-4, 4, 3)), 60.0, 60.0, 16.0, 16.0))
    points = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(pts)], "scene long, point_id long, wx double, wy double, wz double")
    cameras = spark.createDataFrame(cams, "scene long, view int, " + ", ".join(f"{c} double" for c in V.CAM))
    want = set()
    for _, view, w, a, b, c, *rest in cams:
        t = np.array(rest[:3])
        r = np.array([[1 - 2 * (b * b + c * c), 2 * (a * b - w * c), 2 * (a * c + w * b)], [2 * (a * b + w * c), 1 - 2 * (a * a + c * c), 2 * (b * c - w * a)], [2 * (a * c - w * b), 2 * (b * c + w * a), 1 - 2 * (a * a + b * b)]])
        p = (pts - t) @ r  # camera from world by the transposed rotation
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = 60 * p[:, 0] / p[:, 2] + 16, 60 * p[:, 1] / p[:, 2] + 16
        want |= {(int(i), view) for i in np.flatnonzero((p[:, 2] > 0) & (u >= 0) & (u < 32) & (v >= 0) & (v < 32))}
    seen = V.in_view(points, cameras, frame=(0.0, 32.0, 0.0, 32.0))
    inside = seen.filter("u >= 0 and u < 32 and v >= 0 and v < 32").select("point_id", "src").collect()
    assert {(r.point_id, r.src) for r in inside} == want and len(want) > 500
    c = cameras.select("scene", F.col("view").alias("src"), *[F.col(n).alias("_" + n) for n in V.CAM])
    sides = tuple(map(F.lit, (0.0, 32.0, 0.0, 32.0)))
    met = V.with_visible(points, c, ("wx", "wy", "wz"), V.frustum(sides)).count()
    assert len(want) <= met < 0.35 * len(pts) * len(cams)
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in plan and "Cartesian" not in plan


def test_pairs_are_fitted_without_frames(spark):
    """Every pair is one Arrow table with the seed that its id columns always had."""
    for ids in ({"a": np.array([5])}, {"a": np.array([-7], "int32"), "b": np.array(["left"], object)}):
        assert M.pair_seed(list(ids.values())) == int(pd.util.hash_pandas_object(pd.DataFrame(ids), index=False).iloc[0] % 2**32)
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, 10, (2, 40))
    rows = pd.DataFrame({"left": "l", "right": np.repeat([1, 2], 20), "row_id": np.arange(40)[::-1], "x1": x, "y1": y, "x2": 2 * x + 1, "y2": 2 * y - 1})
    rows.loc[rows.row_id % 5 == 0, "x2"] += 50
    out = M.robust_pairs(spark.createDataFrame(rows), ["left", "right"], "row_id", M.Homography(), 0.01, min_inliers=8)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert {r.row_id for r in out.collect() if r.inlier} == {i for i in range(40) if i % 5}


def test_cells_of_single_points_are_not_sorted(spark):
    """The distance field explodes no rows: of a batch of points one row per cell is left, the same as over all points."""
    rng = np.random.default_rng(2)
    xyz = rng.uniform(-1, 1, (60, 3)).tolist()
    rows = [(k, 100 * k + i, *xyz[i % 50], 0.3, -0.2, None if i == 7 else 0.5) for k in (1, 2) for i in range(60)]  # ten copies of a place
    d = spark.createDataFrame(rows, "k long, point_id long, x double, y double, z double, nx double, ny double, nz double")
    out = S.signed_distance(d, ["k"], 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    got = {(r.k, r.vx, r.vy, r.vz): r.sdf for r in out.collect()}
    at = np.array(xyz[:50])
    low, high = at.min(0), at.max(0)
    pad = np.sqrt(((high - low) ** 2).sum()) * 0.05
    base, voxel = low - pad, (high - low + 2 * pad).max() / 8
    last = np.ceil((high - low + 2 * pad) / voxel).astype(int)
    want = {}
    for i, p in enumerate(at):
        c = np.floor((p - base) / voxel).astype(int)
        for v in np.ndindex(7, 7, 7):
            cell = c + v - 3
            if (cell >= 0).all() and (cell <= last).all():
                gap = base + cell * voxel - p
                far = float(np.sqrt((gap ** 2).sum()))
                ahead = i != 7 and gap @ (0.3, -0.2, 0.5) > 0
                want[tuple(cell)] = min(want.get(tuple(cell), (np.inf, 0, 0)), (far, i, far if ahead else -far))
    assert got.keys() == {(k, *map(int, c)) for k in (1, 2) for c in want}
    assert all(abs(got[k, *map(int, c)] - w[2]) < 1e-9 for k in (1, 2) for c, w in want.items())


def test_scenes_of_any_size_meet_their_cameras(spark, monkeypatch):
    """Small scenes without boxes, crowded ones with them, both in one table: the same pairs in view."""
    rng = np.random.default_rng(8)
    rows = [(s, i, *map(float, p)) for s, n in ((0, 400), (1, 30), (2, 5)) for i, p in enumerate(rng.uniform(-3, 3, (n, 3)))]
    points = spark.createDataFrame(rows, "scene long, point_id long, wx double, wy double, wz double")
    cams = [(s, v, 1.0, 0.0, 0.0, 0.0, 0.3 * v, 0.0, -1.0, 8.0, 8.0, 3.5, 3.5) for s in (0, 1) for v in range(4)]
    cameras = spark.createDataFrame(cams, "scene long, view int, " + ", ".join(f"{c} double" for c in V.CAM))
    found = []
    for pairs, boxed in ((1, True), (200, True), (1 << 15, False)):
        monkeypatch.setattr(V, "SCENE_PAIRS", pairs)
        seen = V.in_view(points, cameras, frame=(0.0, 8.0, 0.0, 8.0))
        assert ("_block" in seen._jdf.queryExecution().optimizedPlan().toString()) == boxed
        found.append(sorted((r.scene, r.point_id, r.src) for r in seen.filter("u >= 0 and u < 8 and v >= 0 and v < 8").collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100
    depth = spark.createDataFrame([(s, v, y, x, 2.0 + 0.01 * s) for s in (0, 1) for v in range(4) for y in range(8) for x in range(8)], "scene long, view int, y int, x int, depth double")
    fields = []
    for pairs in (1, 1 << 15):
        monkeypatch.setattr(V, "SCENE_PAIRS", pairs)
        fields.append(sorted((r.scene, r.vx, r.vy, r.vz, round(r.sdf, 9), r.weight) for r in V.integrate_tsdf(depth, cameras, 0.25, 0.3).collect()))
    assert fields[0] == fields[1] and fields[0]


def test_distances_are_held_a_little_at_a_time():
    """The nearest of 3,000 among 4,000 places: the same bits as from whole differences, in a tenth of their memory."""
    import tracemalloc

    rng = np.random.default_rng(3)
    q, t = rng.normal(size=(3000, 3)), rng.normal(size=(4000, 3))
    whole = np.sqrt(((q[:200, None, :] - t[None, :, :]) ** 2).sum(axis=2))
    tracemalloc.start()
    r, c, d, w = S._nearest(q, t, np.ones(len(t)), np.arange(len(t)), 8, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # 4 million pairs at once took 193 MB
    want = np.sort(whole, axis=1)[:, :8]
    assert len(r) == 8 * len(q) and (d[r < 200].reshape(200, 8) == want).all()


def test_anchors_meet_records_in_short_form(spark):
    """Hashes of any text, some alike but for case or length; no payload is moved for the join."""
    texts = ["ab12", "AB12", "0ab12", "ab1", "key", "", "ff" * 32, "ff" * 31 + "f"]
    records = spark.createDataFrame([(i % 2, i, h, texts[i - 1] if i else "genesis", f"t{i}") for i, h in enumerate(texts)], "log int, seq long, hash string, prev_hash string, stamp string")
    a = records.withColumnsRenamed({"seq": "anchor_no"}).withColumns({"event_id": F.lit("e"), "key_id": F.lit("key"), "status": F.lit("anchored"), "signature_ok": F.col("anchor_no") != 2})
    a = a.withColumns({"prev_hash": F.when(F.col("anchor_no") == 3, F.lit("0AB12")).otherwise(F.col("prev_hash")), "hash": F.when(F.col("anchor_no") == 5, F.lit("00")).otherwise(F.col("hash"))})
    a = a.withColumn("signature_payload", F.concat_ws("|", "hash", "prev_hash", "event_id", "stamp", "key_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = joins.verify_anchors(records, a.repartition(2, "log"), "log")
        got = {r.log: (r.records, r.anchored, r.invalid_signatures, r.missing, r.unanchored_tail, r.ok) for r in d.collect()}
        text = d._jdf.queryExecution().optimizedPlan().toString()
        assert text.index("Join LeftOuter, ((log") < text.index("concat_ws")  # payloads are settled below the join
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {0: (4, 3, 1, 0, -2, False), 1: (4, 2, 0, 2, -3, False)}
    rows = spark.createDataFrame([(t,) for t in texts], "h string").select("h", joins.packed("h").alias("p")).collect()
    assert len({bytes(r.p) for r in rows}) == len(texts) and all(len(r.p) == 33 for r in rows if r.h == "ff" * 32)
