"""Physical plans: pushdown, pruning, no cartesian products."""

import pytest

from scanloom.plans import QUERIES
from tests.conftest import DATA


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["nearest_timestamp", "window_mean_fallback", "radius_outliers", "coverage_gaps", "keypoint_suppression", "distribution_match", "time_gap_groups", "public_gallery", "observation_join"])
def test_no_cartesian_product(spark, name):
    text = plan(QUERIES[name].run(spark, DATA))
    assert "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["nearest_within_tolerance"].run(spark, DATA))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in text
    pruned = plan(QUERIES["channel_covariance"].run(spark, DATA))
    assert "l_extendedprice" not in pruned


def test_listing_does_not_read_contents(spark):
    assert "content" not in plan(QUERIES["file_inventory"].run(spark, DATA)).split("ReadSchema")[-1]


def test_per_key_limits_are_pushed_below_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["top_features_per_image"].run(spark, DATA))


def test_scene_joins_are_dealt_over_parts(spark):
    from scanloom.operators import views

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        points = spark.createDataFrame([(0, float(i), 0.0, 1.0) for i in range(200)], "scene int, wx double, wy double, wz double")
        cams = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "scene int, view int")
        d = views.with_scene(points, cams, ["wx", "wy", "wz"])
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(scene" in plan and all("_part" in line for line in plan.splitlines() if "hashpartitioning(scene" in line)
        assert sorted((r.wx, r.view) for r in d.collect()) == sorted((float(i), v) for i in range(200) for v in (1, 2))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["visual_hull", "sparse_colouring", "tsdf_integration"])
def test_exploded_sides_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan(QUERIES[name].run(spark, DATA))


def test_large_groups_are_not_shuffled_whole(spark, monkeypatch):
    from scanloom.operators import ordering, windows

    monkeypatch.setattr(ordering, "CHUNK_ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("a", float(i), i % 3 > 0) for i in range(900)] + [("b", float(i), True) for i in range(20)] + [("c", 1.0, False)]
        d = spark.createDataFrame(rows, "k string, v double, fg boolean")
        graded = windows.percentile_grades(d, ["k"], "v", "fg")
        assert "BroadcastHashJoin" in plan(graded)
        got = sorted(map(tuple, graded.groupBy("k", "grade").count().collect()))
        assert got == [("a", "A", 241), ("a", "B", 150), ("a", "C", 209), ("a", "D", 300), ("b", "A", 9), ("b", "B", 5), ("b", "C", 6), ("c", "D", 1)]
        stats = ordering.order_stats(d.filter("k = 'a'"), ["k"], "v", {"m": ("nearest", 0.5)})
        assert "BroadcastHashJoin" in plan(stats) and stats.first().m == 450.0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_defect_scores_take_whole_rows(spark):
    from pyspark.sql import functions as F

    from scanloom.operators import imaging

    px = [(f, y, [{c: (37 * x + 11 * y + 5 * f + i * x * y) % 251 + (0.5 if c == "l" else 0) for i, c in enumerate("rgb")}
                  | {"l": float((13 * x * y + 7 * x + f) % 200), "m": int((x - 6) ** 2 + (y - 5) ** 2 < 20)} for x in range(12)]) for f in range(2) for y in range(10)]
    rows = spark.createDataFrame(px, "f int, y int, px array<struct<r:int, g:int, b:int, l:double, m:int>>")
    whole, cut = imaging.defects(rows, ["f"]), imaging.defects(rows, ["f"], block=3)
    assert "explode(px" not in plan(whole)  # pixels are no rows of a table
    names = [c for c in whole.columns if c != "f"]
    got, other = ([[r[c] for c in names] for r in d.orderBy("f").collect()] for d in (whole, cut))
    assert len(got) == 2 and all(abs(a - b) < 1e-9 for x, z in zip(got, other) for a, b in zip(x, z))
    st = imaging.stencil(rows.select("f", "y", F.transform("px", lambda p: p.l).alias("px")), ["f"])
    lap = st.select("f", F.when(imaging.interior(), imaging.laplacian()).otherwise(0.0).alias("v")).groupBy("f").agg((F.avg(F.col("v") * F.col("v")) - F.avg("v") * F.avg("v")).alias("b"))
    assert all(abs(r.b - x[names.index("blur")]) < 1e-6 for r, x in zip(lap.orderBy("f").collect(), got))


def test_defect_scores_see_the_whole_rim(spark):
    from scanloom.operators import imaging

    # a mask whose corners lie where x + y is odd: hull of the rim from (2, 1) to (9, 8), 8 by 8 pixels
    px = [(0, y, [{"r": 9, "g": 9, "b": 9, "l": 9.0, "m": int(2 <= x <= 9 and 1 <= y <= 8)} for x in range(12)]) for y in range(10)]
    rows = spark.createDataFrame(px, "f int, y int, px array<struct<r:int, g:int, b:int, l:double, m:int>>")
    assert abs(imaging.defects(rows, ["f"]).first().erosion - 64 / 49) < 1e-9
    assert "(x+y)%2" not in QUERIES["frame_quality_score"].sql
