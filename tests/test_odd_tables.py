"""Queries on tables with odd last groups and sums that lie between two places."""

import datetime
import random

from scanloom.plans import QUERIES
from tools.check import compare

VECTORS = "vec_id long, embedding array<float>, label int"


def same_as_sql(spark, duck, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    ok, text, n = compare(QUERIES[name].run(spark, str(folder)), con, QUERIES[name].sql)
    assert ok, text
    return n


def vectors(n):
    rng = random.Random(3)
    return [(i, [rng.uniform(-0.6, 0.6) for _ in range(64)], 0) for i in range(n)]


def test_short_last_images_are_decoded(spark, duck, tmp_path):
    for rows in (1, 3, 6):
        assert same_as_sql(spark, duck, tmp_path / str(rows), "image_rows_decoded", "embeddings", vectors(16 + rows), VECTORS) == 16 + rows


def test_meshes_without_faces_and_sums_between_two_places(spark, duck, tmp_path):
    halves = [(i, [0.000005 if i % 16 == 0 else (i // 16) * 0.01 + (i % 16) * 0.001] + [0.1] * 63, 0) for i in range(16 * 40)]
    assert same_as_sql(spark, duck, tmp_path, "mesh_scan", "embeddings", halves + [(640, [0.5] * 64, 0), (641, [0.25] * 64, 0)], VECTORS) == 41


def test_equal_magnitudes_are_no_peak_in_any_order(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    bins = {0: [1.0], 1: [0.3, 0.2, 0.1], 2: [0.1, 0.2, 0.3], 3: [0.1], 4: [0.1]}
    rows = [(i, day, 1, "view", v, f'{{"k": {4 * b}}}') for i, (b, v) in enumerate((b, v) for b, vs in {**bins, 0: [0.1]}.items() for v in vs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["spectral_peak_top"].run(spark, str(tmp_path)).collect() == []


def test_peaks_without_a_user_or_a_neighbour_are_none(spark, duck, tmp_path):
    day, schema = datetime.datetime(2024, 1, 1), "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    bins = [(user, b, None if user == 3 and b == 1 else 5.0 if b == 2 else 1.0) for user in (None, 1, 3) for b in range(5)]
    rows = [(i, day, user, "view", v, f'{{"k": {4 * b}}}') for i, (user, b, v) in enumerate(bins)]
    assert same_as_sql(spark, duck, tmp_path, "spectral_peak_top", "events", rows, schema) == 1


def test_votes_are_written_without_sums_that_follow_from_the_offset(spark):
    import glob

    from scanloom.operators.joins import align_hashes
    from scanloom.session import shared_dir

    track = spark.createDataFrame([(1, f"h{i}", i) for i in range(0, 40, 2)], "id long, hash string, time int")
    ref = spark.createDataFrame([(f"h{i}", i + 7 + i // 20) for i in range(40)], "hash string, time long")
    before = set(glob.glob(f"{shared_dir(spark)}/votes-*"))
    got = align_hashes(track, ref, ["id"], 20).collect()
    assert [(r.best_ms, r.votes, r.pairs) for r in got] == [(140, 10, 20)] and 1.02 < got[0].stretch < 1.06
    (path,) = set(glob.glob(f"{shared_dir(spark)}/votes-*")) - before
    assert spark.read.parquet(path).columns == ["id", "offset_ms", "votes", "sx", "sxx"]


def test_means_on_their_threshold_are_no_defect_in_any_order(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    orders = [[0.05, 0.08, 0.06, 0.01, 0.07, 0.03, 0.02, 0.0], [0.03, 0.08, 0.07, 0.02, 0.0, 0.01, 0.06, 0.05]]  # 0.04 on average, and a little more by a running sum in the first order
    rows = [(i, 1, s, 1, 30.0, 1.0, 0.01, x, "A", "O", day) for s, o in enumerate(orders) for i, x in enumerate(o)]
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["capture_quality_score"].run(spark, str(tmp_path)).collect()
    assert len(got) == 2 and {(r.score, r.bad, r.actions) for r in got} == {(1.0, 0, "")}


def test_meshes_are_settled_in_one_task_or_in_rounds(spark, duck, tmp_path, monkeypatch):
    from scanloom.operators import mesh

    asked, rounds = [], mesh.connected_components
    monkeypatch.setattr(mesh, "connected_components", lambda nodes, links: asked.append(1) or rounds(nodes, links))
    rows = [(i, [v - 0.05 for v in e], 0) for i, e, _ in vectors(16 * 3)]
    rows += [(i, [0.3 if 10 < j < 40 else -0.5 for j in range(64)], 0) for i in range(48, 64)]  # one large piece beside small ones
    for name in ("small_components_removed", "hole_filling"):
        assert same_as_sql(spark, duck, tmp_path / name, name, "embeddings", rows, VECTORS) > 0
    assert not asked  # small meshes need no rounds
    monkeypatch.setattr(mesh, "MESH_FACES", 800)  # the even mesh has 870 faces, the others fewer
    for name in ("small_components_removed", "hole_filling"):
        assert same_as_sql(spark, duck, tmp_path / f"{name}-2", name, "embeddings", rows, VECTORS) > 0
    assert len(asked) == 2


def test_votes_far_from_the_winner_are_not_written(spark):
    import glob

    from scanloom.operators.joins import align_hashes
    from scanloom.session import shared_dir

    track = spark.createDataFrame([(t, f"h{i}", i) for t in (1, 2) for i in range(30)], "id long, hash string, time int")
    ref = spark.createDataFrame([(f"h{i}", i + d) for i in range(30) for d in (5, 100 + 7 * i, 900 - 11 * i)], "hash string, time long")
    before = set(glob.glob(f"{shared_dir(spark)}/votes-*"))
    got = align_hashes(track, ref, ["id"], 20).collect()
    assert sorted((r.id, r.best_ms, r.votes, r.pairs, r.stretch) for r in got) == [(1, 100, 30, 30, 1.0), (2, 100, 30, 30, 1.0)]
    (path,) = set(glob.glob(f"{shared_dir(spark)}/votes-*")) - before
    assert spark.read.parquet(path).count() == 2  # of 61 offsets a track
