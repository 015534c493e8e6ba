"""Exact search against a plain sort."""

import math
import random

import pytest

from scanloom.llm import exact_topk

SCHEMA = "vec_id long, embedding array<float>, id int, q string"


def brute(rows, every=5, k=5):
    usable = [(r[0], [math.floor(256 * x) for x in r[1]]) for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    asked = {}
    for i, v in usable:
        if i % every == 0 and (i not in asked or (len(v), v) < (len(asked[i]), asked[i])):
            asked[i] = v
    out = []
    for i, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i and len(w) == len(v))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, every=5, block=16):
    vectors = exact_topk.quantised(spark.createDataFrame(rows, SCHEMA).repartition(3), "vec_id", "embedding")
    found = exact_topk.top_k(vectors, vectors.filter(f"id % {every} = 0"), block=block)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-8, 8)) / 16 + rng.random() / 300 for _ in range(6)], 1, "x") for i in range(90)]
    rows += [(100 + i, [0.25] * 6, 1, "x") for i in range(40)]  # many ties
    rows += [(200, None, 1, "x"), (205, [None] * 6, 1, "x"), (210, [float("nan")] * 6, 1, "x"), (215, [float("inf")] * 6, 1, "x"), (None, [0.5] * 6, 1, "x"), (220, [0.5, 0.5], 1, "x"), (225, [0.25, 0.5], 1, "x")]
    rows += [rows[3], rows[5], rows[95]]
    assert run(spark, rows) == brute(rows)


def test_fewer_candidates_than_k_and_large_values(spark):
    rows = [(0, [30000.0, -1.0], 1, "x"), (1, [-30000.0, 2.0], 1, "x"), (2, [1e-9, -1e-9], 1, "x")]
    assert run(spark, rows) == brute(rows)


def test_empty_and_alone(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1, "x")]) == []
    assert run(spark, [(1, [1.0], 1, "x")]) == []


def test_products_beyond_a_long(spark):
    with pytest.raises(ValueError):
        run(spark, [(0, [1e30], 1, "x"), (1, [1.0], 1, "x")])


def test_blocks_are_packed_small_and_dealt_to_tasks_by_pairs(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], 1, "x") for i in range(400)]
    vectors = exact_topk.quantised(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    found = exact_topk.top_k(vectors, vectors.filter("id % 2 = 0"), block=8)
    plan = found._jdf.queryExecution().toString()
    # 7 query blocks of 32 and 50 candidate blocks: no task gets more as the tables grow
    assert f", {-(-7 * 50 // exact_topk.PAIRS)})" in plan and "REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, found.collect())) == brute(rows, every=2)
    ids, flat = exact_topk._packed(vectors.limit(3).toArrow(), exact_topk.np.int16)
    assert len(ids) == 24 and len(flat) == 3 * 6 * 2


def test_wide_numbers_stay_exact(spark):
    rng = random.Random(5)
    for size in (4, 64, 1 << 20):  # inner products in floats, doubles and longs
        rows = [(i, [rng.randint(-999, 999) * size / 1024 for _ in range(3)], 1, "x") for i in range(40)]
        assert run(spark, rows) == brute(rows)
