"""Composed transitions against the plain folds, with one key that holds all rows."""

import random
from types import SimpleNamespace

import numpy as np
import pytest

from scanloom.operators import transitions as X
from scanloom.streaming import folds as K


def plain(rows, fold):
    out, states = [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        key, us, event_id, *rest = r
        row = SimpleNamespace(us=us, event_id=event_id, **dict(zip(NAMES, rest)))
        out += fold.step(states.setdefault(key, fold.start()), row)
    return out


NAMES = ("action", "owner", "status", "progress")
SCHEMA = "key long, us long, event_id long, action string, owner long, status string, progress double"


def events(seed, n, keys):
    rng = random.Random(seed)
    rows, us = [], 0
    for i in range(n):
        us += rng.choice([0, 1, 5, 40])
        rows.append((rng.randrange(keys), us, i, rng.choice(["claim", "claim", "commit" if i % 50 == 0 else "fail", "interrupt"]), rng.randrange(5), rng.choice(["pending", "running", "running", "progress", "completed", "failed"]), float(i % 7)))
    return rows


def test_functions_compose():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 13):
        steps = rng.integers(0, 6, (n, 6))
        state = np.arange(6)
        for s in steps:
            state = s[state]
        assert X.compose(steps).tolist() == state.tolist()


@pytest.mark.parametrize("keys, size, limit", [(1, 7, 2), (3, 50, 0), (1, 1 << 16, 3)])
def test_work_journal(spark, keys, size, limit):
    rows = events(keys, 600, keys)
    got = X.work_journal(spark.createDataFrame(rows, SCHEMA).drop("status"), ["key"], ["us", "event_id"], limit, size).collect()
    want = plain(rows, K.work_journal(limit))
    assert sorted(((r.event_id, r.decision, r.status, r.attempts) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("keys, size, ttl", [(1, 7, 30), (3, 50, 5), (1, 64, 1000), (1, 1 << 16, 30)])
def test_lease_log(spark, keys, size, ttl):
    action = {"claim": "acquire", "commit": "release", "fail": "renew", "interrupt": "release"}
    rows = [(*r[:3], action[r[3]], *r[4:]) for r in events(10 + ttl, 600, keys)]
    got = X.lease_log(spark.createDataFrame(rows, SCHEMA), ["key"], ["us", "event_id"], ttl, size).collect()
    assert sorted(map(str, ((r.event_id, r.ok, r.holder, r.until) for r in got))) == sorted(map(str, plain(rows, K.lease_log(ttl))))


@pytest.mark.parametrize("keys", [1, 40])
def test_job_states(spark, keys):
    rows = [r for r in events(5, 500, keys) if keys == 1 or r[0] % 3 or r[5] == "progress"]
    got = X.job_states(spark.createDataFrame(rows, SCHEMA), ["key"], ["us", "event_id"]).collect()
    want = {}
    fold, states = K.job_machine(), {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        (out,) = fold.step(states.setdefault(r[0], fold.start()), SimpleNamespace(us=r[1], **dict(zip(NAMES, r[3:]))))
        want[r[0]] = out[1:]
    assert {r.key: tuple(r)[1:] for r in got} == want


def test_a_hot_key_is_many_stretches(spark):
    rows = spark.createDataFrame(events(1, 900, 1), SCHEMA)
    assert X.stretches(rows, ["key"], ["us", "event_id"], 100).groupBy("_part").count().filter("count <= 100").count() == 9
    assert X.work_journal(rows.limit(0).drop("status"), ["key"], ["us", "event_id"], 2).collect() == []


def test_small_keys_need_no_stretches(spark, monkeypatch):
    """Rows of keys that fit into a task are replayed in one pass, larger ones in stretches, with one result."""
    from scanloom.operators import ordering
    from scanloom.operators import transitions as X
    from scanloom.operators import windows as W

    rows = [(i % 7, i * 3_600_000_000, i, ("claim", "fail", "commit", "interrupt", "claim")[i * i % 5], (i * 37 % 11) / 11) for i in range(400)]
    d = spark.createDataFrame(rows, "k long, us long, id long, action string, x double")
    journal = X.work_journal(d, ["k"], ["us", "id"], 2)
    smooth = W.stable_for(W.exponential_smoothing(d, ["k"], "us", "id", "x", 0.3), ["k"], "us", "id", "x", 3, 0.6)
    once = (sorted(map(str, journal.select("id", "decision", "status", "attempts").collect())), smooth.orderBy("id").select("smoothed", "stable").collect())
    assert "FlatMapGroupsInArrow" not in journal._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in smooth._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ordering, "SMALL_BYTES", 0)
    monkeypatch.setattr(ordering, "CHUNK_ROWS", 20)
    journal = X.work_journal(d, ["k"], ["us", "id"], 2, size=16)
    smooth = W.stable_for(W.exponential_smoothing(d, ["k"], "us", "id", "x", 0.3), ["k"], "us", "id", "x", 3, 0.6).orderBy("id").select("smoothed", "stable").collect()
    assert sorted(map(str, journal.select("id", "decision", "status", "attempts").collect())) == once[0]
    assert [r.stable for r in smooth] == [r.stable for r in once[1]] and all(abs(a.smoothed - b.smoothed) < 1e-12 for a, b in zip(smooth, once[1]))
