"""Streaming twins over several micro-batches agree with the batch replay."""

import pytest
from pyspark.sql import functions as F

from scanloom.plans import Tables
from scanloom.plans.inputs import user_events
from scanloom.session import scratch_path
from scanloom.streaming import folds as K
from scanloom.streaming import jobs as J
from scanloom.streaming.expiring import follow_expiring
from tests.conftest import DATA

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def parts(spark):
    """The events in six files by time (five days and more each)."""
    t = Tables(spark, DATA)
    target = scratch_path(spark, "parts")
    for i in range(6):  # one after the other: the file source reads files in the order they appeared
        day = F.dayofmonth("ts")
        t.events.filter(day.between(i * 6, i * 6 + 5)).coalesce(1).write.mode("append").parquet(target)
    return t, target


@pytest.mark.parametrize("fold", [K.token_bucket(3.0, 2 / 86400), K.failure_throttle(432000, 2, 7200, 86400), K.scene_stability(500.0, 0.05, 3)])
def test_follow_equals_replay(spark, parts, fold):
    t, folder = parts
    files = sorted(f for f in spark.read.parquet(folder).inputFiles())
    assert len(files) > 3
    cols = ["user_id", "us", "event_id", "value"]
    s = J.events_stream(spark, folder, files_per_batch=1).select(*cols)
    got = J.drain(K.follow(s, ["user_id"], ["us", "event_id"], fold), "twin")
    want = K.replay(user_events(t).select(*cols), ["user_id"], ["us", "event_id"], fold)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


def test_restart_segments_do_not_change_the_result(spark, parts):
    t, _ = parts
    d = user_events(t).select("user_id", "us", "event_id")
    fold = K.token_bucket(3.0, 2 / 86400)
    plain = K.Fold(fold.start, fold.step, fold.out)
    a, b = (sorted(map(tuple, K.replay(d, ["user_id"], ["us", "event_id"], f).collect())) for f in (fold, plain))
    assert a == b


def test_sessions_stream(spark, parts):
    t, folder = parts
    batch = J.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "6 hours").collect()
    s = J.events_stream(spark, folder, files_per_batch=1)
    live = J.drain(J.sessions(s, ["user_id"], "6 hours", "1 hour"), "sessions").collect()
    # sessions still open at the end of the input are not emitted in append mode
    assert {tuple(r) for r in live} <= {tuple(r) for r in batch} and len(live) > 0.9 * len(batch)


def test_echoes_are_dropped_once(spark, parts):
    _, folder = parts
    s = J.events_stream(spark, folder, files_per_batch=2).select("ts", "event_type")
    out = J.drain(J.without_echoes(s, ["event_type"], "2 seconds"), "echo")
    assert 5 <= out.count() < spark.read.parquet(folder).count() + 1


def test_tracker_keeps_identity_and_drops_lost_tracks():
    from types import SimpleNamespace as N

    fold = K.object_tracker(max_distance=1.0, max_lost=30)
    state = fold.start()

    def det(i, x):
        return {"det_id": i, "x": x, "y": 0.0, "z": 0.0, "x0": x - 1, "y0": -1.0, "z0": -1.0, "x1": x + 1, "y1": 1.0, "z1": 1.0}

    ids = [fold.step(state, N(frame=f, detections=[det(f, 0.3 * f)])) for f in range(6)]
    assert [len(r) for r in ids] == [0, 0, 1, 1, 1, 1] and {r[0][1] for r in ids if r} == {0}
    again = fold.step(state, N(frame=5 + 32, detections=[det(99, 50.0)]))
    assert not again and [t["id"] for t in state["tracks"]] == [1]


def test_a_bound_never_lowers_the_mean():
    from types import SimpleNamespace as N

    fold = K.posterior()
    s = fold.start()
    fold.step(s, N(event_id=1, mean=0.5, variance=0.04, lower_bound=None))
    before = s["mean"]
    fold.step(s, N(event_id=2, mean=None, variance=None, lower_bound=0.7))
    assert s["mean"] > before and s["var"] < 0.04
    assert fold.step(s, N(event_id=3, mean=None, variance=None, lower_bound=99.0))[0][3] == "conflict"


def test_late_rows_go_and_silent_keys_are_forgotten(spark):
    """Files out of order within the delay fold as in event time; a late file is dropped; timers empty the state."""
    rows = [(k, (1000 + i) * HOUR + k, 100 * k + i) for k in range(5) for i in range(12)]
    folder, target = scratch_path(spark, "expiry"), scratch_path(spark, "expired")
    schema = "user_id long, us long, event_id long"

    def send(part):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(folder)

    send([r for r in rows if r[1] % (2 * HOUR) >= HOUR and r[1] < 1006 * HOUR])  # odd hours first
    send([r for r in rows if r[1] % (2 * HOUR) < HOUR and r[1] < 1006 * HOUR])
    send([r for r in rows if r[1] >= 1006 * HOUR])
    send([(9, 1400 * HOUR, 1)])  # long after: all others have fallen silent
    send([(0, 1001 * HOUR + 1, 7777), (9, 1399 * HOUR, 2)])  # the first is late
    fold = K.failure_throttle(3 * 3600, 2, 60, 600)
    stream = J.events_stream(spark, folder, 1).select("ts", "user_id", "us", "event_id")
    got = J.drain(follow_expiring(stream, ["user_id"], ["us", "event_id"], fold, "ts", "8 hours"), "x", target=target)
    want = K.replay(spark.createDataFrame(rows, schema), ["user_id"], ["us", "event_id"], fold)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))

    def kept(name):
        return spark.read.format("statestore").option("stateVarName", name).load(f"{target}/progress")

    assert kept("saved").count() == 0
    waiting = kept("waiting").select("key.user_id", "list_element.event_id")
    assert sorted(map(tuple, waiting.collect())) == [(9, 1), (9, 2)]


def test_a_key_is_folded_once_in_a_batch():
    """All timers of a key that are due together read and fold it once, and one timer is left."""
    from pyspark.sql import Row
    from pyspark.sql import types as T

    from scanloom.streaming.expiring import ExpiringFold

    class Kept:  # a state of one key, and how often it was read
        def __init__(self):
            self.rows, self.reads = [], 0

        def get(self):
            self.reads += 1
            return list(self.rows) if isinstance(self.rows, list) else self.rows

        def put(self, rows):
            self.rows = rows

        def appendList(self, rows):
            self.rows = self.rows + rows

        update = put

        def clear(self):
            self.rows = []

    class Handle:
        def __init__(self):
            self.waiting, self.saved, self.timers = Kept(), Kept(), []
            self.saved.rows = None

        def getValueState(self, name, schema):
            return self.saved

        def getListState(self, name, schema):
            return self.waiting

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    rows = T.StructType.fromDDL("us long, event_id long")
    fold = ExpiringFold(K.failure_throttle(60, 2, 60, 600), ["us", "event_id"], rows, T.StructType.fromDDL("user_id long, event_id long, attempts int, locked_until long"))
    handle, sent = Handle(), Row("user_id", "us", "event_id")
    fold.init(handle)
    assert not list(fold.handleInputRows((1,), iter([sent(1, s * 1_000_000, s) for s in (5, 3)]), Now(0)))
    assert not list(fold.handleInputRows((1,), iter([sent(1, 20_000_000, 20)]), Now(0)))
    assert handle.timers == [3000, 20000]
    fold.init(handle)  # the next batch
    before = handle.waiting.reads
    out = [r for ms in handle.timers[:2] for r in fold.handleExpiredTimer((1,), Now(21_000), ms)]
    assert [r.event_id for r in out] == [3, 5, 20] and [r.attempts for r in out] == [1, 2, 3]
    assert handle.waiting.reads == before + 1 and not handle.waiting.rows
    assert handle.timers[2:] == [20_000 + 61_000]


@pytest.mark.parametrize("fold", [K.motion_analyser(0.3, stale_us=96 * HOUR), K.delta_encoder(40.0, 30, 31 * HOUR), K.token_bucket(3.0, 2 / 86400)])
def test_expiring_twin_equals_replay(spark, parts, fold):
    t, folder = parts
    cols = [F.col("value").alias("x"), F.col("value").alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("volume"), F.floor(F.col("us") / HOUR).alias("sequence")]
    s = J.events_stream(spark, folder, files_per_batch=1).select("ts", "user_id", "us", "event_id", *cols)
    got = J.drain(follow_expiring(s, ["user_id"], ["us", "event_id"], fold, "ts", "1 hour"), "twin").collect()
    want = K.replay(user_events(t).select("user_id", "us", "event_id", *cols), ["user_id"], ["us", "event_id"], fold)
    final = t.events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] // 1000 * 1000 - HOUR
    early = {r.event_id for r in user_events(t).filter(F.col("us") <= final).collect()}
    assert sorted(map(repr, got)) == sorted(repr(r) for r in want.select("user_id", *[f.strip().split()[0] for f in fold.out.split(",")]).collect() if r.event_id in early)
