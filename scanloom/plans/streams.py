"""Stateful operators: batch replays with SQL twins, and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions.numeric import rnd

from scanloom.operators import transitions as X
from scanloom.operators import windows as W
from scanloom.operators.ordering import previous_row, running
from scanloom.plans.inputs import EVT, user_events
from scanloom.plans.joins import NEAR
from scanloom.plans.ordered import GAP
from scanloom.plans.registry import query, with_ctes
from scanloom.streaming import folds as K
from scanloom.streaming import jobs as J
from scanloom.streaming.expiring import follow_expiring

U, OE = ["user_id"], ["us", "event_id"]
HOUR = 3_600_000_000


def fold_sql(first: str, nxt: str, out: str, where: str = "", source: str = "evt", extra: str = "", key: str = "user_id") -> str:
    """Replay in SQL: row by row per key; r is the state row, o the next input row."""
    return (f"WITH RECURSIVE {EVT}{extra}, o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY us, event_id) AS i FROM {source} {where}), "
            f"r AS (SELECT o.*, {first} FROM o WHERE i = 1 UNION ALL SELECT o.*, {nxt} FROM r JOIN o ON o.{key} = r.{key} AND o.i = r.i + 1) {out}")


def stream_of(t):
    return J.events_stream(t.spark, t.path("events"))


#: The streams with a watermark: how far it lags, and the rows that come in a last file, long behind it.
LAG_US = 48 * HOUR
LATE = "{id} % 97 = 3 AND us < {until}"
LATE_EVENT = LATE.format(id="event_id", until=1704844800000000)


def on_time(source: str, late: str = LATE_EVENT, also: str = "true", lag: str = f"{LAG_US}") -> str:
    """SQL for the rows that a stream folds in the end: not late, and final at the last watermark."""
    return f"WHERE {also} AND NOT ({late}) AND us <= (SELECT max(us) FROM {source} WHERE {also}) // 1000 * 1000 - {lag}"


def arriving(t, files: int = 8):
    """The events as a stream of several files per batch, the last of which is late."""
    rows = t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return J.events_stream(t.spark, J.in_files(rows, "us", F.expr(LATE_EVENT), "arriving", files=files), files)


def with_k(df):
    return df.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def folded(stream, fold, name, time="ts"):
    return J.drain(follow_expiring(stream, U, OE, fold, time, "48 hours"), name)


# 9.1
@query("9.1", "SELECT event_type, count(*) AS n, round(sum(value),2) AS total FROM events WHERE event_type IN ('error','purchase') GROUP BY 1")
def stream_fan_out(t):
    s = stream_of(t).withColumn("payload", F.to_json(F.struct("event_type", "user_id", "value")))
    tag = F.col("event.event_type")
    out = J.fan_out(s, F.col("payload"), "event_type string, user_id long, value double", {x: tag == x for x in ("error", "purchase")}, "fan-out")
    both = out["error"].unionByName(out["purchase"])
    return both.groupBy(tag.alias("event_type")).agg(F.count("*").alias("n"), rnd(F.sum("event.value"), 2).alias("total"))


ECHO_TTL = 36 * HOUR


def _echo_sql(where=""):
    return fold_sql("CASE WHEN rec THEN 1 ELSE 0 END AS n, CASE WHEN rec THEN us ELSE 0 END AS seen, false AS sup",
                    f"CASE WHEN o.rec THEN (CASE WHEN r.n>0 AND o.us-r.seen<={ECHO_TTL} THEN r.n ELSE 0 END)+1 WHEN r.n>0 AND o.us-r.seen<={ECHO_TTL} THEN r.n-1 ELSE 0 END, CASE WHEN o.rec THEN o.us ELSE r.seen END, NOT o.rec AND r.n>0 AND o.us-r.seen<={ECHO_TTL}",
                    "SELECT event_id, sup AS suppressed FROM r WHERE NOT rec", where, "ev2", ", ev2 AS (SELECT *, event_type IN ('click','view') AS rec FROM evt)")


def echo_rows(df):
    return df.withColumn("recorded", F.col("event_type").isin("click", "view"))


@query("9.2", _echo_sql())
def echo_suppression(t):
    return K.replay(echo_rows(user_events(t)), U, OE, K.echo_filter(ECHO_TTL)).select("event_id", "suppressed")


@query("9.2", _echo_sql(on_time("ev2")), name="stream_echo_suppression")
def stream_echo_suppression(t):
    s = echo_rows(arriving(t).select("ts", "user_id", "us", "event_id", "event_type")).drop("event_type")
    return folded(s, K.echo_filter(ECHO_TTL), "echo").select("event_id", "suppressed")


SESS = with_ctes("SELECT user_id, count(*) AS frames, min(us) AS started, max(us) AS ended FROM bursts GROUP BY user_id, group_no", EVT, GAP)


@query("9.3", SESS)
def burst_sessions(t):
    d = J.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), U, "6 hours")
    return d.select("user_id", "frames", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"))


# 6 hours of silence end a session; it is final once the watermark has passed that end.
@query("9.3", with_ctes(f"""WITH a AS (SELECT user_id, us FROM evt WHERE NOT ({LATE_EVENT})),
  b AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > {6 * HOUR}, true)::INT AS n FROM a),
  c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM b)
  SELECT user_id, count(*) AS frames, min(us) AS started, max(us) AS ended FROM c GROUP BY user_id, g
  HAVING max(us) + {6 * HOUR} <= (SELECT max(us) FROM evt) // 1000 * 1000 - {LAG_US}""", EVT), name="stream_burst_sessions")
def stream_burst_sessions(t):
    d = J.drain(J.sessions(arriving(t).select("ts", "user_id"), U, "6 hours", "48 hours"), "sessions")
    return d.select("user_id", "frames", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"))


RATE = 2 / 86400.0
BUCKET = fold_sql("2.0::DOUBLE AS tok, true AS al, NULL::BIGINT AS ra",
                  "least(3.0::DOUBLE, r.tok+(o.us-r.us)/1e6*(2/86400.0::DOUBLE)) - CASE WHEN least(3.0::DOUBLE, r.tok+(o.us-r.us)/1e6*(2/86400.0::DOUBLE)) >= 1 THEN 1 ELSE 0 END, least(3.0::DOUBLE, r.tok+(o.us-r.us)/1e6*(2/86400.0::DOUBLE)) >= 1,"
                  " CASE WHEN least(3.0::DOUBLE, r.tok+(o.us-r.us)/1e6*(2/86400.0::DOUBLE)) < 1 THEN greatest(ceil((1-least(3.0::DOUBLE, r.tok+(o.us-r.us)/1e6*(2/86400.0::DOUBLE)))/(2/86400.0::DOUBLE)),1)::BIGINT END",
                  "SELECT event_id, al AS allowed, ra AS retry_after FROM r")


@query("9.4", BUCKET)
def token_bucket(t):
    return K.replay(user_events(t).select("user_id", *OE), U, OE, K.token_bucket(3.0, RATE)).select("event_id", "allowed", "retry_after")


@query("9.4", BUCKET, name="stream_token_bucket")
def stream_token_bucket(t):
    return J.drain(K.follow(stream_of(t).select("user_id", *OE), U, OE, K.token_bucket(3.0, RATE)), "bucket").select("event_id", "allowed", "retry_after")


def _failure_sql(where):
    return fold_sql("us//1000000 AS st, 1 AS att, 0::BIGINT AS lk",
                    "CASE WHEN o.us//1000000-r.st >= 432000 THEN o.us//1000000 ELSE r.st END, CASE WHEN o.us//1000000-r.st >= 432000 THEN 1 ELSE r.att+1 END, CASE WHEN o.us//1000000-r.st >= 432000 THEN 0 WHEN r.att+1 >= 2 THEN greatest(r.lk, o.us//1000000+least(86400, 7200*(1 << least(10, r.att+1-2)))) ELSE r.lk END",
                    "SELECT event_id, att AS attempts, lk AS locked_until FROM r", where)


THROTTLE = K.failure_throttle(432000, 2, 7200, 86400)


@query("9.5", _failure_sql("WHERE event_type='error'"))
def failure_throttle(t):
    e = user_events(t).filter("event_type = 'error'").select("user_id", *OE)
    return K.replay(e, U, OE, THROTTLE).select("event_id", "attempts", "locked_until")


@query("9.5", _failure_sql(on_time("evt", also="event_type='error'")), name="stream_failure_throttle")
def stream_failure_throttle(t):
    e = arriving(t).filter("event_type = 'error'").select("ts", "user_id", *OE)
    return folded(e, THROTTLE, "throttle").select("event_id", "attempts", "locked_until")


STAB = with_ctes("""WITH d AS (SELECT user_id, us, event_id, coalesce(abs(value - lag(value) OVER w)/500 < 0.05, false)::INT AS sm FROM evt WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
  g AS (SELECT *, sum(1-sm) OVER (PARTITION BY user_id ORDER BY us, event_id) AS isl FROM d)
  SELECT event_id, (sum(sm) OVER (PARTITION BY user_id, isl ORDER BY us, event_id))::BIGINT AS run, sum(sm) OVER (PARTITION BY user_id, isl ORDER BY us, event_id) > 3 AS stable FROM g""", EVT)


@query("9.6", STAB)
def scene_stability(t):
    """The run of small changes by built-in scans."""
    d = W.change_runs(user_events(t).select("user_id", *OE, "value"), U, "us", "event_id", "value", 500.0, 0.05)
    return d.select("event_id", "run", (F.col("run") > 3).alias("stable"))


@query("9.6", STAB, name="stream_scene_stability")
def stream_scene_stability(t):
    s = stream_of(t).select("user_id", *OE, "value")
    return J.drain(K.follow(s, U, OE, K.scene_stability(500.0, 0.05, 3)), "stability").select("event_id", "run", "stable")


def moving(df, *also):
    return df.select("user_id", *OE, *also, (F.col("value") / 97).alias("x"), (F.col("k") / 100.0).alias("y"), F.lit(0.0).alias("z"), (F.col("k") + 1.0).alias("volume"))


def _motion_sql(where=""):
    fresh = "(o.us-r.us >= 345600000000)"
    d = {c: f"(CASE WHEN {fresh} THEN 0 ELSE o.{c}-r.{c} END)" for c in "xy"}
    pv = {c: f"(CASE WHEN {fresh} THEN 0 ELSE r.v{c} END)" for c in "xy"}
    pa = {c: f"(CASE WHEN {fresh} THEN 0 ELSE r.a{c} END)" for c in "xy"}
    v = {c: f"({pv[c]}*0.7::DOUBLE+{d[c]}*0.3::DOUBLE)" for c in "xy"}
    a = {c: f"({pa[c]}*0.7::DOUBLE+({d[c]}-{pv[c]})*0.3::DOUBLE)" for c in "xy"}
    n = lambda m: f"least(sqrt({m['x']}*{m['x']}+{m['y']}*{m['y']}),1)"
    shape = f"(CASE WHEN {fresh} THEN 0 ELSE least(abs(o.vol/r.vol-1),1) END)"
    return fold_sql("0.0::DOUBLE vx, 0.0::DOUBLE vy, 0.0::DOUBLE ax, 0.0::DOUBLE ay, 0.0::DOUBLE sc",
                    f"{v['x']}, {v['y']}, {a['x']}, {a['y']}, least(0.4::DOUBLE*{n(d)}+0.3::DOUBLE*{n(v)}+0.2::DOUBLE*{n(a)}+0.1::DOUBLE*{shape},1)",
                    "SELECT event_id, round(sc,8)+0.0::DOUBLE AS score, CASE WHEN sc<0.1 THEN 'static' WHEN sc<0.4 THEN 'slow' WHEN sc<0.8 THEN 'dynamic' ELSE 'rapid' END AS motion, round(x+vx+ax*0.5::DOUBLE,8)+0.0::DOUBLE AS next_x FROM r",
                    where, "mv", ", mv AS (SELECT user_id, us, event_id, value/97 AS x, k/100.0::DOUBLE AS y, k+1.0::DOUBLE AS vol FROM evt)")


@query("9.7", _motion_sql())
def motion_analysis(t):
    d = K.replay(moving(user_events(t)), U, OE, K.motion_analyser(0.3, stale_us=96 * HOUR))
    return d.select("event_id", rnd("score", 8).alias("score"), "motion", rnd("next_x", 8).alias("next_x"))


@query("9.7", _motion_sql(on_time("mv")), name="stream_motion_analysis")
def stream_motion_analysis(t):
    d = folded(moving(with_k(arriving(t)), "ts"), K.motion_analyser(0.3, stale_us=96 * HOUR), "motion")
    return d.select("event_id", rnd("score", 8).alias("score"), "motion", rnd("next_x", 8).alias("next_x"))


@query("9.8", name="object_tracking")
def object_tracking(t):
    e = user_events(t)
    det = F.struct(F.col("event_id").alias("det_id"), (F.col("value") / 20).alias("x"), (F.col("k") / 10.0).alias("y"), F.lit(0.0).alias("z"), (F.col("value") / 20 - 1).alias("x0"), (F.col("k") / 10.0 - 1).alias("y0"),
                   F.lit(-1.0).alias("z0"), (F.col("value") / 20 + 1).alias("x1"), (F.col("k") / 10.0 + 1).alias("y1"), F.lit(1.0).alias("z1"))
    frames = e.groupBy("user_id", F.floor(F.col("us") / (24 * HOUR)).alias("frame")).agg(F.collect_list(det).alias("detections"))  # one frame's detections
    return K.replay(frames, U, ["frame"], K.object_tracker(max_distance=2.0))


def _delta_sql(where=""):
    return fold_sql("true AS em, true AS kf, value AS lx, k AS ly", "o.sq > r.sq+30 OR abs(o.value-r.lx) > 40 OR abs(o.k-r.ly) > 40, o.sq > r.sq+30, CASE WHEN o.sq > r.sq+30 OR abs(o.value-r.lx) > 40 OR abs(o.k-r.ly) > 40 THEN o.value ELSE r.lx END, CASE WHEN o.sq > r.sq+30 OR abs(o.value-r.lx) > 40 OR abs(o.k-r.ly) > 40 THEN o.k ELSE r.ly END",
                    "SELECT event_id, em AS emitted, kf AS key_frame FROM r", where, "sv", ", sv AS (SELECT *, us//3600000000 AS sq FROM evt)")


def sequenced(df, *also):
    return df.select("user_id", *OE, *also, F.col("value").alias("x"), F.col("k").alias("y"), F.lit(0.0).alias("z"), F.floor(F.col("us") / HOUR).alias("sequence"))


DELTA = K.delta_encoder(40.0, 30, 31 * HOUR)  # a pause of 31 hours skips more than 30 numbers


@query("9.9", _delta_sql())
def delta_encoding(t):
    return K.replay(sequenced(user_events(t)), U, OE, DELTA).select("event_id", "emitted", "key_frame")


@query("9.9", _delta_sql(on_time("sv")), name="stream_delta_encoding")
def stream_delta_encoding(t):
    return folded(sequenced(with_k(arriving(t)), "ts"), DELTA, "delta").select("event_id", "emitted", "key_frame")


def job_updates(df):
    status = (F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "completed")
              .when(F.col("event_type") == "error", "failed").otherwise("progress"))
    return df.select("user_id", *OE, status.alias("status"), F.col("value").alias("progress"))


JOBS = fold_sql("CASE st WHEN 'progress' THEN 'pending' ELSE st END AS status, CASE st WHEN 'pending' THEN 0 ELSE value END AS progress, CASE st WHEN 'running' THEN us END AS sa, CASE WHEN st IN ('completed','failed') THEN us END AS fa, CASE st WHEN 'failed' THEN 'failed' END AS er, CASE st WHEN 'running' THEN 1 ELSE 0 END AS att",
                "CASE o.st WHEN 'progress' THEN r.status ELSE o.st END, CASE o.st WHEN 'pending' THEN 0 ELSE o.value END, CASE o.st WHEN 'pending' THEN NULL WHEN 'running' THEN coalesce(r.sa, o.us) ELSE r.sa END, CASE WHEN o.st='pending' THEN NULL WHEN o.st IN ('completed','failed') THEN o.us ELSE r.fa END,"
                " CASE o.st WHEN 'progress' THEN r.er WHEN 'failed' THEN 'failed' END, r.att + CASE WHEN o.st='running' AND r.sa IS NULL THEN 1 ELSE 0 END",
                "SELECT user_id, status, progress, sa AS started_at, fa AS finished_at, er AS last_error, att AS attempts FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1",
                source="jv", extra=", jv AS (SELECT *, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'progress' END AS st FROM evt)")
JOBCOLS = ["status", "progress", "started_at", "finished_at", "last_error", "attempts"]


@query("9.10", JOBS)
def job_states(t):
    return X.job_states(job_updates(user_events(t)), U, OE).select("user_id", *JOBCOLS)


@query("9.10", JOBS, name="stream_job_states")
def stream_job_states(t):
    return J.latest_by(J.drain(K.follow(job_updates(stream_of(t)), U, OE, K.job_machine()), "jobs"), U, ["seq"], JOBCOLS)


@query("9.11", with_ctes("SELECT event_id, user_id, event_type AS status FROM evt QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id)", EVT))
def status_notifications(t):
    d = previous_row(user_events(t).select("user_id", *OE, "event_type"), U, OE, ["event_type"])
    return d.filter(~F.col("event_type").eqNullSafe(F.col("prev.event_type"))).select("event_id", "user_id", F.col("event_type").alias("status"))


def journal_actions(t):
    action = F.element_at(F.array(*map(F.lit, ("claim", "claim", "fail", "interrupt", "commit"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    return t.orders.select(F.col("o_custkey").alias("user_id"), (F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("us"), F.col("o_orderkey").alias("event_id"), action.alias("action"))


@query("9.12", fold_sql("CASE act WHEN 'claim' THEN 'process' END AS decision, CASE act WHEN 'claim' THEN 'running' END AS status, CASE act WHEN 'claim' THEN 1 ELSE 0 END AS attempts",
                        "CASE WHEN o.act='claim' THEN CASE WHEN r.status='committed' THEN 'already_committed' WHEN r.status IS NOT NULL AND r.attempts >= 2 THEN 'retry_limit' ELSE 'process' END END,"
                        " CASE WHEN o.act='claim' THEN CASE WHEN r.status='committed' OR (r.status IS NOT NULL AND r.attempts >= 2) THEN r.status ELSE 'running' END WHEN r.status IS NULL THEN NULL WHEN o.act='commit' THEN 'committed' ELSE 'failed' END,"
                        " CASE WHEN o.act='claim' AND NOT (coalesce(r.status,'')='committed' OR (r.status IS NOT NULL AND r.attempts >= 2)) THEN r.attempts+1 WHEN o.act='interrupt' AND r.status IS NOT NULL THEN greatest(r.attempts-1,0) ELSE r.attempts END",
                        "SELECT event_id, decision, status, attempts FROM r", source="ja", extra=", ja AS (SELECT o_custkey AS user_id, epoch_us(o_orderdate) AS us, o_orderkey AS event_id, CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'claim' WHEN '2' THEN 'claim' WHEN '3' THEN 'fail' WHEN '4' THEN 'interrupt' ELSE 'commit' END AS act FROM orders)"))
def journal_replay(t):
    return X.work_journal(journal_actions(t), U, OE, 2).select("event_id", "decision", "status", "attempts")


TTL = 24 * HOUR


@query("9.13", fold_sql(f"act='acquire' AS ok, CASE WHEN act='acquire' THEN ow END AS holder, CASE WHEN act='acquire' THEN us+{TTL} ELSE 0 END AS until",
                        f"CASE WHEN o.act='acquire' THEN r.holder IS NULL OR r.until <= o.us OR r.holder=o.ow ELSE coalesce(r.holder=o.ow,false) END,"
                        f" CASE WHEN o.act='acquire' AND (r.holder IS NULL OR r.until <= o.us OR r.holder=o.ow) THEN o.ow WHEN o.act='release' AND coalesce(r.holder=o.ow,false) THEN NULL ELSE r.holder END,"
                        f" CASE WHEN o.act='acquire' AND (r.holder IS NULL OR r.until <= o.us OR r.holder=o.ow) THEN o.us+{TTL} WHEN o.act='renew' AND coalesce(r.holder=o.ow,false) THEN o.us+{TTL} WHEN o.act='release' AND coalesce(r.holder=o.ow,false) THEN 0 ELSE r.until END",
                        "SELECT event_id, ok, holder, until FROM r", source="lv", extra=", lv AS (SELECT *, (k%3)::BIGINT AS ow, CASE WHEN event_type IN ('click','view','signup') THEN 'acquire' WHEN event_type='purchase' THEN 'renew' ELSE 'release' END AS act FROM evt)"))
def lease_replay(t):
    act = F.when(F.col("event_type").isin("click", "view", "signup"), "acquire").when(F.col("event_type") == "purchase", "renew").otherwise("release")
    d = user_events(t).select("user_id", *OE, (F.col("k") % 3).cast("long").alias("owner"), act.alias("action"))
    return X.lease_log(d, U, OE, TTL).select("event_id", "ok", "holder", "until")


@query("9.14", with_ctes("""WITH e AS (SELECT *, k % 7 <> 0 AND us < 1705968000000000 AS el FROM evt), c AS (SELECT *, count(*) FILTER (el) OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM e)
  SELECT event_id, el AND n <= 20 AS allowed, least(n, 20) AS uses FROM c""", EVT))
def bounded_use(t):
    d = user_events(t).withColumn("ok", (F.col("k") % 7 != 0) & (F.col("us") < 1705968000000000))
    d = running(d.select("user_id", *OE, "ok"), U, OE, {"n": ("sum", F.col("ok").cast("long"))})
    return d.select("event_id", (F.col("ok") & (F.col("n") <= 20)).alias("allowed"), F.least("n", F.lit(20)).alias("uses"))


def assimilate(measurements, keys):
    """Uncensored evidence is associative: one aggregate per probe."""
    p = F.sum(1 / F.col("variance"))
    return measurements.groupBy(*keys).agg((F.sum(F.col("mean") / F.col("variance")) / p).alias("mean"), (1 / p).alias("variance"), F.count("*").alias("updates"))


@query("9.15", with_ctes("SELECT user_id, round(sum(value/(k+1.0::DOUBLE))/sum(1/(k+1.0::DOUBLE)),6) AS mean, round(1/sum(1/(k+1.0::DOUBLE)),8) AS variance, count(*) AS updates FROM evt GROUP BY 1", EVT))
def posterior_assimilation(t):
    m = user_events(t).select("user_id", F.col("value").alias("mean"), (F.col("k") + 1.0).alias("variance"))
    return assimilate(m, U).withColumns({"mean": rnd("mean"), "variance": rnd("variance", 8)})


@query("9.15", name="censored_posterior")
def censored_posterior(t):
    cens = F.col("event_type") == "error"
    m = user_events(t).select("user_id", *OE, F.when(~cens, F.col("value")).alias("mean"), F.when(~cens, F.col("k") + 1.0).alias("variance"), F.when(cens, F.col("value") / 2).alias("lower_bound"))
    d = K.replay(m, U, OE, K.posterior())
    return d.select("user_id", "event_id", rnd("mean").alias("mean"), rnd("variance").alias("variance"), "effect")


@query("9.16", with_ctes("SELECT user_id, event_type AS phase, count(*) AS updates, arg_max(k, (us, event_id)) AS current, round(arg_max(k, (us, event_id))/100.0::DOUBLE*100,4) AS percent, round(avg(value),9) AS mean_ms FROM evt GROUP BY 1,2", EVT))
def progress_counters(t):
    last = F.max_by("k", F.struct("us", "event_id"))
    return user_events(t).groupBy("user_id", F.col("event_type").alias("phase")).agg(
        F.count("*").alias("updates"), last.alias("current"), rnd(last / 100.0 * 100, 4).alias("percent"), rnd(F.avg("value"), 9).alias("mean_ms"))


# Share of rows kept per client quality.
DENSITY = {"low": 100, "medium": 300, "high": 1000, "ultra": 1000}


def thin(rows, clients, id_col):
    """Deterministic share by a portable hash of the id; per client quality."""
    slot = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 7), 16, 10).cast("long") % 1000
    return rows.join(clients, "client").filter(slot < F.col("per_mille"))


@query("9.17", with_ctes("""SELECT event_id, user_id FROM evt WHERE ('0x' || substr(md5(event_id::VARCHAR),1,7))::BIGINT % 1000 < CASE user_id % 4 WHEN 0 THEN 100 WHEN 1 THEN 300 ELSE 1000 END""", EVT))
def quality_thinning(t):
    ev = user_events(t).select("event_id", "user_id", F.col("user_id").alias("client"))
    q = F.element_at(F.array(*[F.lit(v) for v in DENSITY.values()]), (F.col("client") % 4 + 1).cast("int"))
    clients = ev.select("client").distinct().withColumn("per_mille", q)
    return thin(ev, clients, "event_id").select("event_id", "user_id")


@query("9.18", with_ctes("SELECT event_id, arg_min(rid, (d, bus)) AS matched FROM pr WHERE d < 14400000000 GROUP BY 1", EVT, NEAR))
def stream_live_match(t):
    a, b = stream_of(t).filter("event_type = 'error'"), stream_of(t).filter("event_type = 'purchase'")
    return J.closest(J.drain(J.match_live(a, b, "user_id", "4 HOURS", "2 days"), "live-match"), "event_id")


@query("9.19", with_ctes("SELECT event_id, event_type AS stage FROM evt WHERE us + CASE event_type WHEN 'click' THEN 5 WHEN 'error' THEN 10 ELSE 20 END * 86400000000::BIGINT > 1706486400000000", EVT))
def stage_retention(t):
    days = F.when(F.col("event_type") == "click", 5).when(F.col("event_type") == "error", 10).otherwise(20)
    return user_events(t).filter(F.col("us") + days.cast("long") * 86_400_000_000 > 1706486400000000).select("event_id", F.col("event_type").alias("stage"))


def _hyst_sql(where=""):
    fresh = f"(o.us-r.us < {30 * HOUR})"
    similar = ("(abs((r.bx+r.bw*0.5::DOUBLE)-(o.bx+o.bw*0.5::DOUBLE)) < 0.02 AND abs((r.by_+r.bh*0.5::DOUBLE)-(o.by_+o.bh*0.5::DOUBLE)) < 0.02 AND abs(r.bw-o.bw) < 0.08 AND abs(r.bh-o.bh) < 0.08)")
    since = f"CASE WHEN NOT o.det THEN NULL WHEN {fresh} AND r.det AND {similar} THEN coalesce(r.since, o.us) ELSE o.us END"
    return fold_sql("cf AS conf, CASE WHEN det THEN us END AS since, false AS stb",
                    f"CASE WHEN {fresh} THEN least(o.cf*0.7::DOUBLE+r.conf*0.3::DOUBLE,1) ELSE o.cf END, {since}, coalesce({fresh} AND r.det AND o.det AND {similar} AND o.us-coalesce(r.since,o.us) >= {8 * HOUR}, false)",
                    "SELECT event_id, round(conf,8) AS confidence, stb AS stable, coalesce(us-since,0) AS stable_us FROM r", where, "hv",
                    ", hv AS (SELECT *, event_type <> 'signup' AS det, least(value/97,1) AS cf, 0.3::DOUBLE+(k%4)*0.009::DOUBLE AS bx, 0.4::DOUBLE+(k%3)*0.009::DOUBLE AS by_, 0.2::DOUBLE AS bw, 0.25::DOUBLE AS bh FROM evt)")


def detections(df, *also):
    return df.select("user_id", *OE, *also, (F.col("event_type") != "signup").alias("detected"), F.least(F.col("value") / 97, F.lit(1.0)).alias("confidence"),
                     (0.3 + F.col("k") % 4 * 0.009).alias("bx"), (0.4 + F.col("k") % 3 * 0.009).alias("by"), F.lit(0.2).alias("bw"), F.lit(0.25).alias("bh"))


HYSTERESIS = K.detection_hysteresis(30 * HOUR, 8 * HOUR)


@query("9.20", _hyst_sql())
def detection_hysteresis(t):
    out = K.replay(detections(user_events(t)), U, OE, HYSTERESIS)
    return out.select("event_id", rnd("confidence", 8).alias("confidence"), "stable", "stable_us")


@query("9.20", _hyst_sql(on_time("hv")), name="stream_detection_hysteresis")
def stream_detection_hysteresis(t):
    out = folded(detections(with_k(arriving(t)), "ts"), HYSTERESIS, "hysteresis")
    return out.select("event_id", rnd("confidence", 8).alias("confidence"), "stable", "stable_us")
