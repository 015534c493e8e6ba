"""Window functions and ordered scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions.numeric import rnd
from scanloom.operators import windows as W
from scanloom.plans.inputs import EVT, user_events
from scanloom.plans.registry import query, with_ctes

SIX_HOURS = 6 * 3_600_000_000

GAP = """gaps AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 21600000000 THEN 0 ELSE 1 END AS st FROM evt WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
  bursts AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us, event_id)::BIGINT AS group_no FROM gaps)"""


def bursts(t):
    return W.gap_groups(user_events(t), ["user_id"], "us", "event_id", SIX_HOURS)


@query("5.1", with_ctes("SELECT event_id, user_id, group_no FROM bursts", EVT, GAP))
def time_gap_groups(t):
    return bursts(t).select("event_id", "user_id", "group_no")


@query("5.1 4.1 6.1", with_ctes("""SELECT user_id, group_no, min(ts) AS started, count(*) AS frames, min(value) AS min_v, round(avg(value),4) AS mean_v, max(value) AS max_v,
   round(coalesce(stddev_samp(value),0),4) AS std_v FROM bursts GROUP BY 1,2 ORDER BY started DESC, user_id LIMIT 500""", EVT, GAP))
def newest_burst_statistics(t):
    stats = bursts(t).groupBy("user_id", "group_no").agg(
        F.min("ts").alias("started"), F.count("*").alias("frames"), F.min("value").alias("min_v"), rnd(F.avg("value"), 4).alias("mean_v"),
        F.max("value").alias("max_v"), rnd(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("std_v"))
    return stats.orderBy(F.desc("started"), "user_id").limit(500)


def order_shots(t):
    """Capture groups: shutter per frame in (part, line) order, one group per order."""
    shutter = F.when(F.col("l_returnflag") == "A", 0.01).when(F.col("l_returnflag") == "N", 0.02).otherwise(0.03)
    frames = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber", "l_suppkey", shutter.alias("s")))).alias("f"))
    return frames.select("l_orderkey", F.transform("f", lambda f: f.s).alias("shutters"))


@query("5.2", """WITH f AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS s,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS i FROM lineitem),
  g AS (SELECT l_orderkey, count(*)::INT n, count(DISTINCT s)::INT u FROM f GROUP BY 1),
  m AS (SELECT g.l_orderkey, bool_and(b.s IS NULL OR a.s = b.s) AS rep FROM g JOIN f a USING (l_orderkey)
    LEFT JOIN f b ON b.l_orderkey=a.l_orderkey AND b.i = a.i + g.u GROUP BY 1),
  p AS (SELECT l_orderkey, n, u, CASE WHEN n < 2 THEN 1 WHEN u BETWEEN 2 AND 5 AND rep THEN u ELSE least(u,3) END AS e FROM g JOIN m USING (l_orderkey))
  SELECT l_orderkey, u AS distinct_exposures, e AS exposures_per_plane, ((n+e-1)//e)::INT AS planes,
   (SELECT string_agg(x::VARCHAR, ',' ORDER BY x) FROM (SELECT k*e + e//2 AS x FROM generate_series(0, 20) r(k)) WHERE x < n AND x < e*((n+e-1)//e)) AS reps FROM p""")
def focus_exposure_pattern(t):
    d = W.focus_pattern(order_shots(t), "shutters")
    return d.select("l_orderkey", "distinct_exposures", "exposures_per_plane", "planes",
                    F.array_join(F.col("representatives").cast("array<string>"), ",").alias("reps"))


@query("5.3", """WITH f AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS s,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) - 1 AS i FROM lineitem)
  SELECT l_orderkey, (l_orderkey % 4) * count(*) + coalesce(min(i) FILTER (s = 2), count(*)//2) AS ref_index FROM f GROUP BY 1""")
def reference_frame(t):
    ev = F.transform("shutters", lambda s: F.log2(s / 0.02))
    return order_shots(t).select("l_orderkey", W.reference_index(ev, F.lit(0.0), F.col("l_orderkey") % 4).cast("long").alias("ref_index"))


def audit_payloads(t):
    return user_events(t).select(F.col("user_id").alias("log_id"), "us", "event_id", "k",
                                 F.concat_ws(":", "event_id", "event_type", "k").alias("payload"))


CHAIN = """pay AS (SELECT user_id AS log_id, us, k, event_id || ':' || event_type || ':' || k AS payload,
   row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS seq FROM evt),
  chain AS (SELECT log_id, seq, payload, k, 'genesis' AS prev_hash, sha256('genesis|' || payload) AS hash FROM pay WHERE seq = 1
   UNION ALL SELECT p.log_id, p.seq, p.payload, p.k, c.hash, sha256(c.hash || '|' || p.payload) FROM chain c JOIN pay p ON p.log_id=c.log_id AND p.seq=c.seq+1)"""


@query("5.4", f"""WITH RECURSIVE {EVT}, {CHAIN}, ch AS (SELECT log_id, seq, k, prev_hash, CASE WHEN k = 42 THEN sha256('forged') ELSE hash END AS hash, hash AS good FROM chain),
  v AS (SELECT a.log_id, a.seq, a.hash = a.good AND (a.seq = 1 OR a.prev_hash = b.hash) AS ok FROM ch a LEFT JOIN ch b ON b.log_id=a.log_id AND b.seq+1=a.seq)
  SELECT log_id, count(*) AS records, min(seq) FILTER (NOT ok) AS first_bad, bool_and(ok) AS valid FROM v GROUP BY 1""")
def chain_verification(t):
    """Chains with forged hashes planted where the payload ends in 42."""
    chain = W.rebuild_chain(audit_payloads(t), "log_id", ["us", "event_id"])
    forged = F.when(F.col("payload").rlike(":42$"), F.sha2(F.lit("forged"), 256)).otherwise(F.col("hash"))
    return W.verify_chain(chain.withColumn("hash", forged), "log_id")


@query("5.5", f"""WITH RECURSIVE {EVT.replace('FROM events', "FROM events WHERE ts > TIMESTAMP '2024-01-15'")}, {CHAIN}
  SELECT log_id, seq, payload, prev_hash, hash FROM chain""")
def prune_and_rechain(t):
    kept = audit_payloads(t).filter(F.col("us") > 1705276800000000)
    return W.rebuild_chain(kept, "log_id", ["us", "event_id"])


@query("5.6", """WITH f AS (SELECT l_linestatus, l_extendedprice v, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) - 1 AS i,
   count(*) OVER (PARTITION BY l_linestatus) AS n FROM lineitem WHERE l_returnflag <> 'R'),
  m AS (SELECT l_linestatus, min(v) FILTER (i = floor((n-1)*0.6::DOUBLE)) ta, min(v) FILTER (i = floor((n-1)*0.35::DOUBLE)) tb FROM f GROUP BY 1)
  SELECT l_linestatus, CASE WHEN l_returnflag='R' THEN 'D' WHEN l_extendedprice >= ta THEN 'A' WHEN l_extendedprice >= tb THEN 'B' ELSE 'C' END AS grade, count(*) AS n
  FROM lineitem JOIN m USING (l_linestatus) GROUP BY 1, 2""")
def percentile_grading(t):
    li = t.lineitem.select("l_linestatus", "l_extendedprice", (F.col("l_returnflag") != "R").alias("fg"))
    return W.percentile_grades(li, ["l_linestatus"], "l_extendedprice", "fg").groupBy("l_linestatus", "grade").agg(F.count("*").alias("n"))


@query("5.7", f"""WITH RECURSIVE {EVT}, o AS (SELECT user_id, event_id, value/97 AS x, row_number() OVER w AS i,
    count(*) FILTER (value/97 < 0.5) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS stable FROM evt
    WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
  r AS (SELECT user_id, event_id, i, stable, x*0.3::DOUBLE AS v FROM o WHERE i = 1 UNION ALL
   SELECT o.user_id, o.event_id, o.i, o.stable, r.v*0.7::DOUBLE + o.x*0.3::DOUBLE FROM r JOIN o ON o.user_id=r.user_id AND o.i=r.i+1)
  SELECT event_id, user_id, round(v, 9) AS smoothed, stable FROM r""")
def motion_smoothing(t):
    d = user_events(t).select("user_id", "us", "event_id", (F.col("value") / 97).alias("x"))
    s = W.exponential_smoothing(d, ["user_id"], "us", "event_id", "x", 0.3)
    s = W.stable_for(s, ["user_id"], "us", "event_id", "x", 5, 0.5)
    return s.select("event_id", "user_id", rnd("smoothed", 9).alias("smoothed"), "stable")


@query("5.8", with_ctes("""WITH p AS (SELECT event_id, user_id, sum(value-48) OVER w AS px, sum(k/100.0::DOUBLE-0.5::DOUBLE) OVER w AS pa,
    exp(sum(ln(1+(k-50)/1000.0::DOUBLE)) OVER w) AS sc, row_number() OVER w AS i FROM evt WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
  m AS (SELECT *, avg(px) OVER h AS mx, avg(pa) OVER h AS ma FROM p WINDOW h AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))
  SELECT event_id, round(px*0.2::DOUBLE+mx*0.8::DOUBLE,4)+0.0::DOUBLE AS sx, round(pa*0.2::DOUBLE+ma*0.8::DOUBLE,4)+0.0::DOUBLE AS sa,
   round((mx-px)*0.8::DOUBLE,4)+0.0::DOUBLE AS cx, round(sc,4) AS scale FROM m""", EVT))
def camera_path_smoothing(t):
    d = user_events(t).select("user_id", "us", "event_id", (F.col("value") - 48).alias("x"), (F.col("k") / 100.0 - 0.5).alias("a"),
                              (1 + (F.col("k") - 50) / 1000.0).alias("sc"))
    p = W.camera_path(d, ["user_id"], "us", "event_id", ["x", "a"], "sc", 10, 0.8)
    return p.select("event_id", rnd("s_x", 4).alias("sx"), rnd("s_a", 4).alias("sa"), rnd("c_x", 4).alias("cx"), rnd("p_scale", 4).alias("scale"))


@query("5.9", """WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice v, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS i FROM lineitem),
  r AS (SELECT o_totalprice w, row_number() OVER (ORDER BY o_totalprice) - 1 AS j FROM orders),
  c AS (SELECT (SELECT count(*) FROM lineitem) n, (SELECT count(*) FROM orders) m)
  SELECT l_orderkey, l_linenumber, v AS price, w AS matched FROM s, c JOIN r ON r.j = floor(s.i/(c.n-1)*(c.m-1)+0.5::DOUBLE)""")
def distribution_match(t):
    src = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    ref = t.orders.select(F.col("o_totalprice").alias("price"))
    return W.match_distribution(src, ref, "price", ["l_orderkey", "l_linenumber"])


@query("5.10", """WITH b AS (SELECT event_type, least(greatest(floor(value),0),255)::INT AS lv, (event_id % 2) AS side FROM events),
  g AS (SELECT event_type, side, level, (SELECT 1) FROM (SELECT DISTINCT event_type, side FROM b), generate_series(0,255) l(level)),
  h AS (SELECT g.event_type, g.side, g.level, count(b.lv) AS c FROM g LEFT JOIN b ON b.event_type=g.event_type AND b.side=g.side AND b.lv=g.level GROUP BY 1,2,3),
  d AS (SELECT event_type, side, level, sum(c) OVER (PARTITION BY event_type, side ORDER BY level) / sum(c) OVER (PARTITION BY event_type, side) AS p FROM h)
  SELECT s.event_type, s.level::INT AS level, arg_min(r.level, (abs(r.p-s.p), r.level))::INT AS matched FROM d s JOIN d r ON r.event_type=s.event_type AND s.side=0 AND r.side=1 GROUP BY 1,2""")
def histogram_matching(t):
    b = t.events.select("event_type", F.least(F.greatest(F.floor("value"), F.lit(0)), F.lit(255)).cast("int").alias("bin"), (F.col("event_id") % 2).alias("side"))
    return W.histogram_match(b.filter("side = 0"), b.filter("side = 1"), "bin", ["event_type"])


@query("5.11", with_ctes("""WITH d AS (SELECT user_id, us, event_id, coalesce(abs(value - lag(value) OVER w)/500 < 0.05, false)::INT AS sm FROM evt WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
  g AS (SELECT *, sum(1-sm) OVER (PARTITION BY user_id ORDER BY us, event_id) AS isl FROM d)
  SELECT event_id, user_id, (sum(sm) OVER (PARTITION BY user_id, isl ORDER BY us, event_id))::BIGINT AS run, sum(sm) OVER (PARTITION BY user_id, isl ORDER BY us, event_id) > 3 AS stable FROM g""", EVT))
def change_run_length(t):
    d = W.change_runs(user_events(t).select("user_id", "us", "event_id", "value"), ["user_id"], "us", "event_id", "value", 500.0, 0.05)
    return d.select("event_id", "user_id", "run", (F.col("run") > 3).alias("stable"))
