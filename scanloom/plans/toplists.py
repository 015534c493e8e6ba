"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions.numeric import rnd
from scanloom.operators import sets as S
from scanloom.operators import toplists as T
from scanloom.plans.filters import SPLATS, splats
from scanloom.plans.inputs import EVT, user_events
from scanloom.plans.registry import query, with_ctes


@query("6.1", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def newest_assets(t):
    return T.newest(t.orders, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate", "o_totalprice")


def jobs(t):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").when(
        F.col("o_totalprice") < 100000, "completed").otherwise("failed")
    return t.orders.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
                           F.substring("o_orderpriority", 1, 1).cast("int").alias("attempt_count"), F.lit(3).alias("max_attempts"))


@query("6.2", """WITH j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE CASE WHEN o_totalprice < 100000 THEN 'completed' ELSE 'failed' END END AS status,
   o_orderdate AS created_at, substr(o_orderpriority,1,1)::INT AS attempt_count FROM orders)
  SELECT job_id, status, created_at, 'pending' AS list FROM j WHERE status IN ('pending','running')
  UNION ALL SELECT job_id, status, created_at, 'retry' FROM j WHERE status = 'failed' AND attempt_count < 3""")
def job_listing(t):
    cols = ["job_id", "status", "created_at"]
    return (T.pending_jobs(jobs(t)).select(*cols, F.lit("pending").alias("list"))
            .unionByName(T.retryable_jobs(jobs(t)).select(*cols, F.lit("retry").alias("list"))).orderBy(F.desc("created_at"), "job_id"))


@query("6.3", """WITH v AS (SELECT c_custkey, count(o_orderkey) AS views, max(o_orderdate) AS updated_at FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1)
  SELECT c_custkey, views, updated_at FROM v ORDER BY views DESC, updated_at DESC NULLS LAST, c_custkey LIMIT 24 OFFSET 48""")
def gallery_page(t):
    views = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("views"), F.max("o_orderdate").alias("updated_at"))
    d = t.customer.select("c_custkey").join(views, "c_custkey", "left").fillna(0, ["views"])
    return T.page(d, [F.desc("views"), F.desc_nulls_last("updated_at"), F.col("c_custkey")], 24, 48)


@query("6.4", with_ctes("SELECT splat_id, alpha FROM splats ORDER BY alpha DESC, splat_id LIMIT 200", SPLATS))
def density_top(t):
    from scanloom.operators.predicates import apply_edits
    return apply_edits(splats(t), [("density", 200)]).select("splat_id", "alpha")


@query("6.5", with_ctes("""WITH c AS (SELECT user_id, k % 12 AS bin, sum(value)/100 AS coverage, avg(k)/100.0::DOUBLE AS uncertainty FROM evt GROUP BY 1,2),
  r AS (SELECT *, (uncertainty+0.15::DOUBLE)/(coverage+1) AS score FROM c)
  SELECT user_id, bin, round(score,6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, bin) AS rank FROM r) WHERE rank <= 3""", EVT))
def next_best_bins(t):
    cells = user_events(t).groupBy("user_id", (F.col("k") % 12).alias("bin")).agg((F.sum("value") / 100).alias("coverage"), (F.avg("k") / 100.0).alias("uncertainty"))
    return T.next_best_bins(cells, ["user_id"], 3).select("user_id", "bin", rnd("score").alias("score"), "rank")


def part_utilities(t):
    hdr, foc = F.col("p_retailprice") / 2000, F.col("p_size") / 50.0
    cost = F.lit(5.0) + F.col("p_size") % 7
    return t.part.select("p_brand", F.col("p_partkey").alias("candidate_id"), hdr.alias("hdr_nats"), foc.alias("focus_nats"), (F.round((hdr + foc) / cost, 2)).alias("utility_per_ms"),
                         (F.lit(100) * (F.col("p_partkey") % 5 + 1)).cast("int").alias("iso"), (F.col("p_size") / 1000).alias("shutter"), (-F.col("p_partkey")).alias("focus"))


@query("6.6", """WITH u AS (SELECT p_brand, p_partkey, p_retailprice/2000 AS h, p_size/50.0::DOUBLE AS f, round((p_retailprice/2000+p_size/50.0::DOUBLE)/(5.0::DOUBLE+p_size%7),2) AS u,
   100*(p_partkey%5+1)::INT AS iso, p_size/1000 AS sh FROM part)
  SELECT p_brand, p_partkey AS candidate_id, u AS utility_per_ms, iso FROM u WHERE h >= 0.5 OR f >= 0.5
  QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY u DESC, iso, sh, p_partkey DESC) = 1""")
def best_candidate(t):
    return T.best_candidate(part_utilities(t), ["p_brand"], 0.5)


@query("6.7", """SELECT s_nationkey, s_suppkey AS source_id, score FROM (SELECT *, CASE WHEN s_suppkey % 11 = 0 THEN 100 WHEN s_suppkey % 5 = 0 THEN 80 ELSE s_acctbal/200 END AS score FROM supplier WHERE s_acctbal > 0)
  QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC, s_suppkey) = 1""")
def reference_audio_source(t):
    kind = F.when(F.col("s_suppkey") % 11 == 0, "official").when(F.col("s_suppkey") % 5 == 0, "professional").otherwise("user")
    src = t.supplier.select("s_nationkey", F.col("s_suppkey").alias("source_id"), kind.alias("kind"), (F.col("s_acctbal") / 200).alias("quality"), (F.col("s_acctbal") > 0).alias("has_audio"))
    return T.reference_source(src, ["s_nationkey"]).select("s_nationkey", "source_id", "score")


@query("6.8", """WITH f AS (SELECT l_suppkey AS image_id, l_orderkey*10+l_linenumber AS kp_id, l_partkey%60 AS x, l_quantity AS y, l_extendedprice AS response FROM lineitem)
  SELECT image_id, kp_id, x, y, response FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY response DESC, kp_id) AS r FROM f) WHERE r <= 50 AND x BETWEEN 4 AND 55 AND y BETWEEN 4 AND 47""")
def top_features_per_image(t):
    f = t.lineitem.select(F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("kp_id"),
                          (F.col("l_partkey") % 60).alias("x"), F.col("l_quantity").alias("y"), F.col("l_extendedprice").alias("response"))
    return T.top_features(f, 50, 4, 60, 52).select("image_id", "kp_id", "x", "y", "response")


@query("6.9", with_ctes("""WITH s AS (SELECT user_id, k//4 AS bin, sum(value) AS m FROM evt GROUP BY 1,2), n AS (SELECT a.user_id, a.bin, a.m, count(b.m) AS c, max(b.m) AS best FROM s a JOIN s b
   ON a.user_id=b.user_id AND abs(a.bin-b.bin) BETWEEN 1 AND 2 GROUP BY 1,2,3)
  SELECT user_id, bin, round(m,4) AS magnitude, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, bin) AS r FROM n WHERE c = 4 AND m > best) WHERE r <= 6""", EVT))
def spectral_peak_top(t):
    s = user_events(t).groupBy("user_id", F.floor(F.col("k") / 4).cast("int").alias("bin")).agg(F.sum(F.col("value").cast("decimal(28,18)")).cast("double").alias("magnitude"))  # whatever the order of the rows
    return T.spectral_peaks(s, ["user_id"]).select("user_id", "bin", rnd("magnitude", 4).alias("magnitude"), "rank")


@query("6.10", """WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS row_index FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_index FROM o WHERE row_index % ceil((SELECT count(*) FROM lineitem)/5000)::BIGINT = 0""")
def stride_sampling(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return T.stride_sample(t.lineitem.select(*cols), cols, 5000)


@query("6.11", """WITH f AS (SELECT l_orderkey, l_partkey*10+l_linenumber AS frame, greatest(l_quantity - (CASE WHEN l_discount*1000 < 20 THEN (20-l_discount*1000)*0.5::DOUBLE WHEN l_extendedprice/397 > 240 THEN (l_extendedprice/397-240)*0.5::DOUBLE ELSE 0 END),0) AS score,
  l_quantity q FROM lineitem) SELECT l_orderkey, frame, round(score,6) AS score, frame = first_value(frame) OVER (PARTITION BY l_orderkey ORDER BY score DESC, frame) AS keep FROM f""")
def best_frame_of_burst(t):
    dark = F.col("l_discount") * 1000 < 20
    frames = t.lineitem.select("l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("frame"), F.col("l_quantity").alias("sharpness"),
                               F.when(dark, F.col("l_discount") * 1000).otherwise(F.greatest(F.col("l_extendedprice") / 397, F.lit(20.0))).alias("brightness"))
    return T.best_of_burst(frames, ["l_orderkey"], "frame").select("l_orderkey", "frame", rnd("score").alias("score"), "keep")


@query("6.12", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_history(t):
    return T.recent(t.events.select("event_id", "ts", "value"), "ts", "event_id")


@query("7.1", """SELECT o_orderkey, 'output' AS scope FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'processed' FROM orders WHERE o_orderstatus <> 'O'""")
def scope_union(t):
    out = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("output").alias("scope"))
    return out.unionByName(t.orders.filter("o_orderstatus <> 'O'").select("o_orderkey", F.lit("processed").alias("scope")))


@query("7.2", """SELECT l_suppkey || '-' || l_linenumber AS label FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' UNION SELECT l_suppkey || '-' || l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'""")
def label_union(t):
    li = t.lineitem.select(F.concat_ws("-", "l_suppkey", "l_linenumber").alias("label"), "l_shipdate")
    return li.filter("l_shipdate < '1998-01-01'").select("label").union(li.filter("l_shipdate >= '2000-01-01'").select("label")).distinct()


def split_levels(levels, minimum):
    """Levels of either split that miss the pair count in one of them, and sources seen in both splits."""
    n = levels.groupBy("iso", "level").agg(F.count_if(F.col("split") == "fit").alias("fit"), F.count_if(F.col("split") == "holdout").alias("holdout"))
    return n.withColumn("enough", (F.col("fit") >= minimum) & (F.col("holdout") >= minimum))


@query("7.3", """WITH p AS (SELECT l_linenumber AS iso, l_quantity::INT AS level, CASE WHEN l_linestatus='F' THEN 'fit' ELSE 'holdout' END AS split, l_suppkey AS src FROM lineitem),
  n AS (SELECT iso, level, count(*) FILTER (split='fit') fit, count(*) FILTER (split='holdout') holdout FROM p GROUP BY 1,2),
  o AS (SELECT iso, count(*) AS shared FROM (SELECT iso, src FROM p WHERE split='fit' INTERSECT SELECT iso, src FROM p WHERE split='holdout') GROUP BY 1)
  SELECT n.iso, level, fit, holdout, fit >= 85 AND holdout >= 85 AS enough, coalesce(shared,0) AS shared FROM n LEFT JOIN o ON o.iso=n.iso""")
def level_union_overlap(t):
    split = F.when(F.col("l_linestatus") == "F", "fit").otherwise("holdout")
    p = t.lineitem.select(F.col("l_linenumber").alias("iso"), F.col("l_quantity").cast("int").alias("level"), split.alias("split"), F.col("l_suppkey").alias("src"))
    both = p.filter("split = 'fit'").select("iso", "src").intersect(p.filter("split = 'holdout'").select("iso", "src")).groupBy("iso").agg(F.count("*").alias("shared"))
    return split_levels(p, 85).join(both, "iso", "left").fillna(0, ["shared"])


@query("7.4", """WITH n AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey + 1000000 END AS id, c_acctbal + 1 AS v FROM customer WHERE c_mktsegment = 'BUILDING')
  SELECT coalesce(n.id, c_custkey) AS id, CASE WHEN n.id IS NOT NULL THEN n.v ELSE c_acctbal END AS v FROM customer FULL JOIN n ON n.id = c_custkey""")
def keyed_upsert(t):
    c = t.customer
    fresh = c.filter("c_mktsegment = 'BUILDING'").select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 1000000).alias("id"), (F.col("c_acctbal") + 1).alias("v"))
    return S.upsert(c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v")), fresh, "id").orderBy("id")


@query("7.5", """WITH RECURSIVE d AS (SELECT DISTINCT l_suppkey, l_extendedprice v FROM lineitem), r AS (SELECT l_suppkey, min(v) AS v FROM d GROUP BY 1
   UNION ALL SELECT l_suppkey, v FROM (SELECT r.l_suppkey, min(d.v) AS v FROM r JOIN d ON d.l_suppkey=r.l_suppkey AND d.v - r.v >= 300 GROUP BY 1)) SELECT l_suppkey, v AS l_extendedprice FROM r""")
def tolerance_distinct(t):
    return S.tolerance_distinct(t.lineitem, ["l_suppkey"], "l_extendedprice", 300.0)


@query("7.6", with_ctes("""WITH d AS (SELECT DISTINCT user_id, us//86400000000 AS day FROM evt WHERE event_type='error'), k AS (SELECT DISTINCT user_id, us//86400000000 AS day FROM evt WHERE event_type='purchase')
  SELECT user_id, day, 'detection' AS side FROM d ANTI JOIN k USING (user_id, day) UNION ALL SELECT user_id, day, 'track' FROM k ANTI JOIN d USING (user_id, day)""", EVT))
def unmatched_tracks(t):
    ev = user_events(t).select("user_id", F.floor(F.col("us") / 86_400_000_000).alias("day"), "event_type")
    d, k = (ev.filter(F.col("event_type") == x).select("user_id", "day").distinct() for x in ("error", "purchase"))
    return S.unmatched(d, k, ["user_id", "day"])
