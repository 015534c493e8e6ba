"""Statistics, coverage and catalogue aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import geometry as G
from scanloom.functions.numeric import exact_mean, rnd
from scanloom.operators import aggregates as A
from scanloom.plans.inputs import EVT, PTS, RGB, points, rgb, user_events
from scanloom.plans.registry import query, with_ctes


@query("4.1", """WITH g AS (SELECT l_suppkey, l_returnflag, min(l_quantity) min_ms, avg(l_quantity) mean_ms, max(l_quantity) max_ms, coalesce(stddev_samp(l_quantity),0) std_ms, count(*) AS n, sum(l_quantity) s FROM lineitem GROUP BY 1,2)
  SELECT l_suppkey, l_returnflag, min_ms, round(mean_ms,5) mean_ms, max_ms, round(std_ms,5) std_ms, n AS count, round(mean_ms/sum(s) OVER (PARTITION BY l_suppkey)*100,6) pct_total FROM g""")
def scope_timing(t):
    d = A.scope_timings(t.lineitem, "l_suppkey", "l_returnflag", "l_quantity")
    return d.withColumns({"mean_ms": rnd("mean_ms", 5), "std_ms": rnd("std_ms", 5), "pct_total": rnd("pct_total")})


@query("4.2", """SELECT l_returnflag AS label, l_linenumber AS run, count(*) AS count, round(avg(l_extendedprice),7) mean_ms, min(l_extendedprice) min_ms, max(l_extendedprice) max_ms FROM lineitem GROUP BY 1,2""")
def benchmark_run_summary(t):
    parts = t.lineitem.groupBy(F.col("l_linenumber").alias("run"), "l_orderkey", F.col("l_returnflag").alias("label")).agg(
        F.count("*").alias("count"), F.avg("l_extendedprice").alias("mean_ms"), F.min("l_extendedprice").alias("min_ms"), F.max("l_extendedprice").alias("max_ms"))
    return A.combine_timings(parts, ["run", "label"]).withColumn("mean_ms", rnd("mean_ms", 7))


@query("4.3", """WITH v AS (SELECT event_type, value/500 AS v FROM events), s AS (SELECT event_type, avg(v) mean, stddev_pop(v) std, min(v) mn, max(v) mx FROM v GROUP BY 1),
  h AS (SELECT event_type, least(greatest(floor(v*255),0),255)::INT AS bin, count(*) AS n FROM v GROUP BY 1,2)
  SELECT event_type, bin, n, round(mean,6) mean, round(std,6) std, mn AS min, mx AS max, round(log2(mx/greatest(mn,1e-6)),6) stops FROM s JOIN h USING (event_type)""")
def channel_statistics(t):
    v = t.events.select("event_type", (F.col("value") / 500).alias("v"))
    s = A.channel_statistics(v, ["event_type"], "v").withColumns({c: rnd(c) for c in ("mean", "std", "stops")})
    return A.histogram(v, ["event_type"], F.col("v") * 255).join(s, "event_type")


@query("4.4", "SELECT l_returnflag, " + ", ".join(f"round(covar_samp({a},{b}),6)+0.0::DOUBLE c{i}{j}" for i, a in enumerate(("l_quantity", "l_discount", "l_tax"))
       for j, b in enumerate(("l_quantity", "l_discount", "l_tax")) if j >= i) + " FROM lineitem GROUP BY 1")
def channel_covariance(t):
    d = A.channel_covariance(t.lineitem, ["l_returnflag"], ("l_quantity", "l_discount", "l_tax"))
    return d.select("l_returnflag", *[rnd(c).alias(c) for c in d.columns[1:]])


VOXSQL = "floor(x/0.1::DOUBLE)::INT vx, floor(y/0.1::DOUBLE)::INT vy, floor(z/0.1::DOUBLE)::INT vz"
VC2 = "vc AS (SELECT cloud_id, floor(x/0.2::DOUBLE)::INT vx, floor(y/0.2::DOUBLE)::INT vy, floor(z/0.2::DOUBLE)::INT vz, count(*) AS n FROM pts GROUP BY 1,2,3,4)"
CLASS = "CASE WHEN n/mx >= 0.8 THEN 'excellent' WHEN n/mx >= 0.6 THEN 'good' WHEN n/mx >= 0.4 THEN 'medium' WHEN n/mx >= 0.2 THEN 'low' ELSE 'very_low' END"


@query("4.11", with_ctes(f"""SELECT cloud_id, {VOXSQL}, round(avg(x),6)+0.0::DOUBLE x, round(avg(y),6)+0.0::DOUBLE y, round(avg(z),6)+0.0::DOUBLE z, floor(avg(r))::INT r, floor(avg(g))::INT g, floor(avg(b))::INT b,
   round(avg(confidence),6) confidence, count(*) AS points FROM pts GROUP BY 1,2,3,4""", PTS))
def voxel_downsample(t):
    return A.voxel_downsample(points(t), ["cloud_id"], 0.1).withColumns({c: rnd(c) for c in ("x", "y", "z", "confidence")})


@query("4.12", with_ctes(f"""WITH d AS (SELECT *, {CLASS} AS c FROM (SELECT *, max(n) OVER (PARTITION BY cloud_id) mx FROM vc))
  SELECT cloud_id, count(*) AS voxels, max(n) AS max_density, count(*) FILTER (c='excellent') excellent, count(*) FILTER (c='good') good, count(*) FILTER (c='medium') medium, count(*) FILTER (c='low') low, count(*) FILTER (c='very_low') very_low,
   round(count(*) FILTER (c IN ('good','excellent'))/count(*)*100,4) good_pct, round(count(*) FILTER (c IN ('low','very_low'))/count(*)*100,4) poor_pct FROM d GROUP BY 1""", PTS, VC2))
def coverage_statistics(t):
    return A.coverage_statistics(points(t), ["cloud_id"], 0.2).withColumns({c: rnd(c, 4) for c in ("good_pct", "poor_pct")})


@query("4.13", with_ctes(f"""WITH d AS (SELECT cloud_id, vx, vy, vz, {CLASS} AS c FROM (SELECT *, max(n) OVER (PARTITION BY cloud_id) mx FROM vc))
  SELECT p.cloud_id, point_id, d.c AS class, CASE d.c WHEN 'excellent' THEN '0,255,0' WHEN 'good' THEN '128,255,0' WHEN 'medium' THEN '255,255,0' WHEN 'low' THEN '255,128,0' ELSE '255,0,0' END AS colour FROM pts p JOIN d
   ON p.cloud_id=d.cloud_id AND floor(x/0.2::DOUBLE)=vx AND floor(y/0.2::DOUBLE)=vy AND floor(z/0.2::DOUBLE)=vz""", PTS, VC2))
def heatmap_colours(t):
    d = A.heatmap_colours(points(t).select("cloud_id", "point_id", "x", "y", "z"), points(t), ["cloud_id"], 0.2)
    return d.select("cloud_id", "point_id", "class", F.array_join(F.col("colour").cast("array<string>"), ",").alias("colour"))


@query("4.14", with_ctes("""WITH f AS (SELECT a.cloud_id, a.vx, a.vy, a.vz, a.n, count(b.n) AS filled FROM vc a LEFT JOIN vc b ON a.cloud_id=b.cloud_id AND abs(a.vx-b.vx)+abs(a.vy-b.vy)+abs(a.vz-b.vz)=1 GROUP BY ALL)
  SELECT cloud_id, count(*) AS voxels, round(avg(n)/100,6) avg_density, round(greatest(1-least(stddev_pop(n)/avg(n),1),0),6)+0.0::DOUBLE uniformity, bool_or(n >= 2 AND 6-filled > 3) has_gaps FROM f GROUP BY 1""", PTS, VC2))
def coverage_uniformity(t):
    return A.coverage_uniformity(points(t), ["cloud_id"], 0.2).withColumns({c: rnd(c) for c in ("avg_density", "uniformity")})


@query("4.15", with_ctes("""WITH s AS (SELECT cloud_id, count(*) FILTER (x<0)/count(*) l, count(*) FILTER (y<0)/count(*) b FROM pts GROUP BY 1)
  SELECT cloud_id, CASE WHEN b < 0.15 AND 1-b > 0.4 THEN 'flip' WHEN least(l,1-l) < 0.25 THEN CASE WHEN l < 1-l THEN 'right' ELSE 'left' END
   WHEN least(b,1-b) < 0.25 THEN CASE WHEN 1-b < b THEN 'down' ELSE 'up' END ELSE 'any' END AS direction FROM s""", PTS))
def guidance_direction(t):
    return A.guidance_direction(points(t), ["cloud_id"]).select("cloud_id", "direction")


@query("4.16", with_ctes("""WITH h AS (SELECT user_id, strlen(event_type) % 5 AS el, floor(((k*7.3::DOUBLE) % 360)/360*12)::INT % 12 AS b FROM evt),
  c AS (SELECT user_id, el, b AS bin, 10 AS w FROM h UNION ALL SELECT user_id, el, (b+11)%12, 3 FROM h UNION ALL SELECT user_id, el, (b+1)%12, 3 FROM h),
  g AS (SELECT user_id, el, bin, sum(w) v FROM c GROUP BY 1,2,3)
  SELECT user_id, round(count(*) FILTER (v >= 9)/60,6) AS score, round(sum(least(v,10))/600,6) AS density FROM g GROUP BY 1""", EVT))
def azimuth_coverage(t):
    steps = user_events(t).select("user_id", (F.length("event_type") % 5).alias("elevation"), (F.col("k") * 7.3).alias("angle"))
    return A.bin_coverage(steps, ["user_id"], 12, 5).select("user_id", rnd("score").alias("score"), rnd("density").alias("density"))


@query("4.17", with_ctes("""WITH s AS (SELECT user_id, us/1e6 AS t, sqrt(value*value+k*k+96.04::DOUBLE) a, sqrt(value*value/10000+0.25::DOUBLE) g FROM evt)
  SELECT user_id, count(*) AS samples, round(max(t)-min(t),3) duration, round(avg(a),5) mean_accel, round(sqrt(avg(a*a)),5) rms_accel, round(max(a),5) peak_accel, round(avg(g),5) mean_gyro, round(sqrt(avg(g*g)),5) rms_gyro, round(max(g),5) peak_gyro,
   round((count(*)-1)/(max(t)-min(t)),9) AS rate, concat_ws(',', CASE WHEN count(*) < 10 THEN 'few_samples' END, CASE WHEN max(t)-min(t) <= 0 THEN 'zero_duration' END, CASE WHEN (count(*)-1)/(max(t)-min(t)) < 30 THEN 'low_rate' END) AS warnings FROM s GROUP BY 1""", EVT))
def imu_diagnostics(t):
    s = user_events(t).select("user_id", (F.col("us") / 1e6).alias("t"), F.array(F.col("value"), F.col("k").cast("double"), F.lit(9.8)).alias("accel"), F.array(F.col("value") / 100, F.lit(0.5), F.lit(0.0)).alias("gyro"))
    d = A.imu_diagnostics(s, ["user_id"])
    return d.select("user_id", "samples", rnd("duration", 3).alias("duration"), *[rnd(f"{n}_{p}", 5).alias(f"{n}_{p}") for p in ("accel", "gyro") for n in ("mean", "rms", "peak")],
                    rnd("rate", 9).alias("rate"), F.array_join("warnings", ",").alias("warnings"))


@query("4.18", """WITH e AS (SELECT l_linestatus, l_partkey, l_extendedprice/(1000+l_quantity) AS err FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY err)-1 AS i, count(*) OVER (PARTITION BY l_linestatus) AS n FROM e),
  k AS (SELECT l_linestatus, count(*) AS points, avg(c) mt, max(c) xt, count(*) FILTER (c>=2) t2, count(*) FILTER (c>=3) t3 FROM (SELECT l_linestatus, l_partkey, count(*) c FROM e GROUP BY 1,2) GROUP BY 1)
  SELECT l_linestatus, n, round(avg(err),6) mean, round(median(err),6) median, round(min(err) FILTER (i = round((n-1)*0.9::DOUBLE)),6) p90, round(max(err),6) max, any_value(points) points, round(any_value(mt),6) mean_track, any_value(xt) max_track, any_value(t2) two_views, any_value(t3) three_views
  FROM r JOIN k USING (l_linestatus) GROUP BY 1,2""")
def reprojection_statistics(t):
    e = t.lineitem.select("l_linestatus", "l_partkey", (F.col("l_extendedprice") / (1000 + F.col("l_quantity"))).alias("err"))
    s = A.error_statistics(e, ["l_linestatus"], "err").join(A.track_statistics(e, ["l_linestatus"], "l_partkey"), "l_linestatus")
    return s.withColumns({c: rnd(c) for c in ("mean", "median", "p90", "max", "mean_track")})


@query("4.19", """WITH p AS (SELECT l_suppkey, (l_linenumber-4)/10.0::DOUBLE x, (l_discount-0.05::DOUBLE)*10 y, l_tax*100-2 z, l_quantity*10 u, l_partkey%300 v FROM lineitem),
  n AS (SELECT *, x/z nx, y/z ny FROM p WHERE z > 0), d AS (SELECT *, nx*nx+ny*ny r2 FROM n), q AS (SELECT l_suppkey, 500*nx*(1+0.1::DOUBLE*r2+0.01::DOUBLE*r2*r2)+250-u du, 500*ny*(1+0.1::DOUBLE*r2+0.01::DOUBLE*r2*r2)+150-v dv FROM d)
  SELECT s AS l_suppkey, coalesce(round(1/(1+sqrt(avg(du*du+dv*dv))),9),0) AS confidence FROM (SELECT DISTINCT l_suppkey s FROM lineitem) LEFT JOIN q ON q.l_suppkey=s GROUP BY 1""")
def reprojection_confidence(t):
    p = t.lineitem.select("l_suppkey", ((F.col("l_linenumber") - 4) / 10.0).alias("x"), ((F.col("l_discount") - 0.05) * 10).alias("y"), (F.col("l_tax") * 100 - 2).alias("z"),
                          (F.col("l_quantity") * 10).alias("u"), (F.col("l_partkey") % 300).alias("v"))
    nx, ny = G.brown_conrady(F.col("x") / F.col("z"), F.col("y") / F.col("z"), (0.1, 0.01))
    e2 = (500 * nx + 250 - F.col("u")) ** 2 + (500 * ny + 150 - F.col("v")) ** 2
    s = p.groupBy("l_suppkey").agg(F.avg(F.when(F.col("z") > 0, e2)).alias("m"))
    return s.select("l_suppkey", F.coalesce(rnd(1 / (1 + F.sqrt("m")), 9), F.lit(0.0)).alias("confidence"))


@query("4.20", """SELECT l_partkey, min(q) FILTER (i = n//2) AS median, max(n) AS frames FROM (SELECT l_partkey, l_quantity::INT q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity)-1 AS i, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) GROUP BY 1""")
def median_frame_stack(t):
    return A.median_stack(t.lineitem.select("l_partkey", F.col("l_quantity").cast("int").alias("q")), ["l_partkey"], "q")


@query("4.21", """WITH m AS (SELECT l_linenumber, l_suppkey, avg(l_quantity) mean FROM lineitem GROUP BY 1,2), g AS (SELECT *, CASE WHEN mean <= 1 THEN 1 ELSE max(mean) OVER (PARTITION BY l_linenumber)/mean END AS gain FROM m)
  SELECT l_linenumber, l_suppkey, round(avg(least(l_quantity*gain*4.9::DOUBLE,255)),4) AS corrected, round(gain,6) AS gain FROM lineitem JOIN g USING (l_linenumber, l_suppkey) GROUP BY 1,2,4""")
def flat_field_gain(t):
    px = t.lineitem.select("l_linenumber", "l_suppkey", "l_quantity")
    gains = A.gain_map(px, ["l_linenumber"], ["l_suppkey"], "l_quantity")
    out = A.apply_gain(px.withColumn("l_quantity", F.col("l_quantity") * 4.9), gains, ["l_linenumber", "l_suppkey"], "l_quantity")
    return out.groupBy("l_linenumber", "l_suppkey", rnd("gain").alias("gain")).agg(rnd(F.avg("corrected"), 4).alias("corrected"))


@query("4.22", with_ctes("""WITH m AS (SELECT frame_id % 2 AS camera, avg(r) mr, avg(g) mg, avg(b) mb FROM rgb GROUP BY 1) SELECT camera, round((mr+mg+mb)/3/mr,6) gain_r, round((mr+mg+mb)/3/mg,6) gain_g, round((mr+mg+mb)/3/mb,6) gain_b FROM m""", RGB))
def grey_world_gains(t):
    d = A.grey_world(rgb(t).withColumn("camera", F.col("frame_id") % 2), ["camera"])
    return d.select("camera", *[rnd(c).alias(c) for c in d.columns[1:]])


@query("4.24", """WITH v AS (SELECT l_returnflag k, l_extendedprice-30000 AS v FROM lineitem), c AS (SELECT k, min(v) FILTER (i = round((n-1)*0.5::DOUBLE)) centre, max(n) n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v)-1 i, count(*) OVER (PARTITION BY k) n FROM v) GROUP BY 1),
  d AS (SELECT k, v, centre, n, abs(v-centre) dev FROM v JOIN c USING (k)), m AS (SELECT k, min(dev) FILTER (i = round((n-1)*0.5::DOUBLE)) mad FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dev)-1 i FROM d) GROUP BY 1),
  s AS (SELECT k, any_value(n) n, any_value(centre) centre, any_value(mad) mad, count(*) FILTER (dev <= 6*mad/0.67448974::DOUBLE) kept, sqrt(avg(dev*dev) FILTER (dev <= 6*mad/0.67448974::DOUBLE)) sigma FROM d JOIN m USING (k) GROUP BY 1)
  SELECT k AS l_returnflag, any_value(n) n, round(any_value(centre),4)+0.0::DOUBLE centre, round(any_value(mad),4) mad, any_value(kept) kept, round(any_value(sigma),4) sigma, round(avg(v*v) FILTER (abs(v) <= 6*sigma)/1e6,4) second_moment FROM v JOIN s USING (k) GROUP BY 1""")
def robust_sigma(t):
    d = A.robust_sigma(t.lineitem.select("l_returnflag", (F.col("l_extendedprice") - 30000).alias("v")), ["l_returnflag"], "v")
    return d.withColumns({c: rnd(c, 4) for c in ("centre", "mad", "sigma")}).withColumn("second_moment", rnd(F.col("second_moment") / 1e6, 4))


@query("4.37 12.3", with_ctes("""WITH g AS (SELECT cloud_id, floor(x/0.25::DOUBLE)::INT vx, floor(y/0.25::DOUBLE)::INT vy, floor(z/0.25::DOUBLE)::INT vz, count(*) AS n, sum(confidence) AS w, max(confidence) top FROM pts GROUP BY 1,2,3,4),
  q AS (SELECT cloud_id, point_id, x/0.25::DOUBLE-floor(x/0.25::DOUBLE) fx, y/0.25::DOUBLE-floor(y/0.25::DOUBLE) fy, z/0.25::DOUBLE-floor(z/0.25::DOUBLE) fz, floor(x/0.25::DOUBLE) vx, floor(y/0.25::DOUBLE) vy, floor(z/0.25::DOUBLE) vz FROM pts),
  o AS (SELECT * FROM (VALUES (0),(1)) a(i), (VALUES (0),(1)) b(j), (VALUES (0),(1)) c(k))
  SELECT q.cloud_id, q.point_id AS query_id, round(sum((CASE i WHEN 1 THEN fx ELSE 1-fx END)*(CASE j WHEN 1 THEN fy ELSE 1-fy END)*(CASE k WHEN 1 THEN fz ELSE 1-fz END)*coalesce(w,0)),6) AS value
   FROM q, o LEFT JOIN g ON g.cloud_id=q.cloud_id AND g.vx=q.vx+i AND g.vy=q.vy+j AND g.vz=q.vz+k GROUP BY 1,2""", PTS))
def voxel_accumulate_sample(t):
    p = points(t)
    grid = A.accumulate_voxels(p, ["cloud_id"], 0.25, {"n": F.count("*"), "w": F.sum("confidence"), "top": F.max("confidence")})
    q = p.select("cloud_id", F.col("point_id").alias("query_id"), "x", "y", "z")
    return A.sample_trilinear(q, grid, ["cloud_id"], 0.25, "w").withColumn("value", rnd("value"))


@query("4.41", with_ctes("""WITH a AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'meta' WHEN 'click' THEN 'asset' ELSE 'other' END ev, k%5=0 dl, k%7=0 em, us, CASE WHEN k%10=0 THEN '' ELSE 'site'||(k%10) END ref FROM evt),
  r AS (SELECT user_id, string_agg(ref||':'||c, ',' ORDER BY c DESC, ref) top FROM (SELECT user_id, ref, count(*) c FROM a WHERE ref <> '' GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, ref) <= 5) GROUP BY 1)
  SELECT user_id, count(*) FILTER (ev='meta') views, count(*) FILTER (ev='asset') assets, count(*) FILTER (dl) downloads, count(*) FILTER (em) embeds, max(us) last_access, any_value(top) top_referrers FROM a LEFT JOIN r USING (user_id) GROUP BY 1""", EVT))
def share_analytics(t):
    a = user_events(t).select("user_id", F.when(F.col("event_type") == "view", "meta").when(F.col("event_type") == "click", "asset").otherwise("other").alias("event"),
                              (F.col("k") % 5 == 0).alias("download"), (F.col("k") % 7 == 0).alias("embed"), F.col("us").alias("accessed_at"),
                              F.when(F.col("k") % 10 == 0, "").otherwise(F.concat(F.lit("site"), F.col("k") % 10)).alias("referrer"))
    return A.share_analytics(a, "user_id")


@query("4.42", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type='{x}') AS n_{x}" for x in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def scene_node_statistics(t):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return t.events.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == x).alias("n_" + x) for x in kinds])


@query("4.43", """WITH h AS (SELECT l_returnflag p, sum(l_extendedprice) d, sum(l_quantity) i FROM lineitem WHERE l_linestatus='O' GROUP BY 1), r AS (SELECT s_suppkey, CASE s_suppkey%4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' ELSE 'X' END p FROM supplier)
  SELECT s_suppkey, p AS phase, round(d/i*s_suppkey,4) AS predicted FROM r LEFT JOIN h USING (p)""")
def phase_prediction(t):
    h = t.lineitem.select(F.col("l_returnflag").alias("phase"), F.col("l_extendedprice").alias("duration"), F.col("l_quantity").alias("items"), "l_linestatus")
    r = t.supplier.select("s_suppkey", F.element_at(F.array(*map(F.lit, "ANRX")), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("phase"), F.col("s_suppkey").alias("wanted"))
    return A.predict_duration(h, r, "phase", F.col("l_linestatus") == "O").select("s_suppkey", "phase", rnd("predicted", 4).alias("predicted"))


@query("4.44", with_ctes("""WITH s AS (SELECT user_id, us, event_id, k, value, CASE WHEN k%3=0 THEN NULL ELSE k*10 END p1, CASE WHEN k%5=0 THEN NULL ELSE k*11 END p2, CASE WHEN k%4=0 THEN NULL ELSE k%3 END st FROM evt),
  w AS (SELECT user_id, arg_min(struct_pack(k:=k,v:=value,p1:=p1,p2:=p2,st:=st), (us,event_id)) a, arg_max(struct_pack(k:=k,v:=value,p1:=p1,p2:=p2,st:=st), (us,event_id)) b FROM s GROUP BY 1)
  SELECT user_id, greatest(b.k-a.k,0) d_k, round(greatest(b.v-a.v,0),4)+0.0::DOUBLE d_value, greatest(a.p1,a.p2,b.p1,b.p2) peak, greatest(a.st,b.st) max_state FROM w""", EVT))
def telemetry_window(t):
    k = F.col("k")
    s = user_events(t).select("user_id", "us", "event_id", "k", "value", F.when(k % 3 != 0, k * 10).alias("p1"), F.when(k % 5 != 0, k * 11).alias("p2"), F.when(k % 4 != 0, k % 3).alias("st"))
    return A.telemetry_window(s, ["user_id"], ["us", "event_id"], ["k", "value"], ["p1", "p2"], "st").withColumn("d_value", rnd("d_value", 4))


@query("4.46", with_ctes("""WITH r AS (SELECT user_id, us//86400000000 AS frame, row_number() OVER (PARTITION BY user_id, us//86400000000 ORDER BY us, event_id) AS idx, value/100 x, k/100.0::DOUBLE y, k/100.0::DOUBLE g, value/500 b FROM evt),
  c AS (SELECT user_id, frame, avg(x) mx, avg(y) my FROM r GROUP BY 1,2),
  p AS (SELECT a.user_id, a.frame, avg((abs(a.x-b.x)+abs(a.g-b.g)+abs(a.b-b.b))/3) col, avg(sqrt((a.x-b.x)*(a.x-b.x)+(a.g-b.g)*(a.g-b.g))) sh FROM r a JOIN r b ON a.user_id=b.user_id AND a.frame=b.frame+1 AND a.idx=b.idx GROUP BY 1,2)
  SELECT a.user_id, a.frame, CASE WHEN b.mx IS NULL THEN 0.5 ELSE round(least(0.5::DOUBLE*least(sqrt((a.mx-b.mx)*(a.mx-b.mx)+(a.my-b.my)*(a.my-b.my))/2,1)+0.3::DOUBLE*least(col,1)+0.2::DOUBLE*least(sh/2,1),1),6) END AS score
  FROM c a LEFT JOIN c b ON a.user_id=b.user_id AND a.frame=b.frame+1 LEFT JOIN p ON p.user_id=a.user_id AND p.frame=a.frame""", EVT))
def frame_motion_score(t):
    from pyspark.sql import Window
    ev = user_events(t).withColumn("frame", F.floor(F.col("us") / 86_400_000_000))
    idx = F.row_number().over(Window.partitionBy("user_id", "frame").orderBy("us", "event_id"))  # one frame
    x, y = F.col("value") / 100, F.col("k") / 100.0
    r = ev.select("user_id", "frame", idx.alias("idx"), x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"), x.alias("r"), y.alias("g"), (F.col("value") / 500).alias("b"), F.array(x, y).alias("shape"))
    return A.motion_scores(r, ["user_id"], "frame", limits=(2.0, 1.0, 2.0)).withColumn("score", rnd("score"))


# Defect kinds used by the demonstration query: threshold, low is bad, action.
DEFECTS = [("blur", 26.0, True, "refocus"), ("overexposure", 0.052, False, "reduce_exposure"), ("colour_cast", 0.04, False, "white_balance"), ("black_dots", 4.0, False, "refocus")]
_DEF_SQL = {"blur": "avg(l_quantity)", "overexposure": "avg(l_discount)", "colour_cast": "avg(l_tax)", "black_dots": "avg(l_linenumber)"}


@query("4.47", "WITH s AS (" + " UNION ALL ".join(f"SELECT l_suppkey k, '{d}' defect, {_DEF_SQL[d]} sc, {th}::DOUBLE th, {str(lo).lower()} lo, '{a}' act FROM lineitem GROUP BY 1" for d, th, lo, a in DEFECTS)
       + "), b AS (SELECT *, CASE WHEN lo THEN th-sc ELSE sc-th END AS o FROM s) SELECT k AS l_suppkey, round(greatest(1-sum(CASE WHEN o > 0 THEN 0.2::DOUBLE*least(o/th,1) ELSE 0 END),0),6) score, count(*) FILTER (o>0) bad,"
         " coalesce(string_agg(DISTINCT act, ',' ORDER BY act) FILTER (o>0),'') actions FROM b GROUP BY 1")
def capture_quality_score(t):
    # Means that meet a threshold exactly are no defect: sums of decimals, the same in any order of the rows.
    wide = t.lineitem.groupBy("l_suppkey").agg(*[exact_mean(s[4:-1]).alias(d) for d, s in _DEF_SQL.items()])
    rows = wide.unpivot("l_suppkey", list(_DEF_SQL), "defect", "score")
    th = t.spark.createDataFrame(DEFECTS, "defect string, threshold double, low_is_bad boolean, action string")
    return A.quality_scores(rows, ["l_suppkey"], th).withColumn("score", rnd("score"))


@query("4.48", """SELECT doc_id//50 AS batch, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS digest, count(*) AS verified, 50 AS expected FROM documents GROUP BY 1""")
def batch_digests(t):
    d = t.documents.select(F.floor(F.col("doc_id") / 50).alias("batch"), "doc_id", "text")
    return A.batch_digest(d, ["batch"], "doc_id", F.col("text"), F.lit(50))
