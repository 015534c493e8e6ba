"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions.numeric import rnd
from scanloom.operators import predicates as P
from scanloom.plans.inputs import EVT, IMG, PTS, RGB, e, points, rgb, user_events  # noqa: F401
from scanloom.plans.registry import query, with_ctes


@query("2.1", with_ctes("SELECT cloud_id, point_id, confidence FROM pts WHERE confidence >= 0.5", PTS))
def confidence_filter(t):
    return P.filter_confidence(points(t), 0.5).select("cloud_id", "point_id", "confidence")


def splats(t):
    return t.embeddings.select(
        F.col("vec_id").alias("splat_id"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"),
        *[F.floor((e(i) + 1) * 127.5).cast("int").alias(n) for i, n in ((3, "red"), (4, "green"), (5, "blue"), (7, "alpha"))])


SPLATS = """splats AS (SELECT vec_id AS splat_id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[3]::DOUBLE z,
 floor((embedding[4]::DOUBLE+1)*127.5)::INT red, floor((embedding[5]::DOUBLE+1)*127.5)::INT green,
 floor((embedding[6]::DOUBLE+1)*127.5)::INT blue, floor((embedding[8]::DOUBLE+1)*127.5)::INT alpha FROM embeddings)"""


@query("2.2", with_ctes("""SELECT splat_id, alpha, x, y, z FROM splats WHERE alpha >= 115
  AND x BETWEEN -0.2 AND 0.2 AND y BETWEEN -0.2 AND 0.2 AND z BETWEEN -0.2 AND 0.2 AND x*x+y*y+z*z <= 0.2::DOUBLE*0.2::DOUBLE""", SPLATS))
def splat_edits(t):
    edits = [("opacity", 115), ("box", (-0.2,) * 3, (0.2,) * 3), ("sphere", (0.0, 0.0, 0.0), 0.2)]
    return P.apply_edits(splats(t), edits).select("splat_id", "alpha", "x", "y", "z")


@query("2.3", with_ctes("""SELECT cloud_id, point_id, (x BETWEEN -0.1 AND 0.15) AND (y BETWEEN -0.1 AND 0.15)
  AND (z BETWEEN -0.1 AND 0.15) AS inside FROM pts""", PTS))
def capture_volume(t):
    return points(t).select("cloud_id", "point_id", P.inside_box((-0.1,) * 3, (0.15,) * 3).alias("inside"))


@query("2.5", """SELECT l_orderkey, l_partkey, l_linenumber, count(*) AS n, concat_ws(',',
   CASE WHEN NOT l_quantity BETWEEN 1 AND 45 THEN 'quantity_range' END,
   CASE WHEN NOT l_discount BETWEEN 0 AND 0.09 THEN 'discount_range' END,
   CASE WHEN NOT l_tax BETWEEN 0 AND 1 THEN 'tax_normalised' END,
   CASE WHEN NOT l_tax > 0 THEN 'tax_positive' END,
   CASE WHEN NOT length(l_returnflag) > 0 THEN 'flag_empty' END,
   CASE WHEN NOT l_quantity * l_linenumber >= 10 THEN 'min_count' END,
   CASE WHEN NOT (l_quantity > 0 AND l_quantity <= 65536 AND l_linenumber > 0 AND l_linenumber <= 65536) THEN 'image_dimensions' END) AS failed
  FROM lineitem GROUP BY ALL""")
def record_validation(t):
    rules = {
        "quantity_range": F.col("l_quantity").between(1, 45),
        "discount_range": F.col("l_discount").between(0, 0.09),
        "tax_normalised": F.col("l_tax").between(0, 1),
        "tax_positive": F.col("l_tax") > 0,
        "flag_empty": F.length("l_returnflag") > 0,
        "min_count": F.col("l_quantity") * F.col("l_linenumber") >= 10,
        "image_dimensions": F.col("l_quantity").between(1, 65536) & F.col("l_linenumber").between(1, 65536),
    }
    return (t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.array_join(P.failed_rules(rules), ",").alias("failed"))
            .groupBy("l_orderkey", "l_partkey", "l_linenumber", "failed").agg(F.count("*").alias("n")))


def capture_groups(t):
    """One capture group per order: a frame per line, ordered by part and line."""
    frames = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber", "l_quantity"))).alias("f"))
    steps = (F.lit(1) + F.col("l_orderkey") % 3).cast("int")
    paths = F.transform("f", lambda f, i: F.concat(
        F.when(f.l_quantity >= 50, F.lit("../")).otherwise(F.lit("cap/")), f.l_partkey, F.lit("_"), f.l_linenumber, F.lit(".nef")))
    n = F.size("f")
    bursts = F.lit(1)
    exposures = F.greatest(F.floor(n / steps), F.lit(1)).cast("int")
    order = F.transform("paths", lambda p, i: F.struct(
        i.alias("frame_index"), F.floor(i / (F.col("exposures") * F.col("bursts"))).cast("int").alias("focus_index"),
        F.floor((i % (F.col("exposures") * F.col("bursts"))) / F.col("bursts")).cast("int").alias("exposure_index"),
        (i % F.col("bursts")).alias("burst_index"), (i == F.floor(F.size("paths") / 2)).alias("sequence_reference")))
    return (frames.select(
        F.sha2(F.concat(F.lit("order-"), F.col("l_orderkey")), 256).alias("full_id"), "l_orderkey", steps.alias("focus_steps"),
        paths.alias("paths"), exposures.alias("exposures"), bursts.alias("bursts"))
        .withColumn("group_id", F.when(F.col("l_orderkey") % 50 == 0, F.substring("full_id", 1, 60)).otherwise(F.col("full_id")))
        .withColumn("frame_order", order).drop("full_id"))


@query("2.6", """WITH f AS (SELECT l_orderkey, count(*)::INT n, count(*) FILTER (l_quantity >= 50) up FROM lineitem GROUP BY 1),
 g AS (SELECT *, (1 + l_orderkey % 3)::INT AS s FROM f)
 SELECT l_orderkey, n AS frames, concat_ws(',', CASE WHEN l_orderkey % 50 = 0 THEN 'id_not_sha256' END,
   CASE WHEN n % s <> 0 THEN 'frames_not_divisible' END,
   CASE WHEN (n-1) // greatest(n // s, 1) >= s THEN 'order_not_contiguous' END,
   CASE WHEN up > 0 THEN 'path_traversal' END) AS failed FROM g""")
def manifest_group_rules(t):
    return capture_groups(t).select("l_orderkey", F.size("paths").alias("frames"),
                                    F.array_join(P.manifest_group_failures(), ",").alias("failed"))


@query("2.7", """WITH o AS (SELECT *, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderdate END AS created_at,
   o_orderdate + INTERVAL 100 DAY AS mtime, CASE o_orderstatus WHEN 'O' THEN 700 WHEN 'F' THEN 0 ELSE 1200 END AS lim FROM orders)
  SELECT o_orderkey, o_orderstatus AS scope FROM o WHERE lim > 0
   AND floor((epoch_us(TIMESTAMP '2001-01-01 06:00:00') - epoch_us(coalesce(created_at, mtime))) / 86400000000) > lim""")
def retention_drop_list(t):
    limit = F.when(F.col("o_orderstatus") == "O", 700).when(F.col("o_orderstatus") == "F", 0).otherwise(1200)
    created = F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderdate"))
    mtime = F.col("o_orderdate") + F.expr("INTERVAL 100 DAYS")
    stamp = F.coalesce(created, mtime).cast("timestamp")
    return (t.orders.filter(P.expired(stamp, F.lit("2001-01-01 06:00:00").cast("timestamp"), limit))
            .select("o_orderkey", F.col("o_orderstatus").alias("scope")))


@query("2.8", """WITH pick AS (SELECT o_custkey AS k, substr(o_orderpriority,1,1) AS slot, arg_max(struct_pack(rms := o_totalprice,
   ts := CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END), (epoch_us(o_orderdate), o_orderkey)) AS c
   FROM orders GROUP BY 1, 2),
  j AS (SELECT s_suppkey, coalesce(p.c.rms, i.c.rms)/400000 AS rms, coalesce(p.c.ts, i.c.ts) AS ts,
    coalesce(pc.c.rms, ic.c.rms)/50000 AS de, coalesce(pc.c.ts, ic.c.ts) AS cts
   FROM supplier LEFT JOIN pick p ON p.k=s_suppkey AND p.slot='1' LEFT JOIN pick i ON i.k=s_suppkey AND i.slot='2'
   LEFT JOIN pick pc ON pc.k=s_suppkey AND pc.slot='3' LEFT JOIN pick ic ON ic.k=s_suppkey AND ic.slot='4')
  SELECT s_suppkey AS camera_id, concat_ws(',', CASE WHEN rms > 0.8 THEN 'rms_high' END, CASE WHEN rms IS NULL THEN 'rms_missing' END,
   CASE WHEN ts IS NULL THEN 'time_missing' END, CASE WHEN ts IS NOT NULL AND try_cast(ts AS DATE) IS NULL THEN 'time_invalid' END,
   CASE WHEN date_diff('day', try_cast(ts AS DATE), DATE '2000-01-01') > 30 THEN 'time_old' END,
   CASE WHEN de > 6 THEN 'colour_high' END, CASE WHEN de IS NULL THEN 'colour_missing' END,
   CASE WHEN cts IS NULL THEN 'colour_time_missing' END, CASE WHEN cts IS NOT NULL AND try_cast(cts AS DATE) IS NULL THEN 'colour_time_invalid' END,
   CASE WHEN date_diff('day', try_cast(cts AS DATE), DATE '2000-01-01') > 30 THEN 'colour_time_old' END) AS warnings FROM j""")
def calibration_freshness(t):
    text = F.when(F.col("o_orderstatus") == "P", F.lit("unknown")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    slots = t.orders.withColumn("slot", F.substring("o_orderpriority", 1, 1))
    pick = F.struct("o_orderdate", "o_orderkey")
    latest = slots.groupBy(F.col("o_custkey").alias("s_suppkey")).agg(*[
        F.max_by(F.struct(F.col("o_totalprice").alias("v"), text.alias("ts")), F.when(F.col("slot") == s, pick)).alias("c" + s)
        for s in "1234"])
    j = t.supplier.join(latest, "s_suppkey", "left").select(
        F.col("s_suppkey").alias("camera_id"),
        (F.coalesce("c1.v", "c2.v") / 400000).alias("rms"), F.coalesce("c1.ts", "c2.ts").alias("ts"),
        (F.coalesce("c3.v", "c4.v") / 50000).alias("de"), F.coalesce("c3.ts", "c4.ts").alias("cts"))
    return j.select("camera_id", F.array_join(P.messages(freshness_conditions("2000-01-01 00:00:00")), ",").alias("warnings"))


def freshness_conditions(now: str, max_rms=0.8, max_age=30, max_de=6.0):
    def age(c):
        parsed = F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd"))
        return parsed, F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(parsed)) / 86_400_000_000)

    (ts, days), (cts, cdays) = age("ts"), age("cts")
    return {
        "rms_high": F.col("rms") > max_rms, "rms_missing": F.col("rms").isNull(),
        "time_missing": F.col("ts").isNull(), "time_invalid": F.col("ts").isNotNull() & ts.isNull(), "time_old": days > max_age,
        "colour_high": F.col("de") > max_de, "colour_missing": F.col("de").isNull(),
        "colour_time_missing": F.col("cts").isNull(), "colour_time_invalid": F.col("cts").isNotNull() & cts.isNull(),
        "colour_time_old": cdays > max_age,
    }


# Fixed values: (metric, direction of failure, tolerance).
GATE = [("psnr_db", -1, 0.1), ("ssim", -1, 0.005), ("chamfer", 1, 0.5), ("hausdorff", 1, 0.5), ("fscore", -1, 0.02),
        ("normal_consistency", -1, 0.02), ("seg_iou", -1, 0.02), ("seg_dice", -1, 0.02)]

_METRIC_SQL = {
    "psnr_db": "avg(l_quantity)", "ssim": "avg(l_discount)", "chamfer": "avg(l_extendedprice)/1000", "hausdorff": "max(l_extendedprice)/1000",
    "fscore": "avg(l_tax)*10", "normal_consistency": "avg(l_linenumber)/7", "seg_iou": "avg(l_discount)*10",
    "seg_dice": "max(CASE WHEN l_tax > 1 THEN l_tax END)",
}


def _metrics(df, period):
    names = [m for m, _, _ in GATE]
    wide = df.filter(F.col("l_linestatus") == period).groupBy("l_returnflag", "l_linenumber").agg(
        *[F.expr(_METRIC_SQL[m]).alias(m) for m in names])
    return wide.unpivot(["l_returnflag", "l_linenumber"], names, "metric", "value")


@query("2.9", "WITH m AS (SELECT l_returnflag, l_linenumber, l_linestatus, " + ", ".join(f"{s} AS {m}" for m, s in _METRIC_SQL.items())
       + " FROM lineitem GROUP BY 1,2,3), d AS ("
       + " UNION ALL ".join(f"SELECT o.l_returnflag, o.l_linenumber, '{m}' AS metric, o.{m} - f.{m} AS delta, {d} AS dir, {tol}::DOUBLE AS tol "
                            "FROM m o JOIN m f ON o.l_returnflag=f.l_returnflag AND o.l_linenumber=f.l_linenumber "
                            "WHERE o.l_linestatus='O' AND f.l_linestatus='F'" for m, d, tol in GATE)
       + ") SELECT l_returnflag, l_linenumber, metric, round(delta, 4) AS delta FROM d WHERE dir*delta > tol")
def baseline_gate(t):
    li = t.lineitem
    tol = t.spark.createDataFrame(GATE, "metric string, direction int, tolerance double")
    return (P.gate_failures(_metrics(li, "O"), _metrics(li, "F"), ["l_returnflag", "l_linenumber"], tol)
            .select("l_returnflag", "l_linenumber", "metric", rnd("delta", 4).alias("delta")))


@query("2.10", with_ctes("""WITH plate AS (SELECT y, x, floor(avg(r))::INT pr, floor(avg(g))::INT pg, floor(avg(b))::INT pb FROM rgb GROUP BY 1,2)
  SELECT frame_id, count(*) FILTER (sqrt((r-120)*(r-120)+(g-130)*(g-130)+(b-125)*(b-125)) > 0.1::DOUBLE*441.6::DOUBLE) AS chroma_fg,
   count(*) FILTER (abs(r-pr)+abs(g-pg)+abs(b-pb) > 60) AS plate_fg, count(*) AS pixels
  FROM rgb JOIN plate USING (y, x) GROUP BY 1""", RGB))
def key_masks(t):
    px = rgb(t)
    plate = px.groupBy("y", "x").agg(*[F.floor(F.avg(c)).cast("int").alias("p" + c) for c in "rgb"])
    return (px.join(plate, ["y", "x"])  # the optimizer broadcasts a plate that is small enough
            .groupBy("frame_id").agg(F.count_if(P.chroma_foreground((120, 130, 125), 0.1)).alias("chroma_fg"),
                                     F.count_if(P.difference_foreground(60)).alias("plate_fg"), F.count("*").alias("pixels")))


def moving_splats(t):
    w = F.pmod("us", F.lit(86_400_000_000)) / 86_400_000_000.0
    return user_events(t).select(
        F.col("event_id").alias("splat_id"), w.alias("centre_t"), (w - 0.3).alias("t0"), (w + 0.2).alias("t1"),
        (F.lit(0.001) + F.col("value") / 10000.0).alias("var_t"), (F.col("k") / 100.0).alias("opacity"),
        F.col("value").alias("x"), (F.col("value") * 2).alias("y"), F.col("k").cast("double").alias("z"),
        (F.col("k") / 10.0).alias("vx"), F.lit(1.0).alias("vy"), (F.col("value") / 50.0).alias("vz"))


MOV = EVT + """, mov AS (SELECT event_id AS splat_id, (us % 86400000000)/86400000000.0::DOUBLE AS w, 0.001::DOUBLE + value/10000.0::DOUBLE AS var_t,
  k/100.0::DOUBLE AS opacity, value AS x, value*2 AS y, k::DOUBLE AS z, k/10.0::DOUBLE AS vx, 1.0::DOUBLE AS vy, value/50.0::DOUBLE AS vz FROM evt)"""


@query("2.11", with_ctes("""WITH s AS (SELECT *, 0.5::DOUBLE - w AS dt, exp(-0.5::DOUBLE*(0.5::DOUBLE-w)*(0.5::DOUBLE-w)/var_t) AS weight FROM mov)
  SELECT splat_id, round(x+vx*dt,6)+0.0::DOUBLE x, round(y+vy*dt,6)+0.0::DOUBLE y, round(z+vz*dt,6)+0.0::DOUBLE z,
   round(opacity*weight,6) opacity, round(weight,6) weight FROM s WHERE 0.5 BETWEEN w-0.3::DOUBLE AND w+0.2::DOUBLE AND weight >= 0.01""", MOV))
def visible_at_time(t):
    v = P.visible_at(moving_splats(t), 0.5)
    return v.select("splat_id", *[rnd(c).alias(c) for c in ("x", "y", "z", "opacity", "weight")])


@query("2.12", with_ctes("""WITH o AS (SELECT user_id AS splat_id, (us - 1704067200000000)//3600000000 AS frame, value/100 AS opacity FROM evt),
  s AS (SELECT splat_id, min(frame) birth, coalesce(max(frame) FILTER (opacity > 0.2), min(frame)) last_active, count(*) FILTER (opacity > 0.2) n,
   coalesce(sum(opacity) FILTER (opacity > 0.2), 0) tot FROM o GROUP BY 1)
  SELECT splat_id, birth, last_active, n AS active_frames, round(tot/greatest(n,1),6) average, round(n/(720-birth+1),6) ratio,
   (last_active-birth+1 < 10 OR 720-last_active > 30 OR tot/greatest(n,1) < 0.01 OR n/(720-birth+1) < 0.055) AS prune FROM s""", EVT))
def lifespan_pruning(t):
    obs = user_events(t).select(F.col("user_id").alias("splat_id"),
                                F.floor((F.col("us") - 1704067200000000) / 3600000000).cast("long").alias("frame"),
                                (F.col("value") / 100).alias("opacity"))
    p = P.lifespan_prune(obs, 720, active_over=0.2, min_ratio=0.055)
    return p.withColumns({"average": rnd("average"), "ratio": rnd("ratio")})


@query("2.13", """SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name),'ring') OR contains(lower(p_type),'ring')
  OR contains(lower(p_brand),'ring')""")
def catalogue_filter(t):
    return P.tagged(t.part, "RING", ["p_name", "p_type", "p_brand"]).orderBy(F.desc("p_partkey")).select("p_partkey", "p_name", "p_brand")
