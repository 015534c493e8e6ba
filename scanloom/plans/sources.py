"""Readers and writers exercised on data derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions.numeric import rnd
from scanloom.functions.registry import Plugins, Ramp, hamming_bits
from scanloom.operators import search as Q
from scanloom.operators.ordering import ranked_within
from scanloom.plans.inputs import PTS, EVT, e, points, user_events
from scanloom.plans.registry import query, with_ctes
from scanloom.session import scratch_path
from scanloom.sources import operational as O
from scanloom.sources import tables as S

@query("1.1", "SELECT DISTINCT page_id // 10 AS folder, true AS sized FROM pages")
def file_inventory(t):
    """Pages written in folders of ten, one file each, and the files listed again."""
    target = scratch_path(t.spark, "inventory")
    t.pages.select(F.floor(F.col("page_id") / 10).alias("folder"), F.col("url").alias("value")).repartition("folder").write.partitionBy("folder").text(target)
    d = S.list_files(t.spark, target, ("txt",))
    return d.select(F.regexp_extract("path", r"folder=(\d+)", 1).cast("long").alias("folder"), (F.col("size") > 0).alias("sized"))


def order_groups(t):
    f = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))).alias("f"))
    paths = F.transform("f", lambda p: F.concat(F.when(F.col("l_orderkey") % 40 == 7, F.lit("../")).otherwise(F.lit("cap/")), p.l_partkey, F.lit("_"), p.l_linenumber, F.lit(".nef")))
    return f.select(paths.alias("paths"), (F.col("l_orderkey") % 3 + 1).cast("int").alias("focus_steps"), F.array(F.lit(0.01), F.lit(0.02)).alias("shutter_speeds"), F.lit(1).alias("burst_factor"), "l_orderkey")


@query("1.2 1.3", "WITH f AS (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) SELECT CASE WHEN l_orderkey % 40 = 7 THEN 'traversal' ELSE 'ok' END AS outcome, count(*) AS groups, sum(n)::BIGINT AS frames FROM f GROUP BY 1")
def manifest_round_trip(t):
    target = scratch_path(t.spark, "manifest")
    S.write_manifest(order_groups(t).drop("l_orderkey"), target, "captures")
    good, bad = S.read_manifest(t.spark, target)
    n = F.size(F.from_json(F.get_json_object("value", "$.paths"), "array<string>")).cast("long")
    rows = good.select(F.lit("ok").alias("outcome"), F.size("paths").cast("long").alias("n")).unionByName(bad.select(F.array_join("reasons", ",").alias("outcome"), n.alias("n")))
    return rows.groupBy("outcome").agg(F.count("*").alias("groups"), F.sum("n").alias("frames"))


@query("1.4", """WITH f AS (SELECT l_orderkey, l_partkey || '_' || l_linenumber || '.nef' AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber)-1 AS i, count(*) OVER (PARTITION BY l_orderkey) n FROM lineitem)
  SELECT l_orderkey, i::INT AS frame_index, CASE WHEN l_orderkey%40=7 THEN '../' ELSE 'cap/' END || name AS path, (i//2)::INT focus_index, (i%2)::INT exposure_index, 0 AS burst_index, i = least(l_orderkey%5, n-1) AS sequence_reference FROM f""")
def frame_explosion(t):
    return S.explode_frames(order_groups(t).withColumn("reference", (F.col("l_orderkey") % 5).cast("int")), ["l_orderkey"])


@query("1.5 1.16", with_ctes("SELECT cloud_id, point_id, round(x,6)+0.0::DOUBLE x, round(y,6)+0.0::DOUBLE y, round(z,6)+0.0::DOUBLE z FROM pts", PTS))
def point_cloud_round_trip(t):
    """Clouds written as ASCII PLY in several files each and scanned back; ids follow the row order."""
    target = scratch_path(t.spark, "clouds")
    S.write_point_clouds(points(t), target, per_file=40)
    back, _ = S.read_point_clouds(t.spark, target)
    rows = ranked_within(points(t).select("cloud_id", "point_id"), ["cloud_id"], [F.col("point_id")], into="row")
    d = rows.join(back.select(F.col("cloud_id").cast("int").alias("cloud_id"), F.col("point_id").alias("row"), "x", "y", "z"), ["cloud_id", "row"])
    return d.select("cloud_id", "point_id", *[rnd(c).alias(c) for c in "xyz"])


@query("1.7", """SELECT count(*) AS splats, sum(floor((embedding[8]::DOUBLE+1)*127.5))::BIGINT AS alpha, round(sum(embedding[1]::DOUBLE),4)+0.0::DOUBLE AS x FROM embeddings""")
def splat_round_trip(t):
    b = lambda i: F.floor((e(i) + 1) * 127.5).cast("int")
    s = t.embeddings.select(*[e(i).cast("float").alias(n) for i, n in enumerate(("x", "y", "z"))], *[e(8 + i).cast("float").alias(n) for i, n in enumerate(("sx", "sy", "sz"))], *[b(i).alias(n) for i, n in ((3, "r"), (4, "g"), (5, "b"), (7, "a"))], *[b(11 + i).alias(f"q{i}") for i in range(4)])
    target = scratch_path(t.spark, "splats")
    S.write_splats(s, target)
    back = S.read_splats(t.spark, target)
    return back.agg(F.count("*").alias("splats"), F.sum("a").alias("alpha"), rnd(F.sum(F.col("x").cast("double")), 4).alias("x"))


@query("1.9", with_ctes("SELECT user_id, count(*) AS samples, round(avg(value),9) AS ax FROM evt GROUP BY 1", EVT))
def imu_timelines(t):
    s = F.struct((F.col("us") / 1e6).alias("timestamp"), F.array("value", F.col("k").cast("double"), F.lit(9.8)).alias("accel"), F.array(F.lit(0.1), F.lit(0.0), F.lit(0.0)).alias("gyro"))
    docs = user_events(t).groupBy("user_id", F.floor(F.col("us") / 86_400_000_000).alias("day")).agg(F.to_json(F.struct(F.collect_list(s).alias("samples"))).alias("body"))  # one document per day
    return S.imu_samples(docs, "user_id", "body").groupBy("user_id").agg(F.count("*").alias("samples"), rnd(F.avg(F.get("accel", F.lit(0))), 9).alias("ax"))


@query("1.9", """SELECT vec_id//16 AS scan, (vec_id%16)::INT AS frame, round(embedding[4]::DOUBLE,6)+0.0::DOUBLE tx, round(embedding[12]::DOUBLE,6)+0.0::DOUBLE tz FROM embeddings""", name="live_scan_poses")
def live_scan_poses(t):
    f = F.struct(F.concat(F.lit("img"), "vec_id").alias("image_path"), F.col("vec_id").cast("double").alias("timestamp"), F.transform(F.slice("embedding", 1, 16), lambda v: v.cast("double")).alias("matrix"))
    docs = t.embeddings.groupBy(F.floor(F.col("vec_id") / 16).alias("scan")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", f.alias("f")))), lambda s: s.f).alias("frames"))).alias("body"))
    return S.live_poses(docs, "scan", "body").select("scan", "frame", rnd("tx").alias("tx"), rnd("tz").alias("tz"))


def report_files(t):
    i = F.col("event_id")
    body = F.when(i % 11 == 0, "broken").otherwise(F.to_json(F.struct(F.when(i % 13 == 0, "old").otherwise("report-v1").alias("schema"), F.col("user_id").cast("string").alias("group_id"), F.when(i % 17 == 0, 0).otherwise(F.get_json_object("props", "$.k").cast("int") + 1).alias("frames"),
                                                                     F.array((i % 300).cast("string"), ((i * 7) % 300).cast("string")).alias("artifacts"))))
    path = F.concat(F.lit("reports/"), F.floor(i / 2), F.when(i % 2 == 1, ".json.enc").otherwise(".json"))
    return t.events.select(path.alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("mtime"), body.alias("body"))


@query("1.10", """WITH b AS (SELECT event_id AS i, user_id, epoch_us(ts) AS mtime FROM events WHERE event_id % 2 = 0 ORDER BY mtime DESC LIMIT 2000),
  r AS (SELECT *, CASE WHEN i%11=0 THEN 'unreadable' WHEN i%13=0 THEN 'schema' WHEN i%17=0 THEN 'no_frames' END AS reject FROM b)
  SELECT 'reports/' || (i//2) || '.json' AS logical, mtime, reject, CASE WHEN reject IS NULL THEN 2 ELSE 0 END AS artifacts, CASE WHEN reject IS NULL THEN (i%300 >= 200)::INT + ((i*7)%300 >= 200)::INT ELSE 0 END AS missing FROM r""")
def provenance_reports(t):
    inv = t.documents.select((F.col("doc_id") % 200).cast("string").alias("path")).distinct()
    d = S.parse_reports(S.pick_reports(report_files(t), 2000), inv, "report-v1")
    return d.select("logical", "mtime", "reject", "artifacts", "missing")


@query("1.11", "SELECT event_id AS seq, event_type AS action, 'user' || user_id AS actor FROM events WHERE event_id % 10 <> 3 ORDER BY event_id DESC LIMIT 500")
def audit_log_tail(t):
    i = F.col("event_id")
    ev = F.struct(i.cast("string").alias("id"), F.concat(F.lit("user"), "user_id").alias("actor"), F.col("event_type").alias("action"), F.lit("scan").alias("resource"))
    line = F.when(i % 10 == 3, F.lit('{"event": broken')).otherwise(F.to_json(F.struct(ev.alias("event"), F.sha2(i.cast("string"), 256).alias("prev_hash"), F.sha2((i + 1).cast("string"), 256).alias("hash"))))
    return S.read_audit(t.events.select(i.alias("seq"), line.alias("value")), "seq", 500).select("seq", "action", "actor")


@query("1.12", "SELECT l_suppkey::VARCHAR AS run_id, l_linenumber::VARCHAR AS sequence, l_returnflag AS label, count(*) AS count, round(avg(l_quantity),9) AS mean_ms FROM lineitem GROUP BY 1,2,3")
def benchmark_documents(t):
    g = t.lineitem.groupBy("l_suppkey", "l_linenumber", "l_returnflag").agg(F.count("*").alias("count"), F.avg("l_quantity").alias("mean_ms"), F.min("l_quantity").alias("min_ms"), F.max("l_quantity").alias("max_ms"))
    timing = F.struct("l_returnflag", F.struct("count", "mean_ms", "min_ms", "max_ms"))
    seq = g.groupBy("l_suppkey", "l_linenumber").agg(F.map_from_entries(F.collect_list(timing)).alias("timings"), F.sum("count").cast("int").alias("frame_count"))  # three labels
    doc = seq.groupBy("l_suppkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("id"), "frame_count", F.lit(0.0).alias("load_total_ms"), "timings")).alias("sequences"))
    body = doc.select(F.to_json(F.struct(F.col("l_suppkey").cast("string").alias("run_id"), "sequences")).alias("body"))
    return S.bench_timings(body, "body").select("run_id", "sequence", "label", "count", rnd("mean_ms", 9).alias("mean_ms"))


@query("1.13", "SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_partkey%20=0 THEN 'license' END, CASE WHEN p_type NOT IN ('SMALL','ECONOMY') THEN 'modality' END, CASE WHEN p_size-5 <= 0 THEN 'size' END) AS failures FROM part")
def dataset_manifest(t):
    i = F.col("p_partkey")
    m = F.when(F.col("p_type") == "SMALL", "rgb").when(F.col("p_type") == "ECONOMY", "depth").otherwise("video")
    d = t.part.select(i.alias("id"), F.col("p_name").alias("name"), F.lit("1").alias("version"), F.when(i % 20 != 0, "CC0").alias("license"), m.alias("modality"), (F.col("p_size") - 5).alias("size_bytes"))
    return S.check_datasets(d).select("id", F.array_join("failures", ",").alias("failures"))


@query("1.14", """SELECT 'jobs' AS relation, count(*) AS rows FROM orders UNION ALL SELECT 'share_links', count(*) FROM customer UNION ALL SELECT 'share_access', count(*) FROM events UNION ALL SELECT 'login_failures', count(DISTINCT user_id) FROM events WHERE event_type='error'""")
def operational_tables(t):
    rel = {"jobs": t.orders, "share_links": t.customer, "share_access": t.events, "login_failures": t.events.filter("event_type = 'error'").select("user_id").distinct()}
    out = None
    for name, d in rel.items():
        d = d.agg(F.lit(name).alias("relation"), F.count("*").alias("rows"))
        out = d if out is None else out.unionByName(d)
    return out


NOW = 1705968000


@query("1.14", f"""WITH j AS (SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 50 <> 0 THEN 'r' || (o_orderkey - CASE WHEN o_orderkey % 300 = 7 THEN 6 ELSE 0 END) END AS request_id,
   CASE WHEN o_orderkey % 90 = 5 THEN NULL ELSE o_orderstatus END AS status FROM orders),
  js AS (SELECT *, status IS NULL AS lost, row_number() OVER (PARTITION BY status IS NULL, request_id ORDER BY id) AS n FROM j),
  l AS (SELECT c_custkey, c_custkey % 5 = 0 AS revoked, {NOW} + (c_custkey % 100 - 20) * 86400 AS expires_at, CASE WHEN c_custkey % 3 > 0 THEN 3 END AS max_uses, c_custkey % 4 AS uses FROM customer),
  p AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey // 2 ORDER BY c_custkey::VARCHAR) AS n FROM customer),
  f AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
  SELECT 'jobs' AS relation, CASE WHEN lost THEN 'status_missing' WHEN request_id IS NOT NULL AND n > 1 THEN 'request_id_taken' ELSE 'ok' END AS outcome, count(*) AS rows FROM js GROUP BY 2
  UNION ALL SELECT 'share_links', CASE WHEN NOT revoked AND expires_at > {NOW} AND (max_uses IS NULL OR uses < max_uses) THEN 'active' ELSE 'ended' END, count(*) FROM l GROUP BY 2
  UNION ALL SELECT 'share_public', CASE WHEN n > 1 THEN 'short_code_taken' ELSE 'ok' END, count(*) FROM p GROUP BY 2
  UNION ALL SELECT 'share_access', 'ok', count(*) FROM events
  UNION ALL SELECT 'login_failures', 'ok', count(*) FROM f""")
def operational_relations(t):
    """Every relation written with its schema and keys and read again, rejects by reason."""
    folder = scratch_path(t.spark, "relations")
    o, c, i = F.col("o_orderkey"), F.col("c_custkey"), F.lit("2024-01-01T00:00:00Z")
    jobs = t.orders.select(
        o.alias("id"), F.when(o % 50 != 0, F.concat(F.lit("r"), o - F.when(o % 300 == 7, 6).otherwise(0))).alias("request_id"), F.lit("process").alias("kind"), F.col("o_orderpriority").alias("name"), F.lit("{}").alias("payload"),
        F.when(o % 90 != 5, F.col("o_orderstatus")).alias("status"), F.lit("0.5").alias("progress"), i.alias("created_at"), F.lit(1).alias("attempt_count"), F.lit(3).alias("max_attempts"), i.alias("updated_at"), F.lit("x").alias("unknown"))
    links = t.customer.select(
        F.sha2(c.cast("string"), 256).alias("token_hash"), F.col("c_nationkey").alias("project_id"), F.lit("a.ply").alias("asset_path"), F.lit(0).alias("created_at"), (F.lit(NOW) + (c % 100 - 20) * 86400).alias("expires_at"),
        F.when(c % 3 > 0, 3).alias("max_uses"), (c % 4).alias("uses"), F.lit(True).alias("allow_download"), F.lit(False).alias("allow_embed"), (c % 5 == 0).alias("revoked"))
    public = t.customer.select(c.cast("string").alias("token_hash"), c.alias("public_token"), F.floor(c / 2).alias("short_code"), F.lit(0).alias("created_at"), F.lit(0).alias("updated_at"), F.lit(True).alias("is_public"))
    access = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("token_hash"), F.col("event_type").alias("event"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("accessed_at"), F.lit(False).alias("embed"), F.lit(False).alias("download"))
    failures = t.events.filter("event_type = 'error'").groupBy(F.col("user_id").alias("identity_hash")).agg(F.count("*").alias("failed_attempts"), F.lit(0).alias("window_started"), F.lit(0).alias("locked_until"), F.lit(0).alias("updated_at"))
    out = None
    for name, rows in {"jobs": jobs, "share_links": links, "share_public": public, "share_access": access, "login_failures": failures}.items():
        bad = O.save(rows, name, folder).select(F.array_join("reasons", ",").alias("outcome"))
        good = O.load(t.spark, folder, name)
        if name == "share_links":
            active = O.active_links(good, F.lit(NOW)).select("token_hash", F.lit("active").alias("outcome"))
            good = good.join(active, "token_hash", "left").select(F.coalesce("outcome", F.lit("ended")).alias("outcome"))
        else:
            good = good.select(F.lit("ok").alias("outcome"))
        part = good.unionByName(bad).groupBy("outcome").agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "outcome", "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("1.15", with_ctes("""SELECT cloud_id, round(min(x),6)+0.0::DOUBLE AS x0, round(max(x),6) AS x1, 5 AS corners FROM pts GROUP BY 1""", PTS))
def measurement_sinks(t):
    """Bounds as CSV and the outline as GeoJSON, both read back."""
    m = points(t).groupBy("cloud_id").agg(*[f(a).alias(n) for a, n, f in (("x", "x0", F.min), ("x", "x1", F.max), ("y", "y0", F.min), ("y", "y1", F.max))])
    csv, geo = scratch_path(t.spark, "measurements"), scratch_path(t.spark, "outlines")
    S.write_measurements(m, csv)
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("corner"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))])).alias("c")
    S.outline_geojson(m.select("cloud_id", corner).select("cloud_id", "c.*"), "cloud_id").select(F.to_json(F.struct("cloud_id", "feature")).alias("value")).write.text(geo)
    back = t.spark.read.schema("cloud_id int, x0 double, x1 double, y0 double, y1 double").option("header", True).csv(csv)
    ring = F.from_json(F.get_json_object(F.get_json_object("value", "$.feature"), "$.geometry.coordinates"), "array<array<array<double>>>")
    feats = t.spark.read.text(geo).select(F.get_json_object("value", "$.cloud_id").cast("int").alias("cloud_id"), F.size(F.get(ring, F.lit(0))).alias("corners"))
    return back.join(feats, "cloud_id").select("cloud_id", rnd("x0").alias("x0"), rnd("x1").alias("x1"), "corners")


BM = """tk AS (SELECT doc_id, 'text' AS field, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM documents UNION ALL SELECT doc_id, 'source', unnest(list_filter(regexp_split_to_array(lower(source), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) FROM documents),
  ln AS (SELECT field, doc_id, count(*) AS len FROM tk GROUP BY 1,2), st AS (SELECT f.field, (SELECT count(*) FROM documents) AS docs, sum(len)/(SELECT count(*) FROM documents) AS al FROM (VALUES ('text'),('source')) f(field) JOIN ln ON ln.field=f.field GROUP BY 1),
  tf AS (SELECT field, term, doc_id, count(*) AS tf FROM tk GROUP BY 1,2,3), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY 1,2),
  qt AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM benchmark)"""


@query("11.1", with_ctes("""WITH s AS (SELECT item_id, tf.doc_id, round(sum(ln(1+(docs-df+0.5::DOUBLE)/(df+0.5::DOUBLE))*tf*2.2::DOUBLE/(tf+1.2::DOUBLE*(0.25::DOUBLE+0.75::DOUBLE*len/al))),9) AS sc FROM qt JOIN tf ON tf.term=qt.term JOIN df ON df.field=tf.field AND df.term=tf.term JOIN st ON st.field=tf.field JOIN ln ON ln.field=tf.field AND ln.doc_id=tf.doc_id GROUP BY 1,2)
  SELECT item_id, doc_id, round(sc,5) AS score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sc DESC, doc_id) AS r FROM s) WHERE r <= 10""", BM))
def ranked_search(t):
    index = Q.build_index(t.documents, "doc_id", ["text", "source"])
    d = Q.search(t.benchmark, index, "item_id", "text", "doc_id", digits=9)
    return d.withColumn("score", rnd("score", 5))


@query("12.1", "SELECT l.i AS level, round(0.5::DOUBLE+l.i*0.25::DOUBLE,4) AS exposure, sum(bit_count(xor(l_orderkey, l_partkey)))::BIGINT AS bits FROM lineitem, (VALUES (0),(1),(2)) l(i) GROUP BY 1,2")
def plugin_functions(t):
    p = Plugins(t.spark)
    p.scalar("hamming_bits", hamming_bits, "int")
    p.table("exposure_ramp", Ramp, "level int, exposure double")
    t.lineitem.createOrReplaceTempView("plugin_lineitem")
    return t.spark.sql("""SELECT level, round(exposure, 4) AS exposure, bits FROM exposure_ramp(0.5D, 0.25D, 3),
        (SELECT sum(hamming_bits(l_orderkey, l_partkey)) AS bits FROM plugin_lineitem)""")


def _bytes(n, width):
    """Little-endian characters of a small number (every byte below 128)."""
    n = F.lit(n) if isinstance(n, int) else n
    return [F.chr(F.floor(n / 256 ** i).cast("long") % 256) for i in range(width)]


@query("1.8", """SELECT vec_id//16 AS frame, (vec_id%16)::INT AS y, (sum(least(greatest(floor((v+0.5::DOUBLE)*127),0),127)))::BIGINT AS grey, count(*) AS width FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1,2""")
def image_rows_decoded(t):
    """7-bit bitmaps written by the text sink (one value per image) and decoded by the image source."""
    row = F.array_join(F.transform("embedding", lambda v: F.repeat(F.chr(F.least(F.greatest(F.floor((v.cast("double") + 0.5) * 127), F.lit(0)), F.lit(127)).cast("long")), F.lit(3))), "")
    img = t.embeddings.groupBy(F.floor(F.col("vec_id") / 16).alias("frame")).agg(F.count("*").alias("h"), F.array_sort(F.collect_list(F.struct((-F.col("vec_id")).alias("o"), row.alias("line")))).alias("l"))  # sixteen rows
    size = F.col("h") * 256  # 192 bytes of pixels a row and 64 that follow them all: no byte of a size reaches 128, whatever the rows
    head = [F.lit("BM"), *_bytes(size + 54, 4), *_bytes(0, 4), *_bytes(54, 4), *_bytes(40, 4), *_bytes(64, 4), *_bytes(F.col("h"), 4), *_bytes(1, 2), *_bytes(24, 2), *_bytes(0, 4), *_bytes(size, 4), F.repeat(F.chr(F.lit(0)), F.lit(16))]
    bmp = F.concat(*head, F.array_join(F.transform("l", lambda s: s.line), ""), F.repeat(F.chr(F.lit(0)), F.col("h").cast("int") * 64))
    target = scratch_path(t.spark, "images")
    img.select("frame", bmp.alias("value")).repartition("frame").write.partitionBy("frame").text(target)
    d, _ = S.read_images(t.spark, target + "/*")
    grey = F.aggregate("g", F.lit(0).cast("long"), lambda s, p: s + p)
    return d.select(F.regexp_extract("frame_id", r"frame=(\d+)", 1).cast("long").alias("frame"), "y", grey.alias("grey"), F.size("g").cast("long").alias("width"))


@query("1.6", """SELECT vec_id//16 AS mesh, count(*) AS vertices, (count(*)-2)::BIGINT AS faces, round(sum(round(embedding[1]::DOUBLE,6)),5)+0.0::DOUBLE AS x FROM embeddings GROUP BY 1""")
def mesh_scan(t):
    """Triangle strips written as OBJ text, one file per mesh, and scanned back."""
    v = t.embeddings.select(F.floor(F.col("vec_id") / 16).alias("mesh"), (F.col("vec_id") % 16).alias("seq"), F.format_string("v %.6f %.6f %.6f", e(0), e(1), e(2)).alias("line"))
    top = v.groupBy("mesh").agg(F.max("seq").alias("top"))
    # the last corner counts from the end of the vertex list
    f = v.filter("seq >= 2").join(top, "mesh").select("mesh", (F.col("seq") + 1000).alias("seq"), F.format_string("f %d %d %d", F.col("seq") - 1, F.col("seq"), F.col("seq") - F.col("top") - 1).alias("line"))
    target = scratch_path(t.spark, "meshes")
    (v.unionByName(f).repartition("mesh").sortWithinPartitions("mesh", "seq").select("mesh", F.col("line").alias("value")).write.partitionBy("mesh").text(target))
    name = F.regexp_extract("mesh_id", r"mesh=(\d+)", 1).cast("long").alias("mesh")
    verts, faces = S.read_meshes(t.spark, target + "/*", default="obj")
    # sixteen vertices, summed in their order: the sums have six places, so halves of the fifth are common
    a = verts.groupBy(name).agg(F.count("*").alias("vertices"), F.array_sort(F.collect_list(F.struct("v", "x"))).alias("l"))
    total = F.aggregate("l", F.lit(0.0), lambda s, e: s + e.x)
    x = (F.round(total * 1e5, 0) / 1e5 + 0.0).alias("x")
    faces = faces.groupBy(name).agg(F.count("*").alias("faces"))
    return a.join(faces, "mesh", "left").select("mesh", "vertices", F.coalesce("faces", F.lit(0)).alias("faces"), x)
