"""Joins over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions.numeric import rnd
from scanloom.operators import audio as A
from scanloom.operators import joins as J
from scanloom.operators import windows as W
from scanloom.operators.ordering import ranked_within
from scanloom.plans.inputs import EVT, user_events
from scanloom.plans.ordered import CHAIN
from scanloom.plans.registry import query, with_ctes


def side(t, kind):
    return user_events(t).filter(F.col("event_type") == kind).select("user_id", "us", "event_id", "value", "k")


NEAR = """pr AS (SELECT a.user_id, a.event_id, a.us, b.event_id rid, b.value rv, abs(a.us-b.us) d, b.us bus FROM evt a JOIN evt b ON a.user_id=b.user_id AND a.event_type='error' AND b.event_type='purchase'),
  lft AS (SELECT event_id, user_id FROM evt WHERE event_type='error')"""


@query("3.1", with_ctes("""SELECT l.event_id, m.rid AS matched, m.d AS distance_us, m.rid IS NULL AS identity FROM lft l LEFT JOIN
  (SELECT event_id, arg_min(rid, (d, -bus)) rid, min(d) d FROM pr GROUP BY 1) m USING (event_id)""", EVT, NEAR))
def nearest_timestamp(t):
    d = J.asof_nearest(side(t, "error"), side(t, "purchase"), ["user_id"], "event_id", ["event_id"], tie="later")
    return d.select("event_id", F.col("nearest.event_id").alias("matched"), "distance_us", F.col("nearest").isNull().alias("identity"))


@query("3.2", with_ctes("""SELECT l.event_id, CASE WHEN m.d < 14400000000 THEN m.rid END AS matched FROM lft l LEFT JOIN
  (SELECT event_id, arg_min(rid, (d, bus)) rid, min(d) d FROM pr GROUP BY 1) m USING (event_id)""", EVT, NEAR))
def nearest_within_tolerance(t):
    d = J.asof_nearest(side(t, "error"), side(t, "purchase"), ["user_id"], "event_id", ["event_id"], tie="earlier")
    return d.select("event_id", F.when(F.col("distance_us") < 4 * 3_600_000_000, F.col("nearest.event_id")).alias("matched"))


@query("3.3", with_ctes("""SELECT l.event_id, round(coalesce(avg(rv) FILTER (d <= 43200000000), arg_min(rv, (d, bus))),4) AS mean, count(*) FILTER (d <= 43200000000) AS hits FROM lft l LEFT JOIN pr USING (event_id) GROUP BY 1""", EVT, NEAR))
def window_mean_fallback(t):
    d = J.window_mean(side(t, "error"), side(t, "purchase"), ["user_id"], "event_id", "value", 12 * 3_600_000_000)
    return d.select("event_id", rnd("mean", 4).alias("mean"), "hits")


@query("3.4", with_ctes("""SELECT event_id, (r-1)::INT AS slot, 'angle_' || k || '_cam_' || (r-1) || '.nef' AS target, rid AS file FROM (SELECT pr.*, e.k, row_number() OVER (PARTITION BY pr.event_id ORDER BY bus, rid) AS r FROM pr JOIN evt e USING (event_id) WHERE d < 86400000000) WHERE r <= 1 + k % 3""", EVT, NEAR))
def event_file_match(t):
    ev = side(t, "error").select("user_id", "us", "event_id", "k", (1 + F.col("k") % 3).alias("expected"))
    files = side(t, "purchase").select("user_id", "us", F.col("event_id").alias("file"))
    m = J.interval_match(ev, files, ["user_id"], "event_id", ["file"], 86_400_000_000)
    m = m.join(ev.select("event_id", "k"), "event_id")
    return m.select("event_id", "slot", F.concat(F.lit("angle_"), "k", F.lit("_cam_"), "slot", F.lit(".nef")).alias("target"), "file")


@query("3.5", """WITH f AS (SELECT page_id, 'scan/' || page_id || '/img' || page_id || '.jpg' AS image, length(html) AS pose FROM pages),
  q AS (SELECT page_id AS query_id, CASE WHEN page_id % 5 = 0 THEN 'scan/' || page_id || '/img' || page_id || '.jpg' ELSE 'card/' || (page_id * 37 % 400) || '.jpg' END AS path FROM pages),
  m AS (SELECT query_id, arg_min(pose, page_id) AS pose, min(page_id) AS frame FROM q JOIN f ON f.image = q.path OR ends_with(f.image, string_split(q.path, '/')[-1]) GROUP BY 1)
  SELECT q.query_id, frame, pose FROM q LEFT JOIN m USING (query_id)""")
def path_suffix_lookup(t):
    i = F.col("page_id")
    image = F.concat(F.lit("scan/"), i, F.lit("/img"), i, F.lit(".jpg"))
    frames = t.pages.select(i.alias("frame"), image.alias("image"), F.length("html").cast("long").alias("pose"))
    paths = t.pages.select(i.alias("query_id"), F.when(i % 5 == 0, image).otherwise(F.concat(F.lit("card/"), i * 37 % 400, F.lit(".jpg"))).alias("path"))
    return J.suffix_lookup(paths, frames, "path", "image", "frame", "pose").select("query_id", "frame", "pose")


@query("3.15", """SELECT l_orderkey, count(*) AS observations, count(*) FILTER (p_partkey IS NULL OR s_suppkey IS NULL) AS invalid,
   round(sum(abs(p_retailprice - s_acctbal)),2) AS error FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + 20 LEFT JOIN supplier ON s_suppkey = l_suppkey + 3 GROUP BY 1""")
def observation_join(t):
    tracks = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_suppkey") + 3).alias("image"), (F.col("l_partkey") + 20).alias("keypoint"))).alias("track"))
    kp = t.part.select(F.col("p_partkey").alias("keypoint"), F.col("p_retailprice").alias("u"))
    poses = t.supplier.select(F.col("s_suppkey").alias("image"), F.col("s_acctbal").alias("tx"))
    return J.resolve_observations(tracks, kp, poses, "l_orderkey").withColumn("error", rnd("error", 2))


@query("3.17", """WITH l AS (SELECT l_partkey || '-' || l_linenumber AS label, l_shipdate < TIMESTAMP '1998-06-01' AS old, l_extendedprice v FROM lineitem),
  b AS (SELECT label, avg(v) v FROM l WHERE old GROUP BY 1), c AS (SELECT label, avg(v) v FROM l WHERE NOT old GROUP BY 1)
  SELECT coalesce(b.label, c.label) AS label, CASE WHEN b.label IS NOT NULL THEN round(coalesce(c.v,0) - b.v,7)+0.0::DOUBLE END AS delta FROM b FULL JOIN c ON b.label=c.label""")
def baseline_comparison(t):
    l = t.lineitem.select(F.concat_ws("-", "l_partkey", "l_linenumber").alias("label"), (F.col("l_shipdate") < "1998-06-01").alias("old"), "l_extendedprice")
    b, c = (l.filter(f).groupBy("label").agg(F.avg("l_extendedprice").alias("value")) for f in ("old", "NOT old"))
    return J.compare_runs(b, c, "label").select("label", rnd("delta", 7).alias("delta"))


@query("3.18", f"""WITH RECURSIVE {EVT}, {CHAIN}, n AS (SELECT log_id, max(seq) AS n FROM chain GROUP BY 1),
  a AS (SELECT c.log_id, seq, CASE WHEN k=7 THEN 'failed' ELSE 'anchored' END st, CASE WHEN k=9 THEN 'payload' WHEN k=11 THEN 'sig' WHEN k=13 THEN 'gone' WHEN k=15 THEN 'prev' WHEN k=17 THEN 'time' ELSE 'good' END AS why, n
    FROM chain c JOIN n USING (log_id) WHERE seq <= n - log_id % 3)
  SELECT log_id, any_value(n) AS records, count(*) AS anchor_records, count(*) FILTER (st <> 'anchored') anchor_errors, count(*) FILTER (why='good') anchored, count(*) FILTER (why IN ('payload','sig')) invalid_signatures,
   count(*) FILTER (why IN ('gone','prev','time')) missing, any_value(n) - coalesce(CASE WHEN arg_max(why, seq) = 'gone' THEN NULL ELSE max(seq) END, 0) AS unanchored_tail,
   count(*) FILTER (st <> 'anchored' OR why <> 'good') = 0 AND any_value(n) = CASE WHEN arg_max(why, seq) = 'gone' THEN NULL ELSE max(seq) END AS ok FROM a GROUP BY 1""")
def anchor_verification(t):
    ev = user_events(t).select(F.col("user_id").alias("log_id"), "us", "event_id", F.concat_ws(":", "event_id", "event_type", "k").alias("payload"))
    part = F.split("payload", ":")
    ev = ev.join(ev.groupBy("log_id").agg(F.count("*").alias("n")), "log_id")  # events are far shorter than their records with hashes
    rec = W.rebuild_chain(ev, "log_id", ["us", "event_id"], keep=("n",)).select("log_id", "seq", "hash", "prev_hash", part[0].alias("event_id"), F.concat(F.lit("t"), part[0]).alias("stamp"), part[2].cast("int").alias("k"), "n")
    a = rec.filter(F.col("seq") <= F.col("n") - F.col("log_id") % 3)
    k = F.col("k")
    a = a.select("log_id", F.col("seq").alias("anchor_no"), "event_id", F.lit("key").alias("key_id"), k.alias("_k"),
                 F.when(k == 13, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"), F.when(k == 15, "x").otherwise(F.col("prev_hash")).alias("prev_hash"),
                 F.when(k == 17, "never").otherwise(F.col("stamp")).alias("stamp"), F.when(k == 7, "failed").otherwise("anchored").alias("status"), (k != 11).alias("signature_ok"))
    sp = F.concat_ws("|", "hash", "prev_hash", "event_id", "stamp", "key_id")
    a = a.withColumn("signature_payload", F.when(F.col("_k") == 9, "tampered").otherwise(sp))
    return J.verify_anchors(rec, a, "log_id")


@query("3.19", """WITH d AS (SELECT doc_id//10 AS entry, doc_id % 97 = 0 AS wrong_size, doc_id % 89 = 0 AS wrong_sha, doc_id % 2 = 0 AS no_mtime FROM documents)
  SELECT entry, NOT bool_or(wrong_size OR (no_mtime AND wrong_sha)) AND entry % 4 <> 1 AS quick, NOT bool_or(wrong_size OR wrong_sha) AND entry % 4 <> 1 AS complete FROM d GROUP BY 1""")
def artifact_verification(t):
    i = F.col("doc_id")
    files = t.documents.select(i.cast("string").alias("path"), F.octet_length("text").cast("long").alias("size"), (i * 1000 + 1).alias("mtime"), F.sha2("text", 256).alias("sha256"))
    art = F.struct(i.cast("string").alias("path"), (F.octet_length("text") + F.when(i % 97 == 0, 1).otherwise(0)).cast("long").alias("size"),
                   F.when(i % 2 == 0, F.lit(0)).otherwise(i * 1000 + 1).alias("mtime"), F.when(i % 89 == 0, "0").otherwise(F.sha2("text", 256)).alias("sha256"))
    entries = t.documents.groupBy(F.floor(i / 10).alias("entry")).agg(F.collect_list(art).alias("artifacts"))  # ten per entry
    entries = entries.withColumn("status", F.when(F.col("entry") % 4 == 1, "failed").otherwise("committed"))
    quick, complete = (J.verify_artifacts(entries, files, "entry", m).withColumnRenamed("valid", n) for m, n in ((False, "quick"), (True, "complete")))
    return quick.join(complete, "entry")


@query("3.20", """WITH l AS (SELECT o_custkey AS token, arg_max(o_orderstatus, o_orderkey) st, max(o_orderdate) ex, bool_or(o_orderpriority LIKE '1%') em FROM orders GROUP BY 1),
  v AS (SELECT user_id AS token, count(*) AS views FROM events WHERE event_type='click' GROUP BY 1)
  SELECT c_custkey AS token, c_name AS title, coalesce(views,0) AS views FROM customer JOIN l ON l.token=c_custkey LEFT JOIN v ON v.token=c_custkey
  WHERE c_acctbal > 0 AND st <> 'F' AND em AND ex > TIMESTAMP '1999-01-01' AND contains(lower(c_mktsegment),'build')""")
def public_gallery(t):
    links = t.orders.groupBy(F.col("o_custkey").alias("token")).agg(
        (F.max_by("o_orderstatus", "o_orderkey") == "F").alias("revoked"), F.max("o_orderdate").alias("expires_at"), F.max(F.col("o_orderpriority").startswith("1")).alias("allow_embed"))
    public = t.customer.select(F.col("c_custkey").alias("token"), F.col("c_name").alias("title"), (F.col("c_acctbal") > 0).alias("is_public"), F.col("c_mktsegment").alias("tags"))
    access = t.events.select(F.col("user_id").alias("token"), F.when(F.col("event_type") == "click", "asset").otherwise("meta").alias("event"))
    d = J.public_gallery(public, links, access, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"), "BUILD")
    return d.select("token", "title", "views").orderBy(F.desc("views"), "token")


def tokens(df, *cols):
    return df.select(*cols, F.posexplode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("time", "hash")).filter("hash <> ''")


TOK = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')"


@query("3.21", f"""WITH s AS (SELECT doc_id, unnest({TOK}) AS h, generate_subscripts({TOK},1)-1 AS t FROM documents), sf AS (SELECT * FROM s WHERE h <> ''),
  r AS (SELECT h, t FROM (SELECT item_id, unnest({TOK}) AS h, item_id*1000 + generate_subscripts({TOK},1)-1 AS t FROM benchmark) WHERE h <> '' QUALIFY row_number() OVER (PARTITION BY h ORDER BY t) <= 6),
  p AS (SELECT doc_id, s.t AS st, r.t AS rt, (r.t-s.t)*20 AS o FROM sf s JOIN r ON s.h=r.h), v AS (SELECT doc_id, o, count(*) c FROM p GROUP BY 1,2),
  b AS (SELECT doc_id, arg_max(o, (c,-o)) bo, max(c) c FROM v GROUP BY 1), n AS (SELECT doc_id, count(*) AS hn FROM sf GROUP BY 1),
  f AS (SELECT p.doc_id, count(*) np, var_pop(st*0.02::DOUBLE)*count(*) den, regr_slope(rt*0.02::DOUBLE, st*0.02::DOUBLE) sl, regr_intercept(rt*0.02::DOUBLE, st*0.02::DOUBLE) ic, avg(rt*0.02::DOUBLE)-avg(st*0.02::DOUBLE) sh
    FROM p JOIN b USING (doc_id) WHERE abs(o-bo) <= 40 GROUP BY 1)
  SELECT doc_id, bo AS best_ms, c AS votes, np AS pairs, round(CASE WHEN np < 3 OR den < 1e-9 THEN 1 ELSE sl END,4)+0.0::DOUBLE AS stretch,
   round(bo/1000.0::DOUBLE + CASE WHEN np < 3 THEN 0 WHEN den < 1e-9 THEN sh ELSE ic END,7)+0.0::DOUBLE AS offset_s, round(least(c/hn,1),6) AS confidence FROM b JOIN f USING (doc_id) JOIN n USING (doc_id)""")
def audio_hash_alignment(t):
    ref = tokens(t.benchmark, "item_id").select("hash", (F.col("item_id") * 1000 + F.col("time")).alias("time"))
    d = J.align_hashes(tokens(t.documents, "doc_id"), ref, ["doc_id"], 20, per_hash=6)
    return d.withColumns({"stretch": rnd("stretch", 4), "offset_s": rnd("offset_s", 7), "confidence": rnd("confidence")})


# Tracks are the vectors of one label, end to end; the reference is that of the smallest label.
@query("3.21", """WITH v AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS nth FROM embeddings),
  s AS (SELECT label, nth * 64 + generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM v), a AS (SELECT i, x FROM s WHERE label = (SELECT min(label) FROM embeddings)),
  z AS (SELECT label, max(i) + 1 AS nb, least(max(i) + 1, (SELECT max(i) + 1 FROM a)) AS n FROM s GROUP BY 1), l AS (SELECT label, nb, n, unnest(generate_series(-(n // 4), n // 4 - 1)) AS lag FROM z),
  c AS (SELECT l.label, lag, round(sum(a.x * s.x) / count(*), 9) AS corr FROM l JOIN a ON a.i % 16 = 0 AND a.i < l.n JOIN s ON s.label = l.label AND s.i = a.i + lag GROUP BY 1, 2),
  b AS (SELECT label, arg_max(lag, (corr, -lag)) AS lag, max(corr) AS corr FROM c WHERE corr > 0 GROUP BY 1)
  SELECT z.label, round(coalesce(lag, 0) * 16 / 8000.0::DOUBLE, 6) + 0.0::DOUBLE AS offset_s, round(least(coalesce(corr, 0) / 2 + 0.5::DOUBLE, 1), 6) AS confidence, 'correlation' AS method FROM z LEFT JOIN b USING (label)""")
def audio_correlation(t):
    """Tracks without hashes: every one falls back to correlation."""
    v = ranked_within(t.embeddings.select("label", "vec_id", "embedding"), ["label"], [F.col("vec_id")], into="nth")
    s = v.select("label", F.posexplode("embedding").alias("at", "x"), "nth").select("label", (F.col("nth") * 64 + F.col("at")).alias("i"), F.col("x").cast("double").alias("value"))
    first = t.embeddings.agg(F.min("label").alias("label"))  # one row
    none = s.filter("false").select("label", F.lit("").alias("hash"), F.lit(0).alias("time"))
    d = A.align_tracks(none, none.select("hash", "time"), s, s.join(first, "label").select("i", "value"), ["label"], 20, 8000.0)
    return d.select("label", rnd("offset_s").alias("offset_s"), rnd("confidence").alias("confidence"), "method")


@query("3.23", """WITH p AS (SELECT lower(regexp_replace(p_brand,'[^A-Za-z0-9]','','g')) mk, lower(p_type) md, p_size%4 AS w, min(p_partkey) AS pid, avg(p_retailprice)/300 ap, avg(p_size) fl, min(p_size)/10.0::DOUBLE f0, max(p_size)/10.0::DOUBLE f1 FROM part GROUP BY 1,2,3, p_partkey % 2),
  c AS (SELECT p_partkey, lower(regexp_replace(p_brand,'[^A-Za-z0-9]','','g')) mk, lower(p_type) md, p_size%4 AS w, p_retailprice/300 ap, p_size::DOUBLE fl, (p_size+1)/10.0::DOUBLE f FROM part),
  h AS (SELECT c.p_partkey, count(*) n, min(pid) pid FROM c JOIN p USING (mk, md, w) WHERE abs(p.ap-c.ap) <= 0.01::DOUBLE*p.ap AND abs(p.fl-c.fl) <= 0.005::DOUBLE*p.fl AND f >= f0-greatest(f0*0.02::DOUBLE,0.005) AND f <= f1+greatest(f1*0.02::DOUBLE,0.005) GROUP BY 1)
  SELECT p_partkey AS capture_id, coalesce(n,0) AS hits, pid AS profile_id, CASE coalesce(n,0) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'ambiguous' END AS match FROM part LEFT JOIN h USING (p_partkey)""")
def profile_match(t):
    w = (F.col("p_size") % 4).alias("width")
    prof = t.part.groupBy("p_brand", "p_type", w, (F.col("p_partkey") % 2).alias("half")).agg(
        F.min("p_partkey").alias("profile_id"), (F.avg("p_retailprice") / 300).alias("aperture"), F.avg("p_size").alias("focal"), (F.min("p_size") / 10.0).alias("focus_min"), (F.max("p_size") / 10.0).alias("focus_max"))
    prof = prof.select(F.upper("p_brand").alias("make"), F.col("p_type").alias("model"), "width", F.lit(1).alias("height"), "profile_id", "aperture", "focal", "focus_min", "focus_max")
    cap = t.part.select(F.col("p_partkey").alias("capture_id"), F.col("p_brand").alias("make"), F.lower("p_type").alias("model"), w, F.lit(1).alias("height"), (F.col("p_retailprice") / 300).alias("aperture"),
                        F.col("p_size").cast("double").alias("focal"), ((F.col("p_size") + 1) / 10.0).alias("focus"))
    return J.match_profiles(cap, prof)


@query("3.25", """WITH pr AS (SELECT p_brand, p_size % 7 AS probe, avg(p_retailprice)/1000 variance, count(*)/10.0::DOUBLE weight FROM part GROUP BY 1,2),
  c AS (SELECT p_partkey, p_brand, p_size*2.0::DOUBLE/1000 sh, 20.0::DOUBLE+p_size%5 ro, p_partkey%9<>0 cal, p_size/100.0::DOUBLE+0.5::DOUBLE noise FROM part),
  r AS (SELECT *, sh*1000+ro AS cost, CASE WHEN NOT cal THEN 'missing_iso' WHEN sh*1000+ro > 110 THEN 'time' WHEN 0.9::DOUBLE+(sh*1000+ro)*0.001::DOUBLE > 0.9955 THEN 'thermal' WHEN sh*20 > 1.31 THEN 'motion' END rej FROM c)
  SELECT p_partkey AS candidate_id, rej AS rejected, round(g,6) AS nats, round(g/cost,6) AS utility FROM r LEFT JOIN (SELECT p_partkey, sum(weight*0.5::DOUBLE*ln(1+variance/noise)) g FROM r JOIN pr USING (p_brand) WHERE rej IS NULL GROUP BY 1) USING (p_partkey)""")
def candidate_information(t):
    probes = t.part.groupBy("p_brand", (F.col("p_size") % 7).alias("probe")).agg((F.avg("p_retailprice") / 1000).alias("variance"), (F.count("*") / 10.0).alias("weight"))
    size = F.col("p_size")
    cand = t.part.select("p_brand", F.col("p_partkey").alias("candidate_id"), (size * 2.0 / 1000).alias("shutter"), (F.lit(20.0) + size % 5).alias("readout_ms"), (F.col("p_partkey") % 9 != 0).alias("calibrated"),
                         (size / 100.0 + 0.5).alias("noise"), F.lit(0.9).alias("thermal"), F.lit(20.0).alias("motion"))
    d = J.score_candidates(cand, probes, ["p_brand"], 110.0, 1.31, 0.9955)
    return d.select("candidate_id", "rejected", rnd("nats").alias("nats"), rnd("utility").alias("utility"))


@query("3.28", "SELECT n_name AS model, s_suppkey AS sequence, s_name AS name, CASE WHEN s_acctbal < 0 THEN 'failed' WHEN s_acctbal < 5000 THEN 'pending' ELSE 'complete' END AS status FROM nation JOIN supplier ON s_nationkey=n_nationkey WHERE s_acctbal >= 0")
def sequence_lookup(t):
    status = F.when(F.col("s_acctbal") < 0, "failed").when(F.col("s_acctbal") < 5000, "pending").otherwise("complete")
    seq = t.supplier.withColumn("status", status).filter("status <> 'failed'")
    nation = t.nation.withColumnRenamed("n_nationkey", "s_nationkey")
    return seq.join(nation, "s_nationkey").select(F.col("n_name").alias("model"), F.col("s_suppkey").alias("sequence"), F.col("s_name").alias("name"), "status")
