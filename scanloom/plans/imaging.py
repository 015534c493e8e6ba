"""Image statistics, pair metrics and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions.numeric import rnd
from scanloom.operators import imaging as I
from scanloom.operators.aggregates import quality_scores
from scanloom.operators.predicates import quality_reason
from scanloom.plans.inputs import IMG, RGB, WIDTH, grey, image_rows, rgb
from scanloom.plans.registry import query, with_ctes

FR = ["frame_id"]


def nb(source: str, cols=("v",), name="nb", key="frame_id") -> str:
    """Neighbour columns in SQL: suffix n, s, w, e, nw, ne, sw, se per value column."""
    h = ", ".join(f"lag({c}) OVER r AS {c}_w, lead({c}) OVER r AS {c}_e" for c in cols)
    v = ", ".join(f"lag({c}) OVER q AS {c}_n, lead({c}) OVER q AS {c}_s, lag({c}_w) OVER q AS {c}_nw, lag({c}_e) OVER q AS {c}_ne, lead({c}_w) OVER q AS {c}_sw, lead({c}_e) OVER q AS {c}_se" for c in cols)
    return (f"{name}_h AS (SELECT *, {h} FROM {source} WINDOW r AS (PARTITION BY {key}, y ORDER BY x)), "
            f"{name} AS (SELECT *, {v} FROM {name}_h WINDOW q AS (PARTITION BY {key}, x ORDER BY y))")


IN = "v_nw IS NOT NULL AND v_se IS NOT NULL AND v_ne IS NOT NULL AND v_sw IS NOT NULL"
NB = IMG + ", " + nb("img") + f", lp AS (SELECT *, CASE WHEN {IN} THEN (v_n+v_s+v_w+v_e-4*v)::DOUBLE END AS l FROM nb)"
SHARP = "sh AS (SELECT frame_id, avg(v) AS mean, CASE WHEN count(l) > 0 THEN avg(l*l)-avg(l)*avg(l) ELSE 0 END AS s1, CASE WHEN count(l) > 0 THEN sum(l*l)/count(*)-(sum(l)/count(*))*(sum(l)/count(*)) ELSE 0 END AS s2 FROM lp GROUP BY 1)"


def grey_stencil(t):
    return I.stencil(image_rows(t), FR)


@query("4.5", with_ctes("SELECT frame_id, round(mean,5) mean, round(s1,4) sharpness, round(s2,4) sharpness_all FROM sh", NB, SHARP))
def laplacian_sharpness(t):
    d = I.sharpness(grey_stencil(t), FR)
    return d.select("frame_id", rnd("mean", 5).alias("mean"), rnd("sharpness", 4).alias("sharpness"), rnd("sharpness_all", 4).alias("sharpness_all"))


PIQE = f"""dq AS (SELECT frame_id, max(y)+1 h, max(x)+1 w, (coalesce(sum(abs(v-v_w)) FILTER (x%8=0),0)+coalesce(sum(abs(v-v_n)) FILTER (y%8=0),0))/greatest(count(v_w) FILTER (x%8=0)+count(v_n) FILTER (y%8=0),1) bd,
   (coalesce(sum(abs(v-v_w)) FILTER (x%8<>0),0)+coalesce(sum(abs(v-v_n)) FILTER (y%8<>0),0))/greatest(count(v_w) FILTER (x%8<>0)+count(v_n) FILTER (y%8<>0),1) it, avg(v/255.0::DOUBLE) m, avg(v/255.0::DOUBLE*v/255.0::DOUBLE) q FROM nb GROUP BY 1),
  rs AS (SELECT frame_id, r, row_number() OVER (PARTITION BY frame_id ORDER BY r)-1 i, count(*) OVER (PARTITION BY frame_id) n FROM (SELECT frame_id, abs(8*v-v_n-v_s-v_w-v_e-v_nw-v_ne-v_sw-v_se) r FROM nb WHERE {IN})),
  pq AS (SELECT dq.frame_id, CASE WHEN h < 16 OR w < 16 THEN 100 ELSE 100*(0.5::DOUBLE*least(least(bd/(it+0.001::DOUBLE),5)/3,1)+0.3::DOUBLE*least(least(mid/9/255/0.6745::DOUBLE,1)/0.15::DOUBLE,1)+0.2::DOUBLE*(1-least(sqrt(greatest(q-m*m,0)),1))) END AS score
   FROM dq LEFT JOIN (SELECT frame_id, min(r)::DOUBLE mid FROM rs WHERE i = n//2 GROUP BY 1) USING (frame_id))"""


@query("4.7", with_ctes("SELECT frame_id, round(score,5) score FROM pq", NB, PIQE))
def blockiness_score(t):
    return I.blockiness(grey_stencil(t), FR).withColumn("score", rnd("score", 5))


@query("2.4", with_ctes("""SELECT sh.frame_id, CASE WHEN s1 < 4000 THEN 'too_blurry' WHEN mean < 20 THEN 'underexposed' WHEN mean > 140 THEN 'overexposed' WHEN score > 62 THEN 'low_perceptual_quality' END AS reject_reason FROM sh JOIN pq USING (frame_id)""", NB, SHARP, PIQE))
def image_quality_gate(t):
    st = grey_stencil(t)
    d = I.sharpness(st, FR).join(I.blockiness(st, FR), "frame_id")
    reason = quality_reason(F.col("sharpness"), F.col("mean"), F.col("score"), min_sharpness=4000.0, bright=140.0, max_score=62.0)
    return d.select("frame_id", reason.alias("reject_reason"))


def rgb_rows(t, mask_only=False):
    """Rows of pixel structs (r, g, b, l luma, m mask)."""
    i = lambda k, o: F.get("px", (k + o) % WIDTH)
    st = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda k: F.struct(
        i(k, 0).alias("r"), i(k, 21).alias("g"), i(k, 42).alias("b"), (0.299 * i(k, 0) + 0.587 * i(k, 21) + 0.114 * i(k, 42)).alias("l"), (i(k, 0) >= 112).cast("int").alias("m")))
    return image_rows(t).select("frame_id", "y", st.alias("px"))


LUM = RGB + ", lum AS (SELECT frame_id, y, x, r, g, b, mask, mask AS m, 0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b AS l, 0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b AS v FROM rgb), " + nb("lum", ("v", "m"), "ln")


def _kurt(c):
    m, q, t3, f = (f"avg(pow({c},{i}))" for i in (1, 2, 3, 4))
    return f"CASE WHEN {q}-{m}*{m} <= 1e-12 THEN 0 ELSE ({f}-4*{m}*{t3}+6*{m}*{m}*{q}-3*{m}*{m}*{m}*{m})/(({q}-{m}*{m})*({q}-{m}*{m})) END"


DEF = f"""gr AS (SELECT frame_id, CASE WHEN {IN} THEN v_ne+2*v_e+v_se-v_nw-2*v_w-v_sw ELSE 0 END gx, CASE WHEN {IN} THEN v_sw+2*v_s+v_se-v_nw-2*v_n-v_ne ELSE 0 END gy, CASE WHEN {IN} THEN v_n+v_s+v_w+v_e-4*v ELSE 0 END lap FROM ln),
  ed AS (SELECT frame_id, {_kurt('gx')}+{_kurt('gy')} AS kb, avg(lap*lap)-avg(lap)*avg(lap) AS blur FROM gr GROUP BY 1),
  sz AS (SELECT frame_id, max(y)+1 h, max(x)+1 w, least(greatest(floor(least(max(y)+1,max(x)+1)*0.05::DOUBLE+0.5::DOUBLE),2),least(max(y)+1,max(x)+1)-1) bw FROM rgb GROUP BY 1),
  lk AS (SELECT frame_id, count(*) FILTER (bor AND mask>0)/greatest(count(*) FILTER (bor),1) leak, count(*) FILTER (mask>0) area FROM (SELECT rgb.*, (y<bw OR y+bw>=h OR x<bw OR x+bw>=w) bor FROM rgb JOIN sz USING (frame_id)) GROUP BY 1),
  rim AS (SELECT frame_id, x, y FROM ln WHERE m=1 AND least(coalesce(m_n,1),coalesce(m_s,1),coalesce(m_w,1),coalesce(m_e,1),coalesce(m_nw,1),coalesce(m_ne,1),coalesce(m_sw,1),coalesce(m_se,1))=0),
  ex AS (SELECT frame_id, y, min(x) x FROM rim GROUP BY 1,2 UNION SELECT frame_id, y, max(x) FROM rim GROUP BY 1,2),
  he AS (SELECT p.frame_id, p.x px, p.y py, q.x qx, q.y qy FROM ex p JOIN ex q ON p.frame_id=q.frame_id AND (p.x,p.y)<>(q.x,q.y) JOIN ex o ON o.frame_id=p.frame_id GROUP BY 1,2,3,4,5
    HAVING bool_and((q.x-p.x)*(o.y-p.y)-(q.y-p.y)*(o.x-p.x) > 0 OR ((q.x-p.x)*(o.y-p.y)-(q.y-p.y)*(o.x-p.x) = 0 AND (o.x-p.x)*(o.x-q.x)+(o.y-p.y)*(o.y-q.y) <= 0))),
  hl AS (SELECT frame_id, abs(sum(px*qy-qx*py))/2 AS ha FROM he GROUP BY 1), rc AS (SELECT frame_id, count(*) AS rn FROM rim GROUP BY 1),
  oe AS (SELECT frame_id, sum((r>=254)::INT+(g>=254)::INT+(b>=254)::INT)/(3*count(*)) ov, sqrt(pow(avg(r)-avg(g),2)+pow(avg(b)-avg(g),2)) cast_, count(*) FILTER (mask>0 AND r+g+b<30)/greatest(count(*) FILTER (mask>0),1) bk FROM rgb GROUP BY 1),
  df AS (SELECT ed.frame_id, kb edge_banding, leak background_leak, CASE WHEN area=0 THEN 0 WHEN coalesce(rn,0)<3 THEN 1 WHEN ha<=1e-6 THEN 1 ELSE area/greatest(ha,1) END erosion, blur, ov overexposure, cast_ colour_cast, bk black_dots
    FROM ed JOIN lk USING (frame_id) JOIN oe USING (frame_id) LEFT JOIN hl USING (frame_id) LEFT JOIN rc USING (frame_id))"""
EVEN_RIM = DEF.replace("WHERE m=1 AND least(", "WHERE m=1 AND (x+y)%2=0 AND least(")
NAMES = ["edge_banding", "background_leak", "erosion", "blur", "overexposure", "colour_cast", "black_dots"]


def defect_table(t, rim_step=1):
    return I.defects(rgb_rows(t), FR, rim_step=rim_step)


@query("4.6", with_ctes("SELECT frame_id, " + ", ".join(f"round({c},4)+0.0::DOUBLE {c}" for c in NAMES) + " FROM df", LUM, EVEN_RIM))
def defect_assessment(t):
    return defect_table(t, rim_step=2).select("frame_id", *[rnd(c, 4).alias(c) for c in NAMES])


@query("4.47 4.6", with_ctes("WITH s AS (" + " UNION ALL ".join(f"SELECT frame_id, {d} sc, {th}::DOUBLE th, {str(lo).lower()} lo, '{a}' act FROM df" for d, th, lo, a in I.DEFECT_RULES)
       + "), b AS (SELECT *, CASE WHEN lo THEN th-sc ELSE sc-th END o FROM s) SELECT frame_id, round(greatest(1-sum(CASE WHEN o>0 THEN 0.2::DOUBLE*least(o/th,1) ELSE 0 END),0),5)+0.0::DOUBLE score, count(*) FILTER (o>0) bad,"
         " coalesce(string_agg(DISTINCT act, ',' ORDER BY act) FILTER (o>0),'') actions FROM b GROUP BY 1", LUM, DEF))
def frame_quality_score(t):
    rows = defect_table(t).unpivot("frame_id", NAMES, "defect", "score")
    th = t.spark.createDataFrame(list(I.DEFECT_RULES), "defect string, threshold double, low_is_bad boolean, action string")
    return quality_scores(rows, FR, th).withColumn("score", rnd("score", 5))


@query("4.8", with_ctes("""WITH h AS (SELECT frame_id, v AS t, count(*) c FROM img GROUP BY 1,2), c AS (SELECT *, sum(c) OVER u wb, sum(c*t) OVER u sb, sum(c) OVER a n, sum(c*t) OVER a s, lead(t) OVER u nx FROM h WINDOW u AS (PARTITION BY frame_id ORDER BY t), a AS (PARTITION BY frame_id)),
  b AS (SELECT *, CASE WHEN n-wb > 0 THEN wb::DOUBLE*(n-wb)*(sb/wb-(s-sb)/(n-wb))*(sb/wb-(s-sb)/(n-wb)) END bv FROM c), m AS (SELECT * FROM (SELECT *, max(bv) OVER (PARTITION BY frame_id) mx FROM b) WHERE bv=mx)
  SELECT frame_id, min(t) AS first, ((min(t)+max(coalesce(nx-1,255)))//2)::INT AS middle FROM m GROUP BY 1""", IMG))
def otsu_threshold(t):
    return I.otsu(grey(t), FR, "v")


def image_pairs(t):
    px = rgb(t).withColumn("pair_id", F.floor(F.col("frame_id") / 2).cast("long"))
    return I.pair_images(px.filter("frame_id % 2 = 0").drop("frame_id"), px.filter("frame_id % 2 = 1").drop("frame_id"), ["pair_id"])


PAIR = "pa AS (SELECT frame_id//2 AS pair_id, y, x, r, g, b, mask FROM rgb WHERE frame_id%2=0), pb AS (SELECT frame_id//2 AS pair_id, y, x, r qr, g qg, b qb, mask qm FROM rgb WHERE frame_id%2=1), pr AS (SELECT *, 0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b la, 0.299::DOUBLE*qr+0.587::DOUBLE*qg+0.114::DOUBLE*qb lb, abs(r-qr)+abs(g-qg)+abs(b-qb) ad FROM pa FULL JOIN pb USING (pair_id, y, x))"


@query("4.9 3.22", with_ctes("""WITH s AS (SELECT pair_id, count(*)=count(r) AND count(*)=count(qr) ok, sum((r-qr)*(r-qr)+(g-qg)*(g-qg)+(b-qb)*(b-qb))/(3*count(*)) mse, avg(la) mx, avg(lb) my, var_pop(la) vx, var_pop(lb) vy, covar_pop(la,lb) c, count(*) FILTER (mask>0 AND qm>0) i, count(*) FILTER (mask>0 OR qm>0) u,
   count(*) FILTER (mask>0) ma, count(*) FILTER (qm>0) mb, coalesce(avg((ad>30)::INT) FILTER (x%10=0 AND y%10=0),0) ch, coalesce(avg(least(ad/765.0::DOUBLE,1)) FILTER (x%4=0 AND y%4=0 AND mask>0),0) mo, coalesce(avg(least(abs(la-lb)/255.0::DOUBLE,1)) FILTER (x%6=0 AND y%6=0 AND mask>0),0) px FROM pr GROUP BY 1)
  SELECT pair_id, CASE WHEN ok THEN round(10*log10(65025/mse),5) END psnr, CASE WHEN ok THEN round((2*mx*my+6.5025::DOUBLE)*(2*c+58.5225::DOUBLE)/((mx*mx+my*my+6.5025::DOUBLE)*(vx+vy+58.5225::DOUBLE)),6)+0.0::DOUBLE END ssim,
   CASE WHEN ok THEN round(i/u,6) END iou, CASE WHEN ok THEN round(2*i/(ma+mb),6) END dice, CASE WHEN ok THEN round(ch,6) ELSE 1 END change, CASE WHEN ok THEN round(mo,6) ELSE 0 END motion, CASE WHEN ok THEN round(px,6) ELSE 0 END parallax FROM s""", RGB, PAIR))
def image_pair_metrics(t):
    d = I.pair_metrics(image_pairs(t), ["pair_id"])
    return d.select("pair_id", rnd("psnr", 5).alias("psnr"), *[rnd(c).alias(c) for c in ("ssim", "iou", "dice", "change", "motion", "parallax")])


@query("8.20", with_ctes("SELECT pair_id, sum(qr)::BIGINT diffuse_r, sum(qg)::BIGINT diffuse_g, sum(greatest(r-qr,0))::BIGINT specular_r, sum(greatest(b-qb,0))::BIGINT specular_b, count(*) pixels FROM pr WHERE r IS NOT NULL AND qr IS NOT NULL GROUP BY 1", RGB, PAIR))
def specular_split(t):
    d = I.split_specular(image_pairs(t).filter("r IS NOT NULL AND qr IS NOT NULL"))
    return d.groupBy("pair_id").agg(*[F.sum(c).alias(c) for c in ("diffuse_r", "diffuse_g", "specular_r", "specular_b")], F.count("*").alias("pixels"))


def stacks(df):
    return df.withColumns({"stack_id": F.floor(F.col("frame_id") / 4).cast("long"), "slice": (F.col("frame_id") % 4).cast("int")})


@query("4.29", with_ctes("""WITH w AS (SELECT frame_id, greatest(exp(-pow(coalesce(avg((0.2126::DOUBLE*r+0.7152::DOUBLE*g+0.0722::DOUBLE*b)/255) FILTER (x%8=0 AND y%8=0),0.5)-0.5::DOUBLE,2)/0.125)*exp(-pow((frame_id%4-1)*0.5::DOUBLE,2)/2),1e-4) w FROM rgb GROUP BY 1)
  SELECT frame_id//4 AS stack_id, y, x, floor(sum(r*w)/sum(w)+0.5::DOUBLE)::INT r, floor(sum(g*w)/sum(w)+0.5::DOUBLE)::INT g, floor(sum(b*w)/sum(w)+0.5::DOUBLE)::INT b FROM rgb JOIN w USING (frame_id) GROUP BY 1,2,3""", RGB))
def exposure_fusion(t):
    return I.fuse_exposures(stacks(rgb(t)), ["stack_id"], "frame_id", (F.col("slice") - 1) * 0.5)


@query("4.30", with_ctes("""WITH u AS (SELECT frame_id, y, x, r/255.0::DOUBLE r, g/255.0::DOUBLE g, b/255.0::DOUBLE b, CASE WHEN """ + IN + """ THEN abs(v-(v_n+v_s+v_w+v_e)/4)/255.0::DOUBLE ELSE 0 END c FROM ln),
  w AS (SELECT *, (c+0.001::DOUBLE)*(sqrt(pow(r-(r+g+b)/3,2)+pow(g-(r+g+b)/3,2)+pow(b-(r+g+b)/3,2))/sqrt(3.0::DOUBLE)+0.001::DOUBLE)*(exp(-pow(r-0.5::DOUBLE,2)/0.08)*exp(-pow(g-0.5::DOUBLE,2)/0.08)*exp(-pow(b-0.5::DOUBLE,2)/0.08)+0.001::DOUBLE) w FROM u)
  SELECT frame_id//4 AS stack_id, y, x, floor(sum(r*w)/greatest(sum(w),1e-6)*255+1e-6)::INT r, floor(sum(g*w)/greatest(sum(w),1e-6)*255+1e-6)::INT g, floor(sum(b*w)/greatest(sum(w),1e-6)*255+1e-6)::INT b FROM w GROUP BY 1,2,3""", LUM))
def mertens_fusion(t):
    rows = rgb_rows(t).select("frame_id", "y", F.transform("px", lambda p: F.struct(*[(p[c] / 255.0).alias(c) for c in "rgbl"])).alias("px"))
    return I.mertens(stacks(I.stencil(rows, FR)), ["stack_id"])


@query("4.31", with_ctes("WITH d AS (SELECT frame_id//4 AS stack_id, (frame_id%4-2)*1.0::DOUBLE ev, * FROM rgb), h AS (SELECT stack_id, y, x, " + ", ".join(
    f"sum(greatest(CASE WHEN {c}<=127 THEN {c}/127.0::DOUBLE ELSE (255-{c})/128.0::DOUBLE END,0.01)*({c}/255.0::DOUBLE/pow(2.0::DOUBLE,-ev)))/sum(greatest(CASE WHEN {c}<=127 THEN {c}/127.0::DOUBLE ELSE (255-{c})/128.0::DOUBLE END,0.01)) {c}" for c in "rgb")
    + " FROM d GROUP BY 1,2,3) SELECT stack_id, y, x, " + ", ".join(f"floor(least(pow({c}/(1+{c}),1/2.2::DOUBLE),1)*255+1e-6)::INT {c}" for c in "rgb") + " FROM h", RGB))
def debevec_merge(t):
    return I.debevec(stacks(rgb(t)), ["stack_id"], (F.col("slice") - 2) * F.lit(1.0))


@query("4.32", with_ctes("""WITH q AS (SELECT frame_id, y, x, v, coalesce(l*l,0) sq FROM lp), hh AS (SELECT frame_id, max(y)+1 h FROM img GROUP BY 1),
  st AS (SELECT frame_id//4 AS stack_id, max(h) h FROM hh GROUP BY 1),
  b1 AS (SELECT frame_id, y, x, sum(sq) OVER (PARTITION BY frame_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) s FROM q),
  b2 AS (SELECT frame_id, y, x, sum(s) OVER (PARTITION BY frame_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)/16 s FROM b1),
  f AS (SELECT frame_id//4 AS stack_id, frame_id%4 AS sl, y, x, CASE WHEN x BETWEEN 2 AND 61 AND y >= 2 AND y < h-2 THEN s ELSE 0 END s FROM b2 JOIN st ON st.stack_id=frame_id//4)
  SELECT stack_id, y, x, arg_max(sl, (s, -sl))::INT AS best FROM f GROUP BY 1,2,3""", NB))
def focus_stack_selection(t):
    rows = stacks(image_rows(t)).select("stack_id", "slice", "y", "px")
    d = I.focus_stack(rows, ["stack_id"], "slice")
    return d.select("stack_id", "y", F.posexplode("best").alias("x", "best"))


@query("4.32", name="focus_stack_fused")
def focus_stack_fused(t):
    rows = stacks(image_rows(t)).select("stack_id", "slice", "y", "px")
    return I.focus_stack(rows, ["stack_id"], "slice").select("stack_id", "y", F.posexplode("px").alias("x", "v"))


@query("4.33", """WITH f AS (SELECT l_orderkey, l_quantity*10+l_linenumber AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_quantity)-1 AS i, count(*) OVER (PARTITION BY l_orderkey) n FROM lineitem),
  t AS (SELECT l_orderkey, any_value(n) n, max(m) mx, arg_max(i, (m,-i)) k FROM f GROUP BY 1),
  v AS (SELECT t.*, ln(greatest(max(m) FILTER (i=k-1),1e-6)) v0, ln(greatest(mx,1e-6)) v1, ln(greatest(max(m) FILTER (i=k+1),1e-6)) v2 FROM t JOIN f USING (l_orderkey, n) GROUP BY ALL),
  p AS (SELECT *, CASE WHEN k>0 AND k<n-1 AND abs(2*(v0-2*v1+v2)) > 1e-5 THEN k+(v0-v2)/(2*(v0-2*v1+v2)) ELSE k END AS pos FROM v)
  SELECT l_orderkey, round(pos,6) AS plane, mx AS confidence, round((100+15*floor(pos))*(1-(pos-floor(pos)))+(100+15*least(floor(pos)+1,n-1))*(pos-floor(pos)),5) AS distance FROM p""")
def depth_from_focus(t):
    m = F.col("l_quantity") * 10 + F.col("l_linenumber")
    g = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber", "l_quantity", m.alias("m")))).alias("f"))  # one capture group
    d = g.select("l_orderkey", F.transform("f", lambda f: f.m).alias("m")).withColumn("z", F.transform("m", lambda _, i: 100.0 + 15.0 * i))
    out = I.depth_from_focus(F.col("m"), F.col("z"))
    return d.select("l_orderkey", rnd(out["plane"]).alias("plane"), out["confidence"].alias("confidence"), rnd(out["distance"], 5).alias("distance"))


@query("4.33", with_ctes("""WITH s AS (SELECT frame_id//4 AS stack_id, frame_id%4 AS sl, y, x, coalesce(abs(l),0) l FROM lp), n AS (SELECT stack_id, max(sl)+1 n FROM s GROUP BY 1),
  d AS (SELECT stack_id, y, x, arg_max(sl, (l,-sl))/greatest(any_value(n)-1,1) AS v FROM s JOIN n USING (stack_id) GROUP BY 1,2,3), """ + nb("d", ("v",), "dn", "stack_id")
  + f" SELECT stack_id, y, x, round(CASE WHEN {IN} THEN (v+v_n+v_s+v_w+v_e+v_nw+v_ne+v_sw+v_se)/9 ELSE v END,6) AS depth FROM dn", NB), name="coarse_depth_from_focus")
def coarse_depth_from_focus(t):
    st = stacks(grey_stencil(t))
    lap = F.when(I.interior(), F.abs(I.laplacian())).otherwise(F.lit(0))
    planes = st.groupBy("stack_id").agg(F.greatest(F.max("slice"), F.lit(1)).alias("last"))
    best = st.groupBy("stack_id", "y", "x").agg(F.max_by("slice", F.struct(lap.alias("l"), (-F.col("slice")).alias("s"))).alias("k"))
    rows = best.join(planes, "stack_id").groupBy("stack_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", (F.col("k") / F.col("last")).alias("d")))).alias("r"))  # one image row
    sm = I.stencil(rows.select("stack_id", "y", F.transform("r", lambda r: r.d).alias("px")), ["stack_id"])
    mean = (F.col("v") + sum(F.col(c) for c in I.AROUND)) / 9
    return sm.select("stack_id", "y", "x", rnd(F.when(I.interior(), mean).otherwise(F.col("v"))).alias("depth"))


@query("4.34", """WITH s AS (SELECT l_orderkey, l_quantity AS v, greatest(l_tax+0.01::DOUBLE,1e-16) va, l_partkey*10+l_linenumber AS fr FROM lineitem), c AS (SELECT l_orderkey, median(v) c, avg(sqrt(va)) nz FROM s GROUP BY 1),
  d AS (SELECT * FROM s JOIN c USING (l_orderkey)), m AS (SELECT l_orderkey, median(abs(v-c)) mad FROM d GROUP BY 1),
  f AS (SELECT *, (v-c)/(4.685::DOUBLE*greatest(1.4826::DOUBLE*mad,2.5::DOUBLE*nz,2e-6)) r FROM d JOIN m USING (l_orderkey)), w AS (SELECT *, (1-r*r)*(1-r*r)/va w FROM f WHERE abs(r) < 1),
  g AS (SELECT l_orderkey, sum(w) sw, sum(w*v)/sum(w) val, count(*) n, arg_max(fr, (w,-fr)) src, sum(w*v*v) q FROM w GROUP BY 1)
  SELECT l_orderkey, round(val,5) AS value, round(CASE WHEN n>1 THEN sqrt(greatest(greatest(q-sw*val*val,0)/(n-1),1)) ELSE 1 END/sqrt(sw),4) AS uncertainty, n AS contributors, src AS source FROM g""")
def robust_weighted_combine(t):
    s = t.lineitem.select("l_orderkey", F.col("l_quantity").alias("value"), (F.col("l_tax") + 0.01).alias("variance"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("frame"))
    d = I.robust_combine(s, ["l_orderkey"])
    return d.withColumns({"value": rnd("value", 5), "uncertainty": rnd("uncertainty", 4)})


@query("4.35", with_ctes("""WITH s AS (SELECT frame_id, (y//8)::INT ty, (x//8)::INT tx, (y%2)*2+x%2 AS site, greatest((v-16)/200.0::DOUBLE,0) sg FROM img)
  SELECT frame_id, ty AS tile_y, tx AS tile_x, site, count(*) FILTER (sg<0.7) valid, count(*) FILTER (sg>=0.7) censored, CASE WHEN count(*) FILTER (sg<0.7)>=4 THEN round(sum(sg) FILTER (sg<0.7)/count(*) FILTER (sg<0.7)/1.5::DOUBLE,7) END mean,
   CASE WHEN count(*) FILTER (sg<0.7)>=4 THEN round(sum((4+sg*200/3.0::DOUBLE)/40000) FILTER (sg<0.7)/(count(*) FILTER (sg<0.7)*count(*) FILTER (sg<0.7))/2.25,9) END variance,
   CASE WHEN count(*) FILTER (sg<0.7)=0 THEN round(0.7::DOUBLE/1.5::DOUBLE,9) END lower_bound FROM s GROUP BY 1,2,3,4""", IMG))
def radiance_observation(t):
    d = I.radiance_tiles(grey(t), FR, 8, 16.0, 200.0, 0.7, 2.0, 3.0, 1.5, 4)
    return d.withColumns({"mean": rnd("mean", 7), "variance": rnd("variance", 9), "lower_bound": rnd("lower_bound", 9)})


@query("3.24", with_ctes("""WITH a AS (SELECT y, x, (y%2)*2+x%2 AS site, y//4 AS gy, x//16 AS gx, v FROM img), gr AS (SELECT site, gy, gx, 128/greatest(avg(v),1) gain FROM a GROUP BY 1,2,3), bad AS (SELECT DISTINCT y, x FROM img WHERE v >= 250),
  p AS (SELECT frame_id, y, x, v, (y%2)*2+x%2 AS site, least(greatest((x+0.5::DOUBLE)/64*4-0.5::DOUBLE,0),3) fx, least(greatest((y+0.5::DOUBLE)/16*4-0.5::DOUBLE,0),3) fy FROM img),
  q AS (SELECT *, floor(fx) x0, floor(fy) y0, least(floor(fx)+1,3) x1, least(floor(fy)+1,3) y1 FROM p)
  SELECT frame_id, count(*) FILTER (bad.y IS NOT NULL) AS defects, round(sum(v*((a.gain+(b.gain-a.gain)*(fx-x0))*(1-(fy-y0))+(c.gain+(d.gain-c.gain)*(fx-x0))*(fy-y0))),3) AS corrected
  FROM q JOIN gr a ON a.site=q.site AND a.gy=y0 AND a.gx=x0 JOIN gr b ON b.site=q.site AND b.gy=y0 AND b.gx=x1 JOIN gr c ON c.site=q.site AND c.gy=y1 AND c.gx=x0 JOIN gr d ON d.site=q.site AND d.gy=y1 AND d.gx=x1
  LEFT JOIN bad ON bad.y=q.y AND bad.x=q.x GROUP BY 1""", IMG))
def gain_and_defects(t):
    px = grey(t)
    grid = px.groupBy(I.cfa_site().alias("site"), F.floor(F.col("y") / 4).alias("gy"), F.floor(F.col("x") / 16).alias("gx")).agg((F.lit(128.0) / F.greatest(F.avg("v"), F.lit(1.0))).alias("gain"))
    d = I.apply_gain_grid(px, grid, px.filter("v >= 250"), 64, 16, 4, 4)
    return d.groupBy("frame_id").agg(F.count_if("defect").alias("defects"), rnd(F.sum(F.col("v") * F.col("gain")), 3).alias("corrected"))


@query("8.19", with_ctes("WITH d AS (SELECT *, " + ", ".join(f"lead({c}) OVER r {c}e, lead({c}) OVER q {c}s" for c in "rgb") + """ FROM rgb WINDOW r AS (PARTITION BY frame_id, y ORDER BY x), q AS (PARTITION BY frame_id, x ORDER BY y)),
  u AS (SELECT frame_id, x, CASE WHEN mask>0 THEN floor((1-least((coalesce(abs(r-re),0)+coalesce(abs(g-ge),0)+coalesce(abs(b-be),0)+coalesce(abs(r-rs),0)+coalesce(abs(g-gs),0)+coalesce(abs(b-bs),0))/(3.0::DOUBLE*255*2),1))*255+1e-9) ELSE 255 END/255 AS u FROM d)
  SELECT frame_id, floor(x/64.0::DOUBLE*12)::INT AS bin, round(sum(u),6) AS uncertainty FROM u WHERE u >= 0.05 GROUP BY 1,2""", RGB))
def uncertainty_histogram(t):
    u = I.uncertainty_map(I.stencil(rgb_rows(t), FR))
    return I.uncertainty_bins(u, FR, WIDTH, 12).withColumn("uncertainty", rnd("uncertainty"))


COMP = """rn AS (SELECT frame_id, y, min(x) a, max(x) b FROM (SELECT frame_id, y, x, x - row_number() OVER (PARTITION BY frame_id, y ORDER BY x) g FROM img WHERE v >= 150) GROUP BY frame_id, y, g),
  eg AS (SELECT p.frame_id, p.y*1000+p.a u, q.y*1000+q.a v FROM rn p JOIN rn q ON p.frame_id=q.frame_id AND abs(p.y-q.y)=1 AND p.a<=q.b AND q.a<=p.b),
  rc AS (SELECT frame_id, y*1000+a u, y*1000+a l FROM rn UNION SELECT eg.frame_id, eg.v, rc.l FROM rc JOIN eg ON eg.frame_id=rc.frame_id AND eg.u=rc.u AND rc.l < eg.v),
  cp AS (SELECT frame_id, u, min(l) l FROM rc GROUP BY 1,2),
  cc AS (SELECT rn.frame_id, l, min(a) min_x, max(b) max_x, min(y) min_y, max(y) max_y, sum(b-a+1)::BIGINT area FROM rn JOIN cp ON cp.frame_id=rn.frame_id AND cp.u=rn.y*1000+rn.a GROUP BY 1,2)"""


def regions(t):
    return I.mask_components(image_rows(t), FR, F.transform("px", lambda v: v >= 150))


@query("10.3", f"WITH RECURSIVE {IMG}, {COMP} SELECT frame_id, min_x, max_x, min_y, max_y, area FROM cc")
def mask_regions(t):
    return regions(t).drop("component")


@query("10.3", f"""WITH RECURSIVE {IMG}, {COMP}, z AS (SELECT frame_id, max(y)+1 h, max(x)+1 w FROM img GROUP BY 1),
  s AS (SELECT cc.*, area/(w*h) sh, 1-least(sqrt(pow((min_x+max_x)/2-w/2,2)+pow((min_y+max_y)/2-h/2,2))/((w+h)/4),1) ct, (max_x-min_x+1)/(max_y-min_y+1) ar FROM cc JOIN z USING (frame_id)),
  k AS (SELECT *, round((CASE WHEN sh>0.01 AND sh<0.3 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END)*0.4::DOUBLE+ct*0.4::DOUBLE+(CASE WHEN ar>0.2 AND ar<5 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END)*0.2::DOUBLE,9) sc FROM s WHERE sh BETWEEN 0.001 AND 0.6)
  SELECT frame_id, min_x, min_y, max_x, max_y, area, sc AS score FROM k QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY sc DESC, l) = 1""", name="main_mask_region")
def main_mask_region(t):
    sizes = image_rows(t).groupBy("frame_id").agg((F.max("y") + 1).alias("h"), F.first(F.size("px")).alias("w"))
    return I.main_component(regions(t), sizes, FR)
