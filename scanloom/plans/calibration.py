"""Sensor, lens and colour calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions.numeric import rnd
from scanloom.operators import calibration as C
from scanloom.plans.inputs import IMG, grey
from scanloom.plans.registry import query, with_ctes
from scanloom.plans.scalars import lab_sql, lin_sql


def frame_pairs(t):
    """Consecutive frames as exposure pairs, kept where both frames have the pixel."""
    px = grey(t).withColumn("pair_id", F.floor(F.col("frame_id") / 2).cast("long"))
    a = px.filter("frame_id % 2 = 0").select("pair_id", "y", "x", F.col("v").alias("first"))
    return a.join(px.filter("frame_id % 2 = 1").select("pair_id", "y", "x", F.col("v").alias("second")), ["pair_id", "y", "x"])


FP = IMG + ", fp AS (SELECT a.frame_id//2 AS pair_id, a.y, a.x, ((a.y%2)*2+a.x%2)::INT AS site, a.v AS first, b.v AS second FROM img a JOIN img b ON a.frame_id%2=0 AND b.frame_id=a.frame_id+1 AND a.y=b.y AND a.x=b.x)"
TRIM = """tm AS (SELECT pair_id, site, avg(a) FILTER (ra >= n//20 AND ra < n-n//20) c1, avg(b) FILTER (rb >= n//20 AND rb < n-n//20) c2, max(n) n FROM
  (SELECT pair_id, site, a, b, row_number() OVER (PARTITION BY pair_id, site ORDER BY a)-1 ra, row_number() OVER (PARTITION BY pair_id, site ORDER BY b)-1 rb, count(*) OVER (PARTITION BY pair_id, site) n FROM sv) GROUP BY 1,2)"""


@query("4.23", with_ctes(f"""WITH sv AS (SELECT pair_id, site, y, x, first::DOUBLE a, second::DOUBLE b FROM fp), {TRIM}
  SELECT pair_id, site, n AS samples, round(any_value(c1),5) centre1, round(any_value(c2),5) centre2, round(sqrt(avg(pow(((a-c1)-(b-c2))/sqrt(2.0::DOUBLE),2))),5) rms, round(avg(abs((a-c1+b-c2)*0.5::DOUBLE)),5) pattern FROM sv JOIN tm USING (pair_id, site) GROUP BY 1,2,3""", FP))
def dark_pair_evidence(t):
    p = C.stride_pixels(frame_pairs(t), ["pair_id"], 64, 16)
    c, d = C.dark_evidence(p, ["pair_id"])
    s = d.groupBy("pair_id", "site").agg(rnd(F.sqrt(F.avg(F.col("residual") ** 2)), 5).alias("rms"), rnd(F.avg(F.abs("pattern")), 5).alias("pattern"))
    return c.select("pair_id", "site", "samples", rnd("centre1", 5).alias("centre1"), rnd("centre2", 5).alias("centre2")).join(s, ["pair_id", "site"])


@query("4.23", with_ctes(f"""WITH sv AS (SELECT pair_id, site, y, x, first fi, second se, greatest(first-16.0::DOUBLE,0) a, greatest(second-16.0::DOUBLE,0) b FROM fp), {TRIM},
  k AS (SELECT *, (c1+c2)*0.5::DOUBLE tg FROM tm), r AS (SELECT pair_id, site, fi, se, (tg/greatest(c1,1)*a+tg/greatest(c2,1)*b)*0.5::DOUBLE sg, (tg/greatest(c1,1)*a-tg/greatest(c2,1)*b)/sqrt(pow(tg/greatest(c1,1),2)+pow(tg/greatest(c2,1),2)) rs FROM sv JOIN k USING (pair_id, site)),
  pk AS (SELECT pair_id, site, min(sg) FILTER (i = round((n-1)*0.999::DOUBLE)) peak FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, site ORDER BY sg)-1 i, count(*) OVER (PARTITION BY pair_id, site) n FROM r) GROUP BY 1,2)
  SELECT k.pair_id, k.site, round(abs(c1-c2)/greatest(tg,1),6) mismatch, round(peak,4) peak, count(*) kept, round(sqrt(avg(rs*rs)),5) rms FROM k JOIN pk ON pk.pair_id=k.pair_id AND pk.site=k.site JOIN r ON r.pair_id=k.pair_id AND r.site=k.site AND fi < 250 AND se < 250 AND sg <= 234*0.8::DOUBLE GROUP BY 1,2,3,4""", FP), name="flat_pair_evidence")
def flat_pair_evidence(t):
    p = C.stride_pixels(frame_pairs(t), ["pair_id"], 64, 16)
    c, d = C.flat_evidence(p, ["pair_id"], 16.0, 250.0, 0.8)
    s = d.groupBy("pair_id", "site").agg(F.count("*").alias("kept"), rnd(F.sqrt(F.avg(F.col("residual") ** 2)), 5).alias("rms"))
    return c.select("pair_id", "site", rnd("mismatch").alias("mismatch"), rnd("peak", 4).alias("peak")).join(s, ["pair_id", "site"])


def noise_samples(t):
    res = (F.col("l_extendedprice") % 991 - 495) / 100 * F.sqrt(F.col("l_quantity"))
    return t.lineitem.select("l_linestatus", (F.col("l_linenumber") % 2).alias("site"), (F.col("l_quantity") * 20).alias("signal"), res.alias("residual"))


NOISE = """ns AS (SELECT l_linestatus, l_linenumber%2 AS site, least(floor(l_quantity*20/800*32),31)::INT AS bin, l_quantity*20 AS sg, (l_extendedprice%991-495)/100*sqrt(l_quantity) AS v FROM lineitem WHERE l_quantity*20 <= 800),
  nm AS (SELECT l_linestatus, site, bin, avg(sg) signal, count(*) n FROM ns GROUP BY 1,2,3 HAVING count(*) >= 256),
  nc AS (SELECT l_linestatus, site, bin, min(v) FILTER (i = round((n-1)*0.5::DOUBLE)) c FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus, site, bin ORDER BY v)-1 i, count(*) OVER (PARTITION BY l_linestatus, site, bin) n FROM ns) GROUP BY 1,2,3),
  nd AS (SELECT ns.*, c, abs(v-c) d FROM ns JOIN nc USING (l_linestatus, site, bin)), na AS (SELECT l_linestatus, site, bin, greatest(min(d) FILTER (i = round((n-1)*0.5::DOUBLE))/0.67448974::DOUBLE,1e-6) s0 FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus, site, bin ORDER BY d)-1 i, count(*) OVER (PARTITION BY l_linestatus, site, bin) n FROM nd) GROUP BY 1,2,3),
  nb AS (SELECT l_linestatus, site, bin, sqrt(avg(d*d)) sg6 FROM nd JOIN na USING (l_linestatus, site, bin) WHERE d <= 6*s0 GROUP BY 1,2,3), nv AS (SELECT l_linestatus, site, bin, avg(v*v) variance FROM ns JOIN nb USING (l_linestatus, site, bin) WHERE abs(v) <= 6*sg6 GROUP BY 1,2,3)"""


@query("4.25", with_ctes("SELECT l_linestatus, site, bin, round(signal,4) signal, n AS count, round(variance,5) variance FROM nm JOIN nv USING (l_linestatus, site, bin)", NOISE))
def noise_variance_bins(t):
    return C.variance_bins(noise_samples(t), ["l_linestatus", "site"], 800.0).withColumns({"signal": rnd("signal", 4), "variance": rnd("variance", 5)})


SLOPE = ", ".join([
    "bb AS (SELECT l_linestatus, site, signal AS x, variance AS v, n FROM nm JOIN nv USING (l_linestatus, site, bin))",
    """br AS (SELECT *, (v-1)/x AS ratio, sum(n) OVER (PARTITION BY l_linestatus, site ORDER BY (v-1)/x, x) AS upto, sum(n) OVER (PARTITION BY l_linestatus, site) AS total FROM bb WHERE v > 1 AND x > 0)""",
    "s0 AS (SELECT l_linestatus, site, min(ratio) FILTER (2*upto >= total) AS slope FROM br GROUP BY 1,2)",
    *[f"""s{i + 1} AS (SELECT l_linestatus, site, sum(w*x*greatest(v-1,0))/sum(w*x*x) AS slope FROM
      (SELECT *, n*CASE WHEN abs(v-p) <= 0.1::DOUBLE*greatest(p,1e-6) THEN 1 ELSE 0.1::DOUBLE/(abs(v-p)/greatest(p,1e-6)) END AS w FROM
      (SELECT bb.*, 1+slope*x AS p FROM bb JOIN s{i} USING (l_linestatus, site))) GROUP BY 1,2)""" for i in range(8)]])


@query("4.25", with_ctes("SELECT l_linestatus, site, round(slope,6)+0.0::DOUBLE AS slope, (SELECT count(*) FROM bb WHERE bb.l_linestatus=s8.l_linestatus AND bb.site=s8.site)::INT AS bins FROM s8", NOISE, SLOPE), name="shot_noise_slope")
def shot_noise_slope(t):
    b = C.variance_bins(noise_samples(t), ["l_linestatus", "site"], 800.0).withColumn("base", F.lit(1.0))
    return C.shot_slope(b, ["l_linestatus", "site"]).withColumn("slope", rnd("slope"))


@query("4.26", name="iso_calibration_gates")
def iso_calibration_gates(t):
    """Evidence rows from line items: flag as ISO, status as split, low quantities dark."""
    noise = (F.col("l_extendedprice") * 100 % 37 - 18) / 6
    other = (F.col("l_partkey") * 31 % 37 - 18) / 6
    d = t.lineitem.select(F.col("l_returnflag").alias("iso"), F.when(F.col("l_linestatus") == "F", "fit").otherwise("holdout").alias("split"), (F.col("l_suppkey") % 3).alias("pair_id"), (F.col("l_linenumber") % 4).cast("int").alias("site"),
                          (F.col("l_orderkey") % 64).alias("y"), F.col("l_partkey").alias("x"), F.ceil(F.col("l_quantity") / 10).cast("int").alias("level"), F.col("l_quantity").alias("q"), noise.alias("n1"), other.alias("n2"))
    dark = d.filter("level = 1").withColumns({"first": 64 + F.col("n1"), "second": 64 + F.col("n2")}).drop("level", "q", "n1", "n2")
    root = F.sqrt(F.col("level") * 150 / 3.0 + 9)
    flat = d.filter("level > 1").withColumns({"first": 64 + F.col("level") * 150 + F.col("n1") * root / 3, "second": 64 + F.col("level") * 150 + F.col("n2") * root / 3}).drop("q", "n1", "n2")
    r = C.evaluate_iso(dark, flat, 64.0, 1023.0)
    return r.select("iso", "site", rnd("read", 4).alias("read"), rnd("electrons_per_dn", 4).alias("electrons_per_dn"), F.array_join("failures", ",").alias("failures"), "profile")


RESP = FP + """, sg AS (SELECT pair_id, y*4//16 AS gy, x*4//64 AS gx, site, y, x, greatest(first-16.0::DOUBLE,0) a, greatest(second-16.0::DOUBLE,0) b FROM fp), rs AS (SELECT pair_id, gy, gx, site, avg((a+b)*0.5::DOUBLE) r FROM sg WHERE (a+b)*0.5::DOUBLE > 0 AND (a+b)*0.5::DOUBLE < 239*0.95::DOUBLE GROUP BY 1,2,3,4),
  tg AS (SELECT pair_id, site, r AS target FROM rs WHERE gy=1 AND gx=1), rr AS (SELECT rs.pair_id, gy, gx, rs.site, r/target AS r, target FROM rs JOIN tg ON tg.pair_id=rs.pair_id AND tg.site=rs.site)"""


@query("4.27", with_ctes("SELECT gy, gx, site, round(exp(-avg(ln(r))),6) AS gain, count(*) AS pairs, exp(-avg(ln(r))) BETWEEN 0.25 AND 4 AS safe FROM rr GROUP BY 1,2,3", RESP))
def spatial_gain_grid(t):
    r = C.grid_response(frame_pairs(t), ["pair_id"], 64, 16, 4, 4, 16.0, 255.0)
    return C.response_gains(r, []).withColumn("gain", rnd("gain"))


@query("4.27", with_ctes("""WITH d AS (SELECT sg.y, sg.x, target*r AS want, a, b FROM sg JOIN rr USING (pair_id, gy, gx, site)) SELECT y, x, count(*) AS hits FROM d WHERE want >= 2.39 AND abs(a-b)/greatest(want,1) <= 0.6 AND ((a+b)*0.5::DOUBLE/greatest(want,1) <= 0.8 OR (a+b)*0.5::DOUBLE/greatest(want,1) >= 1.2)
  GROUP BY 1,2 HAVING count(*) >= ceil((SELECT count(DISTINCT pair_id) FROM fp)*0.5::DOUBLE)""", RESP), name="persistent_sensor_defects")
def persistent_sensor_defects(t):
    p = frame_pairs(t).withColumn("camera", F.lit(0))
    r = C.grid_response(p, ["camera", "pair_id"], 64, 16, 4, 4, 16.0, 255.0)
    return C.persistent_defects(p, r, ["camera"], "pair_id", 64, 16, 4, 4, 16.0, 255.0, 0.8, 1.2, 0.6, 0.5).select("y", "x", "hits")


def _lens_sql():
    """Fit rows at 1, 2 and 4 m, holdout rows also between; radius knots 0, 0.5 and 1."""
    def blur(focal, pupil, f="f", d="d"):
        image = lambda x: f"({focal})*{x}*1000/({x}*1000-({focal}))"
        return f"(({pupil})*abs({image(f)}-{image(d)})/({image(d)}))"

    lens = "50.0::DOUBLE/2.8::DOUBLE"
    knot = "CASE WHEN r < 0.25::DOUBLE THEN 0 WHEN r <= 0.75::DOUBLE THEN 1 ELSE 2 END"
    between = "(CASE WHEN r < 0.5::DOUBLE THEN r/0.5::DOUBLE ELSE (r-0.5::DOUBLE)/0.5::DOUBLE END)"
    radial = lambda x: f"((CASE WHEN r < 0.5::DOUBLE THEN {x}.s0+({x}.s1-{x}.s0)*{between} ELSE {x}.s1+({x}.s2-{x}.s1)*{between} END)/greatest({x}.s0, 1e-8::DOUBLE))"
    share = "((1/h.f-1/lo.f)/(1/hi.f-1/lo.f))"
    mix = lambda a, b: f"({a}+({b}-{a})*{share})"
    model = blur(mix("lo.focal", "hi.focal"), f"{lens}*{mix('lo.s0', 'hi.s0')}", "h.f", "h.d")
    pick = lambda e: f"list_sort(list({e}))[round((count(*)-1)*0.95::DOUBLE)::INT+1]"
    return f"""WITH m0 AS (SELECT p_type, p_partkey % 2 = 0 AS fit, CASE WHEN p_partkey % 2 = 0 THEN [1, 2, 4][p_partkey % 3 + 1] ELSE [1, 2, 4, 1.5, 3][p_partkey % 5 + 1] END::DOUBLE AS f, p_size, 50 + p_retailprice % 5 * 0.01::DOUBLE AS fl FROM part),
  m1 AS (SELECT *, f * (1.05::DOUBLE + p_size % 7 * 0.02::DOUBLE) AS d, p_size % 11 / 10.0::DOUBLE AS r FROM m0),
  m AS (SELECT *, {blur("fl", lens)} * (1.2::DOUBLE + 0.3::DOUBLE * r) AS observed, {knot} AS knot FROM m1),
  fo AS (SELECT p_type, f, median(fl) AS focal FROM m WHERE fit GROUP BY 1, 2),
  c AS (SELECT p_type, f, focal, knot, CASE WHEN count(*) < 3 THEN 1 ELSE median(observed / {blur("focal", lens)}) END AS s FROM m JOIN fo USING (p_type, f) WHERE fit GROUP BY 1, 2, 3, 4),
  k AS (SELECT p_type, f, focal, coalesce(max(s) FILTER (knot = 0), 1) AS s0, coalesce(max(s) FILTER (knot = 1), 1) AS s1, coalesce(max(s) FILTER (knot = 2), 1) AS s2 FROM c GROUP BY 1, 2, 3),
  e AS (SELECT h.p_type, abs({blur("50.0::DOUBLE", lens, "h.f", "h.d")} - observed) / greatest(observed, 1e-8::DOUBLE) AS e0,
         abs({model} * {mix(radial("lo"), radial("hi"))} - observed) / greatest(observed, 1e-8::DOUBLE) AS e1
        FROM m h JOIN k lo ON lo.p_type = h.p_type AND lo.f = CASE WHEN h.f <= 2 THEN 1 ELSE 2 END JOIN k hi ON hi.p_type = h.p_type AND hi.f = CASE WHEN h.f <= 2 THEN 2 ELSE 4 END WHERE NOT fit)
  SELECT p_type, count(*) AS holdout, 3 AS focus_knots, round({pick("e0")}, 6) AS ideal_p95, round({pick("e1")}, 6) + 0.0::DOUBLE AS calibrated_p95, round(1 - {pick("e1")} / {pick("e0")}, 6) AS reduction FROM e GROUP BY 1"""


@query("4.28", _lens_sql(), name="lens_blur_calibration")
def lens_blur_calibration(t):
    """Lenses by part type; blur is the ideal one times a planted radial growth, also between the fitted distances."""
    pick = lambda by, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % by + 1).cast("int"))
    focus = F.when(F.col("p_partkey") % 2 == 0, pick(3, 1.0, 2.0, 4.0)).otherwise(pick(5, 1.0, 2.0, 4.0, 1.5, 3.0))
    subject = focus * (1.05 + F.col("p_size") % 7 * 0.02)
    radius = F.col("p_size") % 11 / 10.0
    focal = F.lit(50.0) + F.col("p_retailprice") % 5 * 0.01
    ideal = C.defocus(focal, F.lit(50.0 / 2.8), focus, subject)
    m = t.part.select("p_type", F.when(F.col("p_partkey") % 2 == 0, "fit").otherwise("holdout").alias("split"), focus.alias("focus_m"), subject.alias("subject_m"), radius.alias("radius"), focal.alias("focal_mm"),
                      (ideal * (1.2 + 0.3 * radius) / 0.005).alias("blur_px"), F.lit(5.0).alias("pitch_um"))
    _, rep = C.lens_psf(m, ["p_type"], [0.0, 0.5, 1.0], 50.0, 2.8)
    return rep.select("p_type", "holdout", "focus_knots", *[rnd(c).alias(c) for c in ("ideal_p95", "calibrated_p95", "reduction")])


def _ccm_sql():
    rgb = "rgb"
    s = ", ".join(f"sum(w{a}*w{b}) s{a}{b}" for a in rgb for b in rgb) + ", " + ", ".join(f"sum(w{a}*t{b}) q{a}{b}" for a in rgb for b in rgb)

    def minor(i, j):
        r, c = [k for k in rgb if k != i], [k for k in rgb if k != j]
        sign = "" if (rgb.index(i) + rgb.index(j)) % 2 == 0 else "-"
        return f"({sign}(s{r[0]}{c[0]}*s{r[1]}{c[1]}-s{r[0]}{c[1]}*s{r[1]}{c[0]}))"

    det = "(" + "+".join(f"s{'r'}{c}*{minor('r', c)}" for c in rgb) + ")"
    m = ", ".join("(" + "+".join(f"{minor(k, i)}*q{k}{j}" for k in rgb) + f")/{det} AS m{i}{j}" for i in rgb for j in rgb)
    obs = {"r": "p_size/50.0::DOUBLE", "g": "(p_retailprice-900)/210", "b": "(p_partkey%97)/97.0::DOUBLE"}
    ref = {"r": "least(0.9::DOUBLE*p_size/50.0::DOUBLE+0.05::DOUBLE,1)", "g": "least(0.8::DOUBLE*(p_retailprice-900)/210+0.1::DOUBLE*(p_partkey%97)/97.0::DOUBLE,1)", "b": "0.95::DOUBLE*(p_partkey%97)/97.0::DOUBLE"}
    base = "SELECT p_brand, " + ", ".join(f"{obs[c]} w_{c}, {ref[c]} t_{c}" for c in rgb) + " FROM part"
    lin = "SELECT p_brand, " + ", ".join(f"{lin_sql(p + '_' + c)} {p}{c}" for p in "wt" for c in rgb) + " FROM base"
    fix = ", ".join("least(greatest(" + "+".join(f"m{i}{j}*w{j}" for j in rgb) + f",0),1) AS f{i}" for i in rgb)
    return (f"WITH base AS ({base}), lin AS ({lin}), su AS (SELECT p_brand, count(*) n, {s} FROM lin GROUP BY 1), ma AS (SELECT p_brand, n, {m} FROM su WHERE n >= 6), fx AS (SELECT lin.*, n, mrr, mgg, mbb, {fix} FROM lin JOIN ma USING (p_brand)), "
            f"lb AS (SELECT p_brand, n, mrr, mgg, mbb, {lab_sql('fr', 'fg', 'fb', '1')}, {lab_sql('tr', 'tg', 'tb', '2')} FROM fx) "
            "SELECT p_brand, n AS patches, round(mrr,5) mrr, round(mgg,5) mgg, round(mbb,5) mbb, round(avg(sqrt(pow(l1-l2,2)+pow(a1-a2,2)+pow(b1-b2,2))),4) delta_e FROM lb GROUP BY 1,2,3,4,5")


@query("4.45", _ccm_sql())
def colour_matrix_fit(t):
    r, g, b = F.col("p_size") / 50.0, (F.col("p_retailprice") - 900) / 210, (F.col("p_partkey") % 97) / 97.0
    d = t.part.select("p_brand", r.alias("o_r"), g.alias("o_g"), b.alias("o_b"), F.least(0.9 * r + 0.05, F.lit(1.0)).alias("t_r"), F.least(0.8 * g + 0.1 * b, F.lit(1.0)).alias("t_g"), (0.95 * b).alias("t_b"))
    m = C.fit_colour_matrix(d, ["p_brand"])
    return m.select("p_brand", "patches", *[rnd(c, 5).alias(c) for c in ("mrr", "mgg", "mbb")], rnd("delta_e", 4).alias("delta_e"))
