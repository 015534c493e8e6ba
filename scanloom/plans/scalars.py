"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import colour, geometry as G, text
from scanloom.functions.numeric import clamp, norm, rnd
from scanloom.plans.filters import MOV, moving_splats
from scanloom.plans.inputs import RGB, e, rgb
from scanloom.plans.registry import query, with_ctes

LI = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
LIK = LI.split(", ")


def exposure_ev(shutter, aperture, iso):
    """log2 of exposure relative to 1/125 s, f/5.6, ISO 100; null when invalid."""
    valid = (shutter > 0) & (aperture > 0) & (iso > 0)
    reference = (1 / 125.0) / 5.6 ** 2
    return F.when(valid, F.log2(shutter * (iso / 100.0) / (aperture * aperture) / reference))


@query("8.1", f"""SELECT {LI}, CASE WHEN l_discount > 0 AND l_quantity > 0 AND l_tax > 0 THEN
   round(log2(l_discount*(l_tax*10000/100)/((l_quantity/5)*(l_quantity/5))/((1/125)/(5.6::DOUBLE*5.6::DOUBLE))),6)+0.0::DOUBLE END AS ev,
   CASE WHEN l_discount > 0 AND l_quantity > 0 AND l_tax > 0 THEN NULL ELSE 'invalid_exposure' END AS reason FROM lineitem""")
def exposure_value(t):
    ev = exposure_ev(F.col("l_discount"), F.col("l_quantity") / 5, F.col("l_tax") * 10000)
    return t.lineitem.select(*LIK, rnd(ev).alias("ev"), F.when(ev.isNull(), "invalid_exposure").alias("reason"))


@query("8.2", """WITH f AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN split_part(p_name,' ',1) ELSE
   replace(p_name,' ','_') || '_' || lpad(p_size::VARCHAR,3,CASE WHEN p_size > 40 THEN 'v' ELSE '0' END) || '_CAM' || (p_size % 3 + 1)::VARCHAR END AS n FROM part)
  SELECT p_partkey, CASE WHEN p LIKE 'x' THEN 0 ELSE 0 END AS zero,
   CASE WHEN n LIKE '%\\_%' ESCAPE '\\' THEN split_part(n,'_',2) ELSE 'mid' END AS vantage,
   CASE WHEN n LIKE '%\\_%' ESCAPE '\\' THEN split_part(n,'_',1) ELSE n END AS subject,
   coalesce(try_cast(split_part(n,'_',3) AS INT),0)*10.0::DOUBLE AS rotation,
   CASE WHEN n LIKE '%CAM2%' THEN 1 WHEN n LIKE '%CAM3%' THEN 2 ELSE 0 END AS camera FROM f, (SELECT '' AS p)""")
def file_name_parse(t):
    pad = F.when(F.col("p_size") > 40, F.lit("v")).otherwise(F.lit("0"))
    size = F.col("p_size").cast("string")
    padded = F.concat(F.repeat(pad, F.lit(3) - F.length(size)), size)
    name = F.when(F.col("p_size") < 10, F.get(F.split("p_name", " "), F.lit(0))).otherwise(
        F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), padded, F.lit("_CAM"), (F.col("p_size") % 3 + 1).cast("string")))
    df = t.part.select("p_partkey", name.alias("n"))
    return df.select("p_partkey", F.lit(0).alias("zero"), *[c.alias(k) for k, c in text.parse_name(F.col("n")).items()],
                     text.camera_index(F.col("n")).alias("camera"))


@query("8.3", """WITH p AS (SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN '2024:01:' || lpad((page_id % 40)::VARCHAR,2,'0') || 'T03:04:05' END AS original,
   CASE WHEN page_id % 4 = 1 THEN '2023:06:' || lpad((page_id % 33)::VARCHAR,2,'0') || ' 10:20:30' END AS digitised,
   CASE WHEN page_id % 4 = 2 AND page_id % 3 > 0 THEN TIMESTAMP '2022-01-01' + to_days((page_id % 300)::INT) END AS mtime,
   regexp_replace(url || '_2021' || lpad((page_id % 14)::VARCHAR,2,'0') || '09080706','[^0-9]','','g') AS d FROM pages),
  w AS (SELECT page_id, unnest(generate_series(1, greatest(length(d)-13,0))) AS i, d FROM p),
  v AS (SELECT page_id, arg_min(s, i) AS s FROM (SELECT page_id, i, try_strptime(substr(d,i,14),'%Y%m%d%H%M%S') AS s FROM w) WHERE s IS NOT NULL GROUP BY 1)
  SELECT p.page_id, coalesce(try_strptime(replace(original,'T',' '),'%Y:%m:%d %H:%M:%S'), try_strptime(digitised,'%Y:%m:%d %H:%M:%S'), mtime, v.s) AS taken
  FROM p LEFT JOIN v ON v.page_id = p.page_id""")
def timestamp_fallback(t):
    i = F.col("page_id")

    def two(n):
        return F.lpad((i % n).cast("string"), 2, "0")

    original = F.when(i % 4 == 0, F.concat(F.lit("2024:01:"), two(40), F.lit("T03:04:05")))
    digitised = F.when(i % 4 == 1, F.concat(F.lit("2023:06:"), two(33), F.lit(" 10:20:30")))
    mtime = F.when((i % 4 == 2) & (i % 3 > 0), F.timestamp_add("DAY", (i % 300).cast("int"), F.lit("2022-01-01").cast("timestamp")))
    name = F.concat("url", F.lit("_2021"), two(14), F.lit("09080706"))
    return t.pages.select("page_id", F.coalesce(text.exif_time(original), text.exif_time(digitised), mtime, text.compact_time(name)).alias("taken"))


FULL_FRAME_DIAGONAL_MM = 43.266615  # fixed value: 36 x 24 mm frame


def intrinsics(override, focal_mm, x_res, y_res, unit, equivalent, width, height):
    """(fx, fy, source) by the first available of four sources."""
    per = F.when(unit == 3, 10.0).otherwise(25.4)
    pfx, pfy = focal_mm * x_res / per, focal_mm * y_res / per
    plane = (pfx > 0) & (pfy > 0)
    diag = norm(width.cast("double"), height.cast("double"))
    eq = F.when(equivalent > 0, diag / 2 / F.tan(F.atan(FULL_FRAME_DIAGONAL_MM / (2.0 * equivalent))))
    guess = F.greatest(width, height) * 1.2
    source = (F.when(override.isNotNull(), "override").when(plane, "focal_plane").when(eq > 0, "focal_35mm").otherwise("heuristic"))
    return (F.coalesce(override, F.when(plane, pfx), eq, guess), F.coalesce(override, F.when(plane, pfy), eq, guess), source)


@query("8.4", """SELECT p_partkey, CASE WHEN p_brand='Brand#1' THEN 'override' WHEN p_type='ECONOMY' THEN 'focal_plane' WHEN p_type='SMALL' THEN 'focal_35mm' ELSE 'heuristic' END AS source,
  round(CASE WHEN p_brand='Brand#1' THEN p_retailprice WHEN p_type='ECONOMY' THEN p_size*p_retailprice/(CASE WHEN p_size%2=1 THEN 10.0::DOUBLE ELSE 25.4::DOUBLE END)
   WHEN p_type='SMALL' THEN sqrt(4000.0::DOUBLE*4000+3000.0::DOUBLE*3000)/2/tan(atan(43.266615::DOUBLE/(2.0::DOUBLE*p_size))) ELSE 4000*1.2::DOUBLE END, 4) AS fx FROM part""")
def intrinsics_fallback(t):
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    eco, small = F.col("p_type") == "ECONOMY", F.col("p_type") == "SMALL"
    fx, _, source = intrinsics(F.when(F.col("p_brand") == "Brand#1", price), F.when(eco, size), F.when(eco, price), F.when(eco, price),
                               F.when(F.col("p_size") % 2 == 1, 3).otherwise(2), F.when(small, size), F.lit(4000), F.lit(3000))
    return t.part.select("p_partkey", source.alias("source"), rnd(fx, 4).alias("fx"))


BC = (0.1, -0.05, 0.001, -0.002, 0.01, 0.02, 0.003, 0.001)
FE = (0.05, -0.01, 0.002, -0.001)


def _bc_sql(x, y):
    k1, k2, p1, p2, k3, k4, k5, k6 = (f"{v}::DOUBLE" for v in BC)
    r2 = f"({x}*{x}+{y}*{y})"
    rad = f"((1+{k1}*{r2}+{k2}*{r2}*{r2}+{k3}*{r2}*{r2}*{r2})/(1+{k4}*{r2}+{k5}*{r2}*{r2}+{k6}*{r2}*{r2}*{r2}))"
    return (f"({x}*{rad}+2*{p1}*{x}*{y}+{p2}*({r2}+2*{x}*{x}))", f"({y}*{rad}+{p1}*({r2}+2*{y}*{y})+2*{p2}*{x}*{y})")


def _undistort_sql():
    steps = ["u0 AS (SELECT vec_id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[1]::DOUBLE ux, embedding[2]::DOUBLE uy FROM embeddings)"]
    for i in range(8):
        dx, dy = _bc_sql("ux", "uy")
        steps.append(f"u{i+1} AS (SELECT vec_id, x, y, ux+x-{dx} AS ux, uy+y-{dy} AS uy FROM u{i})")
    dx, dy = _bc_sql("x", "y")
    th = "atan(sqrt(x*x+y*y))"
    f = "+".join(f"{k}::DOUBLE*pow({th},{2*(i+1)})" for i, k in enumerate(FE))
    sc = f"({th}*(1+{f})/sqrt(x*x+y*y))"
    return ("WITH " + ", ".join(steps) + f" SELECT vec_id, round({dx},6)+0.0::DOUBLE dx, round({dy},6)+0.0::DOUBLE dy, round(ux,6)+0.0::DOUBLE ux,"
            f" round(uy,6)+0.0::DOUBLE uy, round(x*{sc},6)+0.0::DOUBLE fx, round(y*{sc},6)+0.0::DOUBLE fy FROM u8")


@query("8.5", _undistort_sql())
def lens_distortion(t):
    df = t.embeddings.select("vec_id", e(0).alias("x"), e(1).alias("y"))
    df = G.undistort(df, "x", "y", G.brown_conrady, BC)
    d, f = G.brown_conrady(F.col("x"), F.col("y"), BC), G.fisheye(F.col("x"), F.col("y"), FE)
    return df.select("vec_id", *[rnd(c).alias(n) for n, c in
                                 (("dx", d[0]), ("dy", d[1]), ("ux", F.col("_ux")), ("uy", F.col("_uy")), ("fx", f[0]), ("fy", f[1]))])


def _pose_sql():
    q = "WITH b AS (SELECT vec_id, " + ", ".join(f"embedding[{i+1}]::DOUBLE e{i}" for i in range(10)) + " FROM embeddings), n AS (SELECT *, sqrt(e3*e3+e4*e4+e5*e5+e6*e6) AS l FROM b), "
    q += "m AS (SELECT *, e3/l qw, e4/l qx, e5/l qy, e6/l qz FROM n), r AS (SELECT *, "
    q += "1-2*(qy*qy+qz*qz) r00, 2*(qx*qy-qw*qz) r01, 2*(qx*qz+qw*qy) r02, 2*(qx*qy+qw*qz) r10, 1-2*(qx*qx+qz*qz) r11, 2*(qy*qz-qw*qx) r12, 2*(qx*qz-qw*qy) r20, 2*(qy*qz+qw*qx) r21, 1-2*(qx*qx+qy*qy) r22 FROM m), "
    q += "w AS (SELECT *, r00*e0+r01*e1+r02*e2+e7 wx, r10*e0+r11*e1+r12*e2+e8 wy, r20*e0+r21*e1+r22*e2+e9 wz, "
    q += "r00*(e0-e7)+r10*(e1-e8)+r20*(e2-e9) cx, r01*(e0-e7)+r11*(e1-e8)+r21*(e2-e9) cy, r02*(e0-e7)+r12*(e1-e8)+r22*(e2-e9) cz FROM r) "
    q += "SELECT vec_id, " + ", ".join(f"round({c},6)+0.0::DOUBLE {c}" for c in ("wx", "wy", "wz", "cx", "cy", "cz"))
    q += ", CASE WHEN cz > 0.01 THEN round(500*cx/cz+320,2)+0.0::DOUBLE END u, CASE WHEN cz > 0.01 THEN round(500*cy/cz+240,2)+0.0::DOUBLE END v FROM w"
    return q


@query("8.6", _pose_sql())
def pose_algebra(t):
    length = norm(e(3), e(4), e(5), e(6))
    df = t.embeddings.select("vec_id", *[e(i).alias(f"e{i}") for i in range(10)], length.alias("l"))
    q = tuple(F.col(f"e{i}") / F.col("l") for i in range(3, 7))
    p, tr = tuple(F.col(f"e{i}") for i in range(3)), tuple(F.col(f"e{i}") for i in range(7, 10))
    w, c = G.camera_to_world(q, tr, p), G.world_to_camera(q, tr, p)
    df = df.select("vec_id", *[v.alias(n) for n, v in zip(("wx", "wy", "wz", "cx", "cy", "cz"), (*w, *c))])
    u, v = G.project((F.col("cx"), F.col("cy"), F.col("cz")), 500.0, 500.0, 320.0, 240.0)
    near = F.col("cz") > 0.01
    return df.select("vec_id", *[rnd(n).alias(n) for n in ("wx", "wy", "wz", "cx", "cy", "cz")],
                     F.when(near, rnd(u, 2)).alias("u"), F.when(near, rnd(v, 2)).alias("v"))


@query("8.7", f"""WITH d AS (SELECT *, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 1 WHEN 'AO' THEN 2 WHEN 'NF' THEN 3 ELSE 4 END AS dir FROM lineitem)
  SELECT {LI}, round((CASE WHEN dir IN (2,4) THEN -1 ELSE 1 END)*((CASE WHEN dir IN (1,2) THEN l_quantity/(51-1) ELSE l_linenumber/(8.0::DOUBLE-1) END)-0.5::DOUBLE)*(l_tax*100/1000),9)+0.0::DOUBLE AS dt FROM d""")
def rolling_shutter(t):
    key = F.concat("l_returnflag", "l_linestatus")
    direction = (F.when(key == "AF", "top_to_bottom").when(key == "AO", "bottom_to_top").when(key == "NF", "left_to_right").otherwise("right_to_left"))
    dt = G.shutter_offset(direction, F.col("l_linenumber").cast("double"), F.col("l_quantity"), F.lit(8.0), F.lit(51.0), F.col("l_tax") * 100)
    return t.lineitem.select(*LIK, rnd(dt, 9).alias("dt"))


@query("8.8", f"""WITH b AS (SELECT {LI}, l_quantity ax, l_discount*100 ay, l_tax*100 az, l_quantity+l_linenumber bx, l_discount*100+3 by_, l_tax*100+2 bz,
   l_partkey%50 cx, l_suppkey%10 cy, l_linenumber cz, l_partkey%50+6 dx, l_suppkey%10+5 dy, l_linenumber+4 dz FROM lineitem),
  i AS (SELECT *, least(bx,dx)-greatest(ax,cx) ix, least(by_,dy)-greatest(ay,cy) iy, least(bz,dz)-greatest(az,cz) iz FROM b)
  SELECT {LI}, round((bx-ax)*(by_-ay)*(bz-az),6) AS volume, round(2*((bx-ax)*(by_-ay)+(by_-ay)*(bz-az)+(bz-az)*(bx-ax)),6) AS area,
   (ix>=0 AND iy>=0 AND iz>=0) AS touch, CASE WHEN ix>=0 AND iy>=0 AND iz>=0 THEN round(ix*iy*iz/((bx-ax)*(by_-ay)*(bz-az)+120-ix*iy*iz),6)+0.0::DOUBLE ELSE 0.0::DOUBLE END AS iou,
   round((bx-ax+2)*(by_-ay+2)*(bz-az+2),6) AS grown, (cx BETWEEN ax AND bx AND cy BETWEEN ay AND by_ AND cz BETWEEN az AND bz) AS holds FROM i""")
def box_functions_3d(t):
    lo = (F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100)
    hi = (lo[0] + F.col("l_linenumber"), lo[1] + 3, lo[2] + 2)
    blo = tuple(c.cast("double") for c in (F.col("l_partkey") % 50, F.col("l_suppkey") % 10, F.col("l_linenumber")))
    bhi = (blo[0] + 6, blo[1] + 5, blo[2] + 4)
    grown = G.box_volume(tuple(c - 1.0 for c in lo), tuple(c + 1.0 for c in hi))
    holds = blo[0].between(lo[0], hi[0]) & blo[1].between(lo[1], hi[1]) & blo[2].between(lo[2], hi[2])
    return t.lineitem.select(*LIK, rnd(G.box_volume(lo, hi)).alias("volume"), rnd(G.box_area(lo, hi)).alias("area"),
                             G.boxes_touch(lo, hi, blo, bhi).alias("touch"), rnd(G.box_iou(lo, hi, blo, bhi)).alias("iou"),
                             rnd(grown).alias("grown"), holds.alias("holds"))


@query("8.9", f"""WITH b AS (SELECT {LI}, l_quantity::BIGINT x, l_linenumber::BIGINT y, l_partkey%40+1 w, l_suppkey%9+1 h, l_partkey%50 u, 3::BIGINT v FROM lineitem),
  i AS (SELECT *, greatest(x,u) x1, greatest(y,v) y1, least(x+w,u+20) x2, least(y+h,v+6) y2 FROM b)
  SELECT {LI}, w*h AS area, (u>=x AND u<x+w AND v>=y AND v<y+h) AS holds, CASE WHEN x2>x1 AND y2>y1 THEN (x2-x1)*(y2-y1) END AS overlap,
   floor(w*1.5::DOUBLE)::BIGINT AS scaled_w, floor(x-w*0.1::DOUBLE)::BIGINT AS bx0, ceil((x-w*0.1::DOUBLE)+(w+2*(w*0.1::DOUBLE)))::BIGINT AS bx1 FROM i""")
def box_functions_2d(t):
    x, y = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    w, h = F.col("l_partkey") % 40 + 1, F.col("l_suppkey") % 9 + 1
    u, v = F.col("l_partkey") % 50, F.lit(3).cast("long")
    hit = G.rect_intersection((x, y, w, h), (u, v, F.lit(20), F.lit(6)))
    grown_x, grown_w = x - w * 0.1, w + 2 * (w * 0.1)
    return t.lineitem.select(*LIK, (w * h).alias("area"), ((u >= x) & (u < x + w) & (v >= y) & (v < y + h)).alias("holds"),
                             (hit["w"] * hit["h"]).alias("overlap"), F.floor(w * 1.5).alias("scaled_w"),
                             F.floor(grown_x).alias("bx0"), F.ceil(grown_x + grown_w).alias("bx1"))


def hamming(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def packed_signs(vector):
    """Sign bits of up to 64 values in one long."""
    bits = F.transform(vector, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))


def l2(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda s, v: s + v))


@query("8.10", """WITH f AS (SELECT label, arg_min(embedding, vec_id) AS f FROM embeddings GROUP BY 1),
  u AS (SELECT vec_id, unnest(embedding)::DOUBLE a, unnest(f)::DOUBLE b FROM embeddings JOIN f USING (label))
  SELECT vec_id, count(*) FILTER ((a>0) <> (b>0))::INT AS hamming, round(sqrt(sum((a-b)*(a-b))),6) AS l2 FROM u GROUP BY 1""")
def descriptor_distance(t):
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return t.embeddings.join(first, "label").select(
        "vec_id", hamming(packed_signs(F.col("embedding")), packed_signs(F.col("first"))).alias("hamming"),
        rnd(l2(F.col("embedding"), F.col("first"))).alias("l2"))


def lin_sql(c):
    return f"(CASE WHEN {c} <= 0.04045 THEN {c}/12.92::DOUBLE ELSE pow(({c}+0.055::DOUBLE)/1.055::DOUBLE, 2.4) END)"


def lab_sql(r, g, b, out):
    """Two CTE select lists: linear to Lab, columns suffixed by ``out``."""
    def f(v):
        return f"(CASE WHEN {v} > 0.008856 THEN pow({v}, 1.0::DOUBLE/3) ELSE 7.787::DOUBLE*{v}+16.0::DOUBLE/116 END)"

    x = f"(({r}*0.4124::DOUBLE+{g}*0.3576::DOUBLE+{b}*0.1805::DOUBLE)/0.95047::DOUBLE)"
    y = f"({r}*0.2126::DOUBLE+{g}*0.7152::DOUBLE+{b}*0.0722::DOUBLE)"
    z = f"(({r}*0.0193::DOUBLE+{g}*0.1192::DOUBLE+{b}*0.9505::DOUBLE)/1.08883::DOUBLE)"
    return f"116*{f(y)}-16 AS l{out}, 500*({f(x)}-{f(y)}) AS a{out}, 200*({f(y)}-{f(z)}) AS b{out}"


@query("8.11", f"""WITH c AS (SELECT {LI}, l_discount*10 AS r, l_tax*12.5::DOUBLE AS g, l_quantity/50 AS b FROM lineitem),
  n AS (SELECT {LI}, {lin_sql('r')} lr, {lin_sql('g')} lg, {lin_sql('b')} lb, {lin_sql('0.5::DOUBLE')} k FROM c),
  q AS (SELECT {LI}, {lab_sql('lr','lg','lb','1')}, {lab_sql('k','k','k','2')} FROM n)
  SELECT {LI}, round(l1,4)+0.0::DOUBLE l, round(a1,4)+0.0::DOUBLE a, round(b1,4)+0.0::DOUBLE b, round(sqrt((l1-l2)*(l1-l2)+(a1-a2)*(a1-a2)+(b1-b2)*(b1-b2)),4) de FROM q""")
def colour_difference(t):
    rgb_ = (F.col("l_discount") * 10, F.col("l_tax") * 12.5, F.col("l_quantity") / 50)
    df = t.lineitem.select(*LIK, *[colour.linear(c).alias(n) for c, n in zip(rgb_, "rgb")], colour.linear(F.lit(0.5)).alias("k"))
    lab1 = colour.lab(colour.xyz((F.col("r"), F.col("g"), F.col("b"))))
    lab2 = colour.lab(colour.xyz((F.col("k"),) * 3))
    df = df.select(*LIK, *[c.alias(n) for n, c in zip("lab", lab1)], *[c.alias(n + "2") for n, c in zip("lab", lab2)])
    de = colour.delta_e(tuple(F.col(c) for c in "lab"), tuple(F.col(c + "2") for c in "lab"))
    return df.select(*LIK, *[rnd(c, 4).alias(c) for c in "lab"], rnd(de, 4).alias("de"))


def tone_map(pixels, keys=("frame_id",)):
    """Linear channels scaled so that the image maximum is 0.6, dark chroma
    reduced, then sRGB encoded to 8 bits (truncated)."""
    top = pixels.groupBy(*keys).agg(F.max(F.greatest("r", "g", "b")).alias("_top"))
    gain = F.when(F.col("_top") > 0.01, F.lit(0.6) / F.col("_top")).otherwise(F.lit(1.0))
    px = pixels.join(top, list(keys)).withColumn("_gain", gain).drop("_top")
    px = px.withColumns({c: F.least(F.col(c) * F.col("_gain"), F.lit(1.0)) for c in "rgb"})
    px = px.withColumn("_l", colour.luma(F.col("r"), F.col("g"), F.col("b")))
    s = F.when(F.col("_l") < 0.15, clamp((F.lit(0.15) - F.col("_l")) / 0.15, 0.0, 1.0)).otherwise(F.lit(0.0))
    px = px.withColumn("_s", s)
    px = px.withColumns({c: F.col(c) * (1.0 - F.col("_s")) + F.col("_l") * F.col("_s") for c in "rgb"})
    px = px.withColumns({c: F.floor(clamp(colour.encode(F.col(c)), 0.0, 1.0) * 255 + 1e-9).cast("int") for c in "rgb"})
    return px.drop("_gain", "_l", "_s")


def _enc(c):
    return f"floor(least(greatest(CASE WHEN {c} <= 0.0031308 THEN {c}*12.92::DOUBLE ELSE pow({c}, 1.0::DOUBLE/2.4)*1.055::DOUBLE-0.055::DOUBLE END,0),1)*255+1e-9)::INT"


@query("8.12", with_ctes(f"""WITH l AS (SELECT frame_id, y, x, r/255.0::DOUBLE r, g/255.0::DOUBLE g, b/255.0::DOUBLE b FROM rgb),
  m AS (SELECT frame_id, max(greatest(r,g,b)) m FROM l GROUP BY 1),
  s AS (SELECT frame_id, y, x, least(r*k,1) r, least(g*k,1) g, least(b*k,1) b FROM l JOIN (SELECT frame_id, CASE WHEN m > 0.01 THEN 0.6::DOUBLE/m ELSE 1 END k FROM m) USING (frame_id)),
  u AS (SELECT *, 0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b lu FROM s), w AS (SELECT *, CASE WHEN lu < 0.15 THEN least(greatest((0.15::DOUBLE-lu)/0.15::DOUBLE,0),1) ELSE 0 END q FROM u),
  z AS (SELECT frame_id, y, x, r*(1-q)+lu*q r, g*(1-q)+lu*q g, b*(1-q)+lu*q b FROM w)
  SELECT frame_id, y, x, {_enc('r')} r, {_enc('g')} g, {_enc('b')} b FROM z""", RGB))
def tone_mapping(t):
    px = rgb(t).select("frame_id", "y", "x", *[(F.col(c) / 255.0).alias(c) for c in "rgb"])
    return tone_map(px)


@query("8.13", """SELECT event_id, CASE WHEN value/100 < 0.1 THEN 'static' WHEN value/100 < 0.4 THEN 'slow' WHEN value/100 < 0.8 THEN 'dynamic' ELSE 'rapid' END AS motion,
  CASE WHEN value/100 < 0.1 THEN 30 WHEN value/100 < 0.4 THEN 5 ELSE 1 END AS interval_frames FROM events""")
def motion_class(t):
    c, i = classify_motion(F.col("value") / 100)
    return t.events.select("event_id", c.alias("motion"), i.alias("interval_frames"))


def classify_motion(s):
    return (F.when(s < 0.1, "static").when(s < 0.4, "slow").when(s < 0.8, "dynamic").otherwise("rapid"),
            F.when(s < 0.1, 30).when(s < 0.4, 5).otherwise(1))


@query("8.14", f"""WITH d AS (SELECT {LI}, sqrt(l_quantity*l_quantity + l_linenumber*l_linenumber) AS px, l_extendedprice, l_tax FROM lineitem)
  SELECT {LI}, round(px/(l_extendedprice/1000),6) AS pixels_per_mm, round(10.0::DOUBLE/(px/(l_extendedprice/1000)),6) AS mm_of_ten, round((l_tax+1)/px,6) AS meters_per_unit FROM d""")
def gauge_measure(t):
    px = norm(F.col("l_quantity"), F.col("l_linenumber").cast("double"))
    scale = px / (F.col("l_extendedprice") / 1000)
    return t.lineitem.select(*LIK, rnd(scale).alias("pixels_per_mm"), rnd(10.0 / scale).alias("mm_of_ten"),
                             rnd((F.col("l_tax") + 1) / px).alias("meters_per_unit"))


@query("8.15", with_ctes("""SELECT splat_id, round(x+vx*(0.25::DOUBLE-w),6)+0.0::DOUBLE x, round(opacity*exp(-0.5::DOUBLE*(0.25::DOUBLE-w)*(0.25::DOUBLE-w)/var_t),6) opacity,
  round(least(greatest(opacity+0.1::DOUBLE*(0.25::DOUBLE-w)*vy+0.3::DOUBLE,0),1),6)+0.0::DOUBLE red FROM mov""", MOV))
def state_at_time(t):
    dt = F.lit(0.25) - F.col("centre_t")
    weight = F.exp(-0.5 * dt * dt / F.col("var_t"))
    return moving_splats(t).select("splat_id", rnd(F.col("x") + F.col("vx") * dt).alias("x"), rnd(F.col("opacity") * weight).alias("opacity"),
                                   rnd(clamp(F.col("opacity") + 0.1 * dt * F.col("vy") + 0.3, 0.0, 1.0)).alias("red"))


@query("8.16", """WITH s AS (SELECT vec_id, embedding[1]::DOUBLE*8-6 AS s0, 2*sqrt(embedding[2]::DOUBLE*embedding[2]::DOUBLE+embedding[3]::DOUBLE*embedding[3]::DOUBLE+4)/500 AS m FROM embeddings)
  SELECT vec_id, round(CASE WHEN exp(s0) >= m THEN s0 WHEN exp(s0+0.7::DOUBLE) >= m THEN s0+0.7::DOUBLE WHEN exp(s0+1.4::DOUBLE) >= m THEN s0+1.4::DOUBLE ELSE s0+2.1::DOUBLE END,6)+0.0::DOUBLE AS scale FROM s""")
def level_of_detail(t):
    s0 = e(0) * 8 - 6
    distance = norm(e(1), e(2), F.lit(2.0))
    scales = F.array(s0, s0 + 0.7, s0 + 1.4, s0 + 2.1)
    return t.embeddings.select("vec_id", rnd(G.pick_lod(scales, 2 * distance / 500)).alias("scale"))


@query("8.17", """SELECT l_orderkey, sha256('capture-group' || chr(0) || count(*)::VARCHAR || chr(0) ||
  string_agg(l_partkey::VARCHAR || '_' || l_linenumber::VARCHAR, chr(0) ORDER BY l_partkey, l_linenumber)) AS group_id FROM lineitem GROUP BY 1""")
def stable_group_ids(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))).alias("f"))
    names = F.transform("f", lambda f: F.concat(f.l_partkey.cast("string"), F.lit("_"), f.l_linenumber.cast("string")))
    return g.select("l_orderkey", text.stable_id("capture-group", F.size("f").cast("string"), F.array_join(names, "\x00")).alias("group_id"))


@query("8.18", """SELECT event_id, '{"token":"[redacted]","n":{"Password":"[redacted]","k":"[redacted]","v":[{"secret":"[redacted]"},' || (props::JSON->>'$.k') || ']}}' AS details, NULL::VARCHAR AS ip FROM events""")
def json_redaction(t):
    k = F.get_json_object("props", "$.k")
    raw = F.concat(F.lit('{"token":"t'), "event_id", F.lit('","n":{"Password":"p","k":'), k, F.lit(',"v":[{"secret":1},'), k, F.lit("]}}"))
    return t.events.select("event_id", text.redact_json(("k",))(raw).alias("details"), F.lit(None).cast("string").alias("ip"))
