"""Neighbour search, outliers, clustering and surfaces on point tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions.numeric import rnd
from scanloom.operators import spatial as S
from scanloom.plans.inputs import PTS, points
from scanloom.plans.registry import query, with_ctes

D = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


def xyz(t):
    return points(t).select("cloud_id", "point_id", "x", "y", "z")


@query("3.9", with_ctes(f"""SELECT a.cloud_id, a.point_id, round(min({D}),6) AS distance, arg_min(b.point_id, ({D}, b.point_id)) AS nearest_id FROM pts a JOIN pts b ON b.cloud_id = (a.cloud_id + 1) % 10 GROUP BY 1, 2""", PTS))
def nearest_point_join(t):
    """Each point against the cloud of the next label."""
    q = xyz(t)
    target = q.withColumn("cloud_id", (F.col("cloud_id") + 9) % 10)
    d = S.nearest(q, target, ["cloud_id"], "point_id", "point_id")
    return d.withColumn("distance", rnd("distance"))


@query("3.10", with_ctes(f"""SELECT a.cloud_id, a.point_id FROM pts a JOIN pts b ON a.cloud_id=b.cloud_id AND {D} > 0 AND {D} < 0.15 GROUP BY 1,2 HAVING count(*) >= 6""", PTS))
def radius_outliers(t):
    return S.remove_radius_outliers(xyz(t), ["cloud_id"], "point_id", 0.15, 6).select("cloud_id", "point_id")


KD = f"""kd AS (SELECT a.cloud_id, a.point_id, a.x ax, a.y ay, a.z az, b.x, b.y, b.z, {D} AS d, row_number() OVER (PARTITION BY a.cloud_id, a.point_id ORDER BY {D}, b.point_id) AS r FROM pts a JOIN pts b ON a.cloud_id=b.cloud_id)"""


@query("3.11", with_ctes("""WITH m AS (SELECT cloud_id, point_id, avg(d) md FROM kd WHERE r BETWEEN 2 AND 9 GROUP BY 1,2), s AS (SELECT cloud_id, avg(md)+1.5::DOUBLE*stddev_pop(md) cut FROM m GROUP BY 1)
  SELECT cloud_id, point_id, round(md,6) AS mean_distance FROM m JOIN s USING (cloud_id) WHERE md < cut""", PTS, KD))
def statistical_outliers(t):
    return S.remove_statistical_outliers(xyz(t), ["cloud_id"], "point_id", 8, 1.5).withColumn("mean_distance", rnd("mean_distance"))


@query("3.12", with_ctes("""SELECT cloud_id, point_id, round(sum((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz)),6) AS spread FROM
  (SELECT *, avg(x) OVER w mx, avg(y) OVER w my, avg(z) OVER w mz FROM kd WHERE r <= 8 WINDOW w AS (PARTITION BY cloud_id, point_id)) GROUP BY 1,2""", PTS, KD))
def neighbour_covariance(t):
    """Trace of the neighbour covariance that the normals are taken from."""
    d = S.knn(xyz(t), xyz(t), ["cloud_id"], "point_id", "point_id", 8, rows_per_block=150)
    def tot(f):
        return F.aggregate("neighbours", F.lit(0.0), lambda s, e: s + e.weight * f(e))
    n = tot(lambda e: F.lit(1.0))
    spread = sum(tot(lambda e, a=a: e[a] * e[a]) - tot(lambda e, a=a: e[a]) * tot(lambda e, a=a: e[a]) / n for a in "xyz")
    return d.select("cloud_id", "point_id", rnd(spread).alias("spread"))


@query("3.12", name="neighbour_normals")
def neighbour_normals(t):
    n = S.estimate_normals(xyz(t), ["cloud_id"], "point_id", 8)
    flip = F.when((F.col("nz") < 0) | ((F.col("nz") == 0) & (F.col("nx") < 0)), -1.0).otherwise(1.0)
    return n.select("cloud_id", "point_id", *[rnd(F.col(c) * flip).alias(c) for c in ("nx", "ny", "nz")])


@query("3.26", """WITH v AS (SELECT s_suppkey, s_nationkey % 4 AS scene, (s_acctbal::DOUBLE)/1000 AS x, (s_nationkey*37 % 25)::DOUBLE AS y, (s_suppkey % 11)::DOUBLE AS z FROM supplier)
  SELECT v.s_suppkey AS view_id, coalesce(string_agg(o, ',' ORDER BY r), '') AS sources FROM v LEFT JOIN (SELECT a.s_suppkey, b.s_suppkey::VARCHAR o, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), b.s_suppkey) r
   FROM v a JOIN v b ON a.scene=b.scene AND a.s_suppkey<>b.s_suppkey) n ON n.s_suppkey=v.s_suppkey AND r <= 4 GROUP BY 1""")
def nearest_views(t):
    v = t.supplier.select((F.col("s_nationkey") % 4).alias("scene"), F.col("s_suppkey").alias("view_id"), (F.col("s_acctbal") / 1000).alias("x"),
                          (F.col("s_nationkey") * 37 % 25).cast("double").alias("y"), (F.col("s_suppkey") % 11).cast("double").alias("z"))
    d = S.knn_ids(v, v, ["scene"], "view_id", "view_id", 4, exclude_self=True, rows_per_block=150)
    return d.select("view_id", F.coalesce(F.array_join(F.transform("neighbours", lambda e: e.id.cast("string")), ","), F.lit("")).alias("sources"))


@query("3.27", with_ctes("""WITH b AS (SELECT cloud_id, min(x)-0.2::DOUBLE bx, min(y)-0.2::DOUBLE by_, min(z)-0.2::DOUBLE bz, ceil((max(x)-min(x)+0.4::DOUBLE)/0.2::DOUBLE)::INT nx, ceil((max(y)-min(y)+0.4::DOUBLE)/0.2::DOUBLE)::INT ny, ceil((max(z)-min(z)+0.4::DOUBLE)/0.2::DOUBLE)::INT nz FROM pts GROUP BY 1),
  g AS (SELECT cloud_id, i ix, j iy, k iz, bx+i*0.2::DOUBLE x, by_+j*0.2::DOUBLE y, bz+k*0.2::DOUBLE z FROM b, generate_series(0,11) a(i), generate_series(0,11) c(j), generate_series(0,11) d(k) WHERE i < nx AND j < ny AND k < nz),
  vc AS (SELECT cloud_id, floor(x/0.2::DOUBLE) vx, floor(y/0.2::DOUBLE) vy, floor(z/0.2::DOUBLE) vz, count(*) AS n FROM pts GROUP BY 1,2,3,4), m AS (SELECT *, max(n) OVER (PARTITION BY cloud_id) mx FROM vc)
  SELECT g.cloud_id, g.ix, g.iy, g.iz FROM g WHERE EXISTS (SELECT 1 FROM pts p WHERE p.cloud_id=g.cloud_id AND (p.x-g.x)*(p.x-g.x)+(p.y-g.y)*(p.y-g.y)+(p.z-g.z)*(p.z-g.z) < 0.16)
   AND NOT EXISTS (SELECT 1 FROM m WHERE m.cloud_id=g.cloud_id AND vx=floor(g.x/0.2::DOUBLE) AND vy=floor(g.y/0.2::DOUBLE) AND vz=floor(g.z/0.2::DOUBLE) AND n/mx >= 0.2)""", PTS))
def coverage_gaps(t):
    return S.coverage_gaps(xyz(t), ["cloud_id"], 0.2).select("cloud_id", "ix", "iy", "iz")


@query("4.10", with_ctes(f"""WITH d AS (SELECT a.cloud_id//2 AS g, a.cloud_id%2 AS s, a.point_id, min({D}) d FROM pts a JOIN pts b ON a.cloud_id//2=b.cloud_id//2 AND a.cloud_id<>b.cloud_id GROUP BY 1,2,3),
  s AS (SELECT g, avg(d) FILTER (s=0) m0, avg(d) FILTER (s=1) m1, max(d) mx, avg((d<=0.1)::INT) FILTER (s=0) p, avg((d<=0.1)::INT) FILTER (s=1) r FROM d GROUP BY 1)
  SELECT g AS pair_id, round((m0+m1)*0.5::DOUBLE,6) chamfer, round(mx,6) hausdorff, round(p,6) "precision", round(r,6) recall, round(2*p*r/(p+r),6) fscore FROM s""", PTS))
def geometry_metrics(t):
    p = xyz(t).withColumn("pair_id", F.floor(F.col("cloud_id") / 2).cast("int"))
    d = S.geometry_metrics(p.filter("cloud_id % 2 = 0"), p.filter("cloud_id % 2 = 1"), ["pair_id"], "point_id", 0.1)
    return d.select("pair_id", *[rnd(c).alias(c) for c in ("chamfer", "hausdorff", "precision", "recall", "fscore")])


@query("4.10 3.12", name="geometry_normal_consistency")
def geometry_normal_consistency(t):
    p = xyz(t).withColumn("pair_id", F.floor(F.col("cloud_id") / 2).cast("int"))
    d = S.geometry_metrics(p.filter("cloud_id % 2 = 0"), p.filter("cloud_id % 2 = 1"), ["pair_id"], "point_id", 0.1, normal_k=8)
    return d.select("pair_id", rnd("normal_consistency").alias("normal_consistency"))


@query("4.49", with_ctes("""WITH o AS (SELECT *, x*3 nx, y*3 ny, 0.5::DOUBLE nz FROM pts), b AS (SELECT cloud_id, min(x) lx, min(y) ly, min(z) lz, max(x) hx, max(y) hy, max(z) hz FROM pts GROUP BY 1), c AS (SELECT *, sqrt((hx-lx)*(hx-lx)+(hy-ly)*(hy-ly)+(hz-lz)*(hz-lz))*0.05::DOUBLE pad FROM b),
  v AS (SELECT cloud_id, lx-pad bx, ly-pad by_, lz-pad bz, hx-lx+2*pad ex, hy-ly+2*pad ey, hz-lz+2*pad ez FROM c), w AS (SELECT *, greatest(ex,ey,ez)/16 vs FROM v),
  g AS (SELECT o.cloud_id, point_id, floor((x-bx)/vs)::INT+i vx, floor((y-by_)/vs)::INT+j vy, floor((z-bz)/vs)::INT+k vz, x,y,z,nx,ny,nz,bx,by_,bz,vs,ex,ey,ez FROM o JOIN w USING (cloud_id), generate_series(-3,3) a(i), generate_series(-3,3) e(j), generate_series(-3,3) f(k)),
  h AS (SELECT *, bx+vx*vs-x gx, by_+vy*vs-y gy, bz+vz*vs-z gz FROM g WHERE vx BETWEEN 0 AND ceil(ex/vs) AND vy BETWEEN 0 AND ceil(ey/vs) AND vz BETWEEN 0 AND ceil(ez/vs)),
  q AS (SELECT *, sqrt(gx*gx+gy*gy+gz*gz) d FROM h)
  SELECT cloud_id, vx, vy, vz, round(arg_min(CASE WHEN gx*nx+gy*ny+gz*nz > 0 THEN d ELSE -d END, (d, point_id)),6)+0.0::DOUBLE AS sdf FROM q GROUP BY 1,2,3,4""", PTS))
def signed_distance_field(t):
    p = xyz(t).withColumns({"nx": F.col("x") * 3, "ny": F.col("y") * 3, "nz": F.lit(0.5)})
    return S.signed_distance(p, ["cloud_id"], 16).withColumn("sdf", rnd("sdf"))


@query("10.1", f"""WITH RECURSIVE {PTS}, e AS (SELECT a.cloud_id, a.point_id u, b.point_id v FROM pts a JOIN pts b ON a.cloud_id=b.cloud_id AND {D} < 0.11),
  r AS (SELECT cloud_id, u, u AS l FROM e UNION SELECT e.cloud_id, e.v, r.l FROM r JOIN e ON e.u=r.u AND r.l < e.v),
  c AS (SELECT cloud_id, u, min(l) AS component FROM r GROUP BY 1,2),
  b AS (SELECT c.cloud_id, component, count(*) AS points, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz FROM c JOIN pts p ON p.point_id=c.u GROUP BY 1,2 HAVING count(*) >= 2)
  SELECT cloud_id, component, points, round((lx+hx)/2,6)+0.0::DOUBLE cx, round((ly+hy)/2,6)+0.0::DOUBLE cy, round((lz+hz)/2,6)+0.0::DOUBLE cz FROM b QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY component) <= 10""")
def euclidean_clusters(t):
    c = S.cluster(xyz(t), ["cloud_id"], "point_id", 0.11, 2, 10)
    return c.select("cloud_id", "component", "points", *[rnd((F.col("lo" + d) + F.col("hi" + d)) / 2).alias("c" + d) for d in "xyz"])


@query("10.6", with_ctes("""WITH k AS (SELECT point_id, cloud_id, floor((x+0.5::DOUBLE)*40)::INT px, floor((y+0.5::DOUBLE)*40)::INT py, confidence r FROM pts)
  SELECT cloud_id, point_id FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE a.cloud_id=b.cloud_id AND abs(a.px-b.px) <= 2 AND abs(a.py-b.py) <= 2 AND (a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py) < 9 AND b.r > a.r)""", PTS))
def keypoint_suppression(t):
    k = points(t).select("cloud_id", "point_id", F.floor((F.col("x") + 0.5) * 40).cast("int").alias("px"), F.floor((F.col("y") + 0.5) * 40).cast("int").alias("py"), F.col("confidence").alias("response"))
    return S.suppress_weaker(k, ["cloud_id"], "point_id").select("cloud_id", "point_id")
