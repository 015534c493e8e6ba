"""Matching, multi-view geometry, meshes and voxel surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions.numeric import norm, rnd
from scanloom.operators import matching as M
from scanloom.operators import mesh as X
from scanloom.operators import views as V
from scanloom.plans.inputs import PTS, e, points
from scanloom.plans.registry import query, with_ctes
from scanloom.plans.scalars import packed_signs

# --- features: image = 25 vectors, scene = 4 images -------------------------


def features(t):
    return t.embeddings.select(F.floor(F.col("vec_id") / 100).alias("scene"), F.floor(F.col("vec_id") / 25).alias("image_id"), F.col("vec_id").alias("kp_id"),
                               (e(0) * 200).alias("x"), (e(1) * 200).alias("y"), "embedding")


FEAT = """ft AS (SELECT vec_id//100 AS scene, vec_id//25 AS img, vec_id AS kp, embedding AS d, embedding[1]::DOUBLE*200 AS x, embedding[2]::DOUBLE*200 AS y FROM embeddings)"""


def _near(table, dist):
    return f""", pd AS ({dist}), r1 AS (SELECT scene, i1, i2, k1 kp, k2 best, d, row_number() OVER (PARTITION BY i1, i2, k1 ORDER BY d, k2) r FROM pd), r2 AS (SELECT scene, i1, i2, k2 kp, k1 best, d, row_number() OVER (PARTITION BY i1, i2, k2 ORDER BY d, k1) r FROM pd),
  fw AS (SELECT scene, i1, i2, kp, min(best) FILTER (r=1) best, min(d) FILTER (r=1) d1, coalesce(min(d) FILTER (r=2),'infinity'::DOUBLE) d2 FROM r1 WHERE r <= 2 GROUP BY 1,2,3,4),
  bw AS (SELECT scene, i1, i2, kp, min(best) FILTER (r=1) best, min(d) FILTER (r=1) d1, coalesce(min(d) FILTER (r=2),'infinity'::DOUBLE) d2 FROM r2 WHERE r <= 2 GROUP BY 1,2,3,4)"""


L2 = _near("ft", "SELECT scene, i1, i2, k1, k2, sqrt(sum((u-v)*(u-v))) d FROM (SELECT a.scene, a.img i1, b.img i2, a.kp k1, b.kp k2, unnest(a.d)::DOUBLE u, unnest(b.d)::DOUBLE v FROM ft a JOIN ft b ON a.scene=b.scene AND a.img < b.img) GROUP BY 1,2,3,4,5")
HAM = _near("ft", "SELECT scene, i1, i2, k1, k2, count(*) FILTER ((u>0)<>(v>0))::DOUBLE d FROM (SELECT a.scene, a.img i1, b.img i2, a.kp k1, b.kp k2, unnest(a.d)::DOUBLE u, unnest(b.d)::DOUBLE v FROM ft a JOIN ft b ON a.scene=b.scene AND a.img < b.img) GROUP BY 1,2,3,4,5")


@query("3.6", f"WITH {FEAT}{L2} SELECT scene, i1 AS image1, i2 AS image2, kp, best, round(d1,6) AS d1, matches FROM (SELECT *, count(*) OVER (PARTITION BY i1, i2) AS matches FROM fw WHERE d1 < 0.95::DOUBLE*d2) WHERE matches >= 5")
def descriptor_matching(t):
    f = features(t).withColumn("descriptor", F.transform("embedding", lambda v: v.cast("double")))
    near = M.two_nearest(f, M.image_pairs(f.select("scene", "image_id").distinct(), "scene"), "scene")
    return M.match_all_pairs(near, "scene", 0.95, 5).withColumn("d1", rnd("d1"))


def mutual(t):
    f = features(t).withColumn("descriptor", F.array(packed_signs(F.col("embedding"))))
    near = M.two_nearest(f, M.image_pairs(f.select("scene", "image_id").distinct(), "scene"), "scene", "hamming")
    return f, M.mutual_matches(near, "scene", 0.97)


MUT = ", mu AS (SELECT fw.scene, fw.i1, fw.i2, fw.kp kp1, fw.best kp2, fw.d1 AS distance FROM fw JOIN bw ON fw.i1=bw.i1 AND fw.i2=bw.i2 AND fw.kp=bw.best AND fw.best=bw.kp WHERE fw.d1/fw.d2 < 0.97 AND bw.d1/bw.d2 < 0.97)"


@query("3.7", f"WITH {FEAT}{HAM}{MUT} SELECT scene, i1 AS image1, i2 AS image2, kp1, kp2, distance FROM mu")
def mutual_matching(t):
    return mutual(t)[1]


@query("3.8", f"""WITH {FEAT}{HAM}{MUT}, mo AS (SELECT mu.*, b.x-a.x dx, b.y-a.y dy FROM mu JOIN ft a ON a.kp=kp1 JOIN ft b ON b.kp=kp2),
  rk AS (SELECT *, row_number() OVER (PARTITION BY i1,i2 ORDER BY dx)-1 rx, row_number() OVER (PARTITION BY i1,i2 ORDER BY dy)-1 ry, count(*) OVER (PARTITION BY i1,i2) n FROM mo),
  md AS (SELECT i1, i2, min(dx) FILTER (rx=n//2) mx, min(dy) FILTER (ry=n//2) my FROM rk GROUP BY 1,2)
  SELECT scene, rk.i1 AS image1, rk.i2 AS image2, kp1, kp2, distance FROM rk JOIN md USING (i1, i2) WHERE n < 4 OR sqrt((dx-mx)*(dx-mx)+(dy-my)*(dy-my)) < 30""")
def consistent_matching(t):
    f, m = mutual(t)
    return M.consistent_matches(m, f, "scene", 30.0)


@query("10.7 12.2", """SELECT l_orderkey//16 AS pair_id, l_orderkey*1000000+l_partkey*100+l_linenumber AS row_id, l_tax < 0.075 AND count(*) FILTER (l_tax < 0.075) OVER (PARTITION BY l_orderkey//16) >= 8 AS inlier FROM lineitem""")
def robust_homography(t):
    """Planted truth: a shared homography, with rows of the highest tax moved far away;
    pairs with fewer than eight agreeing rows have no model."""
    x, y = (F.col("l_partkey") % 97).cast("double"), F.col("l_extendedprice") / 1000
    w = 1 + 0.001 * x + 0.0005 * y
    bad = F.col("l_tax") >= 0.075
    d = t.lineitem.select(F.floor(F.col("l_orderkey") / 16).alias("pair_id"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("row_id"), x.alias("x1"), y.alias("y1"),
                          ((1.1 * x + 0.2 * y + 5) / w + F.when(bad, 200 + F.col("l_partkey") % 89 * 7).otherwise(0)).alias("x2"), ((-0.1 * x + 0.9 * y - 3) / w + F.when(bad, 100 + F.col("l_suppkey") % 83 * 9).otherwise(0)).alias("y2"))
    return M.robust_pairs(d, ["pair_id"], "row_id", M.Homography(), 0.01, min_inliers=8).select("pair_id", "row_id", "inlier")


def _projection(angle, tx, ty, f=500.0, c=256.0):
    """K [R | t] of a camera turned by ``angle`` about y, at (tx, ty, 0)."""
    co, si = F.cos(angle), F.sin(angle)
    r = [[co, F.lit(0.0), -si], [F.lit(0.0), F.lit(1.0), F.lit(0.0)], [si, F.lit(0.0), co]]
    p = [[*row, -(row[0] * tx + row[1] * ty)] for row in r]
    return [[f * a + c * b for a, b in zip(p[0], p[2])], [f * a + c * b for a, b in zip(p[1], p[2])], p[2]]


@query("10.8", "SELECT vec_id AS match_id, round(embedding[1]::DOUBLE,5)+0.0::DOUBLE x, round(embedding[2]::DOUBLE,5)+0.0::DOUBLE y, round(3+embedding[3]::DOUBLE,5) z FROM embeddings")
def batch_triangulation(t):
    """Planted truth: points projected into two views come back."""
    a, b = F.lit(0.02) * (F.col("vec_id") % 7), F.lit(-0.03) * (F.col("vec_id") % 5) - 0.05
    m1, m2 = _projection(a, F.lit(-0.2), F.lit(0.0)), _projection(b, F.lit(0.3), F.lit(0.1))
    pt = (e(0), e(1), 3 + e(2))

    def proj(m):
        h = [sum(m[i][j] * pt[j] for j in range(3)) + m[i][3] for i in range(3)]
        return h[0] / h[2], h[1] / h[2]

    (u1, v1), (u2, v2) = proj(m1), proj(m2)
    flat = lambda m: F.array(*[c for row in m for c in row])
    d = t.embeddings.select(F.col("vec_id").alias("match_id"), u1.alias("u1"), v1.alias("v1"), u2.alias("u2"), v2.alias("v2"), flat(m1).alias("p1"), flat(m2).alias("p2"))
    return M.triangulate(d, ["match_id"]).select("match_id", *[rnd(c, 5).alias(c) for c in "xyz"])


# --- views: scene = 4 vectors, each an 8 x 8 depth image ---------------------


def depth_pixels(t):
    d = t.embeddings.select(F.floor(F.col("vec_id") / 4).alias("scene"), (F.col("vec_id") % 4).cast("int").alias("view"), F.posexplode("embedding").alias("i", "v"))
    v = F.col("v").cast("double")
    return d.select("scene", "view", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), (2 + v).alias("depth"), F.least(F.lit(1.0), F.abs(v) * 8).alias("confidence"), v.alias("v"))


def cameras(t):
    k = F.col("view") * 0.05
    return t.embeddings.select(F.floor(F.col("vec_id") / 4).alias("scene"), (F.col("vec_id") % 4).cast("int").alias("view")).select(
        "scene", "view", F.cos(k / 2).alias("qw"), F.lit(0.0).alias("qx"), F.sin(k / 2).alias("qy"), F.lit(0.0).alias("qz"), (F.col("view") * 0.1).alias("tx"), (F.col("view") * 0.02).alias("ty"), F.lit(0.0).alias("tz"),
        F.lit(8.0).alias("fx"), F.lit(8.0).alias("fy"), F.lit(3.5).alias("cx"), F.lit(3.5).alias("cy"))


DEP = """dp AS (SELECT vec_id//4 AS scene, (vec_id%4)::INT AS view, (i//8)::INT AS y, (i%8)::INT AS x, 2+v AS depth, least(1.0::DOUBLE, abs(v)*8) AS conf, v FROM
   (SELECT vec_id, generate_subscripts(embedding,1)-1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)),
  cam AS (SELECT DISTINCT vec_id//4 AS scene, (vec_id%4)::INT AS view, cos((vec_id%4)*0.05::DOUBLE) c, sin((vec_id%4)*0.05::DOUBLE) s, (vec_id%4)*0.1::DOUBLE tx, (vec_id%4)*0.02::DOUBLE ty FROM embeddings),
  wd AS (SELECT scene, view, y, x, depth, conf, c*((x-3.5::DOUBLE)*depth/8)+s*depth+tx wx, (y-3.5::DOUBLE)*depth/8+ty wy, -s*((x-3.5::DOUBLE)*depth/8)+c*depth wz FROM dp JOIN cam USING (scene, view))"""
SEE = "c.c*(p.wx-c.tx)-c.s*p.wz AS px, p.wy-c.ty AS py, c.s*(p.wx-c.tx)+c.c*p.wz AS z"


@query("3.13", with_ctes(f"""WITH pr AS (SELECT p.*, c.view AS src, {SEE} FROM wd p JOIN cam c ON c.scene=p.scene AND c.view<>p.view WHERE depth > 0 AND conf >= 0.5),
  uv AS (SELECT *, 8*px/z+3.5::DOUBLE u, 8*py/z+3.5::DOUBLE v FROM pr WHERE z > 0), ag AS (SELECT uv.scene, uv.view, uv.y, uv.x, count(*) n FROM uv JOIN dp ON dp.scene=uv.scene AND dp.view=uv.src AND dp.y=floor(uv.v) AND dp.x=floor(uv.u) WHERE uv.u>=0 AND uv.v>=0 AND dp.conf>0.5 AND abs(dp.depth-z)<0.1 GROUP BY 1,2,3,4)
  SELECT scene, view, y, x, round(wx,6)+0.0::DOUBLE wx, round(wy,6)+0.0::DOUBLE wy, round(wz,6)+0.0::DOUBLE wz, coalesce(n,0)+1 AS views FROM wd LEFT JOIN ag USING (scene, view, y, x) WHERE depth > 0 AND conf >= 0.5 AND coalesce(n,0)+1 >= 3""", DEP))
def depth_consistency(t):
    d = V.fuse_depth(depth_pixels(t).drop("v"), cameras(t), 0.1, 3)
    return d.withColumns({c: rnd(c) for c in ("wx", "wy", "wz")})


@query("3.14", with_ctes("""WITH sc AS (SELECT DISTINCT scene FROM dp), vw AS (SELECT DISTINCT scene, view FROM dp), g AS (SELECT scene, i ix, j iy, k iz, -1+i*0.25::DOUBLE x, -1+j*0.25::DOUBLE y, -1+k*0.25::DOUBLE z FROM sc, generate_series(0,7) a(i), generate_series(0,7) b(j), generate_series(0,7) c(k)),
  p AS (SELECT g.scene, view, ix, iy, iz, ((x+0.1::DOUBLE*view)/(1+0.2::DOUBLE*z*(view%2))*0.5::DOUBLE+0.5::DOUBLE)*8 u, (1-y/(1+0.2::DOUBLE*z*(view%2)))*0.5::DOUBLE*8 v FROM g JOIN vw USING (scene)),
  h AS (SELECT p.scene, ix, iy, iz, dp.v > -0.12 AS inside FROM p JOIN dp ON dp.scene=p.scene AND dp.view=p.view AND dp.y=floor(p.v) AND dp.x=floor(u) WHERE u>=0 AND u<8 AND p.v>=0 AND p.v<8)
  SELECT scene, ix, iy, iz, count(*) AS views FROM h GROUP BY 1,2,3,4 HAVING bool_and(inside)""", DEP))
def visual_hull(t):
    px = depth_pixels(t)
    masks = px.select("scene", "view", "y", "x", F.when(F.col("v") > -0.12, 255).otherwise(0).alias("mask"))
    view = F.col("view")
    z = F.lit(0.0)
    mvp = F.array(F.lit(1.0), z, z, view * 0.1, z, F.lit(1.0), z, z, z, z, F.lit(1.0), z, z, z, 0.2 * (view % 2), F.lit(1.0))
    cams = cameras(t).select("scene", "view", mvp.alias("mvp"))
    vox = V.voxel_grid(cams.select("scene").distinct(), (-1, -1, -1), (1, 1, 1), 0.25)
    return V.carve(vox, cams, masks, 8, 8)


@query("3.16", with_ctes(f"""WITH pt AS (SELECT vec_id//4 AS scene, vec_id AS point_id, embedding[1]::DOUBLE*3 wx, embedding[2]::DOUBLE*3 wy, 2+embedding[3]::DOUBLE wz FROM embeddings),
  uv AS (SELECT p.scene, p.point_id, c.view AS src, {SEE} FROM pt p JOIN cam c ON c.scene=p.scene AND c.view < 3), q AS (SELECT *, floor(8*px/z+4.0::DOUBLE)::INT x, floor(8*py/z+4.0::DOUBLE)::INT y FROM uv WHERE z > 0),
  f AS (SELECT scene, point_id, src, x, y FROM q WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY src) = 1)
  SELECT pt.point_id, src AS view, coalesce(floor((v+0.5::DOUBLE)*255)::INT,180) AS r FROM pt LEFT JOIN f USING (point_id) LEFT JOIN dp ON dp.scene=f.scene AND dp.view=f.src AND dp.y=f.y AND dp.x=f.x""", DEP))
def sparse_colouring(t):
    pts = t.embeddings.select(F.floor(F.col("vec_id") / 4).alias("scene"), F.col("vec_id").alias("point_id"), (e(0) * 3).alias("wx"), (e(1) * 3).alias("wy"), (2 + e(2)).alias("wz"))
    grey = F.floor((F.col("v") + 0.5) * 255).cast("int")
    px = depth_pixels(t).select("scene", "view", "y", "x", grey.alias("r"), grey.alias("g"), grey.alias("b"))
    return V.colour_points(pts, cameras(t), px, 8, 8, 3).select("point_id", "view", "r")


@query("4.36", with_ctes(f"""WITH b AS (SELECT DISTINCT scene, floor(wx/0.25::DOUBLE)::INT vx, floor(wy/0.25::DOUBLE)::INT vy, floor(wz/0.25::DOUBLE)::INT vz FROM wd), c3 AS (SELECT DISTINCT scene, vx+i vx, vy+j vy, vz+k vz FROM b, generate_series(-1,1) a(i), generate_series(-1,1) e(j), generate_series(-1,1) f(k)),
  p AS (SELECT *, (vx+0.5::DOUBLE)*0.25::DOUBLE wx, (vy+0.5::DOUBLE)*0.25::DOUBLE wy, (vz+0.5::DOUBLE)*0.25::DOUBLE wz FROM c3), s AS (SELECT p.*, c.view AS src, {SEE} FROM p JOIN cam c ON c.scene=p.scene),
  q AS (SELECT *, floor(8*px/z+4.0::DOUBLE)::INT x, floor(8*py/z+4.0::DOUBLE)::INT y FROM s WHERE z > 0)
  SELECT q.scene, vx, vy, vz, round(avg(least(depth-z,0.3)/0.3::DOUBLE),6)+0.0::DOUBLE AS sdf, count(*) AS weight FROM q JOIN dp ON dp.scene=q.scene AND dp.view=q.src AND dp.x=q.x AND dp.y=q.y WHERE depth > 0 AND depth-z >= -0.3 GROUP BY 1,2,3,4""", DEP))
def tsdf_integration(t):
    return V.integrate_tsdf(depth_pixels(t).drop("v", "confidence"), cameras(t), 0.25, 0.3).withColumn("sdf", rnd("sdf"))


@query("4.38", """WITH v AS (SELECT vec_id//4 AS scene, (vec_id%4)::INT//2 AS t_idx, embedding[1]::DOUBLE*3 cx, embedding[2]::DOUBLE*3 cy, embedding[3]::DOUBLE*3 cz, embedding[4]::DOUBLE/n dx, embedding[5]::DOUBLE/n dy, embedding[6]::DOUBLE/n dz FROM
   (SELECT *, sqrt(pow(embedding[4]::DOUBLE,2)+pow(embedding[5]::DOUBLE,2)+pow(embedding[6]::DOUBLE,2)) n FROM embeddings)), sc AS (SELECT DISTINCT scene FROM v),
  g AS (SELECT scene, i ix, j iy, k iz, -1+i*0.5::DOUBLE x, -1+j*0.5::DOUBLE y, -1+k*0.5::DOUBLE z FROM sc, generate_series(0,3) a(i), generate_series(0,3) b(j), generate_series(0,3) c(k)),
  d AS (SELECT g.scene, t_idx, ix, iy, iz, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)) r, ((x-cx)*dx+(y-cy)*dy+(z-cz)*dz)/sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)) co FROM g JOIN v USING (scene)),
  s AS (SELECT scene, t_idx, ix, iy, iz, sum(least(1/(1+r*0.1::DOUBLE),1)*(co-cos(0.6::DOUBLE))/(1-cos(0.6::DOUBLE))) val FROM d WHERE co > cos(0.6::DOUBLE) GROUP BY 1,2,3,4,5)
  SELECT scene, t_idx, ix, iy, iz, round(val/max(val) OVER (PARTITION BY scene),6) AS value FROM s""")
def space_time_confidence(t):
    n = norm(e(3), e(4), e(5))
    views = t.embeddings.select(F.floor(F.col("vec_id") / 4).alias("scene"), (F.col("vec_id") % 4).cast("double").alias("time"), *[(e(i) * 3).alias("c" + a) for i, a in enumerate("xyz")], *[(e(3 + i) / n).alias("d" + a) for i, a in enumerate("xyz")], F.lit(1.0).alias("weight"))
    vox = V.voxel_grid(views.select("scene").distinct(), (-1, -1, -1), (1, 1, 1), 0.5)
    return V.confidence_field(vox, views, 1.2, 2.0).withColumn("value", rnd("value"))


# --- meshes: height field of 16 rows x 64 values, holes where a corner is low --

LOW = -0.2


def mesh(t):
    rows = t.embeddings.select(F.floor(F.col("vec_id") / 16).alias("mesh_id"), (F.col("vec_id") % 16).cast("int").alias("y"), "embedding")
    vert = rows.select("mesh_id", "y", F.posexplode("embedding").alias("i", "h")).select("mesh_id", (F.col("y") * 64 + F.col("i")).alias("v"), F.col("i").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("h").cast("double") * 10).alias("z"))
    nxt = rows.select("mesh_id", (F.col("y") - 1).alias("y"), F.col("embedding").alias("below"))
    ok = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.least(F.get("embedding", i), F.get("embedding", i + 1), F.get("below", i), F.get("below", i + 1)) > LOW)
    quads = rows.join(nxt, ["mesh_id", "y"]).select("mesh_id", "y", F.posexplode(ok).alias("i", "k")).filter("k").select("mesh_id", (F.col("y") * 64 + F.col("i")).alias("q"))
    two = F.explode(F.array(F.struct((F.col("q") * 2).alias("f"), F.col("q").alias("a"), (F.col("q") + 1).alias("b"), (F.col("q") + 64).alias("c")),
                            F.struct((F.col("q") * 2 + 1).alias("f"), (F.col("q") + 1).alias("a"), (F.col("q") + 65).alias("b"), (F.col("q") + 64).alias("c"))))
    return vert, quads.select("mesh_id", two.alias("t")).select("mesh_id", "t.*")


MESH = """ve AS (SELECT vec_id//16 AS mesh_id, ((vec_id%16)*64+i)::INT AS v, i::DOUBLE AS x, (vec_id%16)::DOUBLE AS y, h::DOUBLE*10 AS z, h FROM (SELECT vec_id, generate_subscripts(embedding,1)-1 AS i, unnest(embedding) AS h FROM embeddings)),
  vn AS (SELECT *, lead(h) OVER (PARTITION BY mesh_id, y ORDER BY x) hr FROM ve), vm AS (SELECT *, lead(h) OVER c hd, lead(hr) OVER c hrd FROM vn WINDOW c AS (PARTITION BY mesh_id, x ORDER BY y)),
  qd AS (SELECT mesh_id, v q FROM vm WHERE hr IS NOT NULL AND hd IS NOT NULL AND hrd IS NOT NULL AND least(h,hr,hd,hrd)::DOUBLE > -0.2::DOUBLE),
  fa AS MATERIALIZED (SELECT mesh_id, q*2 AS f, q a, q+1 b, q+64 c FROM qd UNION ALL SELECT mesh_id, q*2+1, q+1, q+65, q+64 FROM qd),
  ed AS MATERIALIZED (SELECT mesh_id, f, least(p,q) u, greatest(p,q) v FROM (SELECT mesh_id, f, a p, b q FROM fa UNION ALL SELECT mesh_id, f, b, c FROM fa UNION ALL SELECT mesh_id, f, c, a FROM fa)),
  fp AS MATERIALIZED (SELECT fa.mesh_id, f, fa.a, fa.b, fa.c, p.x x0,p.y y0,p.z z0,q.x x1,q.y y1,q.z z1,r.x x2,r.y y2,r.z z2 FROM fa JOIN ve p ON p.mesh_id=fa.mesh_id AND p.v=fa.a JOIN ve q ON q.mesh_id=fa.mesh_id AND q.v=fa.b JOIN ve r ON r.mesh_id=fa.mesh_id AND r.v=fa.c),
  nf AS (SELECT *, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) nx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) ny, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) nz FROM fp)"""


@query("4.39", with_ctes("""WITH s AS (SELECT mesh_id, count(*) triangles, min(least(sqrt(pow(x1-x0,2)+pow(y1-y0,2)+pow(z1-z0,2)),sqrt(pow(x2-x1,2)+pow(y2-y1,2)+pow(z2-z1,2)),sqrt(pow(x0-x2,2)+pow(y0-y2,2)+pow(z0-z2,2)))) e0,
   max(greatest(sqrt(pow(x1-x0,2)+pow(y1-y0,2)+pow(z1-z0,2)),sqrt(pow(x2-x1,2)+pow(y2-y1,2)+pow(z2-z1,2)),sqrt(pow(x0-x2,2)+pow(y0-y2,2)+pow(z0-z2,2)))) e1, sum(sqrt(nx*nx+ny*ny+nz*nz)/2) area FROM nf GROUP BY 1)
  SELECT ve.mesh_id, any_value(triangles) triangles, round(any_value(e0),6) min_edge, round(any_value(e1),6) max_edge, round(any_value(area),4) area, count(*) vertices, round(min(z),6) min_z, round(max(z),6) max_z FROM ve LEFT JOIN s USING (mesh_id) GROUP BY 1""", MESH))
def mesh_statistics(t):
    d = X.mesh_statistics(*mesh(t))
    return d.select("mesh_id", "triangles", rnd("min_edge").alias("min_edge"), rnd("max_edge").alias("max_edge"), rnd("area", 4).alias("area"), "vertices", rnd("min_z").alias("min_z"), rnd("max_z").alias("max_z"))


@query("4.39", with_ctes("""WITH c AS (SELECT mesh_id, a v, nx, ny, nz FROM nf UNION ALL SELECT mesh_id, b, nx, ny, nz FROM nf UNION ALL SELECT mesh_id, c, nx, ny, nz FROM nf), s AS (SELECT mesh_id, v, sum(nx) x, sum(ny) y, sum(nz) z FROM c GROUP BY 1,2)
  SELECT mesh_id, v, round(x/sqrt(x*x+y*y+z*z),6)+0.0::DOUBLE nx, round(y/sqrt(x*x+y*y+z*z),6)+0.0::DOUBLE ny, round(z/sqrt(x*x+y*y+z*z),6)+0.0::DOUBLE nz FROM s""", MESH), name="mesh_vertex_normals")
def mesh_vertex_normals(t):
    return X.vertex_normals(*mesh(t)).select("mesh_id", "v", *[rnd(c).alias(c) for c in ("nx", "ny", "nz")])


@query("10.2", f"""WITH RECURSIVE {MESH}, lk AS (SELECT DISTINCT p.mesh_id, p.f u, q.f v FROM ed p JOIN ed q ON p.mesh_id=q.mesh_id AND p.u=q.u AND p.v=q.v), rc AS (SELECT mesh_id, f u, f l FROM fa UNION SELECT lk.mesh_id, lk.v, rc.l FROM rc JOIN lk ON lk.mesh_id=rc.mesh_id AND lk.u=rc.u AND rc.l < lk.v),
  cp AS (SELECT mesh_id, u f, min(l) l FROM rc GROUP BY 1,2), big AS (SELECT mesh_id, l FROM cp GROUP BY 1,2 HAVING count(*) >= 8) SELECT cp.mesh_id, cp.f FROM cp JOIN big USING (mesh_id, l)""")
def small_components_removed(t):
    return X.remove_small_components(mesh(t)[1], 8).select("mesh_id", "f")


@query("10.4", with_ctes("SELECT mesh_id, u, v FROM ed GROUP BY 1,2,3 HAVING count(*) = 1", MESH))
def boundary_edges(t):
    return X.boundary_edges(mesh(t)[1])


@query("10.4", f"""WITH RECURSIVE {MESH}, bd AS (SELECT mesh_id, u, v FROM ed GROUP BY 1,2,3 HAVING count(*) = 1), lk AS (SELECT mesh_id, u, v FROM bd UNION ALL SELECT mesh_id, v, u FROM bd), nd AS (SELECT DISTINCT mesh_id, u FROM lk),
  rc AS (SELECT mesh_id, u, u l FROM nd UNION SELECT lk.mesh_id, lk.v, rc.l FROM rc JOIN lk ON lk.mesh_id=rc.mesh_id AND lk.u=rc.u AND rc.l < lk.v), cp AS (SELECT mesh_id, u, min(l) l FROM rc GROUP BY 1,2),
  ct AS (SELECT cp.mesh_id, l, count(*) n, avg(x) x, avg(y) y, avg(z) z FROM cp JOIN ve ON ve.mesh_id=cp.mesh_id AND ve.v=cp.u GROUP BY 1,2 HAVING count(*) BETWEEN 3 AND 12)
  SELECT bd.mesh_id, bd.u AS a, bd.v AS b, n, round(ct.x,6) x, round(ct.y,6) y, round(ct.z,6)+0.0::DOUBLE z FROM bd JOIN cp ON cp.mesh_id=bd.mesh_id AND cp.u=bd.u JOIN ct ON ct.mesh_id=cp.mesh_id AND ct.l=cp.l""", name="hole_filling")
def hole_filling(t):
    d = X.fill_holes(*mesh(t), 12)
    return d.select("mesh_id", "a", "b", "n", *[rnd(c).alias(c) for c in "xyz"])


def _smooth(i):
    return (f"n{i} AS (SELECT aj.mesh_id, aj.u, sum(s.x*m)/sum(m) x, sum(s.y*m)/sum(m) y, sum(s.z*m)/sum(m) z FROM aj JOIN s{i} s ON s.mesh_id=aj.mesh_id AND s.v=aj.v GROUP BY 1,2), "
            f"s{i+1} AS (SELECT s.mesh_id, s.v, coalesce(s.x+0.5::DOUBLE*(n.x-s.x),s.x) x, coalesce(s.y+0.5::DOUBLE*(n.y-s.y),s.y) y, coalesce(s.z+0.5::DOUBLE*(n.z-s.z),s.z) z FROM s{i} s LEFT JOIN n{i} n ON n.mesh_id=s.mesh_id AND n.u=s.v)")


@query("10.5", with_ctes("WITH aj AS (SELECT mesh_id, u, v, count(*) m FROM (SELECT mesh_id, u, v FROM ed UNION ALL SELECT mesh_id, v, u FROM ed) GROUP BY 1,2,3), s0 AS (SELECT mesh_id, v, x, y, z FROM ve), "
       + ", ".join(_smooth(i) for i in range(3)) + " SELECT mesh_id, v, round(x/7.3::DOUBLE,9)+0.0::DOUBLE x, round(y/7.3::DOUBLE,9)+0.0::DOUBLE y, round(z/7.3::DOUBLE,9)+0.0::DOUBLE z FROM s3", MESH))
def laplacian_smoothing(t):
    """Reported in units of 7.3, so that no value lies on a rounding border."""
    return X.smooth(*mesh(t), 3, 0.5).select("mesh_id", "v", *[rnd(F.col(c) / 7.3, 9).alias(c) for c in "xyz"])


# --- voxels: grid of 8 x 8 x 16 ----------------------------------------------


def voxels(t):
    d = t.embeddings.select(F.floor(F.col("vec_id") / 16).alias("grid_id"), (F.col("vec_id") % 16).cast("int").alias("vz"), F.posexplode("embedding").alias("i", "h"))
    return d.select("grid_id", (F.col("i") % 8).cast("int").alias("vx"), F.floor(F.col("i") / 8).cast("int").alias("vy"), "vz", F.col("h").cast("double").alias("density"))


VOXS = """vo AS (SELECT vec_id//16 AS grid_id, (i%8)::INT vx, (i//8)::INT vy, (vec_id%16)::INT vz, h::DOUBLE d FROM (SELECT vec_id, generate_subscripts(embedding,1)-1 AS i, unnest(embedding) AS h FROM embeddings))"""


@query("10.9", with_ctes("""WITH pr AS (SELECT a.*, 0 AS axis, b.d d1 FROM vo a JOIN vo b ON b.grid_id=a.grid_id AND b.vx=a.vx+1 AND b.vy=a.vy AND b.vz=a.vz UNION ALL SELECT a.*, 1, b.d FROM vo a JOIN vo b ON b.grid_id=a.grid_id AND b.vx=a.vx AND b.vy=a.vy+1 AND b.vz=a.vz
   UNION ALL SELECT a.*, 2, b.d FROM vo a JOIN vo b ON b.grid_id=a.grid_id AND b.vx=a.vx AND b.vy=a.vy AND b.vz=a.vz+1), c AS (SELECT *, CASE WHEN abs(d1-d) > 1e-6 THEN (0.15::DOUBLE-d)/(d1-d) ELSE 0.5 END t FROM pr WHERE (d > 0.15) <> (d1 > 0.15))
  SELECT grid_id, vx, vy, vz, axis, round(vx+CASE axis WHEN 0 THEN t ELSE 0 END,6) x, round(vy+CASE axis WHEN 1 THEN t ELSE 0 END,6) y, round(vz+CASE axis WHEN 2 THEN t ELSE 0 END,6) z FROM c""", VOXS))
def isosurface_vertices(t):
    return X.marching_cubes(voxels(t), 0.15)[0].withColumns({c: rnd(c) for c in "xyz"})


@query("10.9", name="isosurface_triangles")
def isosurface_triangles(t):
    tri = X.marching_cubes(voxels(t), 0.15)[1]
    return tri.select("grid_id", "vx", "vy", "vz", "k", *[F.concat_ws(",", *[F.col(f"e{i}.{c}") for c in ("vx", "vy", "vz", "axis")]).alias(f"e{i}") for i in range(3)])


def scaled_splats(t):
    return t.embeddings.select(F.col("vec_id").alias("splat_id"), e(0).alias("x"), e(1).alias("y"), (e(6) * 2).alias("scale"), e(7).alias("grad"))


@query("10.10", """WITH s AS (SELECT vec_id splat_id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[7]::DOUBLE*2 scale, embedding[8]::DOUBLE g FROM embeddings),
  k AS (SELECT *, 0 AS copy FROM s UNION ALL SELECT splat_id, x+0.001::DOUBLE, y+0.001::DOUBLE, scale, g, 1 FROM s WHERE g > 0.1),
  p AS (SELECT splat_id, x, y, scale, g, 0 AS copy FROM s WHERE g >= -0.1 UNION ALL SELECT splat_id, x+0.01::DOUBLE, y, scale+ln(0.8::DOUBLE), g, 0 FROM s WHERE g < -0.1 UNION ALL SELECT splat_id, x-0.01::DOUBLE, y, scale+ln(0.8::DOUBLE), g, 1 FROM s WHERE g < -0.1)
  SELECT 'clone' AS edit, splat_id, copy, round(x,6)+0.0::DOUBLE x, round(y,6)+0.0::DOUBLE y, round(scale,6)+0.0::DOUBLE scale FROM k UNION ALL SELECT 'split', splat_id, copy, round(x,6)+0.0::DOUBLE, round(y,6)+0.0::DOUBLE, round(scale,6)+0.0::DOUBLE FROM p
  UNION ALL SELECT 'remove', splat_id, 0, round(x,6)+0.0::DOUBLE, round(y,6)+0.0::DOUBLE, round(scale,6)+0.0::DOUBLE FROM s WHERE NOT g > 0.1""")
def splat_density_control(t):
    s = scaled_splats(t)
    up, down = s.filter("grad > 0.1").select("splat_id"), s.filter("grad < -0.1").select("splat_id")
    parts = {"clone": X.clone_splats(s, up), "split": X.split_splats(s, down), "remove": X.remove_splats(s, up).withColumn("copy", F.lit(0))}
    out = None
    for name, d in parts.items():
        d = d.select(F.lit(name).alias("edit"), "splat_id", "copy", *[rnd(c).alias(c) for c in ("x", "y", "scale")])
        out = d if out is None else out.unionByName(d)
    return out


@query("4.40", with_ctes("""WITH p AS (SELECT cloud_id//5 AS site, x, y, z FROM pts), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY y)-1 i, count(*) OVER (PARTITION BY site) n FROM p),
  s AS (SELECT site, min(y) FILTER (i=least(floor(n*0.05::DOUBLE),n-1)) fl, min(y) FILTER (i=least(floor(n*0.12::DOUBLE),n-1)) al, max(y) top FROM k GROUP BY 1), b AS (SELECT *, greatest(0.1,greatest(top-fl,1e-3)*0.05::DOUBLE) bd FROM s),
  e AS (SELECT p.*, y <= fl+bd lo, y <= least(al+bd*1.5::DOUBLE,top) hi, count(*) FILTER (y <= fl+bd) OVER (PARTITION BY site) m FROM p JOIN b USING (site)), q AS (SELECT site, x px, z pz FROM e WHERE CASE WHEN m >= 64 THEN lo ELSE hi END),
  bx AS (SELECT site, count(*) points, min(px) x0, max(px) x1, min(pz) z0, max(pz) z1, greatest(ceil((max(px)-min(px))/0.1::DOUBLE),1) w, greatest(ceil((max(pz)-min(pz))/0.1::DOUBLE),1) h FROM q GROUP BY 1 HAVING count(*) >= 16),
  c AS (SELECT site, floor((px-x0)/0.1::DOUBLE)::INT cx, floor((pz-z0)/0.1::DOUBLE)::INT cz, count(*) n FROM q JOIN bx USING (site) WHERE floor((px-x0)/0.1::DOUBLE) < w AND floor((pz-z0)/0.1::DOUBLE) < h GROUP BY 1,2,3),
  oc AS (SELECT site, cx, cz FROM (SELECT *, max(n) OVER (PARTITION BY site) mx FROM c) WHERE n >= least(2, mx)),
  eg AS (SELECT a.site, a.cx, a.cz FROM oc a LEFT JOIN oc b ON a.site=b.site AND abs(a.cx-b.cx)<=1 AND abs(a.cz-b.cz)<=1 AND (a.cx,a.cz)<>(b.cx,b.cz) GROUP BY 1,2,3 HAVING count(b.cx) < 8),
  he AS (SELECT p.site, p.cx px, p.cz py, q.cx qx, q.cz qy FROM eg p JOIN eg q ON p.site=q.site AND (p.cx,p.cz)<>(q.cx,q.cz) JOIN eg o ON o.site=p.site GROUP BY 1,2,3,4,5
    HAVING bool_and((q.cx-p.cx)*(o.cz-p.cz)-(q.cz-p.cz)*(o.cx-p.cx) > 0 OR ((q.cx-p.cx)*(o.cz-p.cz)-(q.cz-p.cz)*(o.cx-p.cx) = 0 AND (o.cx-p.cx)*(o.cx-q.cx)+(o.cz-p.cz)*(o.cz-q.cz) <= 0))),
  hl AS (SELECT site, abs(sum(px*qy-qx*py))/2*0.01::DOUBLE area, sum(sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py)))*0.1::DOUBLE perimeter, count(*)::INT corners FROM he GROUP BY 1),
  oo AS (SELECT site, count(*) occupied FROM oc GROUP BY 1), ee AS (SELECT site, count(*) boundary FROM eg GROUP BY 1)
  SELECT site, points, occupied, boundary, corners, round(area,6) area, round(perimeter,6) perimeter, round(least(occupied/(w*h)*1.5::DOUBLE+least(boundary/occupied,1)*0.5::DOUBLE,1),6) confidence FROM bx JOIN hl USING (site) JOIN oo USING (site) JOIN ee USING (site)""", PTS))
def floor_plan(t):
    v = points(t).select(F.floor(F.col("cloud_id") / 5).cast("int").alias("site"), "x", "y", "z")
    d = X.floor_plan(v, ["site"], 0.05, 0.1, 0.1, 2)
    return d.select("site", "points", "occupied", "boundary", "corners", *[rnd(c).alias(c) for c in ("area", "perimeter", "confidence")])
