"""Mesh tables: vertices (mesh_id, v, x, y, z) and faces (mesh_id, f, a, b, c)."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.operators.graph import connected_components
from scanloom.session import checkpointed


def corners(faces: DataFrame) -> DataFrame:
    return faces.select("mesh_id", "f", F.posexplode(F.array("a", "b", "c")).alias("corner", "v"))


def face_points(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row per face with its three positions; one shuffle of corners."""
    p = F.struct("x", "y", "z")
    d = corners(faces).join(vertices, ["mesh_id", "v"])
    return d.groupBy("mesh_id", "f").agg(*[F.max(F.when(F.col("corner") == i, p)).alias(f"p{i}") for i in range(3)])


def _cross() -> tuple[Column, Column, Column]:
    e1 = {a: F.col(f"p1.{a}") - F.col(f"p0.{a}") for a in "xyz"}
    e2 = {a: F.col(f"p2.{a}") - F.col(f"p0.{a}") for a in "xyz"}
    return (e1["y"] * e2["z"] - e1["z"] * e2["y"], e1["z"] * e2["x"] - e1["x"] * e2["z"], e1["x"] * e2["y"] - e1["y"] * e2["x"])


def mesh_statistics(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    fp = face_points(vertices, faces)

    def edge(i, j):
        return F.sqrt(sum((F.col(f"p{i}.{a}") - F.col(f"p{j}.{a}")) ** 2 for a in "xyz"))

    e = [edge(0, 1), edge(1, 2), edge(2, 0)]
    area = F.sqrt(sum(c * c for c in _cross())) / 2
    s = fp.groupBy("mesh_id").agg(F.count("*").alias("triangles"), F.min(F.least(*e)).alias("min_edge"), F.max(F.greatest(*e)).alias("max_edge"), F.sum(area).alias("area"))
    v = vertices.groupBy("mesh_id").agg(F.count("*").alias("vertices"), *[F.min(a).alias("min_" + a) for a in "xyz"], *[F.max(a).alias("max_" + a) for a in "xyz"])
    return v.join(s, "mesh_id", "left")


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    n = face_points(vertices, faces).select("mesh_id", "f", *[c.alias(k) for k, c in zip(("nx", "ny", "nz"), _cross())])
    s = corners(faces).join(n, ["mesh_id", "f"]).groupBy("mesh_id", "v").agg(*[F.sum(c).alias(c) for c in ("nx", "ny", "nz")])
    length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return s.withColumns({c: F.when(length > 1e-10, F.col(c) / length).otherwise(F.col(c)) for c in ("nx", "ny", "nz")})


def edges(faces: DataFrame) -> DataFrame:
    """Undirected edges of faces, u < v."""
    pair = F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q")), F.struct(F.col("b").alias("p"), F.col("c").alias("q")), F.struct(F.col("c").alias("p"), F.col("a").alias("q"))))
    return faces.select("mesh_id", "f", pair.alias("e")).select("mesh_id", "f", F.least("e.p", "e.q").alias("u"), F.greatest("e.p", "e.q").alias("v"))


def _key(*cols: str) -> Column:
    """The columns as one ordered id, whatever their length."""
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])


#: Faces up to which a mesh is settled in one task; larger ones go through the rounds of ``connected_components``.
MESH_FACES = 1 << 20


def _by_size(faces: DataFrame, alone: Callable[[pa.Table], pa.Table], schema: T.StructType, rounds: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``alone`` on every mesh of up to MESH_FACES faces, ``rounds`` on all others together."""
    large = checkpointed(faces.groupBy("mesh_id").agg(F.count("*").alias("n")).filter(F.col("n") > MESH_FACES).select("mesh_id"))
    if large.isEmpty():
        return faces.groupBy("mesh_id").applyInArrow(alone, schema)
    large = F.broadcast(large)  # at most one for every MESH_FACES faces
    small = faces.join(large, "mesh_id", "left_anti").groupBy("mesh_id").applyInArrow(alone, schema)
    return small.unionByName(rounds(faces.join(large, "mesh_id", "left_semi")))


def component_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The lowest node of the component of each of ``n`` nodes under the links u - v."""
    label = np.arange(n)
    while True:
        low, found = np.minimum(label[u], label[v]), label.copy()
        np.minimum.at(found, label[u], low)
        np.minimum.at(found, label[v], low)
        while not np.array_equal(found, found[found]):
            found = found[found]
        if np.array_equal(found, label):
            return label
        label = found


def _edge_numbers(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct edges (u < v) of one mesh, and the number of the edge of all first, second and third sides."""
    a, b, c = (found.column(x).to_numpy() for x in "abc")
    p, q = np.concatenate([a, b, c]), np.concatenate([b, c, a])
    pairs, number = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], 1), axis=0, return_inverse=True)
    return pairs[:, 0], pairs[:, 1], number.ravel()


def remove_small_components(faces: DataFrame, min_faces: int) -> DataFrame:
    """Faces are adjacent when they share an edge; each edge links its faces to the
    lowest one, so an edge used very often is a star and not a clique."""
    def alone(found: pa.Table) -> pa.Table:
        _, node = np.unique(found.column("f").to_numpy(), return_inverse=True)
        edge = _edge_numbers(found)[2]
        side = np.tile(node, 3)
        hub = np.full(edge.max() + 1, len(node))
        np.minimum.at(hub, edge, side)
        label = component_labels(node.max() + 1, side, hub[edge])
        return found.filter(pa.array((np.bincount(label, minlength=len(label)) >= min_faces)[label][node]))

    def rounds(large: DataFrame) -> DataFrame:
        e = edges(large).withColumn("id", _key("mesh_id", "f"))
        hub = e.groupBy("mesh_id", "u", "v").agg(F.min("id").alias("hub"))
        links = e.join(hub, ["mesh_id", "u", "v"]).select(F.col("id").alias("u"), F.col("hub").alias("v"))
        d = large.withColumn("id", _key("mesh_id", "f"))
        comp = connected_components(d.select("id"), links)
        keep = comp.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= min_faces).select("component")
        return d.join(comp.join(keep, "component", "left_semi"), "id").drop("id", "component")

    return _by_size(faces, alone, faces.schema, rounds)


def boundary_edges(faces: DataFrame) -> DataFrame:
    return edges(faces).groupBy("mesh_id", "u", "v").agg(F.count("*").alias("n")).filter("n = 1").drop("n")


def _boundary_loops(faces: DataFrame) -> DataFrame:
    """Boundary edges (u, v) with their ``component``, the lowest vertex of the loop."""
    kind = faces.schema["a"].dataType
    schema = T.StructType([faces.schema["mesh_id"], *(T.StructField(c, kind) for c in ("u", "v", "component"))])

    def alone(found: pa.Table) -> pa.Table:
        u, v, edge = _edge_numbers(found)
        once = np.bincount(edge) == 1
        u, v = u[once], v[once]
        ends, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = component_labels(len(ends), at[: len(u)], at[len(u) :])
        mesh = found.column("mesh_id").take(pa.array(np.zeros(len(u), np.int64)))
        return pa.table({"mesh_id": mesh, **{n: pa.array(x) for n, x in (("u", u), ("v", v), ("component", ends[label][at[: len(u)]]))}})

    def rounds(large: DataFrame) -> DataFrame:
        b = boundary_edges(large)
        links = b.select(_key("mesh_id", "u").alias("u"), _key("mesh_id", "v").alias("v"))
        nodes = b.select(F.explode(F.array(_key("mesh_id", "u"), _key("mesh_id", "v"))).alias("id"))
        comp = connected_components(nodes, links).select(F.col("id.k0").alias("mesh_id"), F.col("id.k1").alias("u"), F.col("component.k1").alias("component"))
        return b.join(comp, ["mesh_id", "u"])

    return _by_size(faces, alone, schema, rounds)


def fill_holes(vertices: DataFrame, faces: DataFrame, max_vertices: int) -> DataFrame:
    """Boundary loops of three to ``max_vertices`` vertices, each closed by a fan
    around the mean of its vertices: one row per new face with the centroid."""
    b = checkpointed(_boundary_loops(faces))
    on = b.select("mesh_id", "component", F.explode(F.array("u", "v")).alias("v")).distinct()
    size = on.join(vertices, ["mesh_id", "v"]).groupBy("mesh_id", "component").agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in "xyz"])
    small = size.filter(F.col("n").between(3, max_vertices))
    return b.join(small, ["mesh_id", "component"]).select("mesh_id", _key("mesh_id", "component").alias("component"), F.col("u").alias("a"), F.col("v").alias("b"), "n", "x", "y", "z")


def smooth(vertices: DataFrame, faces: DataFrame, iterations: int, strength: float, cut_every: int = 4) -> DataFrame:
    """v += strength * (mean of neighbours, counted per shared edge, - v)."""
    e = edges(faces)
    both = e.select("mesh_id", "u", "v").unionByName(e.select("mesh_id", F.col("v").alias("u"), F.col("u").alias("v")))
    adj = checkpointed(both.groupBy("mesh_id", "u", "v").agg(F.count("*").alias("m")))
    v = vertices.select("mesh_id", "v", "x", "y", "z")
    for i in range(iterations):
        mean = adj.join(v, ["mesh_id", "v"]).groupBy("mesh_id", F.col("u").alias("v")).agg(*[(F.sum(F.col(a) * F.col("m")) / F.sum("m")).alias("n" + a) for a in "xyz"])
        v = v.join(mean, ["mesh_id", "v"], "left").select("mesh_id", "v", *[F.when(F.col("n" + a).isNull(), F.col(a)).otherwise(F.col(a) + strength * (F.col("n" + a) - F.col(a))).alias(a) for a in "xyz"])
        if (i + 1) % cut_every == 0:
            v = checkpointed(v)
    return v


# Cube corners 0..7 carry bit i for (x, y, z) = (i & 1, i >> 1 & 1, i >> 2 & 1);
# the twelve edges join corners that differ in one bit.
CUBE_EDGES = [(a, b) for a in range(8) for b in range(8) if a < b and bin(a ^ b).count("1") == 1]


def cube_cases() -> list[list[tuple[int, int, int]]]:
    """Triangles (edge numbers) of all 256 corner patterns, built from a rule.

    Each cube face joins its crossed edges; where four cross, the inside corners
    are kept apart.  The segments of the six faces form loops, oriented so that
    the inside lies behind, and every loop becomes a fan."""
    number = {e: i for i, e in enumerate(CUBE_EDGES)}

    def edge(a, b):
        return number[(min(a, b), max(a, b))]

    faces = []
    for axis, side in product(range(3), (0, 1)):
        p, q = [b for b in range(3) if b != axis]
        ring = [(side << axis) | (i << p) | (j << q) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]
        # seen from outside the ring must run counter-clockwise
        flip = (side == 1) == (axis == 1)
        faces.append(ring[::-1] if flip else ring)
    out = []
    for case in range(256):
        inside = [bool(case >> i & 1) for i in range(8)]
        nxt = {}
        for ring in faces:
            for i in range(4):
                # entering an inside run at corner i: the segment goes from its leaving edge back to its entering edge
                if inside[ring[i]] and not inside[ring[i - 1]]:
                    j = i
                    while inside[ring[(j + 1) % 4]]:
                        j += 1
                    nxt[edge(ring[j % 4], ring[(j + 1) % 4])] = edge(ring[i - 1], ring[i])
        tris = []
        while nxt:
            start = min(nxt)
            loop, at = [start], nxt.pop(start)
            while at != start:
                loop.append(at)
                at = nxt.pop(at)
            tris.extend((loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1))
        out.append(tris)
    return out


def marching_cubes(voxels: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of the surface density = threshold.

    Voxels are rows (grid_id, vx, vy, vz, density).  Vertices are keyed by grid
    edge (lower corner and axis), so cells share them without a search."""
    v = voxels.select("grid_id", "vx", "vy", "vz", "density")
    key = ["grid_id", "vx", "vy", "vz"]
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), *[(F.col("v" + a) - (1 if j == i else 0)).alias("v" + a) for j, a in enumerate("xyz")]) for i in range(3)]))
    upper = v.select("grid_id", F.col("density").alias("d1"), ends.alias("e")).select("grid_id", "d1", "e.*")
    pair = v.withColumnRenamed("density", "d0").join(upper, key)
    cut = pair.filter((F.col("d0") > threshold) != (F.col("d1") > threshold))
    t = F.when(F.abs(F.col("d1") - F.col("d0")) > 1e-6, (F.lit(threshold) - F.col("d0")) / (F.col("d1") - F.col("d0"))).otherwise(F.lit(0.5))
    vertices = cut.select(*key, "axis", *[(F.col("v" + a) + F.when(F.col("axis") == i, t).otherwise(F.lit(0.0))).alias(a) for i, a in enumerate("xyz")])
    inside = F.when(F.col("density") > threshold, 1).otherwise(0)
    to_cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[(F.col("v" + a) - (i >> j & 1)).alias("v" + a) for j, a in enumerate("xyz")]) for i in range(8)]))
    cells = v.select("grid_id", inside.alias("in"), to_cells.alias("c")).select("grid_id", "in", "c.*").groupBy(*key).agg(
        F.count("*").alias("n"), F.sum(F.shiftleft(F.lit(1), 0) * F.col("in") * F.pow(F.lit(2), F.col("i"))).cast("int").alias("case"))
    cells = cells.filter("n = 8 AND `case` > 0 AND `case` < 255")
    rows = [(c, k, *[x for e in tri for x in (CUBE_EDGES[e][0], (CUBE_EDGES[e][0] ^ CUBE_EDGES[e][1]).bit_length() - 1)]) for c, tris in enumerate(cube_cases()) for k, tri in enumerate(tris)]
    table = voxels.sparkSession.createDataFrame(rows, "`case` int, k int, c0 int, a0 int, c1 int, a1 int, c2 int, a2 int")
    tri = cells.join(F.broadcast(table), "case")  # fixed number of cases

    def ref(i):
        return F.struct(*[(F.col("v" + a) + F.shiftright(F.col(f"c{i}"), j).bitwiseAND(F.lit(1))).alias("v" + a) for j, a in enumerate("xyz")], F.col(f"a{i}").alias("axis")).alias(f"e{i}")

    triangles = tri.select(*key, "k", ref(0), ref(1), ref(2))
    return vertices, triangles


def clone_splats(splats: DataFrame, ids: DataFrame, offset: float = 0.001) -> DataFrame:
    """Marked splats stay and gain a shifted copy."""
    copies = splats.join(ids, "splat_id", "left_semi").withColumns({"x": F.col("x") + offset, "y": F.col("y") + offset})
    return splats.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)))


def split_splats(splats: DataFrame, ids: DataFrame, offset: float = 0.01, shrink: float = 0.8) -> DataFrame:
    """Marked splats are replaced by two smaller ones (log scale)."""
    import math

    hit = splats.join(ids.withColumn("_m", F.lit(True)), "splat_id", "left")
    n = F.when(F.col("_m"), F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = hit.withColumn("copy", F.explode(n))
    side = F.when(F.col("_m").isNull(), F.lit(0.0)).when(F.col("copy") == 0, F.lit(offset)).otherwise(F.lit(-offset))
    return d.withColumns({"x": F.col("x") + side, "scale": F.col("scale") + F.when(F.col("_m"), F.lit(math.log(shrink))).otherwise(F.lit(0.0))}).drop("_m")


def remove_splats(splats: DataFrame, ids: DataFrame) -> DataFrame:
    return splats.join(ids, "splat_id", "left_anti")


def floor_plan(vertices: DataFrame, keys: list[str], percentile: float, band_m: float, cell: float, min_points: int, scale: float = 1.0) -> DataFrame:
    """Area, perimeter and confidence of the floor outline per object.  Points in
    the height band are counted per cell; only boundary cells reach the hull."""
    from scanloom.operators.imaging import row_hull
    from scanloom.operators.ordering import join_groups, order_stats

    s = order_stats(vertices, keys, "y", {"_floor": ("scaled", percentile), "_alt": ("scaled", 0.12)})
    s = checkpointed(s.join(vertices.groupBy(*keys).agg(F.max("y").alias("_top")), keys))  # one row per key
    band = F.greatest(F.lit(band_m), F.greatest(F.col("_top") - F.col("_floor"), F.lit(1e-3)) * 0.05)
    d = join_groups(vertices, s.withColumn("_band", band), keys).drop("n")
    low = F.col("y") <= F.col("_floor") + F.col("_band")
    alt = F.col("y") <= F.least(F.col("_alt") + F.col("_band") * 1.5, F.col("_top"))
    enough = checkpointed(d.groupBy(*keys).agg((F.count_if(low) >= 64).alias("_many"), F.count("*").alias("n")))
    p = join_groups(d, enough, keys).filter(F.when(F.col("_many"), low).otherwise(alt)).select(*keys, (F.col("x") * scale).alias("px"), (F.col("z") * scale).alias("pz"))
    box = p.groupBy(*keys).agg(F.count("*").alias("points"), F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("pz").alias("z0"), F.max("pz").alias("z1")).filter("points >= 16")
    box = checkpointed(box).withColumns({"w": F.greatest(F.ceil((F.col("x1") - F.col("x0")) / cell), F.lit(1)), "h": F.greatest(F.ceil((F.col("z1") - F.col("z0")) / cell), F.lit(1))})
    c = join_groups(p, box, keys, rows="points").withColumns({"cx": F.floor((F.col("px") - F.col("x0")) / cell).cast("int"), "cz": F.floor((F.col("pz") - F.col("z0")) / cell).cast("int")})
    c = c.filter((F.col("cx") < F.col("w")) & (F.col("cz") < F.col("h"))).groupBy(*keys, "cx", "cz").agg(F.count("*").alias("n"))
    top = c.groupBy(*keys).agg(F.max("n").alias("_m"))
    occ = c.join(top, keys).filter(F.col("n") >= F.least(F.lit(max(min_points, 1)), F.col("_m"))).select(*keys, "cx", "cz")
    occ = checkpointed(occ)
    ring = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    beside = occ.select(*keys, F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cz") + j).alias("cz")) for i, j in ring])).alias("o")).groupBy(*keys, "o.cx", "o.cz").agg(F.count("*").alias("_k"))
    edge = occ.join(beside, [*keys, "cx", "cz"], "left").filter(F.coalesce("_k", F.lit(0)) < 8)  # a missing neighbour is outside or empty
    hull = row_hull(edge.select(*keys, F.col("cx").alias("x"), F.col("cz").alias("y")), keys)
    s = box.join(occ.groupBy(*keys).agg(F.count("*").alias("occupied")), keys).join(edge.groupBy(*keys).agg(F.count("*").alias("boundary")), keys).join(hull, keys).filter("corners >= 3")
    density, cover = F.col("occupied") / (F.col("w") * F.col("h")), F.least(F.col("boundary") / F.col("occupied"), F.lit(1.0))
    return s.select(*keys, "points", "occupied", "boundary", "corners", (F.col("area") * cell * cell).alias("area"), (F.col("perimeter") * cell).alias("perimeter"),
                    F.least(density * 1.5 + cover * 0.5, F.lit(1.0)).alias("confidence"), "x0", "x1", "z0", "z1")
