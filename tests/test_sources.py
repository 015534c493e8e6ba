"""Cloud, mesh and splat files; ids of any length; the shared folder."""

import json
import struct

import numpy as np
import pytest

from scanloom import session
from scanloom.operators import mesh as X
from scanloom.operators.graph import connected_components
from scanloom.sources import ply, ranges, shapes
from scanloom.sources import tables as S

CLOUD = "cloud_id string, point_id long, x double, y double, z double, r int, g int, b int"


def test_cloud_in_several_files(spark, tmp_path):
    n = 4000
    rows = [("a/long path " * 3, 10 * i, i / 8, -i / 4, 1.0, i % 256, 1, 2) for i in range(n)] + [("b", 5, 1.0, 1.0, 1.0, 0, 0, 0)] * 3
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        S.write_point_clouds(spark.createDataFrame(rows, CLOUD), str(tmp_path / "c"), per_file=700)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(list((tmp_path / "c").rglob("part-*.txt"))) == 7
    points, bad = S.read_point_clouds(spark, str(tmp_path / "c"))
    got = points.filter("r is not null").orderBy("cloud_id", "point_id").collect()
    assert bad.count() == 0 and len(got) == n + 3
    first = [r for r in got if r.cloud_id != "b"]
    assert [r.point_id for r in first] == list(range(n)) and [(r.x, r.y, r.r) for r in first] == [(i / 8, -i / 4, i % 256) for i in range(n)]


def test_binary_clouds_and_rejects(spark, tmp_path):
    xyz = {c: np.arange(5) * f for c, f in (("x", 0.5), ("y", 1.5), ("z", 2.5))} | {"red": np.arange(5), "green": np.arange(5), "blue": np.arange(5)}
    (tmp_path / "a.ply").write_bytes(ply.write(xyz, first=7))
    (tmp_path / "cut.ply").write_bytes(ply.write(xyz)[:-40])
    (tmp_path / "bad.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\nx y z\n4 5 6\n")
    (tmp_path / "none.ply").write_text("no file at all")
    (tmp_path / "o.obj").write_text("v 1 2 3\nv nope 1 2\nvn 0 0 1\n")
    points, bad = S.read_point_clouds(spark, str(tmp_path))
    by = {}
    for r in points.orderBy("point_id").collect():
        by.setdefault(r.cloud_id.rpartition("/")[2], []).append(r)
    assert [(r.point_id, r.x, r.y, r.z, r.r) for r in by["a.ply"]] == [(7 + i, 0.5 * i, 1.5 * i, 2.5 * i, i) for i in range(5)]
    assert len(by["cut.ply"]) == 3 and [r.x for r in by["bad.ply"]] == [1.0, 4.0] and by["o.obj"][0].nz == 1.0
    assert {r.cloud_id.rpartition("/")[2] for r in bad.collect()} == {"cut.ply", "bad.ply", "none.ply", "o.obj"}


@pytest.mark.parametrize("order, name", [("<", "binary_little_endian"), (">", "binary_big_endian")])
def test_binary_meshes(spark, tmp_path, order, name):
    head = f"ply\nformat {name} 1.0\nelement vertex 5\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nproperty float s\nproperty float t\nelement face 3\nproperty list uchar int vertex_indices\nproperty uchar flag\nend_header\n"
    body = b"".join(struct.pack(order + "fffBBBff", i, 2 * i, 3 * i, i, 0, 9, i / 4, 0.5) for i in range(5))
    body += b"".join(struct.pack(order + f"B{len(f)}iB", len(f), *f, 1) for f in ([0, 1, 2], [0, 1, 2, 3, 4], [2, 3, 4]))
    (tmp_path / "m.ply").write_bytes(head.encode() + body)
    verts, faces = S.read_meshes(spark, str(tmp_path))
    assert [(r.x, r.z, r.r, r.b, r.tex_u, r.tex_v) for r in verts.orderBy("v").collect()] == [(i, 3 * i, i, 9, i / 4, 0.5) for i in range(5)]
    assert [(r.a, r.b, r.c) for r in faces.orderBy("f").collect()] == [(0, 1, 2), (0, 1, 2), (0, 2, 3), (0, 3, 4), (2, 3, 4)]


def test_obj_colours_and_texture(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 0 0 0 1 0 0.2\nv 1 0 0\nv 0 1 0\nvt 0.5 0.25\nf 1/1 2/1 3\n")
    verts, faces = S.read_meshes(spark, str(tmp_path))
    assert [(r.r, r.g, r.b, r.tex_u) for r in verts.orderBy("v").collect()] == [(255, 0, 51, 0.5), (None, None, None, 0.5), (None, None, None, None)]
    assert faces.count() == 1


def test_raw_splat_records(spark, tmp_path):
    v = np.zeros(1000, S.SPLAT)
    v["p"][:, 0], v["c"][:, 3] = np.arange(1000), np.arange(1000) % 256
    (tmp_path / "s.bin").write_bytes(v.tobytes())
    got = S.read_splats(spark, str(tmp_path)).orderBy("x").collect()
    assert [(r.x, r.a) for r in got] == [(i, i % 256) for i in range(1000)]


FACES = "mesh_id string, f long, a long, b long, c long"


def test_components_of_meshes_with_long_names(spark):
    name = "file:/a/very/long/path/"
    rows = [(name + "a.ply", 0, 0, 1, 2), (name + "b.ply", 0, 0, 1, 2), (name + "b.ply", 1, 1, 2, 3), (name + "c.ply", 10**12, 1, 2, 3), (name + "c.ply", 10**12 + 1, 2, 3, 4), (name + "c.ply", 10**13, 8, 9, 10)]
    kept = X.remove_small_components(spark.createDataFrame(rows, FACES), 2).select("mesh_id", "f").collect()
    assert sorted((r.mesh_id[-5:], r.f) for r in kept) == [("b.ply", 0), ("b.ply", 1), ("c.ply", 10**12), ("c.ply", 10**12 + 1)]


def test_holes_of_meshes_with_long_names(spark):
    name = "file:/a/very/long/path/"
    faces = [(name + "a.ply", 0, 0, 1, 2), (name + "a.ply", 1, 5, 6, 7), (name + "b.ply", 0, 2, 5, 9)]
    verts = [(m, v, float(v), 0.0, 0.0) for m in (name + "a.ply", name + "b.ply") for v in range(10)]
    got = X.fill_holes(spark.createDataFrame(verts, "mesh_id string, v long, x double, y double, z double"), spark.createDataFrame(faces, FACES), 12)
    assert sorted((r.mesh_id[-5], r.n, r.x) for r in got.collect()) == [("a", 3, 1.0)] * 3 + [("a", 3, 6.0)] * 3 + [("b", 3, 16 / 3)] * 3


def test_components_of_a_long_chain(spark):
    n = 20_000
    edges = spark.range(n - 1).selectExpr("pmod(id * 7919, 20011) % 20000 AS k", "id AS u", "id + 1 AS v").drop("k")
    got = connected_components(spark.range(n), edges)
    assert got.count() == n and got.select("component").distinct().count() == 1


def test_shared_folder():
    class Context:
        applicationId = "test"

        def __init__(self, master):
            self.master = master

    class Session:
        def __init__(self, master, folder=None):
            self.sparkContext, self.conf = Context(master), {"spark.checkpoint.dir": folder} if folder else {}

    assert session.shared_dir(Session("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session("spark://host:7077"))
    own = session.shared_dir(Session("local[4]"))
    assert own == session.shared_dir(Session("local[2]"))


def test_records_are_read_in_ranges(spark, tmp_path):
    """Any number of partitions over one file; a header of 4 GB of vertices plans a thousand of them."""
    xyz = {c: np.arange(1000) * f for c, f in (("x", 0.5), ("y", 1.5), ("z", 2.5))} | {"red": np.arange(1000) % 250}
    (tmp_path / "a b%20c.ply").write_bytes(ply.write(xyz, first=3))
    (head,) = shapes.heads(spark, str(tmp_path))
    element, offset, n = head.place("vertex")
    assert n == 1000 and element.count == 1000
    file = {"path": head.path, "offset": offset, "count": n, "width": 25}
    d = ranges.read_records(spark, [file], records=64, piece=10)
    assert d.rdd.getNumPartitions() == 16
    got = sorted((r["first"], bytes(r["data"])) for r in d.collect())
    assert [f for f, _ in got][:8] == [0, 10, 20, 30, 40, 50, 60, 64]
    rows = np.frombuffer(b"".join(b for _, b in got), [("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("r", "u1")])
    assert rows["x"].tolist() == xyz["x"].tolist() and rows["r"].tolist() == xyz["red"].tolist()
    reader = ranges.RangeReader({"files": json.dumps([file | {"count": 4 * 2**30 // 25}]), "range": str(1 << 17)})
    parts = reader.partitions()
    assert len(parts) > 1000 and sum(p.count for p in parts) == 4 * 2**30 // 25
    points, bad = S.read_point_clouds(spark, str(tmp_path))
    assert [r.point_id for r in points.orderBy("point_id").collect()] == list(range(3, 1003)) and bad.count() == 0
    with pytest.raises(Exception, match="shorter"):
        ranges.read_records(spark, [file | {"count": 1001}]).collect()


def test_lines_are_numbered_over_any_splits(spark, tmp_path):
    text = "\n".join(f"v {i} 0 0" if i % 7 else "# note" for i in range(3000)) + "\nf -1 -2 -3\n"
    (tmp_path / "big.obj").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = ranges.numbered_lines(spark, [str(tmp_path / "big.obj")])
        assert lines.rdd.getNumPartitions() > 10
        assert [r.value for r in lines.orderBy("no").collect()] == text.splitlines()
        assert [r.no for r in lines.orderBy("no").collect()] == list(range(3001))
        verts, faces = S.read_meshes(spark, str(tmp_path))
        assert [r.x for r in verts.orderBy("v").collect()] == [2999.0, 2998.0, 2997.0]
        assert [tuple(r)[1:] for r in faces.collect()] == [(0, 0, 1, 2)]
        assert S.read_point_clouds(spark, str(tmp_path))[0].orderBy("point_id").collect()[1].x == 2.0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_obj_faults_are_rejected(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 0 0 0\nv bad 0 0\nv 0 1 0\nv 1 1 0\nvt x\nvt 0.5\nf 1 3 4\nf 1 2 3\nf 1 q 3\nf 1/2 3/2 9\nf 1 3\nf 4/2 3/2 1/2 1\n")
    (tmp_path / "p.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float z\nproperty float x\nproperty float y\nelement face 4\nproperty list uchar int vertex_indices\nend_header\n3 1 2\n3 1 2\n9 7 8\n3 0 1 2\n2 0 1\n4 0 1 2 0\n")
    (tmp_path / "x.ply").write_text("nothing")
    verts, faces, rejects = S.meshes_with_rejects(spark, str(tmp_path))
    own = lambda d, end: [r for r in d.collect() if r.mesh_id.endswith(end)]
    assert sorted((r.v, r.x, r.y, r.tex_u) for r in own(verts, "m.obj") if r.tex_u is None) == [(0, 0.0, 0.0, None), (1, 0.0, 1.0, None), (2, 1.0, 1.0, None)]
    assert sorted((r.f, r.a, r.b, r.c) for r in own(faces, "m.obj")) == [(0, 0, 1, 2), (1, 3, 4, 5)]
    assert sorted(r.line for r in own(rejects, "m.obj")) == [1, 4, 7, 8, 9]
    assert sorted((r.v, r.x, r.y, r.z) for r in own(verts, "p.ply")) == [(0, 1.0, 2.0, 3.0), (1, 1.0, 2.0, 3.0), (2, 7.0, 8.0, 9.0)]
    assert sorted((r.f, r.a, r.b, r.c) for r in own(faces, "p.ply")) == [(0, 0, 1, 2), (1, 0, 1, 2), (2, 0, 2, 0)]
    assert sorted((r.line, r.reason) for r in own(rejects, "p.ply")) == [(1, "2 0 1"), (6, "1 rows are missing")]
    assert [r.line for r in own(rejects, "x.ply")] == [-1]


def test_binary_triangles_are_ranges(spark, tmp_path):
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 5\nproperty list uchar int vertex_indices\nend_header\n"
    faces = [(i % 4, (i + 1) % 4, (i + 2) % 4) for i in range(5)]
    body = b"".join(struct.pack("<fff", i, 0, 0) for i in range(4)) + b"".join(struct.pack("<Biii", 3, *f) for f in faces)
    (tmp_path / "t.ply").write_bytes(head.encode() + body)
    assert shapes.heads(spark, str(tmp_path))[0].place("face")[2] == 5
    _, found = S.read_meshes(spark, str(tmp_path))
    assert [(r.a, r.b, r.c) for r in found.orderBy("f").collect()] == faces


SPLATS = "x float, y float, z float, sx float, sy float, sz float, r int, g int, b int, a int, q0 int, q1 int, q2 int, q3 int"


def test_splats_are_written_as_raw_records(spark, tmp_path):
    rows = [(float(i), 1.5, -2.0, 0.5, 0.25, 0.125, i % 256, 255, 0, 7, 1, 2, 3, 4) for i in range(1000)]
    target = tmp_path / "s"
    S.write_splats(spark.createDataFrame(rows, SPLATS).repartition(5), str(target))
    files = sorted(target.glob("part-*.bin"))
    assert len(files) == 5 and (target / "_SUCCESS").exists() and not list(target.glob("_temporary*"))
    v = np.frombuffer(b"".join(f.read_bytes() for f in files), S.SPLAT)
    assert len(v) == 1000 and sorted(v["p"][:, 0]) == list(range(1000)) and set(v["c"][:, 1]) == {255}
    assert sorted(map(tuple, S.read_splats(spark, str(target)).collect())) == rows
    with pytest.raises(Exception, match="null"):
        ranges.write_records(spark.createDataFrame([(b"x",), (None,)], "r binary").coalesce(1), str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*")) if (tmp_path / "bad").exists() else True
    (target / "half.bin").write_bytes(b"123")
    with pytest.raises(ValueError, match="records"):
        S.read_splats(spark, str(target))


def test_relations_keep_their_keys(spark, tmp_path):
    from scanloom.sources import operational as O

    rows = [("a", "s", "1", 5), ("b", None, "1", 5), ("c", "s", "x", 5), (None, "s", "2", 5), ("a", "s", "3", 6), ("d", "t", "7", 1)]
    links = spark.createDataFrame(rows, "token_hash string, project_id string, expires_at string, uses long").selectExpr(
        "*", "'p' AS asset_path", "0 AS created_at", "true AS allow_download", "'false' AS allow_embed", "false AS revoked", "1 AS other")
    bad = O.save(links, "share_links", str(tmp_path))
    got = O.load(spark, str(tmp_path), "share_links")
    assert got.schema == spark.createDataFrame([], O.RELATIONS["share_links"].ddl.replace(" NOT NULL", "")).schema
    assert sorted((r.token_hash, r.expires_at, r.max_uses) for r in got.collect()) == [("a", 1, None), ("d", 7, None)]
    assert sorted(str((r.token_hash, r.reasons)) for r in bad.collect()) == ["('a', ['token_hash_taken'])", "('b', ['project_id_missing'])", "('c', ['expires_at_missing'])", "(None, ['token_hash_missing'])"]
    with pytest.raises(ValueError, match="uses"):
        O.conform(links.drop("uses"), "share_links")


def test_files_that_are_no_image_are_rejected(spark, tmp_path):
    head = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 8, 0, 54, 40, 2, 1, 1, 24, 0, 8, 0, 0, 0, 0)
    (tmp_path / "a.bmp").write_bytes(head + bytes([1, 2, 3, 4, 5, 6, 0, 0]))
    (tmp_path / "b.bmp").write_bytes(b"no image")
    rows, bad = S.read_images(spark, str(tmp_path))
    assert [(r.y, r.r, r.g, r.b) for r in rows.collect()] == [(0, [3, 6], [2, 5], [1, 4])]
    assert [r.frame_id.rpartition("/")[2] for r in bad.collect()] == ["b.bmp"]


def test_audit_lines_without_a_record(spark):
    lines = spark.createDataFrame([(1, '{"event": {"id": "x"}, "prev_hash": "p", "hash": "h"}'), (2, "{broken"), (3, "{}")], "seq long, value string")
    assert [r.seq for r in S.read_audit(lines, "seq").collect()] == [1]
    assert sorted(r.seq for r in S.audit_rejects(lines, "seq").collect()) == [2, 3]


def test_few_links_are_settled_in_one_task(spark, monkeypatch):
    from scanloom.operators import graph

    links = [(bytes([a]), bytes([b])) for a, b in [(1, 2), (3, 2), (200, 201), (9, 9), (201, 5)]]
    edges, nodes = spark.createDataFrame(links, "u binary, v binary"), spark.createDataFrame([(bytes([i]),) for i in (1, 2, 3, 5, 7, 9, 200, 201)], "id binary")
    cuts = []
    monkeypatch.setattr(graph, "checkpointed", lambda d, cut=graph.checkpointed: cuts.append(1) or cut(d))

    def found(e):
        return sorted((bytes(r.id), bytes(r.component)) for r in graph.connected_components(nodes, e).collect())

    one_task = found(edges)
    assert len(cuts) == 1 and one_task == [(bytes([i]), bytes([c])) for i, c in [(1, 1), (2, 1), (3, 1), (5, 5), (7, 7), (9, 9), (200, 5), (201, 5)]]
    assert found(edges.filter("false")) == [(bytes([i]), bytes([i])) for i in (1, 2, 3, 5, 7, 9, 200, 201)]
    monkeypatch.setattr(graph, "FEW", 0)
    assert found(edges) == one_task and len(cuts) > 3
