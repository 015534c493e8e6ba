"""Point clouds and meshes of PLY and OBJ files of any size.

Only headers are read file by file.  Binary vertices (and faces, where all are
triangles) are byte ranges of fixed-width records; lines of text are numbered
on Spark, whatever bytes a file is split at.  What cannot be cut, binary lists
of varying length, is parsed a file at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators.ordering import ranked_within
from scanloom.sources import ply, ranges

#: Bytes of a header at most.
HEADER = 1 << 20


@dataclass
class Head:
    """What the beginning of a file says."""

    path: str
    uri: str
    length: int
    kind: str  # obj, ascii, a binary format, or none
    reason: str | None = None
    body: int = 0
    lines: int = 0
    first: int = 0
    elements: list = field(default_factory=list)

    @property
    def order(self) -> str:
        return ">" if self.kind == "binary_big_endian" else "<"

    def dtype(self, element) -> np.dtype:
        """Fixed width of a row; a list is taken to have three values."""
        scalars, lists, fields = dict(element.scalars), {n: (c, v) for n, c, v in element.lists}, []
        for name in element.order or scalars:
            if name in scalars:
                fields.append((name, self.order + scalars[name]))
            else:
                fields += [(f"{name} count", self.order + lists[name][0]), (name, self.order + lists[name][1], (3,))]
        return np.dtype(fields)

    def place(self, name: str):
        """(element, byte offset, rows that are there) of fixed-width rows; None if they cannot be cut out.
        An element with lists can, if it is the last and its size is that of triangles."""
        at = self.body
        for i, element in enumerate(self.elements):
            width = self.dtype(element).itemsize
            if element.name == name:
                if element.lists and (i < len(self.elements) - 1 or at + element.count * width != self.length):
                    return None
                return element, at, min(element.count, max(0, self.length - at) // max(1, width))
            if element.lists:
                return None
            at += element.count * width
        return None

    def rows_before(self, name: str) -> int:
        """Number of the first line of an element in a text file."""
        before = self.lines
        for element in self.elements:
            if element.name == name:
                break
            before += element.count
        return before

    def element(self, name: str):
        return next((e for e in self.elements if e.name == name), None)


def heads(spark: SparkSession, path: str, default: str = "ply") -> list[Head]:
    """One entry per file below ``path``; files without a known extension are ``default``."""
    columns = "path string, uri string, length long, data binary, obj boolean"

    def look(batches):
        for b in batches:
            for name, uri, length in zip(b["path"], b["uri"], b["length"]):
                ending = name.lower().rpartition(".")[2]
                obj, data = (ending if ending in ("obj", "ply") else default) == "obj", b""
                if not obj:
                    fs, inner = ranges.file_system(name)
                    with fs.open_input_file(inner) as f:
                        while len(data) < HEADER and b"end_header" not in data and (more := f.read(1 << 14)):
                            data += more
                        data += f.read(64)  # the line end behind the last word
                yield pd.DataFrame({"path": [name], "uri": [uri], "length": [length], "data": [data], "obj": [obj]})

    found = []
    for r in ranges.listing(spark, path).mapInPandas(look, columns).collect():  # headers only
        if r.obj:
            found.append(Head(r.path, r.uri, r.length, "obj"))
            continue
        try:
            kind, elements, body, first = ply.header(bytes(r.data))
            found.append(Head(r.path, r.uri, r.length, kind, None, body, bytes(r.data)[:body].count(b"\n"), first, elements))
        except (ValueError, KeyError, IndexError) as problem:
            found.append(Head(r.path, r.uri, r.length, "none", str(problem)))
    return sorted(found, key=lambda h: h.path)


def words(value: str = "value") -> Column:
    return F.split(F.trim(F.col(value)), r"\s+")


def numbers(tokens: Column) -> Column:
    """The tokens as doubles; what is none is null."""
    return F.transform(tokens, lambda x: x.try_cast("double"))


def _rejects(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "path string, line long, reason string")


class Shapes:
    """The files below one path."""

    def __init__(self, spark: SparkSession, path: str, default: str = "ply"):
        self.spark, self.heads = spark, heads(spark, path, default)

    def of(self, *kinds: str) -> list[Head]:
        return [h for h in self.heads if any(h.kind.startswith(k) for k in kinds)]

    def _lines(self, files: list[Head], name: str) -> DataFrame:
        """Lines of one element of ASCII files: path, block, no, row, names of the scalars, tokens."""
        place = [(h.path, h.uri, h.rows_before(name), e.count, [n for n, _ in e.scalars], h.first) for h in files if (e := h.element(name))]
        known = self.spark.createDataFrame(place, "path string, uri string, _begin long, _count long, names array<string>, first long")
        d = ranges.numbered_lines(self.spark, [p[0] for p in place]).join(known, "uri")
        return d.withColumn("row", F.col("no") - F.col("_begin")).filter("row >= 0 and row < _count").withColumn("w", words())

    def _missing(self, files: list[Head]) -> DataFrame:
        """ASCII files with fewer lines than their header promises."""
        promised = self.spark.createDataFrame([(h.path, h.uri, h.lines, h.lines + sum(e.count for e in h.elements)) for h in files], "path string, uri string, _head long, _all long")
        seen = ranges.numbered_lines(self.spark, [h.path for h in files]).groupBy("uri").agg(F.count("*").alias("_n"))
        d = promised.join(seen, "uri", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter("_n < _all")
        return d.select("path", (F.col("_n") - F.col("_head")).alias("line"), F.concat((F.col("_all") - F.col("_n")).cast("string"), F.lit(" rows are missing")).alias("reason"))

    def vertices(self, columns: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
        """(path, row, one double per column) of PLY files, and (path, line, reason).

        ``columns`` names the properties that may fill each column, best first.
        Rows that cannot be read are passed over in the numbering."""
        target = [*columns]
        schema = "path string, row long, " + ", ".join(f"{c} double" for c in target)
        none, bad, cut, whole = self.spark.createDataFrame([], schema), [], [], []
        for h in self.of("binary"):
            found = h.place("vertex")
            if found is None:
                whole.append(h)
                continue
            element, offset, n = found
            cut.append((h, element, offset, n))
            if n < element.count:
                bad.append((h.path, n, f"{element.count - n} rows of vertex are missing"))
        bad += [(h.path, -1, h.reason) for h in self.of("none")]
        out, rejects = none, _rejects(self.spark, bad)
        if cut:
            kinds = {h.path: (h.dtype(e), h.first) for h, e, _, _ in cut}

            def decode(batches):
                for batch in batches:
                    for path, first, data in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), batch.column("data")):
                        kind, begin = kinds[path]
                        rows = np.frombuffer(data.as_buffer(), kind)
                        values = {c: next((pa.array(rows[o].astype(float)) for o in names if o in kind.names), pa.nulls(len(rows), pa.float64())) for c, names in columns.items()}
                        yield pa.RecordBatch.from_pydict({"path": pa.array([path]).take(pa.array(np.zeros(len(rows), np.int64))), "row": pa.array(begin + first + np.arange(len(rows))), **values})

            files = [{"path": h.path, "offset": at, "count": n, "width": h.dtype(e).itemsize} for h, e, at, n in cut]
            out = out.unionByName(ranges.read_records(self.spark, files).mapInArrow(decode, schema))
        if whole:
            out, more = self._whole(whole, out, columns, schema)
            rejects = rejects.unionByName(more)
        text = [h for h in self.of("ascii") if h.element("vertex") and not h.element("vertex").lists]
        if text:
            d = self._lines(text, "vertex")
            d = d.withColumn("v", numbers(F.slice("w", 1, F.size("names")))).withColumn("ok", (F.size("v") == F.size("names")) & F.forall("v", lambda x: x.isNotNull()))
            good = ranges.count_before(d.filter("ok"), {"at": F.lit(1)})
            pick = {c: F.coalesce(*[F.get("v", F.array_position("names", F.lit(o)).cast("int") - 1) for o in names]) for c, names in columns.items()}
            out = out.unionByName(good.select("path", (F.col("first") + F.col("at")).alias("row"), *[x.alias(c) for c, x in pick.items()]))
            rejects = rejects.unionByName(d.filter("not ok").select("path", "row", F.col("value").alias("reason")).withColumnRenamed("row", "line")).unionByName(self._missing(text))
        return out, rejects

    def _whole(self, files: list[Head], out: DataFrame, columns: dict, schema: str) -> tuple[DataFrame, DataFrame]:
        content = self.spark.read.format("binaryFile").load([h.path for h in files]).select("path", "content")
        names = [*columns]

        def parse(batches):
            for b in batches:
                for path, data in zip(b["path"], b["content"]):
                    found = ply.read(bytes(data))
                    n = len(next(iter(found.vertices.values()), ()))
                    values = {c: next((found.vertices[o] for o in columns[c] if o in found.vertices), [None] * n) for c in names}
                    yield pd.DataFrame({"path": path, "row": found.first + np.arange(n), **values, "reason": None}, dtype=object)
                    if found.rejects:
                        yield pd.DataFrame({"path": path, "row": [i for i, _ in found.rejects], **{c: None for c in names}, "reason": [t for _, t in found.rejects]}, dtype=object)

        both = content.mapInPandas(parse, schema + ", reason string")
        return out.unionByName(both.filter("reason is null").drop("reason")), both.filter("reason is not null").select("path", F.col("row").alias("line"), "reason")

    def faces(self) -> tuple[DataFrame, DataFrame]:
        """(path, f, a, b, c): triangles of the PLY files, polygons as fans, and (path, line, reason)."""
        schema = "path string, f long, a long, b long, c long"
        out, rejects, cut, whole = self.spark.createDataFrame([], schema), _rejects(self.spark, []), [], []
        for h in self.of("binary"):
            if (e := h.element("face")) and e.lists:
                (cut if h.place("face") else whole).append(h)
        if cut:
            kinds = {h.path: (h.dtype(h.element("face")), h.element("face").lists[0][0]) for h in cut}

            def decode(batches):
                for batch in batches:
                    for path, first, data in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), batch.column("data")):
                        kind, name = kinds[path]
                        rows = np.frombuffer(data.as_buffer(), kind)
                        if (rows[f"{name} count"] != 3).any():
                            raise ValueError(f"{path}: faces of varying size in the space of triangles")
                        corners = rows[name].astype(np.int64)
                        yield pa.RecordBatch.from_pydict({"path": pa.array([path]).take(pa.array(np.zeros(len(rows), np.int64))), "f": pa.array(first + np.arange(len(rows))), **{c: pa.array(corners[:, i]) for i, c in enumerate("abc")}})

            files = [{"path": h.path, "offset": h.place("face")[1], "count": h.place("face")[2], "width": h.dtype(h.element("face")).itemsize} for h in cut]
            out = out.unionByName(ranges.read_records(self.spark, files).mapInArrow(decode, schema))
        if whole:
            content = self.spark.read.format("binaryFile").load([h.path for h in whole]).select("path", "content")

            def parse(batches):
                for b in batches:
                    for path, data in zip(b["path"], b["content"]):
                        found = ply.read(bytes(data)).faces
                        yield pd.DataFrame({"path": path, "f": np.arange(len(found)), **{c: found[:, i] for i, c in enumerate("abc")}})

            out = out.unionByName(content.mapInPandas(parse, schema))
        text = [h for h in self.of("ascii") if h.element("face")]
        if text:
            d = self._lines(text, "face").withColumn("k", F.get("w", F.lit(0)).try_cast("int"))
            d = d.withColumn("v", F.transform(F.slice("w", 2, F.greatest("k", F.lit(0))), lambda x: x.try_cast("double").cast("long")))
            d = d.withColumn("ok", F.coalesce((F.col("k") >= 3) & (F.size("v") == F.col("k")) & F.forall("v", lambda x: x.isNotNull()), F.lit(False)))
            good = ranges.count_before(d.filter("ok").select("path", "uri", "block", "no", "v", "k"), {"at": F.col("k") - 2})
            fan = good.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - 2)))
            out = out.unionByName(fan.select("path", (F.col("at") + F.col("i") - 1).alias("f"), F.get("v", F.lit(0)).alias("a"), F.get("v", F.col("i")).alias("b"), F.get("v", F.col("i") + 1).alias("c")))
            rejects = rejects.unionByName(d.filter("not ok").select("path", F.col("row").alias("line"), F.col("value").alias("reason")))
        return out, rejects

    def obj_lines(self, *tags: str) -> DataFrame:
        """Lines of OBJ files that begin with one of ``tags``: path, uri, block, no, value, tag, w."""
        known = self.spark.createDataFrame([(h.path, h.uri) for h in self.of("obj")], "path string, uri string")
        d = ranges.numbered_lines(self.spark, [h.path for h in self.of("obj")]).join(known, "uri").withColumn("w", words())
        return d.withColumn("tag", F.get("w", F.lit(0))).filter(F.col("tag").isin(*tags))

    def obj_points(self) -> tuple[DataFrame, DataFrame]:
        """(path, row, x, y, z, nx, ny, nz); normals where a file has as many as positions."""
        d = self.obj_lines("v", "vn").withColumn("n", numbers(F.slice("w", 2, 3)))
        d = d.withColumn("ok", (F.size("n") == 3) & F.forall("n", lambda x: x.isNotNull()))
        good = ranges.count_before(d.filter("ok"), {"v": (F.col("tag") == "v").cast("long"), "vn": (F.col("tag") == "vn").cast("long")})
        part = lambda tag, names: good.filter(F.col("tag") == tag).select("path", F.col(tag).alias("row"), *[F.get("n", F.lit(i)).alias(c) for i, c in enumerate(names)])
        even = good.groupBy("path").agg(F.count_if(F.col("tag") == "v").alias("_v"), F.count_if(F.col("tag") == "vn").alias("_n")).filter("_v = _n").select("path")
        normals = part("vn", ("nx", "ny", "nz")).join(even, "path", "left_semi")
        return part("v", "xyz").join(normals, ["path", "row"], "left"), d.filter("not ok").select("path", F.col("no").alias("line"), F.col("value").alias("reason"))

    def obj_mesh(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(path, v, x, y, z, r, g, b, s, t), (path, f, a, b, c) and (path, line, reason).

        Faces keep their first three corners; negative indices count back from
        the line; equal corners are one vertex, numbered as they first appear.
        Files without faces keep all their vertices, as points.
        A line that cannot be read keeps its number; faces that need it are rejected."""
        d = ranges.count_before(self.obj_lines("v", "vt", "vn", "f"), {n: (F.col("tag") == n).cast("long") for n in ("v", "vt", "vn")}, ("uri", "block", "no"))
        d = d.withColumn("n", numbers(F.slice("w", 2, 6)))
        xyz = F.slice("n", 1, 3)
        pos = d.filter("tag = 'v'").withColumn("ok", (F.size(xyz) == 3) & F.forall(xyz, lambda x: x.isNotNull()))
        tex = d.filter("tag = 'vt'").withColumn("ok", F.coalesce(F.get("n", F.lit(0)).isNotNull(), F.lit(False)))
        at = lambda i: F.get("n", F.lit(i))
        colours = [F.when(F.size("n") == 6, 255 * at(3 + i)).alias(c) for i, c in enumerate("rgb")]
        positions = pos.filter("ok").select("path", (F.col("v") + 1).alias("_v"), *[at(i).alias(c) for i, c in enumerate("xyz")], *colours)
        textures = tex.filter("ok").select("path", (F.col("vt") + 1).alias("_vt"), at(0).alias("s"), F.coalesce(at(1), F.lit(0.0)).alias("t"))

        def corner(x: Column) -> Column:
            parts = F.split(x, "/")

            def index(i: int, before: str) -> Column:
                text = F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
                number = text.try_cast("long")
                return F.when(text == "", F.lit(0).cast("long")).when(number > 0, number).otherwise(F.col(before) + 1 + number)

            return F.struct(index(0, "v").alias("_v"), index(1, "vt").alias("_vt"), index(2, "vn").alias("_vn"))

        f = d.filter("tag = 'f'").withColumn("corners", F.transform(F.slice("w", 2, 3), corner))
        whole = (F.size("corners") == 3) & F.forall("corners", lambda c: c["_v"].isNotNull() & c["_vt"].isNotNull() & c["_vn"].isNotNull())
        corners = f.filter(whole).select("path", "no", "value", F.posexplode("corners").alias("corner", "k")).select("path", "no", "value", "corner", "k.*")
        placed = corners.join(positions.select("path", "_v", F.lit(True).alias("_there")), ["path", "_v"], "left")
        lost = placed.filter("_there is null").select("path", "no").distinct()
        usable = corners.join(lost, ["path", "no"], "left_anti")
        first = usable.groupBy("path", "_v", "_vt", "_vn").agg(F.min(F.struct("no", "corner")).alias("_seen"))
        ids = ranked_within(first, ["path"], [F.col("_seen")], into="id").drop("group_size", "_seen")
        verts = ids.join(positions, ["path", "_v"]).join(textures, ["path", "_vt"], "left").select("path", F.col("id").alias("v"), *"xyzrgbst")
        points = positions.join(f.select("path").distinct(), "path", "left_anti").select("path", (F.col("_v") - 1).alias("v"), *"xyzrgb")
        verts = verts.unionByName(points, allowMissingColumns=True)
        tri = usable.join(ids, ["path", "_v", "_vt", "_vn"]).groupBy("path", "no").agg(*[F.max(F.when(F.col("corner") == i, F.col("id"))).alias(c) for i, c in enumerate("abc")])
        faces = ranked_within(tri, ["path"], [F.col("no")], into="f").select("path", "f", *"abc")
        rejects = pos.filter("not ok").unionByName(tex.filter("not ok"), allowMissingColumns=True).select("path", F.col("no").alias("line"), F.col("value").alias("reason"))
        rejects = rejects.unionByName(f.filter(~whole & (F.size("w") >= 4)).select("path", F.col("no").alias("line"), F.col("value").alias("reason")))
        return verts, faces, rejects.unionByName(f.join(lost, ["path", "no"], "left_semi").select("path", F.col("no").alias("line"), F.col("value").alias("reason")))


def cloud_id(path: str = "path") -> Column:
    """The cloud that a folder ``cloud_id=<id>`` names, or the file itself."""
    own = F.regexp_extract(path, r"cloud_id=([^/]+)/", 1)
    return F.when(own == "", F.col(path)).otherwise(own)


def read_point_clouds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, rejects) of the PLY (ASCII or binary) and OBJ files below a folder.

    A cloud may lie in several files of a folder ``cloud_id=<id>``; each tells
    the number of its first point.  Other files are a cloud of their own, named
    by their path."""
    shapes = Shapes(spark, path)
    names = {"x": ("x",), "y": ("y",), "z": ("z",), "nx": ("nx",), "ny": ("ny",), "nz": ("nz",), "r": ("red",), "g": ("green",), "b": ("blue",)}
    blind = [h for h in shapes.of("ascii", "binary") if not {"x", "y", "z"} <= {n for e in h.elements if e.name == "vertex" for n, _ in e.scalars}]
    shapes.heads = [h for h in shapes.heads if h not in blind]
    points, rejects = shapes.vertices(names)
    rejects = rejects.unionByName(_rejects(spark, [(h.path, -1, "no positions") for h in blind]))
    if shapes.of("obj"):
        more, bad = shapes.obj_points()
        points, rejects = points.unionByName(more, allowMissingColumns=True), rejects.unionByName(bad)
    colour = [F.col(c).cast("int").alias(c) for c in "rgb"]
    return points.select(cloud_id().alias("cloud_id"), F.col("row").alias("point_id"), "x", "y", "z", "nx", "ny", "nz", *colour), rejects.select(cloud_id().alias("cloud_id"), "line", "reason")


def read_meshes(spark: SparkSession, path: str, default: str = "ply") -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of OBJ and PLY files, ASCII or binary, with colours and texture coordinates
    where there are any.  OBJ faces keep their first three corners, negative indices count from the
    end, equal corner keys share a vertex; PLY faces under three indices are skipped.  Files without
    a known extension are read as ``default``."""
    verts, faces, _ = meshes_with_rejects(spark, path, default)
    return verts, faces


def meshes_with_rejects(spark: SparkSession, path: str, default: str = "ply") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``read_meshes`` and (mesh_id, line, reason) of the lines and files that could not be read."""
    shapes = Shapes(spark, path, default)
    names = {"x": ("x",), "y": ("y",), "z": ("z",), "r": ("red", "r"), "g": ("green", "g"), "b": ("blue", "b"), "s": ("s", "u", "texture_u"), "t": ("t", "v", "texture_v")}
    verts, rejects = shapes.vertices(names)
    faces, bad = shapes.faces()
    verts, rejects = verts.withColumnRenamed("row", "v"), rejects.unionByName(bad)
    if shapes.of("obj"):
        own, tri, bad = shapes.obj_mesh()
        verts, faces, rejects = verts.unionByName(own), faces.unionByName(tri), rejects.unionByName(bad)
    verts = verts.select(F.col("path").alias("mesh_id"), "v", "x", "y", "z", *[F.col(c).cast("int").alias(c) for c in "rgb"], F.col("s").alias("tex_u"), F.col("t").alias("tex_v"))
    return verts, faces.withColumnRenamed("path", "mesh_id"), rejects.withColumnRenamed("path", "mesh_id")
