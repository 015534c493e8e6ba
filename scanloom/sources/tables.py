"""Readers and writers for capture catalogues, point files and reports.

Every reader names its schema; malformed rows go to a reject table instead of
stopping the job.  Listings never touch file contents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.text import stable_id
from scanloom.operators.ordering import ranked_within
from scanloom.operators.predicates import bad_path, failed_rules
from scanloom.sources import ranges
from scanloom.sources.shapes import meshes_with_rejects, read_meshes, read_point_clouds  # noqa: F401

# Raw image extensions.
RAW = ("nef", "nrw", "cr2", "cr3", "arw", "dng", "raf", "orf", "rw2")


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """Recursive listing: path, mtime, size.  An encrypted envelope (.enc) counts by its inner extension."""
    wanted = "|".join(extensions)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return (files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
            .filter(F.lower("path").rlike(rf"\.({wanted})(\.enc)?$")))


MANIFEST = ("record_type string, schema string, group_count long, source_root string, group_id string, paths array<string>, "
            "focus_steps int, shutter_speeds array<double>, burst_factor int, _corrupt string")
MANIFEST_SCHEMA = "capture-manifest-v1"


def group_id(paths: str = "paths", steps: str = "focus_steps", shutters: str = "shutter_speeds") -> Column:
    return stable_id("capture-group", F.col(steps).cast("string"), F.size(paths).cast("string"), F.array_join(paths, "\x00"), F.array_join(F.col(shutters).cast("array<string>"), "\x00"))


def write_manifest(groups: DataFrame, target: str, source_root: str, expected: int | None = None) -> None:
    """One header line and one line per group; Spark publishes the folder on success.
    A wrong count fails before anything is written."""
    n = groups.count()
    if expected is not None and n != expected:
        raise ValueError(f"manifest has {n} groups, expected {expected}")
    spark = groups.sparkSession
    body = groups.select(F.lit("group").alias("record_type"), group_id().alias("group_id"), "paths", "focus_steps", "shutter_speeds", "burst_factor")
    head = spark.range(1).select(F.lit("header").alias("record_type"), F.lit(MANIFEST_SCHEMA).alias("schema"), F.lit(n).cast("long").alias("group_count"), F.lit(source_root).alias("source_root"))
    head.unionByName(body, allowMissingColumns=True).write.json(target)


def read_manifest(spark: SparkSession, path: str, max_record: int = 16 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """(groups, rejects).  Group ids are recomputed, paths resolved against the root;
    every reason for a rejected line is listed, a wrong count rejects the header."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rec = lines.select("value", F.from_json("value", MANIFEST, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("value", "r.*")
    head = rec.filter("record_type = 'header'").agg(F.max("group_count").alias("declared"), F.max("schema").alias("file_schema"), F.max("source_root").alias("root"))
    body = rec.filter("record_type IS NULL OR record_type <> 'header'")
    found = body.filter("record_type = 'group'").agg(F.count("*").alias("found"))
    rules = {"corrupt": F.col("_corrupt").isNull(), "too_long": F.length("value") <= max_record, "record_type": F.col("record_type") == "group",
             "group_id": F.col("group_id") == group_id(), "traversal": ~F.exists("paths", bad_path), "no_frames": F.size("paths") > 0}
    checked = body.withColumn("reasons", failed_rules(rules)).crossJoin(F.broadcast(head))  # one header row
    groups = checked.filter(F.size("reasons") == 0).select("group_id", F.transform("paths", lambda p: F.concat_ws("/", "root", p)).alias("paths"), "focus_steps", "shutter_speeds", "burst_factor")
    bad = checked.filter(F.size("reasons") > 0).select("value", "reasons")
    wrong = F.array_compact(F.array(F.when(F.col("declared").isNull(), "header_missing"), F.when(F.col("declared") != F.col("found"), "group_count"), F.when(F.col("file_schema") != MANIFEST_SCHEMA, "schema")))
    header = head.crossJoin(found).select(F.lit("header").alias("value"), wrong.alias("reasons")).filter(F.size("reasons") > 0)
    return groups, bad.unionByName(header)


def explode_frames(groups: DataFrame, keys: list[str]) -> DataFrame:
    """One row per frame with focus, exposure and burst index and one reference."""
    e, b = F.greatest(F.size("shutter_speeds"), F.lit(1)), F.greatest("burst_factor", F.lit(1))
    d = groups.withColumns({"_e": e, "_b": b, "_n": F.size("paths")}).select(*keys, "_e", "_b", "_n", "reference", F.posexplode("paths").alias("frame_index", "path"))
    stride = F.col("_e") * F.col("_b")
    inside = F.col("frame_index") % stride
    return d.select(*keys, "frame_index", "path", F.floor(F.col("frame_index") / stride).cast("int").alias("focus_index"), F.floor(inside / F.col("_b")).cast("int").alias("exposure_index"),
                    (inside % F.col("_b")).alias("burst_index"), (F.col("frame_index") == F.least(F.col("reference"), F.col("_n") - 1)).alias("sequence_reference"))


#: Vertices in one written file of a cloud.
POINTS_PER_FILE = 1_000_000


SPLAT = np.dtype([("p", "<f4", 3), ("s", "<f4", 3), ("c", "u1", 4), ("q", "u1", 4)])  # 32 bytes


def read_splats(spark: SparkSession, path: str) -> DataFrame:
    """Raw files of fixed 32-byte records below a folder; every file is split at record borders."""
    width, files = SPLAT.itemsize, ranges.listing(spark, path).collect()
    broken = [f.path for f in files if f.length % width]
    if broken:
        raise ValueError(f"no whole number of {width}-byte records: {broken[0]}")
    return decode_records(ranges.read_records(spark, [{"path": f.path, "offset": 0, "count": f.length // width, "width": width} for f in files]).select(F.col("data").alias("record")))


def write_splats(splats: DataFrame, target: str) -> None:
    """Raw 32-byte records, one file per task, all visible at once when the job has ended."""
    ranges.write_records(pack_splats(splats), target)


def decode_records(records: DataFrame) -> DataFrame:
    """Columns of the splats in the binary column ``record``, one or many records in each value."""
    out = "x float, y float, z float, sx float, sy float, sz float, r int, g int, b int, a int, q0 int, q1 int, q2 int, q3 int"

    def decode(batches):
        for batch in batches:
            for data in batch.column("record"):
                v = np.frombuffer(data.as_buffer(), SPLAT)
                fields = [*v["p"].T, *v["s"].T, *v["c"].T.astype(np.int32), *v["q"].T.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(f)) for f in fields], names=[c.split()[0] for c in out.split(", ")])

    return records.select("record").mapInArrow(decode, out)


def pack_splats(splats: DataFrame) -> DataFrame:
    """Records as one binary column, ready for a byte sink; packed per Arrow batch."""
    def encode(batches):
        for b in batches:
            v = np.zeros(len(b), dtype=SPLAT)
            v["p"], v["s"] = b[["x", "y", "z"]], b[["sx", "sy", "sz"]]
            v["c"], v["q"] = b[["r", "g", "b", "a"]], b[["q0", "q1", "q2", "q3"]]
            raw = v.tobytes()
            yield pd.DataFrame({"record": [raw[i:i + 32] for i in range(0, len(raw), 32)]})

    return splats.mapInPandas(encode, "record binary")


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): decoded images as rows (frame_id, y, r, g, b), one array per channel, and the files that are no image."""
    img = spark.read.format("image").load(path).select("image.*")
    schema = "frame_id string, y int, r array<int>, g array<int>, b array<int>"

    def rows(batches):
        for batch in batches:
            names, shape = batch.column("origin").to_pylist(), [batch.column(c).to_pylist() for c in ("height", "width", "nChannels")]
            for name, h, w, channels, data in zip(names, *shape, batch.column("data"), strict=True):
                a = np.frombuffer(data.as_buffer(), np.uint8).reshape(h * w, channels).astype(np.int32)
                ends = pa.array(np.arange(h + 1, dtype=np.int32) * w)
                planes = {c: pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(a[:, i if channels > 1 else 0]))) for c, i in (("r", 2), ("g", 1), ("b", 0))}
                yield pa.RecordBatch.from_pydict({"frame_id": pa.array([name] * h), "y": pa.array(np.arange(h, dtype=np.int32)), **planes})

    sound = F.coalesce((F.col("height") > 0) & (F.col("width") > 0), F.lit(False))
    return img.filter(sound).mapInArrow(rows, schema), img.filter(~sound).select(F.col("origin").alias("frame_id"), F.lit("no image").alias("reason"))


IMU = "samples array<struct<timestamp:double,accel:array<double>,gyro:array<double>>>, frames array<struct<image_path:string,timestamp:double,matrix:array<double>>>"


def imu_samples(documents: DataFrame, key: str, body: str) -> DataFrame:
    """Samples of JSON timelines, one row each."""
    return documents.select(key, F.explode(F.from_json(body, IMU).getField("samples")).alias("s")).select(key, F.col("s.timestamp").alias("t"), "s.accel", "s.gyro")


def live_poses(documents: DataFrame, key: str, body: str) -> DataFrame:
    """Frames with their 4x4 matrix (row by row) as camera-to-world translation and rotation rows."""
    d = documents.select(key, F.posexplode(F.from_json(body, IMU).getField("frames")).alias("frame", "f")).select(key, "frame", "f.image_path", F.col("f.timestamp").alias("t"), F.col("f.matrix").alias("m"))
    return d.select(key, "frame", "image_path", "t", *[F.get("m", F.lit(i)).alias(n) for i, n in ((3, "tx"), (7, "ty"), (11, "tz"))], F.array(*[F.get("m", F.lit(4 * i + j)) for i in range(3) for j in range(3)]).alias("rotation"))


def pick_reports(files: DataFrame, limit: int) -> DataFrame:
    """One file per logical report (clear before encrypted, then newest), newest first."""
    d = files.withColumns({"encrypted": F.col("path").endswith(".enc"), "logical": F.regexp_replace("path", r"\.enc$", "")})
    best = d.groupBy("logical").agg(F.max_by(F.struct("path", "mtime", "body"), F.struct((~F.col("encrypted")).alias("clear"), "mtime", "path")).alias("b")).select("logical", "b.*")
    return best.orderBy(F.desc("mtime"), "logical").limit(limit)


REPORT = "schema string, group_id string, frames int, artifacts array<string>"


def parse_reports(reports: DataFrame, inventory: DataFrame, schema_name: str) -> DataFrame:
    """Bounded summaries with a reject reason and the artifacts the inventory lacks."""
    r = reports.withColumn("r", F.from_json("body", REPORT))
    reason = F.when(F.col("r").isNull() | F.col("r.group_id").isNull(), "unreadable").when(F.col("r.schema") != schema_name, "schema").when(F.col("r.frames") <= 0, "no_frames")
    r = r.withColumn("reject", reason)
    a = r.filter("reject IS NULL").select("logical", F.explode("r.artifacts").alias("path")).join(inventory.select("path", F.lit(1).alias("_have")), "path", "left")
    miss = a.groupBy("logical").agg(F.count("*").alias("artifacts"), F.count_if(F.col("_have").isNull()).alias("missing"))
    return r.select("logical", "mtime", "r.group_id", "r.frames", "reject").join(miss, "logical", "left").fillna(0, ["artifacts", "missing"])


AUDIT = "event struct<id:string,actor:string,action:string,resource:string>, prev_hash string, hash string"


def read_audit(lines: DataFrame, order: str, tail: int | None = None) -> DataFrame:
    """Audit records of JSON lines; unreadable lines are skipped (``audit_rejects`` has them); optional tail in log order."""
    d = lines.select(order, F.from_json("value", AUDIT).alias("r")).filter("r.hash IS NOT NULL AND r.event IS NOT NULL").select(order, "r.event.*", "r.prev_hash", "r.hash")
    return d if tail is None else d.orderBy(F.desc(order)).limit(tail).orderBy(order)


def audit_rejects(lines: DataFrame, order: str) -> DataFrame:
    """(order, value) of the lines that hold no audit record."""
    r = F.from_json("value", AUDIT)
    return lines.filter(~F.coalesce(r.getField("hash").isNotNull() & r.getField("event").isNotNull(), F.lit(False))).select(order, "value")


BENCH = "run_id string, sequences array<struct<id:string,frame_count:int,load_total_ms:double,timings:map<string,struct<count:long,mean_ms:double,min_ms:double,max_ms:double>>>>"


def bench_timings(runs: DataFrame, body: str) -> DataFrame:
    """Run documents to one row per run, sequence and timing label."""
    s = runs.select(F.from_json(body, BENCH).alias("r")).select("r.run_id", F.explode("r.sequences").alias("s"))
    return s.select("run_id", F.col("s.id").alias("sequence"), F.explode("s.timings").alias("label", "t")).select("run_id", "sequence", "label", "t.*")


MODALITIES = ("rgb", "depth", "raw", "multimodal")


def check_datasets(entries: DataFrame) -> DataFrame:
    """Dataset entries with the names of the rules they break."""
    rules = {"id": F.col("id").isNotNull(), "name": F.length("name") > 0, "version": F.col("version").isNotNull(), "license": F.col("license").isNotNull(), "modality": F.col("modality").isin(*MODALITIES), "size": F.col("size_bytes") > 0}
    return entries.withColumn("failures", failed_rules(rules))


def write_measurements(rows: DataFrame, target: str) -> None:
    rows.write.option("header", True).csv(target)


def outline_geojson(outline: DataFrame, key: str) -> DataFrame:
    """One GeoJSON feature per object from ordered corners (key, corner, x, y), ring closed."""
    ring = outline.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("corner", "x", "y"))).alias("c"))  # hull corners
    pts = F.transform("c", lambda p: F.array(p.x, p.y))
    closed = F.array_append(pts, F.get(pts, F.lit(0)))
    return ring.select(key, F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")).alias("geometry"))).alias("feature"))


def write_point_clouds(points: DataFrame, target: str, per_file: int = POINTS_PER_FILE) -> None:
    """ASCII PLY files of at most ``per_file`` points in a folder ``cloud_id=<id>`` each.

    Every file has a header with its own number of points and the number of its
    first, so files are written and read on their own and no cloud is one task."""
    line = F.format_string("%.6f %.6f %.6f %d %d %d", "x", "y", "z", "r", "g", "b")
    d = ranked_within(points.select("cloud_id", "point_id", line.alias("line")), ["cloud_id"], [F.col("point_id"), F.col("line")], into="_at")
    d = d.withColumn("part", F.floor(F.col("_at") / per_file))
    kinds = "".join(f"property {t} {n}\n" for t, names in (("float", "x y z"), ("uchar", "red green blue")) for n in names.split())
    head = d.groupBy("cloud_id", "part").agg(F.count("*").alias("n")).select("cloud_id", "part", F.lit(-1).cast("long").alias("_at"), F.concat(
        F.lit("ply\nformat ascii 1.0\ncomment first "), (F.col("part") * per_file).cast("string"), F.lit("\nelement vertex "), F.col("n").cast("string"), F.lit(f"\n{kinds}end_header")).alias("line"))
    files = head.unionByName(d.select("cloud_id", "part", "_at", "line")).repartition("cloud_id", "part").sortWithinPartitions("cloud_id", "part", "_at")
    files.select("cloud_id", "part", F.col("line").alias("value")).write.partitionBy("cloud_id", "part").text(target)
