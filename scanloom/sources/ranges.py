"""Large files in parts: byte ranges of fixed-width records, numbered lines of text.

``FixedRecords`` is a data source.  Read, it cuts every file's records into
ranges, one Spark partition each.  Written, every task puts its records into a
file of its own that only the commit of the job makes visible.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Records of one partition, and of one row of it.
RANGE, PIECE = 1 << 22, 1 << 16


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark lists it (no escapes), and the path in it."""
    found = re.match(r"([A-Za-z0-9+.-]+)://([^/]+)(/.*)", path)
    if found and found[1] != "file":
        fs, base = pafs.FileSystem.from_uri(f"{found[1]}://{found[2]}/")
        return fs, base.rstrip("/") + found[3]
    return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int
    offset: int
    width: int


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    count: int


class FixedRecords(DataSource):
    """``fixed_records``: rows of (path, first, data) with up to ``piece`` records each.

    Read with option ``files``, a JSON list of {path, offset, count, width}, and
    optionally ``range`` and ``piece``.  Write one binary column; a record is
    a row, the folder is ``path``.
    """

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        return "path string, first long, data binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RangeReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if len(schema) != 1 or not isinstance(schema[0].dataType, T.BinaryType):
            raise ValueError("records are one binary column")
        return RecordWriter(self.options["path"])


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.range, self.piece = int(options.get("range", RANGE)), int(options.get("piece", PIECE))

    def partitions(self) -> list[Range]:
        return [Range(f["path"], at, min(self.range, f["count"] - at), f["offset"] + at * f["width"], f["width"]) for f in self.files for at in range(0, f["count"], self.range)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, inner = file_system(part.path)
        with fs.open_input_file(inner) as f:
            f.seek(part.offset)
            for at in range(0, part.count, self.piece):
                n = min(self.piece, part.count - at) * part.width
                data = f.read(n)
                if len(data) < n:
                    raise OSError(f"{part.path} is shorter than its header says")
                yield pa.RecordBatch.from_pydict({"path": [part.path], "first": pa.array([part.first + at], pa.int64()), "data": pa.array([data], pa.binary())})


class RecordWriter(DataSourceArrowWriter):
    """Two phases: tasks write below ``_temporary``, the driver moves what succeeded and removes the rest."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _temporary(self) -> str:
        return f"{self.path}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, count, sink = f"{self._temporary()}/{uuid.uuid4().hex}", 0, None
        fs, inner = file_system(name)
        try:
            for batch in iterator:
                if batch.num_rows:
                    if sink is None:
                        fs.create_dir(inner.rpartition("/")[0], recursive=True)
                        sink = fs.open_output_stream(inner)
                    column = batch.column(0)
                    if column.null_count:
                        raise ValueError("a record is null")
                    sink.write(b"".join(column.to_pylist()))
                    count += batch.num_rows
        finally:
            if sink is not None:
                sink.close()
        return Written(name if count else None, count)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        done = [m.temporary for m in messages if m is not None and m.temporary]
        for i, name in enumerate(sorted(done)):
            fs.move(file_system(name)[1], f"{folder}/part-{i:05d}-{self.job}.bin")
        self._forget(fs)
        with fs.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._forget(file_system(self.path)[0])

    def _forget(self, fs: pafs.FileSystem) -> None:
        inner = file_system(self._temporary())[1]
        if fs.get_file_info(inner).type == pafs.FileType.Directory:
            fs.delete_dir(inner)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, uri, length) of the files below a folder; contents are not read.  ``uri`` is the escaped path of ``numbered_lines``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("_metadata.file_path").alias("uri"), "length")


def read_records(spark: SparkSession, files: list[dict], records: int = RANGE, piece: int = PIECE) -> DataFrame:
    """(path, first, data) of the records of ``files`` ({path, offset, count, width})."""
    spark.dataSource.register(FixedRecords)
    return spark.read.format("fixed_records").option("files", json.dumps(files)).option("range", str(records)).option("piece", str(piece)).load()


def write_records(records: DataFrame, target: str) -> None:
    """Raw bytes of one binary column, one file per task; all of them or none are seen."""
    records.sparkSession.dataSource.register(FixedRecords)
    records.write.format("fixed_records").mode("append").save(target)


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(uri, block, no, value): lines of text files, split at any byte, numbered from zero in each file.

    Lines of one block of a file are read one after the other; only the number
    of lines per block is summed over a file.
    """
    if not paths:
        return spark.createDataFrame([], "uri string, block long, no long, value string")
    read = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_m"), "value")
    ends = read.groupBy("uri", "block").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    starts = ends.select("uri", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return read.join(starts, ["uri", "block"]).select("uri", "block", (F.col("_before") + F.col("_m") - F.col("_first")).alias("no"), "value")


def count_before(lines: DataFrame, counts: dict[str, Column], keys: tuple[str, str, str] = ("uri", "block", "no")) -> DataFrame:
    """``lines`` with, for each name, the sum of its column over all earlier lines of the file."""
    path, block, no = keys
    d = lines.withColumns({f"_v_{n}": c.cast("long") for n, c in counts.items()})
    inside = Window.partitionBy(path, block).orderBy(no).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(path).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    sums = d.groupBy(path, block).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in counts])
    sums = sums.select(path, block, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in counts])
    d = d.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in counts}).join(sums, [path, block])
    return d.withColumns({n: F.col(f"_i_{n}") + F.col(f"_b_{n}") for n in counts}).drop(*[f"_{p}_{n}" for n in counts for p in "vib"])
