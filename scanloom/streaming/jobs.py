"""Structured Streaming jobs over file sources.

Each job drains what is available and writes a table in the shared folder, so
it can run on a schedule or continuously with another trigger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.session import scratch_path
from scanloom.streaming.expiring import STATE_STORE


def events_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Typed event stream with event time and microseconds."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # A single file is named by a filter on its folder, as the file source lists folders.
    raw = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))


def drain(stream: DataFrame, name: str, mode: str = "append", trigger: dict | None = None, target: str | None = None) -> DataFrame:
    """Run to the end of the available data into a parquet table and read it back.

    State is kept in RocksDB: beside a bounded cache it lies on disk and may outgrow the heap.
    ``target`` names the folder of the table and of the query's progress; a new one by default."""
    spark = stream.sparkSession
    target = target or scratch_path(spark, name)
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, STATE_STORE)
    try:  # a query takes its settings when it starts
        q = (stream.writeStream.format("parquet").option("path", f"{target}/table").option("checkpointLocation", f"{target}/progress")
             .outputMode(mode).trigger(**(trigger or {"availableNow": True})).start())
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/table")


def in_files(rows: DataFrame, order: str, late: Column, name: str, parts: int = 3, files: int = 8) -> str:
    """A folder of ``parts`` equal stretches of event time, one written after the other in
    ``files`` files, and the ``late`` rows behind them all, as from a sender that was cut off."""
    spark, target = rows.sparkSession, scratch_path(rows.sparkSession, name)
    first, last = rows.agg(F.min(order), F.max(order)).first()
    width = ((last or 0) - (first or 0)) // parts + 1
    part = F.when(late, parts).otherwise(F.floor((F.col(order) - F.lit(first)) / width))
    for i in range(parts + 1):
        rows.filter(part == i).repartition(files).write.mode("append").parquet(target)
    return target


def fan_out(stream: DataFrame, payload: Column, schema: str, routes: dict[str, Column], name: str) -> dict[str, DataFrame]:
    """Parse the payload once per micro-batch and append each route to its own table."""
    spark = stream.sparkSession
    target = scratch_path(spark, name)
    parsed = stream.withColumn("event", F.from_json(payload, schema))

    def publish(batch: DataFrame, batch_id: int) -> None:
        # One write per route; the batch id names the folder, so a retried batch overwrites itself.
        batch.persist()
        try:
            for route, keep in routes.items():
                batch.filter(keep).write.mode("overwrite").parquet(f"{target}/{route}/batch={batch_id}")
        finally:
            batch.unpersist()

    q = parsed.writeStream.foreachBatch(publish).option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return {r: spark.read.schema(parsed.schema).parquet(f"{target}/{r}/batch=*") for r in routes}


def without_echoes(stream: DataFrame, fingerprint: list[str], within: str) -> DataFrame:
    """Drop repeats of a fingerprint inside the watermark delay."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(fingerprint)


def sessions(df: DataFrame, keys: list[str], gap: str, watermark: str | None = None) -> DataFrame:
    """Bursts as session windows; works on batch and streaming input."""
    d = df.withWatermark("ts", watermark) if watermark else df
    w = F.session_window("ts", gap)
    return d.groupBy(w, *keys).agg(F.count("*").alias("frames"), F.min("ts").alias("started"), F.max("ts").alias("ended")).drop("session_window")


def match_live(left: DataFrame, right: DataFrame, key: str, tolerance: str, delay: str) -> DataFrame:
    """Stream-stream interval join of high-resolution rows with live rows."""
    l = left.select(F.col(key), F.col("event_id"), F.col("ts").alias("lts")).withWatermark("lts", delay)
    r = right.select(F.col(key).alias("_k"), F.col("event_id").alias("matched"), F.col("ts").alias("rts")).withWatermark("rts", delay)
    t = F.expr(f"INTERVAL {tolerance}")
    return l.join(r, (F.col(key) == F.col("_k")) & (F.col("rts") > F.col("lts") - t) & (F.col("rts") < F.col("lts") + t)).drop("_k")


def closest(matches: DataFrame, left_id: str) -> DataFrame:
    gap = F.abs(F.unix_micros("rts") - F.unix_micros("lts"))
    return matches.groupBy(left_id).agg(F.min_by("matched", F.struct(gap, F.unix_micros("rts"))).alias("matched"))


def latest_by(updates: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_s")).select(*keys, "_s.*")
