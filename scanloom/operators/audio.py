"""Offsets between sampled tracks by blocked cross-correlation, for tracks that share no hash.

Every ``STEP``-th reference sample is compared with the track at each lag.  Lags
of one remainder modulo the step are one correlation of thinned sequences, cut
into blocks of lags; a block of lags reads the blocks of both sequences in
order and adds up their products by FFT, so no track is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.operators.joins import align_hashes

#: Fixed value: every how many reference samples are compared.
STEP = 16


def _blocks(samples: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(keys, part, values): runs of ``block`` samples ``i`` (from zero, without gaps) in order."""
    return samples.groupBy(*keys, F.floor(F.col("i") / block).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"].cast("double")).alias("values"))  # at most ``block`` values


def cross_correlate(source: DataFrame, reference: DataFrame, keys: list[str], block: int = 1 << 15) -> DataFrame:
    """(keys, lag, correlation) of each track: the lag with the largest mean product, the smallest of equals.

    ``source`` has keys, ``i`` and ``value``, ``reference`` i and value.  Lags go up to a quarter
    of the shorter length; without a positive product lag and correlation are 0.
    """
    length = reference.agg((F.max("i") + 1).alias("n_a"))  # one row
    sizes = source.groupBy(*keys).agg((F.max("i") + 1).alias("n_b")).crossJoin(length).withColumn("n", F.least("n_a", "n_b")).withColumn("most", F.floor(F.col("n") / 4))
    a = _blocks(reference.filter(F.col("i") % STEP == 0).select((F.col("i") / STEP).cast("long").alias("i"), "value"), [], block).select(F.col("part").alias("k"), F.col("values").alias("a"))
    b = _blocks(source.select(*keys, (F.col("i") % STEP).cast("int").alias("phase"), F.floor(F.col("i") / STEP).alias("i"), "value"), [*keys, "phase"], block)
    # lag = STEP * q + phase; lags of block ``lags`` have q from lags * block on
    low, high = F.floor(-F.col("most") / STEP / block) - 1, F.floor(F.col("most") / STEP / block)
    asked = sizes.withColumn("lags", F.explode(F.sequence(low.cast("long"), high.cast("long")))).withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(STEP - 1))))
    last = F.floor((F.col("n") - 1) / STEP / block)
    wanted = asked.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    # a block of the reference meets two neighbouring blocks of the track
    d = wanted.join(a, "k").withColumn("p", F.col("k") + F.col("lags"))
    d = d.join(b.select(*keys, "phase", F.col("part").alias("p"), F.col("values").alias("b0")), [*keys, "phase", "p"], "left")
    d = d.withColumn("p", F.col("p") + 1).join(b.select(*keys, "phase", F.col("part").alias("p"), F.col("values").alias("b1")), [*keys, "phase", "p"], "left")
    columns = [*keys, "phase", "lags", "k", "n", "n_b", "most", "a", "b0", "b1"]
    schema = T.StructType([*(d.schema[k] for k in keys), *T.StructType.fromDDL("lag long, correlation double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def best():
            (*key, phase, lags), n, n_b, most = at
            lag = (lags * block + np.arange(block)) * STEP + phase
            # reference samples that meet a sample of the track
            begin, end = np.maximum(0, -(-(-lag) // STEP)), np.minimum(n, n_b - lag)
            count = np.maximum(0, -(-end // STEP) - begin)
            mean = np.where((lag >= -most) & (lag < most) & (count > 0), total / np.maximum(count, 1), -np.inf)
            i = int(mean.argmax())
            if mean[i] > 0:
                yield pa.RecordBatch.from_arrays([*(pa.array([v], target.field(c).type) for c, v in zip(keys, key, strict=True)), pa.array([int(lag[i])]), pa.array([float(mean[i])])], schema=target)

        target = None
        for batch in batches:
            if target is None:
                target = pa.schema([*(batch.schema.field(k) for k in keys), pa.field("lag", pa.int64()), pa.field("correlation", pa.float64())])
            for r in range(batch.num_rows):
                get = {c: batch.column(c)[r].as_py() for c in (*keys, "phase", "lags", "k", "n", "n_b", "most")}
                key = tuple(get[c] for c in (*keys, "phase", "lags"))
                if at is None or key != at[0]:
                    if at is not None:
                        yield from best()
                    at, total = (key, get["n"], get["n_b"], get["most"]), np.zeros(block)
                left = np.zeros(block)
                own = batch.column("a")[r].values.to_numpy()[: max(0, -(-get["n"] // STEP) - get["k"] * block)]
                left[: len(own)] = own
                right = np.zeros(2 * block)
                for i, c in enumerate(("b0", "b1")):
                    if batch.column(c)[r].is_valid:
                        values = batch.column(c)[r].values.to_numpy()
                        right[i * block : i * block + len(values)] = values
                total += np.fft.irfft(np.fft.rfft(right) * np.conj(np.fft.rfft(left, 2 * block)), 2 * block)[:block]
        if at is not None:
            yield from best()

    found = d.select(*columns).repartition(*keys, "phase", "lags").sortWithinPartitions(*keys, "phase", "lags", "k").mapInArrow(run, schema)
    tracks = source.select(*keys).distinct()
    top = found.groupBy(*keys).agg(F.max_by(F.struct("lag", "correlation"), F.struct(F.round("correlation", 9), -F.col("lag"))).alias("b")).select(*keys, "b.*")
    return tracks.join(top, keys, "left").fillna(0, ["lag"]).fillna(0.0, ["correlation"])


def align_tracks(hashes: DataFrame, reference_hashes: DataFrame, samples: DataFrame, reference: DataFrame, keys: list[str], step_ms: int, rate: float, per_hash: int | None = None) -> DataFrame:
    """One row per track: offset by common hashes, else by correlation, with ``method``.

    ``rate`` is in samples per second.  A correlation between -1 and 1 becomes a confidence between 0 and 1."""
    by_hash = align_hashes(hashes, reference_hashes, keys, step_ms, per_hash).select(*keys, "offset_s", "stretch", "confidence", F.lit("fingerprint").alias("method"))
    lone = samples.join(by_hash, keys, "left_anti")
    other = cross_correlate(lone, reference, keys).select(
        *keys, (F.col("lag") * STEP / F.lit(rate)).alias("offset_s"), F.lit(1.0).alias("stretch"), F.least(F.greatest(F.col("correlation") / 2 + 0.5, F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.lit("correlation").alias("method"))
    return by_hash.unionByName(other)
