"""Connected components by alternating large-star and small-star rounds
(published algorithm); each round is cut by a checkpoint.  Few links are settled in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scanloom.session import checkpointed

#: Links up to which components are found in one task, for ids that are numbers, strings or bytes.
FEW = 1 << 20


def fold(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the trees of linked members in place (hooking to the smaller root, then pointer jumping)."""
    while len(left):
        a, b = root[left], root[right]
        live = a != b
        left, right, a, b = left[live], right[live], a[live], b[live]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def _settled(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of ``edges`` (u, v), found in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema)
        u, v = table.column("u"), table.column("v")
        ids = pc.unique(pa.chunked_array([*u.chunks, *v.chunks], u.type))
        ids = ids.take(pc.sort_indices(ids))
        root = np.arange(len(ids))
        fold(root, *(pc.index_in(c, ids).to_numpy().astype(np.int64) for c in (u, v)))
        for at in range(0, len(ids), 1 << 16):
            yield pa.RecordBatch.from_arrays([ids[at : at + (1 << 16)], ids.take(pa.array(root[at : at + (1 << 16)]))], names=["id", "component"])

    schema = to_arrow_schema(edges.schema)
    kind = edges.schema["u"].dataType
    return edges.coalesce(1).mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("component", kind)]))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) with the smallest id of each component as its label.

    Ids may be of any ordered type, structs too.  Rounds go on until nothing
    changes; their number grows with the logarithm of the longest path."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = checkpointed(e)
    before = None
    if isinstance(e.schema["u"].dataType, (T.IntegralType, T.StringType, T.BinaryType)) and e.count() <= FEW:
        return nodes.distinct().join(_settled(e), "id", "left").withColumn("component", F.coalesce("component", "id"))
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), "m").filter("a <> m").select(F.greatest("a", "m").alias("u"), F.least("a", "m").alias("v"))
        e = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    label = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return nodes.distinct().join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
