"""Domain tables derived from the driver tables, in Spark and in SQL.

Each derivation is a plain projection of whole tables: nothing is sampled or
dropped, so every query grows with its input.  Embedding vectors (64 values)
supply points, image rows, descriptors, depth maps and voxels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions.numeric import micros
from scanloom.plans.registry import Tables

WIDTH = 64  # values per vector = pixels per image row
ROWS = 16  # image rows per frame


def e(i: int):
    """Vector component ``i`` (from zero) in double precision."""
    return F.col("embedding")[i].cast("double")


def points(t: Tables) -> DataFrame:
    """Point cloud: one cloud per label."""
    return t.embeddings.select(
        F.col("label").alias("cloud_id"),
        F.col("vec_id").alias("point_id"),
        e(0).alias("x"), e(1).alias("y"), e(2).alias("z"),
        F.floor((e(3) + 1) * 127.5).cast("int").alias("r"),
        F.floor((e(4) + 1) * 127.5).cast("int").alias("g"),
        F.floor((e(5) + 1) * 127.5).cast("int").alias("b"),
        F.least(F.lit(1.0), F.abs(e(6)) * 4).alias("confidence"),
    )


PTS = """pts AS (SELECT label AS cloud_id, vec_id AS point_id,
  embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
  floor((embedding[4]::DOUBLE + 1) * 127.5)::INT AS r,
  floor((embedding[5]::DOUBLE + 1) * 127.5)::INT AS g,
  floor((embedding[6]::DOUBLE + 1) * 127.5)::INT AS b,
  least(1.0::DOUBLE, abs(embedding[7]::DOUBLE) * 4) AS confidence FROM embeddings)"""


def image_rows(t: Tables) -> DataFrame:
    """Image rows: frame of 16 rows, 64 grey levels 0..255 each."""
    return t.embeddings.select(
        F.floor(F.col("vec_id") / ROWS).cast("long").alias("frame_id"),
        (F.col("vec_id") % ROWS).cast("int").alias("y"),
        F.transform(
            "embedding",
            lambda v: F.least(F.greatest(F.floor((v.cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("int"),
        ).alias("px"),
    )


IMG = """img AS (SELECT (vec_id // 16)::BIGINT AS frame_id, (vec_id % 16)::INT AS y,
  generate_subscripts(embedding, 1)::INT - 1 AS x,
  least(greatest(floor((unnest(embedding)::DOUBLE + 0.5) * 255), 0), 255)::INT AS v FROM embeddings)"""


def grey(t: Tables) -> DataFrame:
    """Grey pixel table (frame_id, y, x, v)."""
    return image_rows(t).select("frame_id", "y", F.posexplode("px").alias("x", "v"))


def rgb(t: Tables) -> DataFrame:
    """Colour pixel table: channels are the row shifted by 0, 21 and 42 places,
    mask is set where the grey level reaches 112."""
    rows = image_rows(t)
    zipped = F.transform(
        F.sequence(F.lit(0), F.lit(WIDTH - 1)),
        lambda i: F.struct(
            F.get("px", i).alias("r"),
            F.get("px", (i + 21) % WIDTH).alias("g"),
            F.get("px", (i + 42) % WIDTH).alias("b"),
        ),
    )
    return (
        rows.select("frame_id", "y", F.posexplode(zipped).alias("x", "c"))
        .select("frame_id", "y", "x", "c.r", "c.g", "c.b", (F.col("c.r") >= 112).cast("int").alias("mask"))
    )


RGB = IMG + """, rgb AS (SELECT a.frame_id, a.y, a.x, a.v AS r, b.v AS g, c.v AS b, (a.v >= 112)::INT AS mask
  FROM img a JOIN img b ON a.frame_id=b.frame_id AND a.y=b.y AND b.x=(a.x+21)%64
  JOIN img c ON a.frame_id=c.frame_id AND a.y=c.y AND c.x=(a.x+42)%64)"""


def user_events(t: Tables) -> DataFrame:
    """Events with microseconds and the value inside ``props``."""
    return t.events.select(
        "event_id", "user_id", "ts", micros("ts").alias("us"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


EVT = """evt AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us, event_type, value,
  (props::JSON->>'$.k')::INT AS k FROM events)"""
