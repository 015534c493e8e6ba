"""Registry of runnable queries: survey id, Spark builder, comparison SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Lazy readers over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(ids: str, sql: str | None = None, name: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under its own name."""

    def wrap(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = Query(key, tuple(ids.split()), fn, sql)
        return fn

    return wrap


def with_ctes(sql: str, *parts: str) -> str:
    """Prefix a statement with named common table expressions."""
    head = ", ".join(parts)
    body = sql.strip()
    upper = body.upper()
    if upper.startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE'):]}"
    if upper.startswith("WITH"):
        return f"WITH {head}, {body[4:]}"
    return f"WITH {head} {body}"
