"""Operational relations: jobs, shares and login failures, with their columns and keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.operators.predicates import failed_rules


@dataclass(frozen=True)
class Relation:
    """Columns as DDL, the primary key, and other columns whose values are unique where they are not null."""

    ddl: str
    key: str
    unique: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


# Names, types, required columns and keys of the relations.
RELATIONS = {
    "jobs": Relation(
        "id string NOT NULL, request_id string, kind string NOT NULL, name string NOT NULL, payload string NOT NULL, status string NOT NULL, progress double NOT NULL, "
        "created_at string NOT NULL, started_at string, finished_at string, attempt_count int NOT NULL, max_attempts int NOT NULL, last_error string, updated_at string NOT NULL", "id", ("request_id",)),
    "share_links": Relation(
        "token_hash string NOT NULL, project_id string NOT NULL, asset_path string NOT NULL, created_at long NOT NULL, expires_at long NOT NULL, max_uses int, uses int NOT NULL, "
        "allow_download boolean NOT NULL, allow_embed boolean NOT NULL, revoked boolean NOT NULL, last_access long", "token_hash"),
    "share_public": Relation(
        "token_hash string NOT NULL, public_token string NOT NULL, short_code string NOT NULL, title string, description string, tags_json string, cover_path string, "
        "created_at long NOT NULL, updated_at long NOT NULL, is_public boolean NOT NULL", "token_hash", ("short_code",)),
    "share_access": Relation(
        "id long NOT NULL, token_hash string NOT NULL, event string NOT NULL, accessed_at long NOT NULL, ip string, user_agent string, referrer string, embed boolean NOT NULL, download boolean NOT NULL", "id"),
    "login_failures": Relation("identity_hash string NOT NULL, failed_attempts int NOT NULL, window_started long NOT NULL, locked_until long NOT NULL, updated_at long NOT NULL", "identity_hash"),
}


def conform(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a relation.

    Columns are cast, optional ones that are missing are null, others are left
    out.  A row is rejected with every reason: ``<column>_missing`` for a required
    value that is null or cannot be cast, ``<column>_taken`` for a key or unique
    value that a row before it has (rows are taken in the order of their values).
    """
    relation = RELATIONS[name]
    lacking = [f.name for f in relation.schema if not f.nullable and f.name not in rows.columns]
    if lacking:
        raise ValueError(f"{name} lacks {', '.join(lacking)}")
    cast = [(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in relation.schema]
    rules = {f"{f.name}_missing": F.col(f.name).isNotNull() for f in relation.schema if not f.nullable}
    d = rows.select(*cast).withColumn("reasons", failed_rules(rules))
    good, bad = d.filter(F.size("reasons") == 0), d.filter(F.size("reasons") > 0)
    everything = F.struct(*[f.name for f in relation.schema])
    for column in (relation.key, *relation.unique):
        nth = F.row_number().over(Window.partitionBy(column).orderBy(everything))  # a key has few rows
        marked = good.withColumn("_nth", F.when(F.col(column).isNotNull(), nth).otherwise(1))
        bad = bad.unionByName(marked.filter("_nth > 1").withColumn("reasons", F.array(F.lit(f"{column}_taken"))).drop("_nth"))
        good = marked.filter("_nth = 1").drop("_nth")
    return good.drop("reasons"), bad


def save(rows: DataFrame, name: str, folder: str) -> DataFrame:
    """Write the rows that conform below ``folder``; the rejects are returned."""
    good, bad = conform(rows, name)
    good.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
    return bad


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A relation with its own schema; columns that its files do not have yet are null."""
    return spark.read.schema(RELATIONS[name].schema).parquet(f"{folder.rstrip('/')}/{name}")


def active_links(links: DataFrame, now: Column) -> DataFrame:
    """Links that are not revoked, not expired and not used up."""
    return links.filter(~F.col("revoked") & (F.col("expires_at") > now) & (F.col("max_uses").isNull() | (F.col("uses") < F.col("max_uses"))))
