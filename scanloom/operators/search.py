"""Ranked text search: a stored index of posting blocks, BM25, the best documents per query.

Documents are dealt into blocks by the hash of their id, so a common term is
many rows, none of them large.  A row holds the postings of one term in one
block and the best of them.  A query first adds up these maxima per block,
scores its most promising blocks, and then only the blocks whose maxima reach
its k-th best score so far; the postings of the others are never unpacked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators.toplists import top_per_key
from scanloom.session import scratch_path

#: Documents of a block, and blocks that are scored to find a threshold.
BLOCK_DOCS, FIRST_BLOCKS = 1024, 2


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@dataclass
class Index:
    """``postings`` (field, term, block, n, best, docs of (doc, part)), ``terms`` (field, term, df)
    and ``stats`` (field, docs, avg_len; one row per field).  ``part`` is a posting's share of the score but for the idf."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def build_index(docs: DataFrame, doc_id: str, fields: list[str], k1: float = 1.2, b: float = 0.75, block_docs: int = BLOCK_DOCS, target: str | None = None) -> Index:
    """Write the index of some text fields below ``target`` (default: a new folder) and open it."""
    spark = docs.sparkSession
    target = target or scratch_path(spark, "search-index")
    d = docs.select(F.col(doc_id).alias("doc"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("w")) for f in fields])).alias("f")).select("doc", "f.field", "f.w")
    d.groupBy("field").agg(F.count("*").alias("docs"), F.avg(F.size("w")).alias("avg_len")).coalesce(1).write.parquet(f"{target}/stats")
    stats = spark.read.parquet(f"{target}/stats")
    most = stats.agg(F.max("docs")).first()[0] or 0
    words = d.select("doc", "field", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("field", "term", "doc", "length").agg(F.count("*").alias("tf"))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_len")))
    weighed = words.join(F.broadcast(stats), "field").select("field", "term", "doc", part.alias("part"))  # one row per field
    block = F.pmod(F.xxhash64("doc"), F.lit(most // block_docs + 1))
    lists = weighed.groupBy("field", "term", block.alias("block")).agg(F.count("*").alias("n"), F.max("part").alias("best"), F.collect_list(F.struct("doc", "part")).alias("docs"))  # documents of one block
    lists.write.parquet(f"{target}/postings")
    postings = spark.read.parquet(f"{target}/postings")
    postings.groupBy("field", "term").agg(F.sum("n").alias("df")).write.parquet(f"{target}/terms")
    return open_index(spark, target)


def open_index(spark: SparkSession, target: str) -> Index:
    return Index(*[spark.read.parquet(f"{target}/{name}") for name in ("postings", "terms", "stats")])


def weighted_terms(queries: DataFrame, index: Index, query_id: str, text: str) -> DataFrame:
    """(query, field, term, idf) of the distinct terms of every query that some document holds."""
    q = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
    known = index.terms.join(F.broadcast(index.stats), "field")  # one row per field
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return q.join(known.select("field", "term", idf.alias("idf")), "term")


def block_bounds(asked: DataFrame, index: Index) -> DataFrame:
    """(query, block, upper): what a document of the block can score at most; no postings are read."""
    maxima = index.postings.select("field", "term", "block", "best")
    return asked.join(maxima, ["field", "term"]).groupBy("query", "block").agg((F.sum(F.col("idf") * F.col("best")) * (1 + 1e-12)).alias("upper"))


def score_few(wanted: DataFrame, index: Index) -> DataFrame:
    """(query, doc, score) of all documents in the ``wanted`` (query, field, term, idf, block); meant for few of them."""
    hits = wanted.join(index.postings.select("field", "term", "block", "docs"), ["field", "term", "block"]).select("query", "idf", F.explode("docs").alias("d"))
    return hits.groupBy("query", F.col("d.doc").alias("doc")).agg(F.sum(F.col("idf") * F.col("d.part")).alias("score"))


def score_blocks(asked: DataFrame, chosen: DataFrame, index: Index) -> DataFrame:
    """(query, doc, score, floor) of all documents in the ``chosen`` (query, block, floor) that hold a term.

    Queries and postings meet block by block: a document has one block, so what is unpacked is added up where it is."""
    held = index.postings.join(asked.select("field", "term").distinct(), ["field", "term"], "left_semi")
    wanted = asked.join(chosen.select("query", "block", "floor"), "query").repartition("block")
    hits = wanted.join(held.select("field", "term", "block", "docs").repartition("block"), ["field", "term", "block"])
    hits = hits.select("query", "block", "floor", "idf", F.explode("docs").alias("d"))
    return hits.groupBy("block", "query", F.col("d.doc").alias("doc")).agg(F.sum(F.col("idf") * F.col("d.part")).alias("score"), F.first("floor").alias("floor")).drop("block")


def written(df: DataFrame, name: str, by_part_of_key: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder, whose size Spark knows when it plans a join with it.

    ``by_part_of_key``: rows that a part of a join's key has brought together are not moved again."""
    spark = df.sparkSession
    path, key = scratch_path(spark, name), "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, str(not by_part_of_key).lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def search(queries: DataFrame, index: Index, query_id: str, text: str, doc_id: str, k: int = 10, digits: int | None = None) -> DataFrame:
    """(query, doc, score, rank): sum of BM25 over all fields and query terms, ``k`` best documents per query.

    With ``digits`` scores are rounded before they are ranked, so that documents with the same
    terms tie whatever the order of the additions was; ties go to the smaller id."""
    asked = written(weighted_terms(queries, index, query_id, text), "search-asked")
    bounds = written(block_bounds(asked, index), "search-bounds")
    first = written(top_per_key(bounds, ["query"], [F.desc("upper"), F.col("block")], FIRST_BLOCKS).drop("rank"), "search-first")
    begun = written(score_few(written(asked.join(first.select("query", "block"), "query"), "search-wanted"), index), "search-begun")
    best = top_per_key(begun, ["query"], [F.desc("score"), F.col("doc")], k).groupBy("query").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
    slack = 0.0 if digits is None else 10.0 ** -digits
    enough = written(best.filter(F.col("n") == k).select("query", (F.col("floor") - slack).alias("floor")), "search-floors")
    rest = bounds.join(enough, "query", "left").filter(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
    more = score_blocks(asked, rest.join(first, ["query", "block"], "left_anti"), index)
    more = more.filter(F.col("floor").isNull() | (F.col("score") * (1 + 1e-12) >= F.col("floor"))).drop("floor")  # few are left to rank
    scored = begun.unionByName(written(more, "search-more", by_part_of_key=True))
    score = F.col("score") if digits is None else F.round("score", digits)
    d = scored.select(F.col("query").alias(query_id), F.col("doc").alias(doc_id), score.alias("score"))
    return top_per_key(d, [query_id], [F.desc("score"), F.col(doc_id)], k)
