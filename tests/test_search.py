"""The stored index against scoring everything."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scanloom.operators import search as Q

DOCS, ASKED = "doc_id long, title string, body string", "q long, text string"


def tokens(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(docs, queries, k):
    fields = [[(d[0], tokens(d[i])) for d in docs] for i in (1, 2)]
    out = []
    for q, text in queries:
        total = Counter()
        for rows in fields:
            average = sum(len(w) for _, w in rows) / len(rows)
            df = Counter(t for _, w in rows for t in set(w))
            for t in dict.fromkeys(tokens(text)):
                for d, w in rows:
                    tf = w.count(t)
                    if tf:
                        total[d] += math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
        best = sorted(((-round(s, 9), d) for d, s in total.items()))[:k]
        out += [(q, d, i, round(-s, 6)) for i, (s, d) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, block_docs, k", [(0, 8, 10), (1, 1000, 3), (2, 1, 5)])
def test_best_documents(spark, seed, block_docs, k):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=3)), " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 5, 50])))) for i in range(200)]
    docs += [(1000 + i, "W1 w2", "w3, w3") for i in range(12)]  # ties
    queries = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 6)))) for i in range(20)] + [(50, "w1 w3"), (51, ""), (52, "unknown")]
    index = Q.build_index(spark.createDataFrame(docs, DOCS), "doc_id", ["title", "body"], block_docs=block_docs)
    got = Q.search(spark.createDataFrame(queries, ASKED), index, "q", "text", "doc_id", k, digits=9).collect()
    assert sorted((r.q, r.doc_id, r.rank, round(r.score, 6)) for r in got) == brute(docs, queries, k)


def test_few_blocks_are_unpacked_and_common_terms_are_many_rows(spark):
    rng = random.Random(3)
    docs = [(i, "t", "common " * rng.randint(1, 5) + f"own{i} " + ("rare rare " if i % 40 == 0 else "")) for i in range(4000)]
    index = Q.build_index(spark.createDataFrame(docs, DOCS), "doc_id", ["body"], block_docs=20)
    assert index.postings.filter("term = 'common'").agg(F.max("n"), F.count("*")).first()[0] < 80
    asked = Q.weighted_terms(spark.createDataFrame([(1, "rare common")], ASKED), index, "q", "text")
    bounds = Q.block_bounds(asked, index)
    got = Q.search(spark.createDataFrame([(1, "rare common")], ASKED), index, "q", "text", "doc_id").collect()
    floor = min(r.score for r in got)
    assert len(got) == 10 and all(r.doc_id % 40 == 0 for r in got)
    assert 0 < bounds.filter(F.col("upper") >= floor).count() < 0.5 * bounds.count()
    again = Q.open_index(spark, index.postings.inputFiles()[0].split("/postings/")[0])
    assert again.terms.count() == index.terms.count()


def test_hits_are_added_up_where_their_block_is(spark, tmp_path, monkeypatch):
    """Past the join of queries and postings no row of (query, document) is shuffled, also where no side fits a broadcast."""
    docs = [(i, "t", f"common w{i % 7} w{i % 11}") for i in range(300)]
    index = Q.build_index(spark.createDataFrame(docs, DOCS), "doc_id", ["title", "body"], block_docs=10)
    asked = Q.written(Q.weighted_terms(spark.createDataFrame([(1, "common w3"), (2, "w5 w6 t")], ASKED), index, "q", "text"), "asked")
    chosen = Q.block_bounds(asked, index).withColumn("floor", F.lit(0.0))
    monkeypatch.setattr(Q, "scratch_path", lambda spark, name: str(tmp_path / name))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.requireAllClusterKeysForCoPartition")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        more = Q.score_blocks(asked, chosen, index)
        got = Q.written(more, "more", by_part_of_key=True)
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == kept["spark.sql.requireAllClusterKeysForCoPartition"]
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        plan = Q.score_blocks(asked, chosen, index)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert "Exchange" not in plan.split("Generate")[0] and "SortMergeJoin" in plan
    assert got.count() == 600  # every document holds common and t
