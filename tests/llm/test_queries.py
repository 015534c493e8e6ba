"""The registered queries on the smallest tables: SQL where there is some, else rows and their columns."""

import pytest

from scanloom.llm.queries import LLM_QUERIES, LLM_SQL
from tests.conftest import DATA
from tests.llm.test_license_scan import brute as brute_license
from tests.llm.test_simhash import brute_components, brute_fp
from tests.llm.test_suffix_dedup import brute as brute_passages
from tools.check import compare


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_against_sql(spark, duck, name):
    ok, message, n = compare(LLM_QUERIES[name](spark, DATA), duck, LLM_SQL[name])
    assert ok and n, message


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))


def test_op1(spark, documents):
    got = LLM_QUERIES["op1_license_scan"](spark, DATA).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(str((i, *brute_license(t))) for i, t in documents)


def test_op6(spark, documents):
    got = LLM_QUERIES["op6_suffix_array_dedup"](spark, DATA).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *b)) for r, b in zip(documents, brute_passages(documents)))


def test_op10(spark, documents):
    got = LLM_QUERIES["op10_simhash_near_dedup"](spark, DATA).collect()
    fps = {i: brute_fp(t) for i, t in documents}
    root = brute_components(list(fps.values()))
    low = {}
    for i, f in fps.items():
        low[root[f]] = min(low.get(root[f], i), i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", low[root[f]]) for i, f in fps.items()}


@pytest.mark.parametrize("name, columns", [
    ("op2_language_id", {"doc_id", "held_out", "lang_pred", "score"}),
    ("op5_quality_cnn", {"doc_id", "held_out", "score", "predicted"}),
    ("op7_sentencepiece_codec", {"doc_id", "n_tokens", "ids_sha256", "round_trip", "parity"}),
    ("op9_pitman_yor", {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}),
])
def test_rows(spark, documents, name, columns):
    df = LLM_QUERIES[name](spark, DATA)
    assert columns <= set(df.columns)
    assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(i for i, _ in documents)
