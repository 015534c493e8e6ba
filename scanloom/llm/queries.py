"""One query per text operator, over whole tables, with the SQL to compare where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import bpe_automaton, chat_rotation, decontaminate, exact_topk, language_id, lexical_search, license_scan, pitman_yor, quality_cnn, sentencepiece_codec, simhash, suffix_dedup, token_alignment
from scanloom.llm.common import held_out

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def wrap(fn):
        LLM_QUERIES[fn.__name__] = fn
        if sql:
            LLM_SQL[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register()
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@register()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    model = language_id.train(docs, ~F.col("held_out"))
    return language_id.predict(docs, model, ["doc_id", "held_out"])


@register(r"""
WITH t AS (SELECT conv_id, turn, replace(coalesce(text, ''), '<|', '< |') AS txt, coalesce(nullif(trim(role), ''), 'unknown') AS who FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, who, txt) - 1 AS pos FROM t),
people AS (SELECT DISTINCT conv_id, who AS speaker FROM p WHERE who NOT IN ('system', 'unknown')),
v AS (SELECT p.conv_id, speaker, pos // 64 AS part, pos, txt, who = speaker AS mine,
             CASE WHEN who = speaker THEN '<|im_start|>assistant' || chr(10) WHEN who = 'system' THEN '<|im_start|>system' || chr(10)
                  ELSE '<|im_start|>user name=' || replace(who, '<|', '< |') || chr(10) END AS head
      FROM p JOIN people ON p.conv_id IS NOT DISTINCT FROM people.conv_id),
m AS (SELECT *, sum(length(head) + length(txt) + 11) OVER (PARTITION BY conv_id, speaker, part ORDER BY pos) AS stop FROM v)
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || txt || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered,
       coalesce(string_agg(CASE WHEN mine THEN CAST(CAST(stop - 11 - length(txt) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY pos), '') AS mask
FROM m GROUP BY conv_id, speaker, part
""")
def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


@register("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = exact_topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return exact_topk.top_k(vectors, vectors.filter("id % 50 = 0"))


@register()
def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality_cnn.train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    return quality_cnn.score(docs.withColumn("held_out", held_out("doc_id", 3, 1)), net, ["doc_id", "held_out"])


@register()
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@register()
def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), sentencepiece_codec.load(), with_ids=False)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register(rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS p
        FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS i)),
lengths AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
           FROM d, lengths, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, win.n, item_id FROM places JOIN win USING (n, p)),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
              FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""")
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.col("_items").cast("array<string>"), ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"))


@register()
def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 7, 2))
    return pitman_yor.score_texts(docs, "held_out")


@register()
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.link_statistics(table(spark, sf_dir, "documents"), token_alignment.load())


@register()
def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode(table(spark, sf_dir, "documents"), bpe_automaton.load(), with_ids=False)


@register(rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
whole AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, whole GROUP BY t, n_docs),
asked AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(coalesce({_WORDS}, [])) AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY item_id, t),
damped AS (SELECT r, doc_id, 25 + (75 * CAST(len(w) AS BIGINT) * n_docs) // n_terms AS m FROM d, whole WHERE len(w) > 0),
scored AS (SELECT item_id, r, doc_id, CAST(sum(n * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM asked JOIN weights USING (t) JOIN tf USING (t) JOIN damped USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
""")
def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
