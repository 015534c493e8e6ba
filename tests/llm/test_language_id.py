"""Language identification: held-out accuracy and corner cases."""

import numpy as np
from pyspark.sql import functions as F

from scanloom.llm import language_id
from scanloom.llm.common import held_out
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, lang_pred int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("held_out", held_out("doc_id", 4, 2))
    model = language_id.train(docs, ~F.col("held_out"))
    got = language_id.predict(docs, model, ["doc_id", "lang", "held_out"]).filter("held_out and lang is not null")
    n, right = got.count(), got.filter("lang = lang_pred").count()
    assert n > 20 and right >= 0.95 * n


def test_corner_cases(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate([
        ("the cat and the dog", "en"), ("der hund und die katze", "de"), ("the the", None), (None, "en"), ("", "de"), ("123 !!", "en"), ("é", "de"), ("日本", None), ("x" * 200000, None)])]
    rows += [rows[0], (None, "der hund", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.train(docs, F.lit(True))
    assert model.languages == ["de", "en"]
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and by_id[3].score == 0
    assert by_id[2].lang_pred == "en" and by_id[None].lang_pred == "de"


def test_prediction_does_not_depend_on_neighbours(spark):
    rows = [(i, f"{'the' if i % 2 else 'der'} word {i} é", "en" if i % 2 else "de", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.train(docs, F.lit(True))
    one = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs.repartition(7), model).collect()}
    assert one == {i: (names[0], float(p[0])) for i, t, _, _ in rows for names, p in [language_id.score_texts(model, [t])]}


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None, 0)], SCHEMA)
    model = language_id.train(docs, F.lit(True))
    assert [tuple(r) for r in language_id.predict(docs, model).collect()] == [(1, "und", 0.0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.predict(empty, language_id.train(empty, F.lit(True))).collect() == []


def test_counts_and_posteriors_in_plain_python(spark):
    """Hash, counts, smoothing and posterior of every text, one n-gram at a time; equal posteriors go to the first name."""
    mask, buckets, smoothing = 0xFFFFFFFF, 1 << 14, 0.5
    odd = [int(m) for m in language_id._MULTIPLIERS]

    def grams(text):
        chars = [c if c >= 128 else c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in map(ord, text or "")]
        for n in (1, 2, 3):
            for i in range(len(chars) - n + 1):
                h = n * 40503
                for k in range(n):
                    h = ((h ^ chars[i + k]) * odd[k % len(odd)]) & mask
                    h ^= h >> 15
                yield ((h * odd[0]) & mask) >> (32 - 14)

    rows = [(0, "The cat, the dog!", "en", 0), (1, "der Hund und DIE Katze", "de", 0), (2, "the end of it", "en", 0), (3, "el gato y él", "es", 0), (4, None, "es", 0), (5, "no language", None, 0)]
    asked = ["the katze", "él", "ñandú 日本", "a", "der the el", "x" * 300]
    model = language_id.train(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    names = ["de", "en", "es"]
    counts, docs = {n: {} for n in names}, dict.fromkeys(names, 0)
    for _, text, lang, _ in rows:
        if lang:
            docs[lang] += 1
            for b in grams(text):
                counts[lang][b] = counts[lang].get(b, 0) + 1
    got = language_id.score_texts(model, asked)
    assert model.languages == names
    for text, name, score in zip(asked, *got):
        joint = [np.log(docs[n] / 5) + sum(np.log((counts[n].get(b, 0) + smoothing) / (sum(counts[n].values()) + smoothing * buckets)) for b in grams(text)) for n in names]
        posterior = 1 / sum(np.exp(j - max(joint)) for j in joint)
        assert name == names[int(np.argmax(joint))] and abs(score - posterior) < 1e-9
    same = language_id.train(spark.createDataFrame([(0, "abc", "b", 0), (1, "abc", "a", 0)], SCHEMA), F.lit(True))
    assert language_id.score_texts(same, ["abc", "zzz"])[0] == ["a", "a"]
