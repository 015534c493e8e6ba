"""The language model: exact base scores, a proper distribution, seating."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import pitman_yor
from scanloom.llm.common import held_out
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, held_out boolean, score string"


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + ["\n"]


def sample_rows():
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice("abcdeÉß") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), i % 4 == 2, "x") for i in range(80)]
    return rows + [(100, None, False, "x"), (101, "", True, "x"), (None, "a b", None, "x"), rows[3], (102, "a " * 60000, False, "x")]


@pytest.mark.parametrize("block_bytes", [1500, 1 << 24])
def test_base_scores(spark, block_bytes):
    rows = sample_rows()
    got = pitman_yor.score_texts(spark.createDataFrame(rows, SCHEMA).repartition(3), "held_out", block_bytes=block_bytes).collect()
    counts = Counter(t for r in rows if not r[2] for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), bool(r[2]), len(tokens(r[1])), sum(t in counts for t in tokens(r[1])), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(r[1])), 5)) for r in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and r.perplexity >= 1 for r in got)


def test_held_out_text_is_likelier_than_under_the_base(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("held", held_out("doc_id", 7, 2))
    r = pitman_yor.score_texts(docs, "held").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert r[2] > 10 and r[0] > r[1]


def test_corner_tables(spark):
    assert pitman_yor.score_texts(spark.createDataFrame([], SCHEMA), "held_out").collect() == []
    alone = pitman_yor.score_texts(spark.createDataFrame([(1, "a b", True, "x")], SCHEMA), "held_out").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in alone] == [(3, 0, 0, 0.0, 0.0)]


def gathered_of(texts):
    import pyarrow as pa

    hashes, token, context, _ = pitman_yor._tokens(pa.table({"_text": texts}))
    key, n = np.unique(context * len(hashes) + token, return_counts=True)
    contexts, size = np.unique(key // len(hashes), return_counts=True)
    words, place = np.unique(key % len(hashes), return_inverse=True)
    return pitman_yor.Gathered([({"hash": hashes[contexts], "pairs": size}, {"hash": hashes[words]}, {"word": place.ravel(), "count": n})])


def test_probabilities_sum_to_one():
    rng, draw = random.Random(3), np.random.default_rng(0)
    g = gathered_of([" ".join(rng.choice("abcdefgh") * rng.choice([1, 1, 2, 9]) for _ in range(200)) for _ in range(10)])
    r, n = g.restaurants(), len(g.words)
    assert r.customers.sum() == 2010
    types = np.bincount(r.word, minlength=n)
    parent = pitman_yor.Parent(types)
    for _ in range(4):
        p = pitman_yor.parent_probability(parent.customers, parent.tables, parent.customers.sum(), parent.tables.sum(), n, 10.0, 0.7)
        unknown = pitman_yor.parent_probability(np.zeros(1), np.zeros(1), parent.customers.sum(), parent.tables.sum(), n, 10.0, 0.7)[0]
        assert p.sum() + unknown == pytest.approx(1)
        r.sweep(p, 10.0, 0.6, draw)
        assert (r.tables >= 1).all() and (r.tables <= r.count).all()
        # every word behind every context, trained or not
        every = pitman_yor.Restaurants(np.repeat(np.arange(r.n_contexts), n), np.tile(np.arange(n), r.n_contexts), np.zeros(r.n_contexts * n, np.int64))
        every.count[r.context * n + r.word], every.tables[r.context * n + r.word], every.customers = r.count, r.tables, r.customers
        known = every.probabilities(p, 10.0, 0.6).reshape(-1, n).sum(1)
        new = (10.0 + 0.6 * r.tables_of()) * unknown / (10.0 + r.customers)
        assert known + new == pytest.approx(np.ones(r.n_contexts))
        empty = pitman_yor.Restaurants(np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64))
        assert empty.probabilities(p, 10.0, 0.6) == pytest.approx(p)  # a context without customers
        parent = pitman_yor.Parent(r.served(n))
        for _ in range(3):
            parent.sweep(0.0, n, 10.0, 0.7, draw)
            assert (parent.tables >= 1).all() and (parent.tables <= parent.customers).all()


def test_every_preceding_word_has_a_restaurant():
    """The same word is likely behind one word and unlikely behind another."""
    texts = ["x a"] * 50 + ["y b"] * 50 + ["x y"]
    g = gathered_of(texts)
    r = g.restaurants()
    p = np.full(len(g.words), 0.1)
    r.sweep(p, 1.0, 0.5, np.random.default_rng(0))
    likely = dict(zip(zip(r.context.tolist(), r.word.tolist()), r.probabilities(p, 1.0, 0.5).tolist()))
    names = {int(np.searchsorted(g.words, np.uint64(pitman_yor.xxhash.xxh3_64_intdigest(w)))): w for w in (b"a", b"b", b"x", b"y")}
    found = {}
    for (c, w), q in likely.items():
        found.setdefault(c, {})[names.get(w)] = q
    assert any(set(d) == {b"a"} and d[b"a"] > 0.85 for d in found.values()) or any(d.get(b"a", 0) > 0.85 and d.get(b"y", 1) < 0.1 for d in found.values())
    assert any(d.get(b"b", 0) > 0.9 for d in found.values()) and any(d.get(b"x", 0) > 0.4 and b"a" not in d for d in found.values())


def test_sampler_agrees_with_customer_by_customer_gibbs():
    """Mean tables of a tiny corpus under the sweeps and under a plain sampler that takes one customer at a time."""
    counts = {("u", "a"): 12, ("u", "b"): 3, ("v", "a"): 5, ("v", "c"): 7}
    words, strength, discount = ["a", "b", "c"], 2.0, 0.5
    p = {"a": 0.5, "b": 0.3, "c": 0.2}
    rng = random.Random(1)
    tables = {k: [n] for k, n in counts.items()}
    seen = {k: 0.0 for k in counts}
    for turn in range(6000):
        for (c, w), n in counts.items():
            sizes = tables[c, w]
            i = rng.choices(range(len(sizes)), sizes)[0]  # a customer leaves
            sizes[i] -= 1
            if not sizes[i]:
                sizes.pop(i)
            total = sum(len(t) for (d, _), t in tables.items() if d == c)
            weights = [s - discount for s in sizes] + [(strength + discount * total) * p[w]]
            j = rng.choices(range(len(weights)), weights)[0]
            if j == len(sizes):
                sizes.append(1)
            else:
                sizes[j] += 1
        if turn >= 500:
            for k, t in tables.items():
                seen[k] += len(t) / 5500
    keys = list(counts)
    r = pitman_yor.Restaurants(np.array([0, 0, 1, 1]), np.array([words.index(w) for _, w in keys]), np.array([counts[k] for k in keys]))
    draw, mean = np.random.default_rng(2), np.zeros(4)
    for turn in range(4000):
        r.sweep(np.array([p[w] for w in words]), strength, discount, draw)
        if turn >= 200:
            mean += r.tables / 3800
    assert np.abs(mean - [seen[k] for k in keys]).max() < 0.25


def test_seats_follow_the_restaurant_process():
    rng, n = np.random.default_rng(0), 4000
    size, weight, step, discount = 30, 2.0, 0.3, 0.4
    tables, log_weight = pitman_yor.seat(np.full(n, size), np.full(n, weight), np.full(n, step), discount, rng)
    plain = []
    for _ in range(n):
        t = 1
        for j in range(1, size):
            t += rng.random() < (weight + step * t) / (weight + step * t + j - discount * t)
        plain.append(t)
    assert abs(tables.mean() - np.mean(plain)) < 0.2 and abs(tables.std() - np.std(plain)) < 0.2
    one, lw = pitman_yor.seat(np.array([2]), np.array([weight]), np.array([step]), discount, rng)
    assert lw[0] == pytest.approx(math.log(weight + step + 1 - discount))
    big, _ = pitman_yor.seat(np.array([10**6]), np.array([5000.0]), np.array([0.01]), discount, rng)
    assert 20000 < big[0] < 35000
    assert np.allclose(pitman_yor.log_gamma(np.array([0.3, 1, 7.7, 1e6])), [math.lgamma(x) for x in (0.3, 1, 7.7, 1e6)], rtol=1e-9, atol=1e-9)
