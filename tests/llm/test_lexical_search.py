"""Block-Max MaxScore against scoring every document of every item."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scanloom.llm import lexical_search as ls
from scanloom.llm.common import alnum_words

SCHEMA = "doc_id long, text string, score int, term string"


def brute(docs, items, k=10):
    words = [(d, Counter(alnum_words(t))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, w in words if w), sum(sum(w.values()) for _, w in words)
    df = Counter(t for _, w in words for t in w)
    asked = defaultdict(Counter)
    for item, text in items:
        if item is not None:
            asked[item].update(alnum_words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, w in words:
            if w:
                m = 25 + 75 * sum(w.values()) * n_docs // n_terms
                score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w[t] // (1000 * w[t] + 8 * m)) for t, c in terms.items() if t in w)
                if score > 0:
                    scored.append((-score, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


def found(spark, docs, items, shard_bytes=ls.SHARD_BYTES, parts=3, **settings):
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA).repartition(parts)
    asked = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, rank int")
    got = ls.search(ls.build_index(frame, shard_bytes), asked, **settings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(str(tuple(r)) for r in got.collect())


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本", "Ab"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(rng.randint(0, n // 2), " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 30, 200])))) for _ in range(n)]
    docs += [(None, None), (7, None), (8, ""), (None, "w1 w2"), (9, "W3,w3;W3"), (10, "w50 " * 5000)] + [(20 + i, "w1 w40 w41") for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12])))) for i in range(25)] + [(100, None), (101, ""), (102, "never seen"), (None, "w1"), (3, "w40 w40"), (103, "w41 w41 W41")]
    return docs, items


@pytest.mark.parametrize("seed, shard_bytes, settings", [(0, 1 << 24, {}), (1, 3000, {}), (2, 20000, {"k": 3, "query_bytes": 100})])
def test_against_all_scores(spark, seed, shard_bytes, settings):
    docs, items = corpus(700, seed)
    assert found(spark, docs, items, shard_bytes, **settings) == brute(docs, items, settings.get("k", 10))


def test_empty_tables(spark):
    docs, items = [(1, "a b")], [(1, "a")]
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []
    assert found(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("first, last", [(128, 512), (512, 8192)])
def test_blocks_are_skipped(monkeypatch, first, last):
    """A rare term decides the ten best; of the list of a common one few blocks are unpacked."""
    monkeypatch.setattr(ls, "FIRST_WINDOW", first)
    monkeypatch.setattr(ls, "LAST_WINDOW", last)
    rng = random.Random(3)
    texts = ["common " * rng.randint(1, 3) + "filler " * rng.randint(1, 40) + ("rare " if i % 97 == 5 else "") for i in range(20000)]
    rows = ls._shard(0, list(range(len(texts))), texts).to_pylist()
    n = np.array([len(t.split()) for t in texts])
    damp = lambda x: 25 + 75 * x * len(texts) // int(n.sum())
    lists = {r["term"]: ls.Postings(r, r["df"], damp) for r in rows if r["term"]}
    heaps = ls.Heaps(1, 10)
    ls.search_shard(lists, np.arange(len(texts)), n, damp, [[("common", 3), ("rare", 7000)]], heaps)
    scored = sorted(((sum(w * int(ls.impact(np.int64(t.split().count(x)), np.int64(damp(n[i])))) for x, w in (("common", 3), ("rare", 7000)) if x in t), i) for i, t in enumerate(texts)), key=lambda s: (-s[0], s[1]))[:10]
    assert list(zip(heaps.score[0].tolist(), heaps.doc[0].tolist())) == scored
    assert 0 < lists["common"].unpacked < 0.5 * len(lists["common"].last)


def test_lists_are_unpacked_as_they_were(spark):
    rng = random.Random(1)
    texts = ["t " * rng.choice([1, 2, 300, 70000 if i == 50 else 4]) if rng.random() < 0.4 else "" for i in range(3000)]
    (row,) = [r for r in ls._shard(0, list(range(3000)), texts).to_pylist() if r["term"] == "t"]
    part = ls.Postings(row, row["df"], lambda n: n + 1)
    at, tf = part.unpack(np.arange(len(part.last)))
    want = [(i, t.count("t")) for i, t in enumerate(texts) if t]
    assert list(zip(at.tolist(), tf.tolist())) == want
    some = np.array([1, 3])
    assert part.unpack(some)[0].tolist() == [i for i, _ in want[128:256] + want[384:512]]
    assert part.best.tolist() == [max(int(ls.impact(np.int64(f), np.int64(f + 1))) for _, f in want[b : b + 128]) for b in range(0, len(want), 128)]
