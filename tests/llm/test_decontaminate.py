"""Benchmark windows against a plain search."""

import random
import re

import numpy as np

from scanloom.llm import decontaminate

DOCS, BENCH = "doc_id long, text string, item_id string, n_words int", "item_id long, text string, doc_id int"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, bench):
    out = []
    for doc, text, *_ in docs:
        words, hit, items = words_of(text), set(), set()
        for item, other, *_ in bench:
            its = words_of(other)
            for w in range(max(1, len(its) - 9)) if its and item is not None else ():
                part = its[w : w + 10]
                for i in range(len(words) - len(part) + 1):
                    if words[i : i + len(part)] == part:
                        hit.update(range(i, i + len(part)))
                        items.add(item)
        spans, cut = [], sorted(hit)
        for i in cut:
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out.append((doc, len(words), [tuple(s) for s in spans], sorted(items, key=str)))
    return sorted(out, key=repr)


def tables(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "OF", "and", "élan", "9", "z" * 5, "qq", "ab"])
    passage = lambda n: rng.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    bench = [(i, passage(rng.choice([1, 3, 9, 10, 11, 25])), 1) for i in range(2, 30)] + [(30, None, 1), (31, "", 1), (32, "...", 1), (None, "the of", 1)]
    bench += [bench[3], (33, bench[5][1], 1)]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(["unseen", word()]) for _ in range(rng.randint(0, 80)))
        if i % 3:
            text += " " + (rng.choice(bench)[1] or "").upper() + " " + text
        docs.append((i, text, "clash", 1))
    docs += [(100, None, "x", 1), (101, "", "x", 1), (None, docs[4][1], "x", 1), docs[5], docs[5], (102, "the of " * 30000 + (bench[8][1] or ""), "x", 1)]
    return docs, bench


def rows(df):
    return sorted(((r.doc_id, r._n_words, [(s.start, s.stop) for s in r._spans], list(r._items)) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    docs, bench = tables()
    d, b = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(bench, BENCH)
    want = brute(docs, bench)
    assert rows(decontaminate.find_contamination(d, b)) == want
    assert rows(decontaminate.find_contamination(d, b, block_bytes=300)) == want  # several benchmark blocks


def test_cut_text(spark):
    docs = [(1, "Keep. One two, THREE four five six seven eight nine ten! Keep é", "x", 1), (2, "all clean", "x", 1), (3, None, "x", 1)]
    bench = [(7, "one two three four five six seven eight nine ten", 1)]
    got = decontaminate.find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH), ["doc_id"], cut=True)
    assert {r.doc_id: r._clean for r in got.collect()} == {1: "Keep. ! Keep é", 2: "all clean", 3: None}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b", "x", 1)], DOCS), spark.createDataFrame([], BENCH)
    assert rows(decontaminate.find_contamination(docs, bench)) == [(1, 2, [], [])]
    assert rows(decontaminate.find_contamination(docs.limit(0), bench)) == []


def test_index_counts_and_places():
    rng = np.random.default_rng(0)
    for sigma in (1, 2, 5, 40):
        text = rng.integers(1, sigma + 1, 400)
        index = decontaminate.FMIndex(text)
        assert np.array_equal(index.access(np.arange(index.size)), np.append(text, 0)[index._suffixes(np.append(text, 0)) - 1])
        for n in (1, 2, 5):
            phrases = np.array([text[i : i + n] for i in range(0, 300, 7)] + [[99] * n])
            low, high = index.find(phrases)
            for p, a, b in zip(phrases, low, high):
                want = [i for i in range(len(text) - n + 1) if np.array_equal(text[i : i + n], p)]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want
