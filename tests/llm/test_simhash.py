"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from scanloom.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute_fp(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    distinct = list(set(fps))
    up = {f: f for f in distinct}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= 3:
                up[top(a)] = top(b)
    return {f: top(f) for f in distinct}


def expected(rows):
    fps = [brute_fp(r[1]) for r in rows]
    root = brute_components(fps)
    low = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            low[root[f]] = min(low.get(root[f], r[0]), r[0])
    return [(r[0], f"{f:016x}", low.get(root[f])) for r, f in zip(rows, fps)]


def sample_rows(seed=3, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdÉ") for _ in range(rng.randint(1, 6)))
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 and rows:
            words = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 2)):
                if words:
                    words[rng.randrange(len(words))] = word()
            text = "\t".join(words)
        else:
            text = " ".join(word() for _ in range(rng.randint(0, 200)))
        rows.append((i, text, "clash"))
    rows += [(n, None, "x"), (n + 1, "", "x"), (n + 2, " \n\v", "x"), (n + 3, "a b", "x"), rows[5], rows[5], (None, rows[6][1], "x"), (None, "alone in the world", "x"), (n + 4, "w " * 50000, "x")]
    return rows


def test_against_brute_force(spark):
    rows = sample_rows()
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(rows)))


def test_representatives(spark):
    rows = sample_rows(8, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    want = expected(rows)
    stay = {i for i, _, c in want if i is not None and i == c}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(stay)
    assert got.count(None) == len({f for i, f, c in want if c is None})


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert simhash.representatives(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("direct", [1 << 16, 4])
def test_links_find_every_distance(spark, monkeypatch, direct):
    """Chains, stars and clusters; also with every key counted as crowded."""
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = random.Random(1)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(15):
            fps.add(at)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                at ^= 1 << b
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    up = dict(zip(signed, signed))

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for e in edges:
        assert bin((e.u ^ e.v) & ((1 << 64) - 1)).count("1") <= 3 * len(fps)
        up[top(e.u)] = top(e.v)
    want = brute_components(fps)
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            assert (want[a] == want[b]) == (top(signed[i]) == top(signed[j]))


def test_a_dense_cluster_gives_a_forest(spark):
    base, n = 0x0123456789ABCDEF, 64
    fps = [base ^ (1 << b) for b in range(n)]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    per_key = simhash.SEGMENTS * simhash.WIDTH
    assert edges.count() < per_key * n  # at most members - 1 links in each key
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), bits=4)
