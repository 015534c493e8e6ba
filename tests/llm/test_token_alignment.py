"""The lockstep merge and the corpus counts of pairs against a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scanloom.llm import token_alignment as ta
from scanloom.llm.queries import LLM_QUERIES
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, n_a string, pair int"
TEXTS = ["", " ", "a", "the quick brown fox", "Ünïcödé ß 日本語 🙂", "<|endoftext|> <s> </s> <unk> <0x0A>", "▁marker in the text", "\x00nul", "tab\tline\nfeed\r\n", "  two  spaces ", "é" * 300, "x" * 20000, "12,345.67%%% $$$", "the the the the"]


class Plain:
    def __init__(self):
        a, b = ta.load()
        self.a, self.b = Tokenizer.from_str(a), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        self.a_tokens, self.b_tokens = ta.byte_level_vocabulary(a), ta.piece_vocabulary(b)

    def align(self, text):
        """(A ids, B ids, links as places, groups), all empty where the bytes differ."""
        if not text:
            return [], [], [], []
        a, b, want = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), b" " + text.encode()
        spans = []
        for ids, tokens in ((a, self.a_tokens), (b, self.b_tokens)):
            parts = [tokens.joined(np.array([i])) for i in ids]
            if b"".join(parts) != want:
                return [], [], [], []
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends)))
        links, j = [], 0
        for i, (start, end) in enumerate(spans[0]):
            while spans[1][j][1] <= start:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < end:
                links.append((i, k))
                k += 1
        groups, at = [], [0, 0]
        for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            sides = []
            for side, ids in enumerate((a, b)):
                begin = at[side]
                while at[side] < len(ids) and spans[side][at[side]][1] <= cut:
                    at[side] += 1
                sides.append(",".join(map(str, ids[begin : at[side]])))
            groups.append("|".join(sides))
        return a, b, links, groups

    def statistics(self, rows):
        found, count, best = [(d, *self.align(t)) for d, t in rows], Counter(), {}
        for _, a, b, links, _ in found:
            count.update((a[i], b[j]) for i, j in links)
        for (_, y), n in count.items():
            best[y] = max(best.get(y, 0), n)
        for d, a, b, links, groups in found:
            pairs = [(a[i], b[j]) for i, j in links]
            yield (d, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.mark.parametrize("lane", [1, 2, 7, 512])
def test_merge_of_random_cuts(lane):
    rng = random.Random(lane)
    a_end, b_end, a_first, links, cuts, at, start = [], [], [0], set(), set(), 0, [0, 0]
    for _ in range(60):
        size = rng.randint(0, 25)
        sides = [sorted({*(rng.randint(1, size) for _ in range(rng.randint(0, 12))), size}) if size else [] for _ in range(2)]
        for i, e in enumerate(sides[0]):
            for j, f in enumerate(sides[1]):
                if max(0 if not i else sides[0][i - 1], 0 if not j else sides[1][j - 1]) < min(e, f):
                    links.add((start[0] + i, start[1] + j))
                if e == f:
                    cuts.add((start[0] + i, start[1] + j))
        a_end += [at + e for e in sides[0]]
        b_end += [at + e for e in sides[1]]
        start, at = [len(a_end), len(b_end)], at + size
        a_first.append(len(a_end))
    link_a, link_b, cut_a, cut_b = ta.merge(np.array(a_end), np.array(b_end), np.array(a_first), lane)
    assert sorted(zip(link_a.tolist(), link_b.tolist())) == sorted(links)
    assert sorted(zip(cut_a.tolist(), cut_b.tolist())) == sorted(cuts)


def test_links_and_cuts(spark, plain):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, None, None, None), (3, "a", "y", 2), (3, "a", "y", 2)]
    got = ta.align(spark.createDataFrame(rows, SCHEMA), ta.load(), ["doc_id", "n_a"]).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for (_, text, *_), r in zip(rows, got):
        a, b, links, groups = plain.align(text)
        assert (r.a_ids, r.b_ids, [tuple(x) for x in r.links], len(r.cuts)) == (a, b, links, len(groups)), text
        assert not a or (r.cuts[-1].a, r.cuts[-1].b) == (len(a) - 1, len(b) - 1)
    assert ta.align(spark.createDataFrame([], SCHEMA), ta.load()).collect() == []


@pytest.mark.parametrize("block_bytes, shard_bytes", [(1 << 23, 1 << 26), (2000, 3000)])
def test_statistics(spark, plain, block_bytes, shard_bytes):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] * 2 + [(None, None, None, None), (None, "a", None, None), (3, "a", "y", 2), (3, "a", "y", 2)]
    got = ta.link_statistics(spark.createDataFrame(rows, SCHEMA).repartition(3), ta.load(), block_bytes, shard_bytes).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain.statistics([r[:2] for r in rows])))


def test_texts_without_tokens(spark):
    assert ta.link_statistics(spark.createDataFrame([], SCHEMA), ta.load()).collect() == []
    got = ta.link_statistics(spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string"), ta.load()).collect()
    assert sorted(map(tuple, got)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_query(spark, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = LLM_QUERIES["op11_token_alignment"](spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(plain.statistics(docs))
