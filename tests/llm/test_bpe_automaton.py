"""The tokenization automaton against the tokenizers library and against merging by hand."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from scanloom.llm import bpe_automaton as bpe
from scanloom.llm.queries import LLM_QUERIES
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, ids int, n_tokens string"
TEXTS = ["", " ", "\n\t", "the quick brown fox", "don't we'll 's 'song ''s", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "< |endoftext|>", "İstanbul Ⱥb ǅ", "Σίσυφος ΟΔΟΣ", "é é ñ́",
         "日本語 🙂🙂", "ﬀ ½ ² ٣", "힣 힣", "\x1c\x1d \x85\xa0 　z", "\x00nul", "x" * 5000, "ab" * 3000, "aaaa" * 500, "!?!" * 2000, "12,345.67%%% $$$"]


def some_texts():
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice("abcdeéßtsh'<|>. 19ñ́İ\n") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    texts += ["".join(rng.choice("the in an re") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    return texts + [chr(i) + "a" + chr(i) for i in range(0x300)]


@pytest.mark.parametrize("path", [bpe.FILE, bpe.FILE.replace("word_bpe_49k", "byte_bpe_50k")])
def test_texts_have_the_ids_of_the_library(path):
    data = bpe.load(path)
    library, codec = Tokenizer.from_str(data), bpe.Codec(data)
    for text, (ids, pick) in zip(texts := some_texts(), codec.encode(texts)):
        wanted = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(wanted, skip_special_tokens=False)
        assert ids.tolist() == wanted, text
        assert codec.text(ids, pick) == codec.decode(wanted) == decoded, text


def merged(word: list[str], merges: list[tuple[str, str]]) -> list[str]:
    """Every merge in turn, from left to right, wherever it applies."""
    for u, v in merges:
        i = 0
        while i + 1 < len(word):
            if (word[i], word[i + 1]) == (u, v):
                word = [*word[:i], u + v, *word[i + 2 :]]
            i += 1
    return word


@pytest.mark.parametrize("seed", range(30))
def test_automaton_of_random_merges(seed):
    """Merges in any order, among them tokens that no word can hold and tokens merged with themselves."""
    rng = random.Random(seed)
    names = [f"<{i}>" for i in range(256)]
    for c in "abc":
        names[ord(c)] = c
    base, merges = list(range(256)) * 2, []
    while len(merges) < 12:
        u, v = (rng.choice([*"abc", *(a + b for a, b in merges)]) for _ in range(2))
        if u + v not in names:
            names.append(u + v)
            merges.append((u, v))
    number = {t: i for i, t in enumerate(names)}
    automaton = bpe.Automaton(base, [(number[u], number[v], number[u + v]) for u, v in merges], len(names))
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    flat, starts = automaton.encode([w.encode() for w in words])
    for w, a, b in zip(words, starts, starts[1:]):
        assert [names[i] for i in flat[a:b]] == merged(list(w), merges), (w, merges)


def test_improper_merges_are_refused():
    with pytest.raises(ValueError, match="merge"):
        bpe.Automaton(list(range(256)) * 2, [(300, 97, 301)], 302)


def test_forgetting_words_changes_nothing():
    data = bpe.load()
    small, large = bpe.Codec(data, remember=3), bpe.Codec(data)
    for _ in range(2):
        assert [r[0].tolist() for r in small.encode(TEXTS)] == [r[0].tolist() for r in large.encode(TEXTS)]


def test_rows(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, None, None, None), (0, None, 1, None), (3, "a", 1, "y"), (3, "a", 1, "y")]
    data, library = bpe.load(), Tokenizer.from_str(bpe.load())
    docs = spark.createDataFrame(rows, SCHEMA)
    got = bpe.encode(docs, data).collect()
    assert len(got) == len(rows)
    for (_, text, *_), r in zip(rows, got):
        wanted = library.encode(text or "", add_special_tokens=False).ids
        assert r.ids == wanted and r.n_tokens == len(wanted)
        assert r.ids_sha256 == hashlib.sha256(np.array(wanted, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(wanted, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, data), data).collect()
    assert [r.text for r in back] == [library.decode(r.ids, skip_special_tokens=False) for r in got]
    assert bpe.encode(spark.createDataFrame([], SCHEMA), data).collect() == []
    ids = spark.createDataFrame([(1, None), (2, []), (3, [10**6, 320])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode(ids, data).collect()] == [None, "", "a</w>"]


def test_query(spark):
    library = Tokenizer.from_str(bpe.load())
    got = {r.doc_id: r for r in LLM_QUERIES["op12_bpe_automaton"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        wanted, r = library.encode(d.text or "", add_special_tokens=False).ids, got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(wanted), hashlib.sha256(np.array(wanted, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(wanted, skip_special_tokens=False).encode()).hexdigest()
