"""Alignment of two tokenizers' tokens by byte ranges.

Both tokenizers encode the same bytes (a space and the text).  All documents of
a batch are merged in lockstep: one state vector holds a pointer into the A
tokens and one into the B tokens of each, every step emits one link per state,
the pair of tokens pointed at, and moves on the pointer whose token ends first,
or both where the ends meet, which is a cut.  Finished states are taken out.
Long documents are several states that start at every ``LANE``-th A token, so a
step is never left with the tail of one text.

How often an id pair is linked in the whole corpus is known only after all
documents are aligned.  Blocks of documents send their distinct pairs to shards,
which add up the blocks' counts and answer in the order of the question.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scanloom.llm.blocks import pack_arrays, split_by, unpack_arrays
from scanloom.llm.bpe_automaton import BLANKS, byte_letters, near_class
from scanloom.llm.common import carried, give_back, pieces, slices, text_bytes
from scanloom.llm.sentencepiece_codec import BYTE, MARKER, parse
from scanloom.session import checkpointed

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: A tokens per state of the lockstep merge.
LANE = 512
#: Text bytes of a block of documents, and of the blocks that share a shard of pairs.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 64 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The bytes of all tokens, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length

    def joined(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        end = np.cumsum(n)
        return self.data[np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[ids] - (end - n), n)].tobytes()


def byte_level_vocabulary(data: str) -> Vocabulary:
    spec, byte_of = json.loads(data), {c: b for b, c in enumerate(byte_letters())}
    tokens = {i: bytes(map(byte_of.__getitem__, t)) for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return Vocabulary([tokens.get(i, b"") for i in range(max(tokens) + 1)])


def piece_vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary([bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARKER, " ").encode() for p, _, kind in parse(data).pieces])


def merge(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A and B tokens of every link, A and B tokens that end at every cut) of documents laid end to end.

    ``a_end`` and ``b_end`` are the byte ends of all tokens, ``a_first`` the first
    A token of each document and the number of all A tokens at last.
    """
    size = np.diff(a_first)
    lanes = -(-size // lane)
    start = np.repeat(a_first[:-1], lanes) + (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * lane
    stop = np.minimum(start + lane, np.repeat(a_first[1:], lanes))
    a, b = start, np.searchsorted(b_end, np.r_[0, a_end][start], "right")
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(a):
        links_a.append(a)
        links_b.append(b)
        ends_a, ends_b = a_end[a], b_end[b]
        meet = ends_a == ends_b
        cuts_a.append(a[meet])
        cuts_b.append(b[meet])
        a, b = a + (ends_a <= ends_b), b + (ends_b <= ends_a)
        on = a < stop
        if not on.all():
            a, b, stop = a[on], b[on], stop[on]
    none = [np.empty(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (links_a, links_b, cuts_a, cuts_b))


@dataclass
class Aligned:
    """Documents side by side: token ids, where each document's begin, links and cuts (as token places; cuts in order)."""

    a: np.ndarray
    b: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray

    def groups(self, spell: list[str]) -> list[str]:
        """Per document the ids of each group, ``a1,a2|b1;a3|b2,b3``; ``spell`` has three texts per id."""
        n_a, n_b = np.diff(self.cut_a, prepend=-1), np.diff(self.cut_b, prepend=-1)  # tokens of each group
        place = np.empty(len(self.a) + len(self.b), np.int64)
        place[np.arange(len(self.a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)] = self.a * 3  # behind the B tokens of the groups before
        place[np.arange(len(self.b)) + np.repeat(np.cumsum(n_a), n_b)] = self.b * 3
        ends = np.cumsum(n_a + n_b)
        place[ends - 1] += 2
        place[ends - 1 - n_b] += 1
        code, ends = place.tolist(), (self.a_first + self.b_first).tolist()
        return ["".join(map(spell.__getitem__, code[i:j]))[:-1] for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def sorted(self) -> Aligned:
        """With the links in their order; every link moves on at least one pointer."""
        at = np.argsort(self.link_a + self.link_b, kind="stable")
        return replace(self, link_a=self.link_a[at], link_b=self.link_b[at])


class Remembered:
    """Ids of the units of texts, each distinct unit encoded once, with a bounded memory."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], remember: int = 500_000):
        self.encode, self.remember = encode, remember
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start = np.empty(0, np.int32), np.zeros(1, np.int64)

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > self.remember:
            self._forget()
        new = list(set().union(*texts) - self.known.keys())
        if new:
            found = self.encode(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32, sum(map(len, found)))])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(f) for f in found])])
        out = []
        for units in texts:
            pick = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
            n = self.start[pick + 1] - self.start[pick]
            end = np.cumsum(n)
            out.append(self.flat[np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[pick] - (end - n), n)].astype(np.int64))
        return out


#: Fixed value: how byte-level tokenizers cut texts into words that they encode one by one.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{blank}]+(?![^{blank}])|[{blank}]+"


class ByteLevelSide:
    """Ids of a byte-level tokenizer, special tokens being plain text.  Texts of characters
    below U+0300 go word by word, others through the library as a whole."""

    def __init__(self, data: str):
        self.library = Tokenizer.from_str(data)
        self.library.encode_special_tokens = True
        spec = json.loads(data)
        usual = spec["normalizer"] is None and {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items() <= (spec["pre_tokenizer"] or {}).items()
        #: With a token for every byte and nothing changed before, the tokens of a text always spell it.
        self.lossless = usual and set(byte_letters()) <= spec["model"]["vocab"].keys()
        self.words = re.compile(CUTS.format(letter=near_class("L"), number=near_class("N"), other=near_class("PSMCZ"), blank=BLANKS)) if usual else None
        self.units = Remembered(self._whole)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        near = [self.words is not None and (t.isascii() or max(t) < "\u0300") for t in texts]
        quick = iter(self.units.ids([self.words.findall(t) for t, ok in zip(texts, near, strict=True) if ok]))
        slow = iter(self._whole([t for t, ok in zip(texts, near, strict=True) if not ok]))
        return [next(quick) if ok else np.array(next(slow), np.int64) for ok in near]


class PieceSide:
    """Ids of a SentencePiece model.  Where it changes nothing but spaces, units from one
    marker to the next are encoded one by one, as no piece goes on past a marker."""

    def __init__(self, data: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        model = parse(data)
        self.plain = not model.charsmap and not model.squeeze and model.dummy_prefix
        self.unit = re.compile(f"{MARKER}+[^{MARKER}]*")
        self.units = Remembered(self._units)

    def _units(self, units: list[str]) -> list[list[int]]:
        found = self.library.encode([u[1:] if u[0] == MARKER else u for u in units], num_threads=1)  # the library puts the first marker there itself
        for i, u in enumerate(units):
            if u == MARKER:  # it drops a lone marker, so that one is asked for behind a letter
                found[i] = self.library.encode("a" + u)[len(self.library.encode("a")) :]
        return found

    def _cut(self, text: str) -> list[str]:
        """Units of a text; where single spaces stand between words, the words without their marker."""
        if "  " in text or MARKER in text or text[0] == " " or text[-1] == " ":
            return self.unit.findall(MARKER + text.replace(" ", MARKER))
        return text.split(" ")

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if self.plain:
            return self.units.ids([self._cut(t) for t in texts])
        return [np.array(i, np.int64) for i in self.library.encode(texts, num_threads=1)]


class Aligner:
    """Two tokenizers of one task."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.b = ByteLevelSide(a), PieceSide(b)
        self.a_tokens, self.b_tokens = byte_level_vocabulary(a), piece_vocabulary(b)
        if self.a_tokens.size * self.b_tokens.size >= 1 << 31:
            raise ValueError("pairs of ids have 31 bits at most")
        self.spell = [f"{i}{sign}" for i in range(max(self.a_tokens.size, self.b_tokens.size)) for sign in ",|;"]

    def align(self, texts: list[str | None]) -> Aligned:
        a, b = iter(self.a.ids([" " + t for t in texts if t])), iter(self.b.ids([t for t in texts if t]))
        sides: tuple[list, list] = ([], [])
        for t in texts:
            ids = [next(s) for s in (a, b)] if t else [np.empty(0, np.int64)] * 2
            if t:
                want = b" " + t.encode()
                if not (self.a.lossless or self.a_tokens.joined(ids[0]) == want) or self.b_tokens.joined(ids[1]) != want:
                    ids = [np.empty(0, np.int64)] * 2  # no common bytes, no alignment
            for side, own in zip(sides, ids, strict=True):
                side.append(own)
        flat = [np.concatenate(s) if s else np.empty(0, np.int64) for s in sides]
        first = [np.r_[0, np.cumsum(np.fromiter(map(len, s), np.int64, len(s)))] for s in sides]
        ends = [np.cumsum(v.length[ids]) for v, ids in zip((self.a_tokens, self.b_tokens), flat, strict=True)]
        link_a, link_b, cut_a, cut_b = merge(*ends, first[0])
        return Aligned(*flat, *first, link_a, link_b, np.sort(cut_a), np.sort(cut_b))


def load(a: str = BYTE_LEVEL, b: str = PIECES) -> tuple[str, bytes]:
    """Both tokenizer files, read where the job starts; they are sent to the tasks, as they have a fixed size."""
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        return f.read(), g.read()


def align(docs: DataFrame, files: tuple[str, bytes], keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default ``doc_id``) with ``a_ids``, ``b_ids``, ``links`` and ``cuts``.

    A link is (place of the A token, place of the B token) with overlapping byte
    ranges, a cut the same of two tokens that end together.  Null and empty
    texts, and those that one of the tokenizers can't give back, have empty
    lists.  Whole texts; repeated rows give repeated results; an empty table
    gives an empty result.  No shuffle.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))

    def pairs(a: np.ndarray, b: np.ndarray, found: Aligned) -> pa.Array:
        first = np.searchsorted(a, found.a_first)
        n = np.diff(first)
        a, b = (x - np.repeat(f[:-1], n) for x, f in ((a, found.a_first), (b, found.b_first)))
        both = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (a, b)], names=["a", "b"])
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        for batch in batches:
            for at, n, texts in slices(batch, "_text", 1 << 20):
                found = aligner.align(texts).sorted()
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(at, n) for c in keep), lists(found.a, found.a_first), lists(found.b, found.b_first),
                    pairs(found.link_a, found.link_b, found), pairs(found.cut_a, found.cut_b, found)], names=[*keep, "a_ids", "b_ids", "links", "cuts"])

    source = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    return source.mapInArrow(run, carried(source, "a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int>>, cuts array<struct<a:int,b:int>>"))


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)


class Block:
    """Alignments of some documents, reduced to what is needed when the corpus counts are known."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.size = 0
        self.numbers: dict[str, list] = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "kinds")}
        self.digests: list[str] = []
        self.pair, self.times = [], []

    def add(self, ids: list[int | None], texts: list[str | None], aligner: Aligner) -> None:
        found = aligner.align(texts)
        n = len(texts)
        self.ids += ids
        self.size += sum(len(t) for t in texts if t)
        n_a = np.diff(found.a_first)
        self.digests += [hashlib.sha256(g.encode()).hexdigest() if k else "" for g, k in zip(found.groups(aligner.spell), n_a.tolist(), strict=True)]
        doc = np.repeat(np.arange(n), n_a)[found.link_a] if len(found.link_a) else np.empty(0, np.int64)
        key = np.sort(doc << 31 | found.a[found.link_a] * aligner.b_tokens.size + found.b[found.link_b])
        start = _runs(key)
        self.pair.append(key[start] & 0x7FFFFFFF)
        self.times.append(np.diff(np.r_[start, len(key)]))
        cuts = np.searchsorted(found.cut_a, found.a_first)
        for c, x in (("n_a", n_a), ("n_b", np.diff(found.b_first)), ("n_groups", np.diff(cuts)), ("n_links", np.bincount(doc, minlength=n)), ("kinds", np.bincount(key[start] >> 31, minlength=n))):
            self.numbers[c].append(x)

    def rows(self, number: int, shards: int) -> pa.Table:
        """One row with the documents, and one per shard with the distinct pairs it is asked for."""
        pair, times = np.concatenate(self.pair), np.concatenate(self.times)
        asked, place = np.unique(pair, return_inverse=True)
        n = np.bincount(place.ravel(), times, len(asked)).astype(np.int64)
        kinds = np.concatenate(self.numbers["kinds"])
        first = np.cumsum(kinds) - kinds
        step = np.diff(place.ravel(), prepend=0)
        begin = first[kinds > 0]
        step[begin] = place.ravel()[begin]
        out = {"block": [number], "shard": [-1], "data": [pack_arrays(step=step.astype(np.uint32), times=times.astype(np.uint32))],
               "docs": [pack_arrays(id=np.array([i or 0 for i in self.ids], np.int64), null=np.array([i is None for i in self.ids]),
                                    digest=np.frombuffer(b"".join(d.ljust(64).encode() for d in self.digests), np.uint8).reshape(-1, 64), **{c: np.concatenate(v) for c, v in self.numbers.items()})]}
        for shard, at in split_by(shard_of(asked, shards)):
            for c, v in (("block", number), ("shard", shard), ("data", pack_arrays(pair=asked[at], n=n[at])), ("docs", None)):
                out[c].append(v)
        return pa.table({"block": pa.array(out["block"], pa.int64()), "shard": pa.array(out["shard"], pa.int32()), "data": pa.array(out["data"], pa.binary()), "docs": pa.array(out["docs"], pa.binary())})


def shard_of(pair: np.ndarray, shards: int) -> np.ndarray:
    return (((pair.astype(np.uint64) * _SPREAD) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def link_statistics(docs: DataFrame, files: tuple[str, bytes], block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row the numbers of tokens, groups and links, and what the links are worth in the whole corpus.

    The count of an id pair is the number of links in all documents that hold
    it.  ``n_best`` counts links whose count is the highest of their B id (ties
    too), ``count_sum`` adds the counts of all links, ``groups_sha256`` is the
    digest of the groups between cuts.  Rows as in ``align``: null, empty and
    unalignable texts have zeros and an empty digest; repeated rows count each;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(files)
    shards = pieces(text_bytes(docs), shard_bytes)
    n_b = piece_vocabulary(files[1]).size

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block, number = None, Block(), TaskContext.get().partitionId() << 24
        for batch in batches:
            aligner = aligner or Aligner(*shared.value)
            ids = batch.column("_id")
            for at, n, texts in slices(batch, "_text", 1 << 20):
                block.add(ids.slice(at, n).to_pylist(), texts, aligner)
                if block.size >= block_bytes:
                    yield from block.rows(number, shards).to_batches()
                    block, number = Block(), number + 1
                    give_back()
        if block.ids:
            yield from block.rows(number, shards).to_batches()
        give_back()

    source = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    asked = checkpointed(source.mapInArrow(ask, "block long, shard int, data binary, docs binary"))

    def tally(table: pa.Table) -> pa.Table:
        """Counts of a shard's pairs for every block that asked, and the highest count of each B id under block -1."""
        table = table.sort_by("block")
        mail = [unpack_arrays(d) for d in table.column("data")]
        pair, place = np.unique(np.concatenate([m["pair"] for m in mail]), return_inverse=True)
        count = np.bincount(place.ravel(), np.concatenate([m["n"] for m in mail]), len(pair)).astype(np.int64)
        best = np.zeros(n_b, np.int64)
        np.maximum.at(best, pair % n_b, count)
        hit = np.flatnonzero(best)
        ends = np.cumsum([len(m["pair"]) for m in mail])[:-1]
        answers = [pack_arrays(count=c) for c in np.split(count[place.ravel()], ends)]
        give_back()
        return pa.table({"block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()), "shard": pa.array([table.column("shard")[0].as_py()] * (len(mail) + 1), pa.int32()),
                         "data": pa.array([*answers, pack_arrays(b=hit, count=best[hit])], pa.binary())})

    replies = checkpointed(asked.filter("shard >= 0").select("block", "shard", "data").groupBy("shard").applyInArrow(tally, "block long, shard int, data binary"))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                found = unpack_arrays(data)
                yield pa.RecordBatch.from_arrays([pa.array(found["b"]), pa.array(found["count"])], names=["b", "count"])

    best = np.zeros(n_b, np.int64)
    for r in replies.filter("block = -1").select("data").mapInArrow(tops, "b long, count long").groupBy("b").agg(F.max("count").alias("count")).collect():
        best[r.b] = r["count"]  # one number per B id: as many as the vocabulary has
    highest = spark.sparkContext.broadcast(best)

    def finish(table: pa.Table, mail: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        found, links = unpack_arrays(table.column("docs")[0]), unpack_arrays(table.column("data")[0])
        sent, back = {}, {}
        for r in range(mail.num_rows):
            part = mail.column("shard")[r].as_py()
            if mail.column("kind")[r].as_py():
                back[part] = unpack_arrays(mail.column("data")[r])["count"]
            else:
                sent[part] = unpack_arrays(mail.column("data")[r])["pair"]
        kinds = found["kinds"]
        doc = np.repeat(np.arange(len(kinds)), kinds)
        first = np.cumsum(kinds) - kinds
        place = np.cumsum(links["step"].astype(np.int64))
        base = np.r_[0, place][first]  # steps begin anew with every document
        place -= np.repeat(base, kinds)
        pair, count = (np.concatenate([x[s] for s in sorted(sent)]) if sent else np.empty(0, np.int64) for x in (sent, back))
        order = np.argsort(pair)  # the block's pairs were numbered in this order
        pair, count = pair[order], count[order]
        is_best = count == highest.value[pair % n_b]
        times = links["times"].astype(np.int64)
        n_best, total = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        np.add.at(n_best, doc, times * is_best[place])
        np.add.at(total, doc, times * count[place])
        give_back()
        return pa.table({"doc_id": pa.array(found["id"], pa.int64(), mask=found["null"]), **{c: pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")},
                         "n_best": pa.array(n_best), "count_sum": pa.array(total), "groups_sha256": pa.array([bytes(d).decode().strip() for d in found["digest"]], pa.string())})

    empty = pa.table({c: pa.array([], pa.string() if c == "groups_sha256" else pa.int64()) for c in (f.split()[0] for f in RESULT.split(", "))})
    questions = asked.filter("shard >= 0").select("block", "shard", "data", F.lit(0).alias("kind"))
    mail = questions.unionByName(replies.filter("block >= 0").withColumn("kind", F.lit(1)))
    return asked.filter("shard = -1").groupBy("block").cogroup(mail.groupBy("block")).applyInArrow(finish, RESULT)
