"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling.

Every word that stands before another has a restaurant of its own, and so has the
beginning of a text.  The tables of all of them are the customers of one shared
parent restaurant, whose base is uniform over the known words and one unknown
word.  Probabilities are averaged over several seatings.

Restaurants are dealt to shards by the hash of their context, so their seating is
local.  A word's parent table lies in a shard by the hash of the word.  The first
sweeps of a shard use a parent of its own contexts, a random part of all; then the
shards tell how many of their tables serve each word, and get to know how likely
the parent is to serve it, for every seating that is averaged.  Sweeps of different
shards run side by side, the published way to sample in parallel.

A block of documents asks a shard once for each distinct (context, word); the
answers come back in the order of the question.  Words are told apart by 64
bits of hash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count as counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.blocks import pack_arrays, packed, split_by, text_arrays, unpack_arrays, unpacked, with_block
from scanloom.llm.common import pieces, text_bytes
from scanloom.session import checkpointed

END = b"\n"  # no word holds white space
BLOCK_BYTES = 16 << 20
START = b" "  # what the first word of a text follows
#: Tables of one dish up to which every seat is drawn on its own; beyond, in bunches of 1 % of those seated.
SINGLY = 1 << 12


@dataclass(frozen=True)
class Settings:
    strength: float = 10.0
    burn_in: int = 2
    samples: int = 3
    seed: int = 17


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling series after moving the argument above 8 (error below 1e-10)."""
    low, y = np.zeros_like(x), x.astype(np.float64)
    for _ in range(8):
        small = y < 8
        low = np.where(small, low + np.log(np.where(small, np.maximum(y, 1e-300), 1)), low)
        y = np.where(small, y + 1, y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def seat(customers: np.ndarray, open_weight: np.ndarray, open_step: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Seat customers of one dish, restaurant by restaurant in parallel.

    A customer who finds ``j`` seated at ``t`` tables opens one with weight
    ``open_weight + open_step * t`` against ``j - discount * t``.  Instead of
    customer by customer, the wait for the next new table is drawn: a geometric
    time whose chance has a beta distribution (the urn of the two weights).
    Returns the tables and the log of the product of all summed weights.
    """
    tables, seated = np.minimum(customers, 1).astype(np.int64), np.minimum(customers, 1).astype(np.int64)
    log_weight = np.zeros(len(customers))
    live = np.flatnonzero(customers > 1)
    while len(live):
        t, j, c = tables[live], seated[live], customers[live]
        fresh, old = open_weight[live] + open_step[live] * t, j - discount * t
        single = t < SINGLY
        chance = rng.beta(np.maximum(fresh, 1e-12), np.maximum(old, 1e-12))
        wait = np.minimum(np.floor(np.log(rng.random(len(live))) / np.log1p(-np.clip(chance, 1e-300, 1 - 1e-12))), 4e18).astype(np.int64)  # seats at old tables
        bunch = np.maximum(1, np.minimum(c - j, j // 100))
        opened = np.where(single, (wait < c - j).astype(np.int64), rng.binomial(bunch, fresh / (fresh + old)))
        moved = np.where(single, np.minimum(wait + 1, c - j), bunch)
        log_weight[live] += log_gamma(fresh + old + moved) - log_gamma(fresh + old)
        tables[live], seated[live] = t + opened, j + moved
        live = live[j + moved < c]
    return tables, log_weight


class Restaurants:
    """The restaurants of one shard's contexts: customers and tables of every (context, word)."""

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray):
        self.context, self.word, self.count = context, word, count
        self.n_contexts = int(context.max()) + 1 if len(context) else 0
        self.customers = np.bincount(context, count, self.n_contexts)
        self.tables, self.log_weight = np.minimum(count, 1), np.full(len(count), -np.inf)

    def tables_of(self) -> np.ndarray:
        """Tables of each restaurant."""
        return np.bincount(self.context, self.tables, self.n_contexts)

    def served(self, words: int) -> np.ndarray:
        """Tables that serve each word: its customers in the parent restaurant."""
        return np.bincount(self.word, self.tables, words).astype(np.int64)

    def sweep(self, parent: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> None:
        """Take up every dish of every restaurant and seat it anew, with the parent's
        probability of each word; a proposal is kept with the ratio of the weights."""
        probability = parent[self.word]
        rest = np.maximum(self.tables_of()[self.context] - self.tables, 0)
        proposal, weight = seat(self.count, (strength + discount * rest) * probability, discount * probability, discount, rng)
        keep = np.log(rng.random(len(weight))) < weight - self.log_weight
        self.tables, self.log_weight = np.where(keep, proposal, self.tables), np.where(keep, weight, self.log_weight)

    def probabilities(self, parent: np.ndarray, strength: float, discount: float) -> np.ndarray:
        """Of every (context, word) here, with or without customers, given the parent's probability of each word."""
        tables = self.tables_of()[self.context]
        return (self.count - discount * self.tables + (strength + discount * tables) * parent[self.word]) / (strength + self.customers[self.context])


class Parent:
    """The parent restaurant's tables for the words of one shard; ``customers`` are the tables that serve each word."""

    def __init__(self, customers: np.ndarray):
        self.customers = customers
        self.tables, self.log_weight = np.minimum(customers, 1), np.full(len(customers), -np.inf)

    def sweep(self, elsewhere: float, words: int, strength: float, discount: float, rng: np.random.Generator) -> None:
        base = np.full(len(self.tables), 1 / (words + 1))
        rest = np.maximum(elsewhere + self.tables.sum() - self.tables, 0)
        proposal, weight = seat(self.customers, (strength + discount * rest) * base, discount * base, discount, rng)
        keep = np.log(rng.random(len(weight))) < weight - self.log_weight
        self.tables, self.log_weight = np.where(keep, proposal, self.tables), np.where(keep, weight, self.log_weight)


def parent_probability(customers: np.ndarray, tables: np.ndarray, all_customers: float, all_tables: float, words: int, strength: float, discount: float) -> np.ndarray:
    """Of words with these customers and tables in the parent restaurant (zeros: a word never seen)."""
    return (customers - discount * tables + (strength + discount * all_tables) / (words + 1)) / (strength + all_customers)


def _tokens(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: hashes of the words (ascending), word and context (as places there) of each token, offsets of the documents."""
    raw, offsets = text_arrays(texts)
    view, ids = raw.tobytes(), defaultdict(counter().__next__)
    start = ids[START]
    lists = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        words = view[a:b].lower().split()
        words.append(END)
        lists.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    token = np.concatenate(lists)
    first = np.cumsum([0] + [len(x) for x in lists])
    context = np.empty(len(token), np.int64)
    context[1:] = token[:-1]
    context[first[:-1]] = start
    return hashes[order], rank[token], rank[context], first


def _parent_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending places, which compress well."""
    return np.diff(ascending, prepend=0).astype(np.uint32)


class Gathered:
    """The questions of all blocks to one shard of contexts, and the counts they add up to.

    ``key`` is every (context, word) asked for, trained or not, in order."""

    def __init__(self, requests: list[tuple[dict, dict, dict]]):
        self.words, word = np.unique(np.concatenate([w["hash"] for _, w, _ in requests]), return_inverse=True)
        contexts, context = np.unique(np.concatenate([c["hash"] for c, _, _ in requests]), return_inverse=True)
        word, context = word.ravel(), context.ravel()
        own, keys, counts, at, on = [], [], [], 0, 0
        for c, w, p in requests:
            own.append(word[at : at + len(w["hash"])])
            own_contexts = np.repeat(context[on : on + len(c["hash"])], c["pairs"].astype(np.int64))
            at, on = at + len(w["hash"]), on + len(c["hash"])
            keys.append(own_contexts * len(self.words) + own[-1][p["word"].astype(np.int64)])
            counts.append(p["count"].astype(np.int64))
        self.key, place = np.unique(np.concatenate(keys), return_inverse=True)
        self.count = np.bincount(place.ravel(), np.concatenate(counts), len(self.key)).astype(np.int64)
        #: Per question the places of its words and pairs, both ascending as the question is.
        self.asked = list(zip(own, np.split(place.ravel(), np.cumsum([len(k) for k in keys])[:-1]), strict=True))
        self.context, self.word = self.key // max(1, len(self.words)), self.key % max(1, len(self.words))

    def restaurants(self) -> Restaurants:
        return Restaurants(self.context, self.word, self.count)


def score_texts(docs: DataFrame, held_out: str, settings: Settings = Settings(), block_bytes: int = BLOCK_BYTES) -> DataFrame:  # noqa: B008
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    Trained on all rows without ``held_out``.  A token is a word or the end of
    a text.  ``score`` is the log10 probability of the text, ``perplexity`` the
    inverse probability per token.  A null or empty text is its end alone, a
    null ``held_out`` counts as training.  Repeated rows train and score each.
    Without training rows every token has probability 1.  An empty table gives
    an empty result.
    """
    a = settings.strength
    blocks = shards = pieces(text_bytes(docs), block_bytes)
    placed = with_block(docs, blocks, [F.coalesce(F.col(held_out), F.lit(False)).alias("_held")])

    def ask(table: pa.Table) -> pa.Table:
        texts = unpacked(table)
        hashes, token, context, first = _tokens(texts)
        training = np.repeat(~texts.column("_held").to_numpy().astype(bool), np.diff(first))
        key, inverse = np.unique(context * len(hashes) + token, return_inverse=True)
        n = np.bincount(inverse.ravel(), training, len(key)).astype(np.uint32)
        context, word = key // len(hashes), key % len(hashes)
        out: dict[str, list] = {"shard": [], "block": [], "contexts": [], "words": [], "pairs": []}
        for shard, at in split_by((hashes[context] % np.uint64(shards)).astype(np.int64)):
            mine, size = np.unique(context[at], return_counts=True)
            words, place = np.unique(word[at], return_inverse=True)
            for c, v in (("shard", shard), ("block", table.column("block")[0].as_py()), ("contexts", pack_arrays(hash=hashes[mine], pairs=size.astype(np.uint32))),
                         ("words", pack_arrays(hash=hashes[words])), ("pairs", pack_arrays(word=place.ravel().astype(np.uint32), count=n[at]))):
                out[c].append(v)
        return pa.table({c: pa.array(v, pa.int32() if c in ("shard", "block") else pa.binary()) for c, v in out.items()})

    def share(once: int | None, twice: int | None) -> float:  # the usual estimate from what is seen once and twice
        return min(0.95, max(0.05, (once or 0) / max(1, (once or 0) + 2 * (twice or 0))))

    def gather(table: pa.Table) -> pa.Table:
        """All questions of a shard, seated against a parent of its own contexts, and what each shard of parents has to know."""
        table = table.sort_by("block")
        number, n = table.column("shard")[0].as_py(), table.num_rows
        g = Gathered([tuple(unpack_arrays(table.column(c)[i]) for c in ("contexts", "words", "pairs")) for i in range(n)])
        r, words = g.restaurants(), len(g.words)
        seen = g.count > 0
        types, frequency = np.bincount(g.word[seen], minlength=words), np.bincount(g.word, g.count, words)
        once, twice = int((g.count == 1).sum()), int((g.count == 2).sum())
        known = int((types > 0).sum())
        own = parent_probability(types, np.minimum(types, 1), float(types.sum()), float(known), known, a, share((types == 1).sum(), (types == 2).sum()))
        rng = np.random.default_rng([settings.seed, number])
        for _ in range(1 + settings.burn_in):
            r.sweep(own, a, share(once, twice), rng)
        tables, parent = r.served(words), _parent_of(g.words, shards)
        up = [{"parent": p, "data": pack_arrays(hash=g.words[at], tables=tables[at].astype(np.uint32), frequency=frequency[at].astype(np.uint64))} for p, at in split_by(parent)]
        asks = [{"block": b, "words": pack_arrays(step=_steps(w)), "pairs": pack_arrays(step=_steps(p))} for b, (w, p) in zip(table.column("block").to_pylist(), g.asked, strict=True)]
        return pa.table({
            "shard": table.column("shard")[:1], "main": [pack_arrays(step=_steps(g.context), word=g.word.astype(np.uint32), count=g.count.astype(np.uint32), tables=r.tables.astype(np.uint32))], "parents": [pack_arrays(parent=parent.astype(np.uint32))],
            "asks": pa.array([asks], pa.list_(pa.struct([("block", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary())]))), "up": pa.array([up], pa.list_(pa.struct([("parent", pa.int32()), ("data", pa.binary())]))),
            "customers": [int(g.count.sum())], "tables": [int(r.tables.sum())], "once": [once], "twice": [twice]})

    asked = packed(placed).groupBy("block").applyInArrow(ask, "shard int, block int, contexts binary, words binary, pairs binary")
    shelf = checkpointed(asked.groupBy("shard").applyInArrow(gather, "shard int, main binary, parents binary, asks array<struct<block:int,words:binary,pairs:binary>>, up array<struct<parent:int,data:binary>>, customers long, tables long, once long, twice long"))

    def parents(table: pa.Table) -> pa.Table:
        """The words of one shard of parents: for each shard of contexts their places, and tables and frequencies over all."""
        table = table.sort_by("shard")
        mail = [unpack_arrays(d) for d in table.column("data")]
        words, place = np.unique(np.concatenate([m["hash"] for m in mail]), return_inverse=True)
        served, frequency = (np.bincount(place.ravel(), np.concatenate([m[c] for m in mail]).astype(np.float64), len(words)).astype(np.int64) for c in ("tables", "frequency"))
        ends = np.cumsum([len(m["hash"]) for m in mail])[:-1]
        lists = [{"shard": s, "at": pack_arrays(step=_steps(x))} for s, x in zip(table.column("shard").to_pylist(), np.split(place.ravel(), ends), strict=True)]
        return pa.table({"parent": table.column("parent")[:1], "lists": pa.array([lists], pa.list_(pa.struct([("shard", pa.int32()), ("at", pa.binary())]))),
                         "counts": [pack_arrays(served=served, frequency=frequency)], "words": [int((frequency > 0).sum())], "once": [int((served == 1).sum())], "twice": [int((served == 2).sum())]})

    sent = shelf.select("shard", F.explode("up").alias("u")).select("shard", "u.*")
    known = checkpointed(sent.groupBy("parent").applyInArrow(parents, "parent int, lists array<struct<shard:int,at:binary>>, counts binary, words long, once long, twice long"))
    row = shelf.agg(*[F.sum(c).alias(c) for c in ("customers", "tables", "once", "twice")]).first()
    over = known.agg(*[F.sum(c).alias(c) for c in ("words", "once", "twice")]).first()
    n_train, n_words, n_tables = row.customers or 0, over.words or 0, row.tables or 0
    discount, parent_discount = share(row.once, row.twice), share(over.once, over.twice)

    def seat_parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Seatings of the parent restaurant for the tables that the shards of contexts have."""
        for batch in batches:
            for i in range(batch.num_rows):
                number, served = batch.column("parent")[i].as_py(), unpack_arrays(batch.column("counts")[i])["served"]
                parent, rng, out = Parent(served), np.random.default_rng([settings.seed, number, 1]), []
                elsewhere = float(n_words - parent.tables.sum())
                for turn in range(settings.burn_in + settings.samples):
                    parent.sweep(elsewhere, n_words, a, parent_discount, rng)
                    if turn >= settings.burn_in:
                        out.append(parent.tables.copy())
                yield pa.RecordBatch.from_pydict({"parent": pa.array([number], pa.int32()), "lists": batch.column("lists").slice(i, 1), "counts": batch.column("counts").slice(i, 1),
                                                  "seats": [pack_arrays(**{f"t{k}": t.astype(np.uint32) for k, t in enumerate(out)})], "sums": pa.array([[int(t.sum()) for t in out]], pa.list_(pa.int64()))})

    seats = checkpointed(known.select("parent", "lists", "counts").mapInArrow(seat_parents, "parent int, lists array<struct<shard:int,at:binary>>, counts binary, seats binary, sums array<long>"))
    totals = seats.agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"t{i}") for i in range(settings.samples)]).first()
    all_tables = [float(t or 0) for t in totals]

    def resume(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For every shard of contexts the parent's probabilities and the frequencies of its words."""
        for batch in batches:
            for i in range(batch.num_rows):
                counts, seated = unpack_arrays(batch.column("counts")[i]), unpack_arrays(batch.column("seats")[i])
                p = [parent_probability(counts["served"], seated[f"t{k}"].astype(np.float64), n_tables, t, n_words, a, parent_discount).astype(np.float32) for k, t in enumerate(all_tables)]
                for r in batch.column("lists")[i].values:
                    at = np.cumsum(unpack_arrays(r["at"])["step"].astype(np.int64))
                    data = pack_arrays(frequency=counts["frequency"][at], **{f"p{k}": v[at] for k, v in enumerate(p)})
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([r["shard"].as_py()], pa.int32()), "parent": batch.column("parent").slice(i, 1), "data": pa.array([data], pa.binary())})

    def sample(table: pa.Table, mail: pa.Table) -> pa.Table:
        """Sweeps against the parent's seatings, one each, and the averaged answers to every block."""
        number, main = table.column("shard")[0].as_py(), unpack_arrays(table.column("main")[0])
        places = dict(split_by(unpack_arrays(table.column("parents")[0])["parent"].astype(np.int64)))
        words = sum(map(len, places.values()))
        parent, frequency = [np.zeros(words) for _ in range(settings.samples)], np.zeros(words, np.int64)
        for p, data in zip(mail.column("parent").to_pylist(), mail.column("data"), strict=True):
            found = unpack_arrays(data)
            frequency[places[p]] = found["frequency"]
            for k, values in enumerate(parent):
                values[places[p]] = found[f"p{k}"]
        r = Restaurants(np.cumsum(main["step"].astype(np.int64)), main["word"].astype(np.int64), main["count"].astype(np.int64))
        r.tables, rng, mean = main["tables"].astype(np.int64), np.random.default_rng([settings.seed, number, 2]), np.zeros(len(main["word"]))
        for p in parent:
            r.sweep(p, a, discount, rng)
            mean += r.probabilities(p, a, discount) / len(parent)
        log = np.log10(mean).astype(np.float32)
        out: dict[str, list] = {"block": [], "words": [], "pairs": []}
        for ask in table.column("asks")[0].values:
            at, on = (np.cumsum(unpack_arrays(ask[c])["step"].astype(np.int64)) for c in ("words", "pairs"))
            for c, v in (("block", ask["block"].as_py()), ("words", pack_arrays(frequency=frequency[at])), ("pairs", pack_arrays(log=log[on]))):
                out[c].append(v)
        return pa.table({"block": pa.array(out["block"], pa.int32()), "shard": pa.array([number] * len(out["block"]), pa.int32()), "words": pa.array(out["words"], pa.binary()), "pairs": pa.array(out["pairs"], pa.binary())})

    mail = seats.mapInArrow(resume, "shard int, parent int, data binary")
    replies = shelf.select("shard", "main", "parents", "asks").groupBy("shard").cogroup(mail.groupBy("shard")).applyInArrow(sample, "block int, shard int, words binary, pairs binary")
    smallest = float(n_train + n_words + 1)

    def finish(table: pa.Table, mail: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        texts = unpacked(table)
        hashes, token, context, first = _tokens(texts)
        key, inverse = np.unique(context * len(hashes) + token, return_inverse=True)
        frequency, log = np.zeros(len(hashes), np.int64), np.zeros(len(key))
        pairs_of = dict(split_by((hashes[key // len(hashes)] % np.uint64(shards)).astype(np.int64)))
        for shard, words, pairs in zip(mail.column("shard").to_pylist(), mail.column("words"), mail.column("pairs"), strict=True):
            frequency[np.unique(key[pairs_of[shard]] % len(hashes))] = unpack_arrays(words)["frequency"]
            log[pairs_of[shard]] = unpack_arrays(pairs)["log"]
        n, known = np.diff(first), np.add.reduceat((frequency[token] > 0).astype(np.int64), first[:-1])
        base = np.add.reduceat(np.log10((frequency + 1) / smallest)[token], first[:-1])
        score = np.add.reduceat(log[inverse.ravel()], first[:-1])
        return pa.table({"doc_id": texts.column("_id"), "held_out": texts.column("_held"), "n_tokens": pa.array(n), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(n), n_train)),
                         "base_score": pa.array(base), "score": pa.array(score), "perplexity": pa.array(10 ** np.minimum(-score / n, 300))})

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])
    empty = schema.empty_table()
    return packed(placed).groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
