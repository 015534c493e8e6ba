"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that BPE
gives for some word.  It starts as one state with an arc for every base symbol;
then every merge ``u v`` in turn is built into it (a merge gadget):

* the state that ``u`` leads to is copied without its ``v`` arc, and all ``u``
  arcs are redirected to the copy, so ``u`` followed by ``v`` is read no more;
* every state with a ``u`` arc gets a ``uv`` arc to where ``v`` led from there.

All arcs of one label lead to one state, so a state is a chain of copies, each
lacking one label more.  A state reads ``uv`` if it read ``u`` when that merge
was built in.  States are numbered so that the copies made of a state (and of
its copies) follow it without a gap: a missing arc is then one interval of
states, and the transition table is a sorted list of intervals per label.

Every state accepts, so of the tokens that end at a place of a word exactly one
can be read from the state reached before it: the words of a batch go through
the table side by side, one place per step.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scanloom.llm.common import carried, give_back, slices

FILE = "/opt/tokenizers/word_bpe_49k.json"
#: Symbols (bytes of words) encoded at once, more only for one longer word.
SYMBOLS = 1 << 17
_NEVER = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters for themselves, the others from U+0100 on in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Automaton:
    """The compiled automaton of one list of merges; tokens are numbers.

    ``base`` holds the token of each symbol: the 256 bytes inside a word, then
    the 256 bytes at its end.  ``merges`` are (left, right, result).
    """

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]], size: int):
        left, right, made = [-1] * size, [-1] * size, [-1] * size  # parts of each token, number of its merge
        known, states = [0] * size, [0] * size  # symbols of each token, the state behind its label
        for s, t in reversed(list(enumerate(base))):
            known[t], states[t] = 1, 1 if s >= 256 and base[s - 256] != t else 0
        parent, lacks, since = [0, 1], [-1, -1], [-1, -1]  # state 0 starts, state 1 is behind the end of a word
        cut: dict[int, dict[int, int]] = {}  # label -> labels that its state lost by merges of its own, and when
        dead = np.zeros(size, bool)

        def reads(u: int, v: int) -> bool:
            """Whether the state behind ``u`` has a ``v`` arc now."""
            if states[u] == 1:
                return False
            x, limit = v, _NEVER
            while x >= 0:
                y, before = u, _NEVER
                while y >= 0:
                    when = cut.get(y, {}).get(x, _NEVER)
                    if when < before and when <= limit:
                        return False
                    y, before = right[y], made[y]
                x, limit = left[x], made[x]
            return True

        for k, (u, v, uv) in enumerate(merges):
            if not known[u] or not known[v] or known[uv]:
                raise ValueError("a merge of tokens that no earlier merge makes, or of a token made before")
            left[uv], right[uv], made[uv], known[uv], states[uv] = u, v, k, known[u] + known[v], states[v]
            if dead[u] or dead[v] or not reads(u, v):
                dead[uv] = True  # no word ever holds it
                continue
            cut.setdefault(u, {})[v] = k
            parent.append(states[u])
            lacks.append(v)
            since.append(k)
            states[u] = len(parent) - 1
        self.labels, self.left, self.made, self.length = size, np.array(left), np.array(made), np.array(known)

        n = len(parent)
        below = np.ones(n, np.int64)  # states of each subtree of copies
        for s in range(n - 1, 1, -1):
            below[parent[s]] += below[s]
        enter, free = np.zeros(n, np.int64), np.zeros(n, np.int64)
        enter[1] = below[0]
        free[:2] = enter[:2] + 1
        for s in range(2, n):
            enter[s] = free[parent[s]]
            free[parent[s]] += below[s]
            free[s] = enter[s] + 1
        self.n_states = n
        self.target = enter[np.array(states)]  # states go by their place in that order; 0 is the start
        label, first = np.array(lacks[2:], np.int64), enter[2:]
        order = np.argsort(label * n + first)
        self.gap = (label * n + first)[order]
        self.gap_end = (label * n + first + below[2:])[order]
        self.gap_since = np.array(since[2:], np.int64)[order]
        self.live = (self.length > 0) & ~dead
        self.marked = base[:256] != base[256:]  # whether the last symbol of a word is told apart
        spelled: dict[int, list[int]] = {}
        for s, t in enumerate(base):
            spelled.setdefault(t, [s])
        for u, v, uv in merges:
            spelled[uv] = spelled[u] + spelled[v]
        self._suffixes(spelled)

    def _suffixes(self, spelled: dict[int, list[int]]) -> None:
        """A trie of all tokens from their last symbol to their first."""
        node_of: dict[int, int] = {}
        token = [-1]
        for t in np.flatnonzero(self.live).tolist():
            node = 0
            for s in reversed(spelled[t]):
                at = node * 512 + s
                node = node_of.get(at, 0)
                if not node:
                    node = node_of[at] = len(token)
                    token.append(-1)
            token[node] = t
        keys = np.fromiter(node_of, np.int64, len(node_of))
        order = np.argsort(keys)
        self.trie, self.trie_next = keys[order], np.fromiter(node_of.values(), np.int64, len(node_of))[order]
        self.trie_token = np.array(token, np.int64)

    def readable(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each state has an arc with that label: none of the label and its left parts was lacking in time."""
        ok = np.ones(len(state), bool)
        if not len(self.gap):
            return ok
        x, limit, at = token, np.full(len(token), _NEVER, np.int64), np.arange(len(token))
        while len(at):
            place = x * self.n_states + state[at]
            j = np.maximum(np.searchsorted(self.gap, place, "right") - 1, 0)
            lost = (self.gap[j] <= place) & (place < self.gap_end[j]) & (self.gap_since[j] <= limit)
            ok[at[lost]] = False
            on = ~lost & (self.left[x] >= 0)
            at, limit, x = at[on], self.made[x[on]], self.left[x[on]]
        return ok

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, where each word begins in them)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.r_[0, np.cumsum(size)]
        sym = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if self.marked:
            sym[start[1:][size > 0] - 1] += 256
        inside = np.arange(len(sym)) - np.repeat(start[:-1], size)
        # all tokens that end at each place
        at, node, depth, found = np.arange(len(sym)), np.zeros(len(sym), np.int64), 0, []
        while len(at):
            key = node * 512 + sym[at - depth]
            j = np.minimum(np.searchsorted(self.trie, key), len(self.trie) - 1)
            on = self.trie[j] == key
            at, node, depth = at[on], self.trie_next[j[on]], depth + 1
            token = self.trie_token[node]
            hit = token >= 0
            found.append((at[hit], token[hit]))
            on = inside[at] >= depth
            at, node = at[on], node[on]
        where, token = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
        order = np.argsort(inside[where], kind="stable")
        where, token = where[order], token[order]
        steps = np.r_[0, np.cumsum(np.bincount(inside[where]))]
        # one place of every word per step
        state, chosen = np.zeros(len(sym) + 1, np.int64), np.full(len(sym), -1, np.int64)
        length, target = self.length[token], self.target[token]
        for i, (a, b) in enumerate(zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True)):
            w, back = where[a:b], length[a:b]
            ok = self.readable(np.where(back > i, 0, state[w - back + 1]), token[a:b])  # state[p + 1] is behind place p
            state[w[ok] + 1], chosen[w[ok]] = target[a:b][ok], token[a:b][ok]
        # back along the arcs
        place, word = start[1:][size > 0] - 1, np.flatnonzero(size > 0)
        out = []
        while len(place):
            t = chosen[place]
            out.append((word, t))
            place = place - self.length[t]
            on = place >= start[word]
            place, word = place[on], word[on]
        if not out:
            return np.empty(0, np.int64), np.zeros(len(words) + 1, np.int64)
        word, t = (np.concatenate([o[i] for o in reversed(out)]) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        return t[order], np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]


class Codec:
    """Encoder and decoder of one tokenizer file, with a bounded memory of words.

    Normalisation and the cut into words are those of the file.  For its usual
    form (lower case, white space dropped) texts of characters below U+0300 are
    cut by one expression here; other texts by the tokenizers library.
    """

    def __init__(self, data: str, remember: int = 300_000):
        spec = json.loads(data)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only plain BPE models are compiled")
        vocab, letters = model["vocab"], byte_letters()
        self.automaton = compiled(data)
        self.labels: list[str | None] = [None] * self.automaton.labels
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in (vocab | self.special).items():
            self.labels[i] = t
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_of = {c: b for b, c in enumerate(letters)}
        decoder = spec.get("decoder")
        if decoder and decoder["type"] != "ByteLevel":
            raise ValueError("only byte-level decoders and none are known")
        self.joined_bytes = bool(decoder)
        self.library = Tokenizer.from_str(data)
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.quick = near_words() if steps == ["NFC", "Replace", "Lowercase"] and split == WORDS else None
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {s: i for i, s in enumerate(self.special)}
        self.ids = np.array(list(self.special.values()), np.int64)
        self.starts = np.arange(len(self.special) + 1)
        self.spelled = list(self.special)

    def words(self, text: str) -> list[str]:
        """The words of a text as the tokenizer cuts it; special tokens are words of their own."""
        if self.quick and (text.isascii() or max(text) < "̀") and not (self.apart and self.apart.search(text)):
            return self.quick.findall(text.lower())
        out = []
        for part in self.apart.split(text) if self.apart else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                part = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                out += [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def _learn(self, words: list[str]) -> None:
        flat, starts = self.automaton.encode([w.encode() for w in words])
        names = list(map(self.labels.__getitem__, flat.tolist()))
        bounds = starts.tolist()
        self.spelled += [" ".join(names[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.known.update(zip(words, range(len(self.starts) - 1, len(self.starts) - 1 + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + starts[1:]])

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, numbers of the remembered words) of whole texts; null is empty."""
        if len(self.known) > self.remember:
            self._forget()
        split = [self.words(t) if t else [] for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in self.known))
        a = size = 0
        for b, w in enumerate(new):
            if size and size + len(w) > SYMBOLS:
                self._learn(new[a:b])
                a, size = b, 0
            size += len(w)
        if new:
            self._learn(new[a:])
        out = []
        for words in split:
            pick = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            n = self.starts[pick + 1] - self.starts[pick]
            end = np.cumsum(n)
            at = np.arange(end[-1] if len(end) else 0) + np.repeat(self.starts[pick] - (end - n), n)
            out.append((self.ids[at].astype("<u4"), pick))
        return out

    def text(self, ids: np.ndarray, pick: np.ndarray) -> str:
        """The decoded text of one result of ``encode``: the labels of the arcs it went along."""
        return self.decode(ids.tolist()) if self.joined_bytes else " ".join(map(self.spelled.__getitem__, pick.tolist()))

    def decode(self, ids: list[int]) -> str:
        """The labels of ``ids``, joined as the tokenizer file says; numbers without a token are passed over."""
        names = [self.labels[i] for i in ids if 0 <= i < len(self.labels) and self.labels[i] is not None]
        if not self.joined_bytes:
            return " ".join(names)
        return b"".join(bytes(map(self.byte_of.__getitem__, t)) if all(c in self.byte_of for c in t) else t.encode() for t in names).decode(errors="replace")


#: Fixed value: the expression of the tokenizer file that cuts texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Fixed value: the white space below U+0300.
BLANKS = " \t\n\x0b\x0c\r\x85\xa0"


def near_class(kinds: str) -> str:
    """A character class of these general categories without white space, for characters below U+0300 and their lower case."""
    chars = sorted(set("".join(chr(c) + chr(c).lower() for c in range(0x300))))
    return "[" + "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] in kinds and c not in BLANKS) + "]"


def near_words() -> re.Pattern:
    """``WORDS`` for lower-cased texts of characters below U+0300."""
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{near_class('L')}+|{near_class('N')}|{near_class('PSMCZ')}+")


@lru_cache(1)
def compiled(data: str) -> Automaton:
    """The automaton of a tokenizer file; a worker that is used again keeps it."""
    spec = json.loads(data)
    vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    base = [vocab[c] for c in byte_letters()] + [vocab[c + suffix] for c in byte_letters()]
    size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    return Automaton(base, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], size)


def load(path: str = FILE) -> str:
    """The tokenizer file, read where the job starts; it is sent to the tasks, as it has a fixed size."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer: str, keep: list[str] | None = None, with_ids: bool = True, remember: int = 300_000) -> DataFrame:
    """Columns ``keep`` (default ``doc_id``) with ``n_tokens``, ``ids_sha256`` (of the ids as
    little-endian 32-bit numbers), ``decoded_sha256`` (of the decoded text in UTF-8) and,
    ``with_ids``, ``ids``.

    Null and empty texts have no tokens and decode to the empty text.  Strings of special
    tokens in a text become these tokens.  Whole texts; repeated rows give repeated
    results; an empty table gives an empty result.  No shuffle.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    extra = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, remember)
        for batch in batches:
            for at, n, texts in slices(batch, "_text", 1 << 20):
                rows = codec.encode(texts)
                part = batch.slice(at, n)
                columns = [*(part.column(c) for c in keep), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0].tobytes()).hexdigest() for r in rows], pa.string()),
                           pa.array([hashlib.sha256(codec.text(*r).encode()).hexdigest() for r in rows], pa.string())]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.cumsum([0] + [len(r[0]) for r in rows]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[0] for r in rows]).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        del codec
        give_back()

    source = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    return source.mapInArrow(run, carried(source, f"n_tokens long, ids_sha256 string, decoded_sha256 string{extra}"))


def decode(encoded: DataFrame, tokenizer: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default ``doc_id``) with the ``text`` of each ``ids`` list; null ids give a null text."""
    keep = keep or ["doc_id"]
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    source = encoded.select(*keep, F.col("ids").cast("array<int>").alias("_ids"))
    return source.mapInArrow(run, carried(source, "text string"))
