"""SentencePiece encoding and decoding with the tokenizers library.

The model protobuf is parsed here; normaliser, metaspace marker, pieces with
their scores (unigram, or merges ranked by score for a BPE model) and byte
fallback are rebuilt as a tokenizers pipeline, which encodes batches on several
threads.  Every distinct unit is also encoded by the sentencepiece library, only
to report where it differs; for models that change more than spaces the whole
texts are compared.

A unit is a run of markers with the text up to the next marker.  No piece of
the model may have a marker after other text (checked when the model is read),
so a text's encoding is that of its units, and repeated units are encoded once.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from scanloom.llm.common import carried, give_back, slices, with_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: New units encoded at once; the tokenizers library keeps about 2 KB for each meanwhile.
LEARN = 1 << 13
#: New units encoded as one text.
JOIN = 32
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind in (1, 5) else varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class PieceModel:
    """What the protobuf says; the defaults are those of its schema."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            rules = dict(_fields(value))
            model.charsmap = rules.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
    if model.kind not in (UNIGRAM, BPE) or not model.escape or any(p[2] == USER_DEFINED for p in model.pieces):
        raise ValueError("only unigram and BPE models with escaped spaces and no user-defined pieces are rebuilt")
    if any(MARKER in p[0].lstrip(MARKER) for p in model.pieces if p[2] == NORMAL):
        raise ValueError("a piece goes on past a marker, so texts can't be cut into units")
    return model


def rebuild(model: PieceModel, hidden: bool = False) -> Tokenizer:
    """The tokenizers pipeline of a parsed model, for units that are normalised already.

    ``hidden`` gives the pieces of a unigram model that stand for no text names
    that no unit can hold, and leaves byte fallback to the caller.
    """
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    if model.kind == UNIGRAM:
        pieces = [(f"x{MARKER}{i}" if hidden and kind != NORMAL else p, s) for i, (p, s, kind) in enumerate(model.pieces)]
        core = models.Unigram(pieces, unknown, model.byte_fallback and not hidden)
    else:
        ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        normal = {p: s for p, s, kind in model.pieces if kind == NORMAL}
        merges = [(-normal[p], ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for p in normal for i in range(1, len(p)) if p[:i] in normal and p[i:] in normal]
        core = models.BPE(ids, [(a, b) for *_, a, b in sorted(merges)], unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


def normaliser(model: PieceModel) -> normalizers.Normalizer:
    steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    return normalizers.Sequence([*steps, normalizers.Replace(" ", MARKER)])


class Codec:
    """Encoder and decoder of one model, with a bounded memory of units."""

    def __init__(self, data: bytes, remember: int = 300_000):
        self.model = parse(data)
        self.tokenizer = rebuild(self.model)
        self.plain = not self.model.charsmap and not self.model.squeeze
        self.normaliser = normaliser(self.model)
        names = [p for p, _, kind in self.model.pieces if p and kind != NORMAL]
        #: A unigram lattice takes the written name of a control, byte or unknown piece for the piece.
        self.named = re.compile("|".join(map(re.escape, names))) if self.model.kind == UNIGRAM and names else None
        self.hiding = rebuild(self.model, hidden=True) if self.named else None
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE}
        self.unknown = next((i for i, p in enumerate(self.model.pieces) if p[2] == UNKNOWN), 0)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.starts_unit = np.array([p.startswith(MARKER) for p, _, _ in self.model.pieces])
        self.unit = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")
        self.remember = remember
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)  # ids of all units, and where each begins
        self.same, self.back, self.uses = np.empty(0, bool), np.empty(0, bool), np.empty(0, np.int64)

    def _forget(self) -> None:
        """Keep the units used more than once since the last time, at most half of what is remembered."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > self.remember // 2:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: self.remember // 2]])
        place = np.full(len(self.uses), -1, np.int64)
        place[keep] = np.arange(len(keep))
        self.known = {u: int(place[i]) for u, i in self.known.items() if place[i] >= 0}
        self.ids, size = _gathered(self.ids, self.starts, keep)
        self.starts = np.r_[0, np.cumsum(size)]
        self.same, self.back, self.uses = self.same[keep], self.back[keep], np.zeros(len(keep), np.int64)

    def normalised(self, text: str) -> str:
        """Text as the model sees it, marker in front."""
        text = text.replace(" ", MARKER) if self.plain else self.normaliser.normalize_str(text)
        return MARKER + text if text and self.model.dummy_prefix else text

    def _hidden(self, unit: str) -> list[int]:
        """Ids of a unit that holds the written name of a piece without text."""
        found = self.hiding.encode(unit, add_special_tokens=False)
        if not self.model.byte_fallback:
            return found.ids
        return [i for n, (a, b) in zip(found.ids, found.offsets, strict=True) for i in ([n] if n != self.unknown else [self.byte_ids[c] for c in unit[a:b].encode()])]

    def _wanted(self, units: list[str]) -> list[list[int]]:
        """The ids that the library gives the units inside a text."""
        cut = 1 if self.model.dummy_prefix else 0  # the library puts the first marker there itself
        wanted = self.reference.encode([u[cut:] for u in units], num_threads=1)
        if cut:  # it drops a lone marker together with the empty text behind it, so that one is asked for behind a letter
            for i, u in enumerate(units):
                if u[0] != MARKER or len(u) == 1:
                    wanted[i] = self.reference.encode("a" + u)[len(self.reference.encode("a")) :]
        return wanted

    def _cut(self, text: str | None) -> list[str]:
        """Units of a text; where single spaces stand between words, the words, whose marker is understood."""
        if self.plain and self.model.dummy_prefix and text and "  " not in text and MARKER not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return self.unit.findall(self.normalised(text or ""))

    def _learn(self, keys: list[str]) -> None:
        """Encode new units on several threads and hold them against the library."""
        units = [k if k[0] == MARKER or not self.model.dummy_prefix else MARKER + k for k in keys]
        joined = [len(u) > 1 and u.rfind(MARKER) == 0 for u in units] if self.plain and self.model.kind == BPE and self.model.dummy_prefix else [False] * len(units)
        for pick, encoded in ((True, self._joined), (False, self._single)):
            some = [u for u, j in zip(units, joined, strict=True) if j is pick]
            if some:
                ids, size, same, back = encoded(some)
                self.known.update(zip((k for k, j in zip(keys, joined, strict=True) if j is pick), range(len(self.uses), len(self.uses) + len(some)), strict=True))
                self.same, self.back, self.uses = np.r_[self.same, same], np.r_[self.back, back], np.r_[self.uses, np.zeros(len(some), np.int64)]
                self.ids, self.starts = np.concatenate([self.ids, ids]), np.r_[self.starts, self.starts[-1] + np.cumsum(size)]

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units that start with their only marker, their numbers, whether the library gives the same and
        whether they decode to the unit.  Some are one text: every piece that starts with a marker begins a unit."""
        texts = ["".join(units[at : at + JOIN]) for at in range(0, len(units), JOIN)]
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(encoded), np.int32)
        starts = np.flatnonzero(self.starts_unit[ids])
        if len(starts) != len(units) or starts[0]:
            return self._single(units)
        wanted = self.reference.encode([t[1:].replace(MARKER, " ") for t in texts], num_threads=1)
        if wanted == encoded:
            same = np.ones(len(units), bool)
        else:
            ends = np.r_[starts[1:], len(ids)].tolist()
            same = np.array([w == ids[a:b].tolist() for w, a, b in zip(self._wanted(units), starts.tolist(), ends, strict=True)], bool)
        back = np.repeat([d == t.replace(MARKER, " ") for d, t in zip(self.tokenizer.decode_batch(encoded, skip_special_tokens=False), texts, strict=True)], JOIN)[: len(units)]
        size = np.diff(np.r_[starts, len(ids)])
        for i in np.flatnonzero(~back).tolist():
            back[i] = self.tokenizer.decode(ids[starts[i] : starts[i] + size[i]].tolist(), skip_special_tokens=False) == units[i].replace(MARKER, " ")
        return ids, size, same, back

    def _single(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same of any units, one by one."""
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        if self.named:
            encoded = [self._hidden(u) if self.named.search(u) else e for u, e in zip(units, encoded, strict=True)]
        texts = self.tokenizer.decode_batch(encoded, skip_special_tokens=False)
        same = [w == e for w, e in zip(self._wanted(units), encoded, strict=True)] if self.plain else [True] * len(units)
        back = [t == u.replace(MARKER, " ") for t, u in zip(texts, units, strict=True)]
        size = np.array([len(e) for e in encoded], np.int64)
        return np.fromiter(chain.from_iterable(encoded), np.int32, int(size.sum())), size, np.array(same, bool), np.array(back, bool)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool, bool]]:
        """(ids, decodes to the normalised text, same as the library) of whole texts; null is empty."""
        split = [self._cut(t) for t in texts]
        if len(self.known) > self.remember:
            self._forget()
        new = list(set().union(*split) - self.known.keys())
        for at in range(0, len(new), LEARN):
            self._learn(new[at : at + LEARN])
        out, used = [], []
        for text, units in zip(texts, split, strict=True):
            numbers = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
            used.append(numbers)
            ids = _gathered(self.ids, self.starts, numbers)[0]
            same = bool(self.same[numbers].all()) if self.plain else ids.tolist() == self.reference.encode(text or "")
            out.append((ids, bool(self.back[numbers].all()), same))
        if used:
            self.uses += np.bincount(np.concatenate(used), minlength=len(self.uses))
        return out

    def decode(self, batch: list[list[int] | None]) -> list[str | None]:
        """Texts of id lists, without the marker that encoding puts in front; null stays null."""
        cut = 1 if self.model.dummy_prefix else 0
        texts = self.tokenizer.decode_batch([ids or [] for ids in batch], skip_special_tokens=False)
        return [None if ids is None else t[cut:] if t.startswith(" ") else t for ids, t in zip(batch, texts, strict=True)]


def _gathered(values: np.ndarray, starts: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``pick`` of ``values`` one after the other, and their lengths."""
    size = starts[pick + 1] - starts[pick]
    end = np.cumsum(size)
    return values[np.arange(end[-1] if len(end) else 0) + np.repeat(starts[pick] - (end - size), size)], size


def load(path: str = MODEL) -> bytes:
    """The model file, read where the job starts; it is sent to the tasks, as it has a fixed size."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, keep: list[str] | None = None, with_ids: bool = True, remember: int = 300_000) -> DataFrame:
    """Columns ``keep`` (default ``doc_id``) with ``n_tokens``, ``ids_sha256`` (of the ids as
    little-endian 32-bit numbers), ``round_trip``, ``parity`` and, ``with_ids``, ``ids``.

    Null and empty texts have no tokens.  Whole texts; repeated rows give
    repeated results; an empty table gives an empty result.  No shuffle.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = ", ids array<int>" if with_ids else ""
    source, texts_of, fields = with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # every thread keeps memory of its own, and the other cores have tasks
        codec = Codec(shared.value, remember)
        for batch in batches:
            for at, n, texts in slices(batch, texts_of, 1 << 19):
                rows = codec.encode(texts)
                part = batch.slice(at, n)
                columns = [*(part.column(c) for c in keep), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0].tobytes()).hexdigest() for r in rows]),
                           pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])]
                names = [*keep, "n_tokens", "ids_sha256", "round_trip", "parity"]
                if with_ids:
                    ends = np.cumsum([0] + [len(r[0]) for r in rows]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[0] for r in rows]), pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        del codec
        give_back()

    more = T.StructType.fromDDL(f"n_tokens long, ids_sha256 string, round_trip boolean, parity boolean{extra}").fields
    return source.mapInArrow(run, T.StructType([*fields, *more]))


def decode(encoded: DataFrame, model: bytes, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default ``doc_id``) with the ``text`` of each ``ids`` list; null ids give a null text."""
    keep = keep or ["doc_id"]
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            texts = codec.decode(batch.column("ids").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    source = encoded.select(*keep, F.col("ids").cast("array<int>").alias("ids"))
    return source.mapInArrow(run, carried(source, "text string"))
