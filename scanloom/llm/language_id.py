"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per (language, bucket) are summed on Spark over all training rows; the
log-probability matrix is broadcast (its size is bounded by ``max_languages``
times ``buckets`` and checked) and batches are scored sparsely in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm.common import slices, with_text

UNDETERMINED = "und"
#: Bytes of text whose n-grams are in memory at once (some 40 bytes for each).
SLICE = 1 << 19
_LETTER = regex.compile(r"\p{L}")
#: Odd multipliers of the n-gram hash, one per place in the n-gram (any odd numbers do).
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


def ngram_buckets(texts: list[str | None], orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of every n-gram, one pair of arrays per order, over whole texts.

    Characters are code points; A-Z is lowered and every other ASCII sign that
    is no letter becomes a space, so marks and digits carry no language.
    An n-gram never crosses into the next text.
    """
    packed = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in packed], np.int64)
    if not sizes.sum():
        return
    chars = np.concatenate(packed)
    table = np.full(128, 32, np.uint32)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    chars = np.where(chars < 128, table[np.minimum(chars, 127)], chars)
    owner = np.repeat(np.arange(len(texts)), sizes)
    shift = np.uint32(32 - (buckets - 1).bit_length())
    for n in orders:
        if len(chars) < n:
            continue
        last = len(chars) - n + 1
        h = np.full(last, n * 40503, np.uint32)
        for i in range(n):
            h = (h ^ chars[i : i + last]) * _MULTIPLIERS[i % len(_MULTIPLIERS)]
            h ^= h >> np.uint32(15)
        same = owner[:last] == owner[n - 1 :]
        yield ((h * _MULTIPLIERS[0]) >> shift)[same].astype(np.int64), owner[:last][same]


@dataclass(frozen=True)
class LanguageModel:
    """Languages in name order, log priors and the (bucket, language) log probabilities."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    orders: tuple[int, ...]


def train(docs: DataFrame, is_training: Column, orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 14,
          smoothing: float = 0.5, max_languages: int = 256) -> LanguageModel:
    """Fit on every row of ``docs`` with ``is_training`` and a known ``lang``.

    Each task adds up its batches first, so the shuffle holds at most
    languages x buckets rows of each task.  More than ``max_languages``
    languages raise an error; they are never cut.
    """
    rows = docs.filter(is_training & F.col("lang").isNotNull()).selectExpr("cast(text as string) text", "cast(lang as string) lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for start, n, texts in slices(batch, "text", SLICE):
                names, codes = np.unique(langs[start : start + n], return_inverse=True)
                table = np.zeros((len(names), buckets), np.int64)
                for ids, owner in ngram_buckets(texts, orders, buckets):
                    table += np.bincount(codes[owner] * buckets + ids, minlength=table.size).reshape(table.shape)
                for i, name in enumerate(names.tolist()):
                    sums[name] = sums[name] + table[i] if name in sums else table[i]
                    n_docs[name] = n_docs.get(name, 0) + int((codes == i).sum())
        for name, table in sums.items():
            ids = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({"lang": [name] * (len(ids) + 1), "bucket": np.r_[-1, ids], "n": np.r_[n_docs[name], table[ids]]})

    summed = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("table"))  # bounded: ``buckets`` entries
    tables = packed.limit(max_languages + 1).toArrow()
    if tables.num_rows > max_languages:
        raise ValueError(f"more than {max_languages} languages in the training rows")
    languages = sorted(tables.column("lang").to_pylist())
    counts, prior = np.zeros((buckets, len(languages))), np.zeros(len(languages))
    for name, table in zip(tables.column("lang").to_pylist(), tables.column("table"), strict=True):
        ids, n = (np.asarray(table.values.field(k)) for k in ("bucket", "n"))
        counts[ids[ids >= 0], languages.index(name)] = n[ids >= 0]
        prior[languages.index(name)] = n[ids < 0].sum()
    log_prob = np.log(counts + smoothing) - np.log(counts.sum(0) + smoothing * buckets) if languages else counts
    return LanguageModel(languages, np.log(prior / prior.sum()) if languages else prior, log_prob, orders)


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for each text."""
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return names, scores
    joint = np.tile(model.log_prior, (len(texts), 1))
    for ids, owner in ngram_buckets(texts, model.orders, len(model.log_prob)):
        if len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            for k in range(len(model.languages)):  # one gathered column at a time: one number per n-gram in memory
                joint[owner[starts], k] += np.add.reduceat(model.log_prob[:, k][ids], starts)
    best = joint.argmax(1)  # ties: the first in name order
    posterior = 1.0 / np.exp(joint - joint.max(1, keepdims=True)).sum(1)
    for i, text in enumerate(texts):
        if text and _LETTER.search(text):
            names[i], scores[i] = model.languages[best[i]], posterior[i]
    return names, scores


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: ``doc_id``) with ``lang_pred`` and ``score`` (posterior, 0 to 1).

    A null text, or one without a letter, or a model without languages gives
    ``und`` with score 0.  Only ``text`` is looked at; repeated rows give
    repeated results; an empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by max_languages x buckets
    source, texts_of, fields = with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, texts in slices(batch, texts_of, SLICE):
                names, scores = score_texts(shared.value, texts)
                kept = batch.slice(start, n)
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(run, T.StructType([*fields, *T.StructType.fromDDL("lang_pred string, score double").fields]))
