"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over overlapping windows, each chunk
of the document keeps the largest answer of every filter, and the largest and
the mean answer over all chunks combine into one probability.  Chunks overlap
by the filter width and cover the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import carried, slices


@dataclass(frozen=True)
class Shape:
    """Sizes of the network; ``chunk`` and ``width`` are multiples of ``stride``."""

    embed: int = 4
    width: int = 12
    stride: int = 4
    filters: int = 32
    chunk: int = 256


@dataclass
class Network:
    """Weights, and ``shift`` that turns the sample's class balance into that of all training labels."""

    shape: Shape
    weights: dict[str, np.ndarray]
    shift: float = 0.0


def start(shape: Shape, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    fan = shape.width * shape.embed
    embed = rng.normal(0, 0.5, (256, shape.embed))
    embed[0] = 0  # padding
    return Network(shape, {k: v.astype(np.float32) for k, v in {
        "embed": embed, "filters": rng.normal(0, fan**-0.5, (fan, shape.filters)), "bias": np.zeros(shape.filters),
        "dense": rng.normal(0, 0.1, 2 * shape.filters), "out": np.zeros(1)}.items()})


def lay_out(texts: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(padded bytes, first chunk of each document, positions that reach into the next document)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    chunks = np.maximum(1, -(-(sizes + shape.stride) // shape.chunk))
    first = np.cumsum(chunks) - chunks
    flat = np.zeros(chunks.sum() * shape.chunk + shape.width, np.uint8)
    for text, at in zip(texts, (first * shape.chunk).tolist(), strict=True):
        flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
    reach = shape.width // shape.stride - 1  # the last places of a document's last chunk
    ends = (first + chunks) * (shape.chunk // shape.stride)
    return flat, first, (ends[:, None] - 1 - np.arange(reach)).ravel()


def _windows(net: Network, flat: np.ndarray) -> np.ndarray:
    s = net.shape
    embedded = net.weights["embed"][flat]
    n = (len(flat) - s.width) // s.stride
    return np.lib.stride_tricks.as_strided(embedded, (n, s.width * s.embed), (s.stride * s.embed * 4, 4)).copy()


def _chunk_answers(net: Network, flat: np.ndarray, blocked: np.ndarray) -> np.ndarray:
    """Largest filter answer of every chunk, in bounded pieces of the input."""
    s = net.shape
    per, total = s.chunk // s.stride, (len(flat) - s.width) // s.chunk
    out = np.empty((total, s.filters), np.float32)
    step = 512
    for a in range(0, total, step):
        b = min(total, a + step)
        answers = _windows(net, flat[a * s.chunk : b * s.chunk + s.width]) @ net.weights["filters"]
        inside = blocked[np.searchsorted(blocked, a * per) : np.searchsorted(blocked, b * per)] - a * per
        answers[inside] = -np.inf
        out[a:b] = answers.reshape(b - a, per, s.filters).max(1)
    return np.maximum(out + net.weights["bias"], 0)


def _combine(net: Network, pooled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(np.r_[first, len(pooled)])
    features = np.concatenate([np.maximum.reduceat(pooled, first), np.add.reduceat(pooled.astype(np.float64), first) / counts[:, None]], axis=1)
    return features, features @ net.weights["dense"].astype(np.float64) + float(net.weights["out"][0])


def probability(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 of whole texts."""
    if not texts:
        return np.empty(0)
    flat, first, blocked = lay_out(texts, net.shape)
    _, logit = _combine(net, _chunk_answers(net, flat, blocked), first)
    return 1 / (1 + np.exp(-np.clip(logit + net.shift, -30, 30)))


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Gradients of the weighted logistic loss, and the loss."""
    s, w = net.shape, net.weights
    flat, first, blocked = lay_out(texts, s)
    per, total = s.chunk // s.stride, (len(flat) - s.width) // s.chunk
    windows = _windows(net, flat)
    answers = windows @ w["filters"]
    answers[blocked] = -np.inf
    cube = answers.reshape(total, per, s.filters)
    place = cube.argmax(1)
    pooled = np.maximum(np.take_along_axis(cube, place[:, None], 1)[:, 0] + w["bias"], 0)
    features, logit = _combine(net, pooled, first)
    error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * weight / len(labels)
    loss = float(np.mean(weight * np.logaddexp(0, np.where(labels == 1, -logit, logit))))
    back = np.outer(error, w["dense"]).astype(np.float32)
    counts = np.diff(np.r_[first, total])
    doc = np.repeat(np.arange(len(first)), counts)
    grad = (back[:, s.filters :] / counts[:, None])[doc]  # through the mean
    grad += back[:, : s.filters][doc] * (pooled == features[:, : s.filters].astype(np.float32)[doc])  # through the largest
    grad *= pooled > 0
    row = (np.arange(total)[:, None] * per + place).ravel()
    dense_grad = np.zeros_like(w["filters"])
    window_grad = np.zeros((len(row), s.width * s.embed), np.float32)
    column = np.tile(np.arange(s.filters), total)
    picked, value = windows[row], grad.ravel()
    for f in range(s.filters):
        mine = column == f
        dense_grad[:, f] = value[mine] @ picked[mine]
        window_grad[mine] = value[mine][:, None] * w["filters"][:, f]
    symbol = flat[(row * s.stride)[:, None] + np.arange(s.width)].ravel()
    spread = window_grad.reshape(-1, s.embed)
    embed = np.stack([np.bincount(symbol, spread[:, e], 256) for e in range(s.embed)], 1).astype(np.float32)
    embed[0] = 0
    return {"embed": embed, "filters": dense_grad, "bias": grad.sum(0), "dense": (error @ features).astype(np.float32), "out": np.array([error.sum()], np.float32)}, loss


def fit(texts: list[bytes], labels: np.ndarray, shape: Shape | None = None, steps: int = 800, batch: int = 64, rate: float = 5e-3, seed: int = 7, enough: float = 0.01) -> Network:
    """Adam on the logistic loss, both classes with equal weight; ends early once
    the loss of the last passes over 50 batches is below ``enough`` on average."""
    net, rng = start(shape or Shape(), seed), np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    order, losses = np.empty(0, np.int64), []
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(texts))])
        pick, order = order[:batch], order[batch:]
        fade = 1 - step / (steps + 1)
        grads, loss = _gradients(net, [texts[i] for i in pick], labels[pick], weight[pick])
        losses.append(loss)
        if np.mean(losses[-50:]) < enough and step >= 100:
            break
        for k, g in grads.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            change = (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7)
            net.weights[k] = (net.weights[k] - rate * fade * change).astype(np.float32)
    return net


def spread_chunks(text: str | None, limit: int, chunk: int) -> bytes:
    """At most ``limit`` bytes of a training text: whole chunks spread evenly over all of it."""
    raw = (text or "").encode()
    if len(raw) <= limit:
        return raw
    at = np.unique(np.linspace(0, len(raw) // chunk - 1, limit // chunk).astype(int)) * chunk
    return b"".join(raw[a : a + chunk] for a in at.tolist())


def train(docs: DataFrame, labels: DataFrame, is_training: Column, per_class: int = 2000, text_limit: int = 8192, shape: Shape | None = None) -> Network:
    """Fit on a bounded sample of labelled rows: for each class the ``per_class``
    rows with the smallest hash of their id, at most ``text_limit`` bytes each
    (chunks spread over the text).  Class shares come from all training labels.

    ``is_training`` is a condition on ``doc_id``.  Several labels of a document
    count by their mean; null labels and ids are left out.  Without labels of
    both classes the network answers with the share of class 1 (0.5 if none).
    """
    shape = shape or Shape()
    known = labels.filter(is_training & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    share = dict(known.groupBy("label").count().toPandas().itertuples(index=False, name=None))
    ones, zeros = share.get(1, 0), share.get(0, 0)
    net = start(shape)
    if not ones or not zeros:
        net.weights["dense"][:] = 0
        net.shift = 0.0 if not ones + zeros else 30.0 if ones else -30.0
        return net
    sample = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    wanted = sample[0].unionByName(sample[1])  # at most 2 x per_class rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, texts in slices(batch, "text"):
                rest = [batch.column(c).slice(at, n) for c in ("doc_id", "label")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([spread_chunks(t, text_limit, shape.chunk) for t in texts], pa.binary())], names=["doc_id", "label", "raw"])

    joined = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(wanted), "doc_id")
    rows = joined.mapInArrow(cut, "doc_id long, label int, raw binary").groupBy("doc_id", "label").agg(F.min("raw").alias("raw")).toArrow()
    picked = sorted(zip(rows.column("doc_id").to_pylist(), rows.column("label").to_pylist(), rows.column("raw").to_pylist(), strict=True))
    target = np.array([p[1] for p in picked], np.float64)
    if len(set(target.tolist())) < 2:
        net.weights["dense"][:] = 0
    else:
        net = fit([p[2] for p in picked], target, shape)
    net.shift = float(np.log(ones / zeros))
    return net


def score(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default ``doc_id``) with ``score`` (probability of label 1, rounded to 6 places) and ``predicted``.

    Only ``text`` is looked at, all of it.  A null text counts as empty, an
    empty one is a chunk of padding.  Repeated rows give repeated results; an
    empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, texts in slices(batch, "_text", 4 << 20):
                p = np.round(probability(shared.value, [(t or "").encode() for t in texts]), 6)
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    source = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    return source.mapInArrow(run, carried(source, "score double, predicted int"))
