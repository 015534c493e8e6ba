"""Quality network: learning, whole texts, corner cases."""

import numpy as np
from pyspark.sql import functions as F

from scanloom.llm import quality_cnn
from scanloom.llm.common import held_out


def auc(p, y):
    a, b = p[y == 1], p[y == 0]
    return ((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])).mean()


def test_held_out_ranking(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    net = quality_cnn.train(docs, labels, ~held_out("doc_id", 3, 1))
    got = quality_cnn.score(docs, net).join(labels.select("doc_id", "quality"), "doc_id").filter(held_out("doc_id", 3, 1)).toPandas()
    assert len(got) > 80 and auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.9
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_gradients():
    rng = np.random.default_rng(0)
    net = quality_cnn.start(quality_cnn.Shape(filters=3, chunk=32))
    texts, y, w = [bytes(rng.integers(1, 255, n).astype(np.uint8)) for n in (5, 40, 100)], np.array([1.0, 0.0, 1.0]), np.ones(3)
    net.weights = {k: v.astype(np.float32) for k, v in net.weights.items()}
    grads, own = quality_cnn._gradients(net, texts, y, w)

    def loss():
        p = quality_cnn.probability(net, texts)
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    assert abs(own - loss()) < 1e-6
    for name in ("filters", "bias", "dense", "out"):
        flat = net.weights[name].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            old, step = flat[i].copy(), 1e-2
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - grads[name].reshape(-1)[i]) < 2e-2


def test_whole_text_counts_and_neighbours_do_not():
    net = quality_cnn.start(quality_cnn.Shape())
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (0, 1, 7, 250, 252, 255, 256, 257, 5000, 400000)]
    together = quality_cnn.probability(net, texts)
    alone = np.concatenate([quality_cnn.probability(net, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-6)
    net.weights["filters"][:] = 0
    net.weights["embed"][:] = 0
    net.weights["embed"][200] = 1
    net.weights["filters"][:, 0] = 1
    net.weights["dense"][:] = 1
    plain = b"a" * 100001
    for at in (0, 50000, 100000):  # one odd byte anywhere is seen
        assert quality_cnn.probability(net, [plain[:at] + b"\xc8" + plain[at + 1 :]])[0] > quality_cnn.probability(net, [plain])[0]


def test_corner_cases(spark):
    docs = spark.createDataFrame([(1, "good text", 5), (2, None, 5), (3, "", 5), (None, "x", 5), (1, "good text", 5), (4, "z" * 100000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (9, 0)], "doc_id long, quality int")
    net = quality_cnn.train(docs, labels, F.lit(True))
    got = quality_cnn.score(docs, net).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    none = quality_cnn.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_cnn.score(docs, none).collect()} == {0.5}
    ones = quality_cnn.train(docs, labels.filter("quality = 1"), F.lit(True))
    assert all(r.predicted == 1 for r in quality_cnn.score(docs, ones).collect())
    assert quality_cnn.score(docs.limit(0), net).collect() == []


def test_probability_is_the_plain_convolution():
    """Window by window and chunk by chunk in plain Python."""
    rng = np.random.default_rng(1)
    shape = quality_cnn.Shape(embed=2, width=12, stride=4, filters=5, chunk=32)
    net = quality_cnn.start(shape)
    net.shift = 0.3
    w = {k: v.astype(float).tolist() for k, v in net.weights.items()}
    texts = [b"", b"x", bytes(range(1, 29)), b"a" * 32, bytes(rng.integers(1, 256, 31).tolist()), bytes(rng.integers(1, 256, 500).tolist())]

    def plain(text):
        chunks = max(1, -(-(len(text) + 4) // 32))
        padded = list(text) + [0] * (chunks * 32 + 12 - len(text))
        starts = list(range(0, chunks * 32, 4))[:-2]  # the last two windows would reach past the last chunk
        best = [[-np.inf] * 5 for _ in range(chunks)]
        for s in starts:
            window = [x for byte in padded[s : s + 12] for x in w["embed"][byte]]
            for f in range(5):
                best[s // 32][f] = max(best[s // 32][f], sum(x * w["filters"][i][f] for i, x in enumerate(window)))
        pooled = [[max(0.0, b + w["bias"][f]) for f, b in enumerate(row)] for row in best]
        features = [max(row[f] for row in pooled) for f in range(5)] + [sum(row[f] for row in pooled) / chunks for f in range(5)]
        logit = sum(x * d for x, d in zip(features, w["dense"])) + w["out"][0] + 0.3
        return 1 / (1 + np.exp(-logit))

    assert np.allclose(quality_cnn.probability(net, texts), [plain(t) for t in texts], atol=1e-6)
