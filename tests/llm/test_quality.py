import random
import zlib

import numpy as np
import pytest

from barloom.llm import quality

from .frames import documents, empty

QUICK = quality.NetworkSettings(filters=8, hidden=8, epochs=6)


def random_network(settings, seed=1):
    rng = np.random.default_rng(seed)
    f, h = settings.filters, settings.hidden
    return quality.Network(settings, rng.normal(size=(settings.width, quality.SYMBOLS, f)).astype(np.float32),
                           rng.normal(size=f).astype(np.float32), rng.normal(size=(3 * f, h)).astype(np.float32),
                           rng.normal(size=h).astype(np.float32), rng.normal(size=h).astype(np.float32),
                           rng.normal(size=1).astype(np.float32))


def plain_score(net, text):
    """The definition, place by place."""
    s = net.settings
    count = 1
    while (count - 1) * s.step + s.chunk < len(text):
        count += 1
    symbols = list(text) + [quality.FILL] * (count * s.step + s.chunk + s.width)
    maxima = []
    for c in range(count):
        answers = [sum(net.table[j, symbols[p + j]].astype(float) for j in range(s.width)) + net.bias
                   for p in range(c * s.step, c * s.step + s.chunk)]
        maxima.append(np.maximum(np.max(answers, axis=0), 0))
    pooled = np.concatenate([np.max(maxima, axis=0), np.mean(maxima, axis=0), np.min(maxima, axis=0)])
    margin = np.maximum(pooled @ net.inner + net.inner_bias, 0) @ net.outer + net.outer_bias[0]
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


@pytest.mark.parametrize("width", [5, 6])
def test_scores_by_definition(width):
    settings = quality.NetworkSettings(filters=5, hidden=4, width=width)
    net = random_network(settings)
    net.outer *= 0.02
    rng = random.Random(2)
    texts = [b"", b"a", *(bytes(rng.randrange(256) for _ in range(n)) for n in (255, 256, 257, 448, 449, 1000, 5000))]
    assert np.allclose(net.scores(texts), [plain_score(net, t) for t in texts], atol=1e-4)
    assert np.allclose(net.scores(texts), [net.scores([t])[0] for t in texts], atol=1e-6)


def test_gradients_are_differences():
    settings = quality.NetworkSettings(filters=3, hidden=4)
    net = random_network(settings, 5)
    net.outer *= 0.1
    for name in ("table", "bias", "inner", "inner_bias", "outer", "outer_bias"):
        setattr(net, name, getattr(net, name).astype(float))
    rng = random.Random(6)
    texts = [bytes(rng.randrange(60, 80) for _ in range(n)) for n in (30, 300, 700)]
    chunks = [quality.cut(t, settings) for t in texts]
    counts, labels, weight = np.array([len(c) for c in chunks]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    flat = np.concatenate(chunks)

    def loss():
        p = net.scores(texts, [t.astype(np.float64) for t in net.paired()])
        return -(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / len(labels)

    grads = quality.gradients(net, flat, counts, labels, weight)
    for part, grad in zip(net.parts(), grads):
        places = [np.unravel_index(k, part.shape) for k in np.argsort(-np.abs(grad).ravel())[:4]]
        for at in places:
            kept, ends = part[at], []
            for move in (1e-3, -1e-3):
                part[at] = kept + move
                ends.append(loss())
            part[at] = kept
            assert np.isclose((ends[0] - ends[1]) / 2e-3, grad[at], rtol=0.05, atol=2e-4)


def labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 200))]
        good = rng.random() < 0.7
        if not good:
            words = rng.choice([[w + "###" for w in words], [w.upper() + "!!" for w in words], [w for w in words[:6] for _ in range(20)]])
        rows.append((k, " ".join(words), int(good)))
    return rows


def test_rows_and_awkward_input(spark):
    rows = labelled(1500, 2)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in rows] + [(None, 1, 1), (5, None, 1)],
                                   "doc_id long, quality int, toxic int")
    net = quality.train_network(docs, labels, QUICK)
    again = quality.train_network(docs.repartition(7), labels.repartition(3), QUICK)
    assert all((a == b).all() for a, b in zip(net.parts(), again.parts()))
    scored = quality.score_quality(docs, net).collect()
    truth = {k: y for k, _, y in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    assert np.mean([r.predicted == truth[r.doc_id] for r in scored if r.held_out]) > 0.95
    odd = documents(spark)
    got = quality.score_quality(odd, net).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.score_quality(empty(odd), net).count() == 0
    # the last chunk of a long text counts
    clean, dirty = rows[0][1] * 200, rows[0][1] * 200 + " junk###" * 500
    assert net.scores([clean.encode()])[0] != net.scores([dirty.encode()])[0]


def test_held_out_labels_one_class_and_bound(spark, monkeypatch):
    rows = labelled(300, 3)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 3 == 1 else y) for k, _, y in rows]
    one = quality.train_network(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int"), QUICK)
    two = quality.train_network(docs, spark.createDataFrame(flipped, "doc_id long, quality int"), QUICK)
    assert all((a == b).all() for a, b in zip(one.parts(), two.parts()))
    none = quality.train_network(docs, spark.createDataFrame([(k, 1) for k, *_ in rows], "doc_id long, quality int"), QUICK)
    assert {r.predicted for r in quality.score_quality(docs, none).collect()} == {1}
    assert quality.train_network(docs, spark.createDataFrame([], "doc_id long, quality int"), QUICK).scores([b""])[0] == 0.5
    seen = []
    monkeypatch.setattr(quality, "fit_network", lambda c, n, y, s: seen.append(len(y)))
    again = spark.range(3000).selectExpr("id % 2 as doc_id", "concat('t', id) as text")
    marks = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    quality.train_network(again, marks, quality.NetworkSettings(most_rows=2))
    assert seen[0] <= 2
