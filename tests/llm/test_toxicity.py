import random
import zlib

import numpy as np
import pytest

from barloom.llm import toxicity

from .frames import documents, empty

QUICK = toxicity.MachineSettings(dims=1 << 14)


def labelled(n, seed):
    """Single insults are toxic; an `attack` word is so only together with a `group` word."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 60))]
        kind = rng.random()
        toxic = kind < 0.3
        if kind < 0.15:
            words.append("moron")
        elif kind < 0.3:
            words += ["attack", "group"]
        elif kind < 0.45:
            words.append("attack")
        elif kind < 0.6:
            words.append("group")
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_interactions_are_learnt():
    rows = labelled(3000, 1)
    hashed = toxicity.Terms(QUICK.dims)
    terms = [hashed.of(t) for _, t, _ in rows]
    labels = np.array([y for *_, y in rows], float)
    machine = toxicity.fit_machine(terms[:2400], labels[:2400], QUICK)
    right = ((machine.scores(terms[2400:]) >= 0.5) == labels[2400:]).mean()
    assert right > 0.97


@pytest.mark.parametrize("both", [True, False])
def test_terms_that_tell_only_together(both):
    rng = np.random.default_rng(4)
    words = ["aa", "bb", "filler", "more", "other", "none"]
    texts = [" ".join(w for w, k in zip(words, rng.random(len(words)) < 0.5) if k) for _ in range(6000)]
    labels = np.array([(("aa" in t) == ("bb" in t)) == both for t in texts], float)
    hashed = toxicity.Terms(QUICK.dims)
    terms = [hashed.of(t) for t in texts]
    machine = toxicity.fit_machine(terms[:5000], labels[:5000], QUICK)
    assert ((machine.scores(terms[5000:]) >= 0.5) == labels[5000:]).mean() > 0.95


def test_terms_of_a_text():
    dims = 1 << 20
    hashed = toxicity.Terms(dims)

    def crc(form):
        return zlib.crc32(form.encode()) & (dims - 1)

    stems = {crc(f"b{w[:k]}") for w in ("scumbag", "scummy") for k in (3, 4, 5, 6) if len(w) > k}
    again = {(crc(f"b{s}") * toxicity.AGAIN[0] + toxicity.AGAIN[1]) & (dims - 1) for s in ("scu", "scum")}
    want = {crc("wscumbag"), crc("wscummy")} | stems | again
    assert hashed.of("Scumbag scummy, SCUMMY!").tolist() == sorted(want)
    kept = np.zeros(dims, bool)
    kept[[crc("wscummy"), *again]] = True
    assert toxicity.Terms(dims, kept).of("scumbag scummy other").tolist() == sorted({crc("wscummy"), *again})
    assert len(toxicity.bounded(np.arange(1000, dtype=np.int32), 10)) == 10


def test_repeated_rows_keep_the_bound(spark):
    docs = spark.range(4000).selectExpr("id % 2 + 1 as doc_id", "concat('word', id % 7) as text")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    seen = []
    fit, toxicity.fit_machine = toxicity.fit_machine, lambda t, y, s: seen.append(len(y)) or fit(t, y, s)
    try:
        toxicity.train_machine(docs, labels, toxicity.MachineSettings(dims=1 << 14, most_rows=2))
    finally:
        toxicity.fit_machine = fit
    assert seen and seen[0] <= 2


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    machine = toxicity.Machine(64, np.arange(0, 50), 0.3, rng.normal(size=50), rng.normal(size=(50, 3)), 2.0, 0.5)
    for terms in ([], [4], [1, 7, 9, 20, 60]):
        known = [i for i in terms if i < 50]
        want = 0.3 + sum(machine.weights[i] for i in known) + sum(
            machine.factors[i] @ machine.factors[j] for i in known for j in known if i < j)
        some = [np.array(terms, np.int32), np.array([3], np.int32)]
        assert np.isclose(machine.margins(*machine.places(some))[0], want)
        assert np.isclose(machine.scores(some)[0], 1 / (1 + np.exp(-2 * want - 0.5)))


def test_rows_and_awkward_input(spark):
    rows = labelled(1500, 2)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows] + [(None, 1, 1), (5, 1, None)],
                                   "doc_id long, quality int, toxic int")
    machine = toxicity.train_machine(docs, labels, QUICK)
    again = toxicity.train_machine(docs.repartition(7), labels.repartition(3), QUICK)
    assert (machine.weights == again.weights).all() and (machine.factors == again.factors).all()
    scored = toxicity.score_toxicity(docs, machine).collect()
    truth = {k: y for k, _, y in rows}
    out = [r for r in scored if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    odd = documents(spark)
    got = toxicity.score_toxicity(odd, machine).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept = toxicity.drop_toxic(odd, machine)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score_toxicity(empty(odd), machine).count() == 0


def test_held_out_labels_and_one_class(spark):
    rows = labelled(400, 3)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = [(k, y if zlib.crc32(str(k).encode()) % 5 else 1 - y) for k, _, y in rows]
    one = toxicity.train_machine(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"), QUICK)
    two = toxicity.train_machine(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), QUICK)
    assert (one.weights == two.weights).all()
    none = toxicity.train_machine(docs, spark.createDataFrame([(k, 0) for k, *_ in rows], "doc_id long, toxic int"), QUICK)
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} == {0}
    assert toxicity.train_machine(docs, spark.createDataFrame([], "doc_id long, toxic int"), QUICK).bias == 0.0
