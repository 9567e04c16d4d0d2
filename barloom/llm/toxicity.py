"""Toxicity by a factorization machine over hashed terms: a linear weight per term and learnt pairwise interactions."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import sub_batches, text_values

TERM = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are terms beside the word itself: they tell inflected and compound forms.
STEMS = (3, 4, 5, 6)
#: Arithmetic that turns the id of a beginning into the id of "two or more different words begin so".
AGAIN = (0x9E3779B1, 0x7F4A7C15)


@dataclass(frozen=True)
class MachineSettings:
    """`most_rows` bounds the labelled rows a fit reads, `most_terms` the terms of one of them; those of the smallest
    scrambled hashes are taken.  `pair_terms` is the number of frequent terms whose pairs are looked at."""

    dims: int = 1 << 20
    factors: int = 4
    most_rows: int = 12_000
    most_terms: int = 4096
    least_rows: int = 5
    single_z: float = 4.0
    pair_z: float = 6.5
    pair_terms: int = 1024
    epochs: int = 15
    least_steps: int = 1000
    rate: float = 0.15
    fit_l1: float = 0.0003
    batch: int = 256
    folds: int = 2
    seed: int = 7


class Terms:
    """Hashed term ids of texts: every distinct word (a run of letters, lower-cased), its beginnings, and a further
    term for a beginning that two or more different words of the text share.  Words are remembered up to a bound.

    With `kept`, a mask over the ids, only those ids are returned; a word without any then costs one look-up.
    """

    def __init__(self, dims: int, kept: np.ndarray | None = None):
        self.dims, self.kept = dims, kept
        #: Ids that matter themselves or through their "again" term.
        self.used = None if kept is None else kept | kept[self._again(np.arange(dims))]
        self.known: dict[str, bytes] = {}
        self.begun: dict[str, bytes] = {}

    def _again(self, ids: np.ndarray) -> np.ndarray:
        return (ids.astype(np.int64) * AGAIN[0] + AGAIN[1]) & (self.dims - 1)

    def _id(self, form: str) -> bytes:
        k = zlib.crc32(form.encode()) & (self.dims - 1)
        return b"" if self.used is not None and not self.used[k] else k.to_bytes(4, "little")

    def _ids(self, word: str) -> bytes:
        begun, out = self.begun, [self._id(f"w{word}")]
        for k in STEMS:
            if len(word) <= k:
                break
            start = word[:k]
            packed = begun.get(start)
            if packed is None:
                if len(begun) > 200_000:
                    begun.clear()
                packed = begun[start] = self._id(f"b{start}")
            out.append(packed)
        return b"".join(out)

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct ids of a whole text."""
        words = set(TERM.findall(text.lower()))
        known = self.known
        missing = [w for w in words if w not in known]
        if missing:
            if len(known) > 200_000:
                known.clear()
                missing = words
            for w in missing:
                known[w] = self._ids(w)
        flat = np.sort(np.frombuffer(b"".join([known[w] for w in words]), "<i4"))
        if not len(flat):
            return flat
        first = np.ones(len(flat), bool)
        np.not_equal(flat[1:], flat[:-1], out=first[1:])
        again = flat[~first]
        flat = flat[first]
        if len(again):
            flat = np.sort(np.concatenate([flat, self._again(again).astype(np.int32)]))
            first = np.ones(len(flat), bool)
            np.not_equal(flat[1:], flat[:-1], out=first[1:])
            flat = flat[first]
        return flat if self.kept is None else flat[self.kept[flat]]


def bounded(ids: np.ndarray, most: int) -> np.ndarray:
    """At most `most` ids, those of the smallest scrambled value; the scramble differs between texts."""
    if len(ids) <= most:
        return ids
    salt = zlib.crc32(ids.tobytes()) | 1
    return np.sort(ids[np.argsort((ids.astype(np.int64) * salt) % 0x7FFFFFFF, kind="stable")[:most]])


def hashed_terms(docs: DataFrame, settings: MachineSettings) -> DataFrame:
    """(label, terms array<int>) of labelled documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Terms(settings.dims)
        for batch in sub_batches(batches, "text"):
            terms = [bounded(hashed.of(t), settings.most_terms) for t in text_values(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(terms, pa.list_(pa.int32()))], ["label", "terms"])

    return docs.select("label", "text").mapInArrow(run, "label int, terms array<int>")


@dataclass
class Machine:
    """score = sigmoid(scale * (bias + sum w_i + sum over pairs of v_i . v_j) + shift) over the text's chosen terms.

    `ids` are the chosen terms, sorted; row k of `weights` and `factors` belongs to ids[k].
    """

    dims: int
    ids: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def mask(self) -> np.ndarray:
        out = np.zeros(self.dims, bool)
        out[self.ids] = True
        return out

    def places(self, terms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places in `ids` of all terms that are chosen, and their number in each text."""
        sizes = np.array([len(t) for t in terms], np.int64)
        flat = np.concatenate([*terms, np.empty(0, np.int32)]).astype(np.int64)
        if not len(self.ids):
            return np.empty(0, np.int64), np.zeros(len(terms), np.int64)
        place = np.minimum(np.searchsorted(self.ids, flat), len(self.ids) - 1)
        hit = self.ids[place] == flat
        rows = np.repeat(np.arange(len(terms)), sizes)
        return place[hit], np.bincount(rows[hit], minlength=len(terms))

    def margins(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.full(len(sizes), self.bias)
        some = np.flatnonzero(sizes)
        if len(some):
            starts = np.cumsum(sizes[some]) - sizes[some]
            v = self.factors[flat]
            sums = np.add.reduceat(v, starts, axis=0)
            pairs = 0.5 * (sums ** 2 - np.add.reduceat(v ** 2, starts, axis=0)).sum(axis=1)
            out[some] += np.add.reduceat(self.weights[flat], starts) + pairs
        return out

    def scores(self, terms: list[np.ndarray]) -> np.ndarray:
        return logistic(self.scale * self.margins(*self.places(terms)) + self.shift)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def chosen_terms(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, settings: MachineSettings) -> np.ndarray:
    """Ids of the terms worth a weight, sorted: those that tell by themselves or together with another term.

    A term tells alone if the number of label-1 rows that hold it lies `single_z` deviations off its expectation.  A
    pair of the `pair_terms` most frequent terms tells if the sum of the labels' residuals over rows with both lies
    `pair_z` deviations off zero; that sees terms of no use alone.  Terms in fewer than `least_rows` rows are ignored.
    """
    rows = np.repeat(np.arange(len(sizes)), sizes)
    seen = np.bincount(flat, minlength=settings.dims)
    toxic = np.bincount(flat, labels[rows], minlength=settings.dims)
    n, rate = len(labels), labels.mean()
    share = seen / n
    spread = np.sqrt(np.maximum(seen * rate * (1 - rate) * (1 - share), 1e-9))
    often = seen >= settings.least_rows
    alone = often & (np.abs(toxic - seen * rate) >= settings.single_z * spread)
    most = np.argsort(-np.where(often & (seen < n), seen, 0), kind="stable")[:settings.pair_terms]
    most = np.sort(most[often[most] & (seen[most] < n)])
    paired = np.zeros(len(most), bool)
    if len(most) > 1:
        column = np.full(settings.dims, -1)
        column[most] = np.arange(len(most))
        both = np.zeros((len(most), len(most)), np.float32)
        tell = np.zeros_like(both)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for low in range(0, n, 2048):
            high = min(n, low + 2048)
            part = slice(starts[low], starts[high])
            at, row = column[flat[part]], rows[part] - low
            held = np.zeros((high - low, len(most)), np.float32)
            held[row[at >= 0], at[at >= 0]] = 1
            both += held.T @ held
            tell += held.T @ (held * (labels[low:high, None] - rate).astype(np.float32))
        z = np.abs(tell) / np.sqrt(np.maximum(both * rate * (1 - rate), 1e-9))
        z[both < settings.least_rows] = 0
        np.fill_diagonal(z, 0)
        paired = z.max(axis=1) >= settings.pair_z
    alone[most[paired]] = True
    return np.flatnonzero(alone)


def fit_machine(terms: list[np.ndarray], labels: np.ndarray, settings: MachineSettings) -> Machine:
    """Chosen terms, adaptive gradient steps on the logistic loss of weights and interactions, and a calibration.

    The calibration fits scale and shift of the margin on rows that each fold's machine has not seen, so that 0.5 is
    the point where both labels are equally likely.  Without rows of both labels the machine answers the labels' rate.
    """
    sizes = np.array([len(t) for t in terms], np.int64)
    flat = np.concatenate([*terms, np.empty(0, np.int32)]).astype(np.int64)
    rate = (labels.sum() + 1) / (len(labels) + 2)
    empty = Machine(settings.dims, np.empty(0, np.int64), float(np.log(rate / (1 - rate))), np.empty(0),
                    np.empty((0, settings.factors)))
    if not 0 < labels.sum() < len(labels):
        return empty
    starts = np.concatenate([[0], np.cumsum(sizes)])
    fold = np.random.default_rng(settings.seed).permutation(len(labels)) % settings.folds
    unseen = np.full(len(labels), np.nan)
    for k in range(settings.folds if len(labels) >= 20 * settings.folds else 0):
        known = fold != k
        if 0 < labels[known].sum() < known.sum():
            rows = np.flatnonzero(~known)
            machine = descend(*_some(flat, starts, np.flatnonzero(known)), labels[known], settings)
            unseen[rows] = machine.margins(*machine.places([flat[starts[r]:starts[r + 1]] for r in rows]))
    machine = descend(flat, sizes, labels, settings)
    some = ~np.isnan(unseen)
    if 0 < labels[some].sum() < some.sum():
        machine.scale, machine.shift = calibration(unseen[some], labels[some])
    return machine


def _some(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([flat[starts[r]:starts[r + 1]] for r in rows]), starts[rows + 1] - starts[rows]


def calibration(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale (positive) and shift of a logistic curve through the margins, by Newton steps with a weak pull."""
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = logistic(x @ beta)
        slope = x.T @ (p - labels) + 1e-2 * (beta - [1, 0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(curve, slope), -1, 1)
    return max(float(beta[0]), 0.05), float(beta[1])


def descend(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, settings: MachineSettings) -> Machine:
    """Proximal adaptive gradient descent over shuffled batches of rows, on the terms that `chosen_terms` keeps."""
    rng = np.random.default_rng(settings.seed)
    rate = (labels.sum() + 1) / (len(labels) + 2)
    ids = chosen_terms(flat, sizes, labels, settings)
    w, v = np.zeros(len(ids)), rng.normal(0, 0.01, (len(ids), settings.factors))
    machine = Machine(settings.dims, ids, float(np.log(rate / (1 - rate))), w, v)
    if not len(ids):
        return machine
    column = np.full(settings.dims, -1, np.int64)
    column[ids] = np.arange(len(ids))
    place, rows = column[flat], np.repeat(np.arange(len(sizes)), sizes)
    place, rows = place[place >= 0], rows[place >= 0]
    sizes = np.bincount(rows, minlength=len(labels))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    w_sum, v_sum, b_sum = np.full(len(ids), 1e-6), np.full((len(ids), 1), 1e-6), 1e-6
    for _ in range(max(settings.epochs, -(-settings.least_steps * settings.batch // len(labels)))):
        order = rng.permutation(len(labels))
        for low in range(0, len(order), settings.batch):
            some = order[low:low + settings.batch]
            counts = sizes[some]
            at = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            now = place[at]
            error = (logistic(machine.margins(now, counts)) - labels[some]) / len(some)
            b_sum += error.sum() ** 2
            machine.bias -= settings.rate * error.sum() / np.sqrt(b_sum)
            if not len(now):
                continue
            each, full = np.repeat(error, counts), counts[counts > 0]
            sums = np.repeat(np.add.reduceat(v[now], np.cumsum(full) - full, axis=0), full, axis=0)
            used, back = np.unique(now, return_inverse=True)
            g_w = np.bincount(back, each, len(used))
            pull = each[:, None] * (sums - v[now])
            g_v = np.stack([np.bincount(back, pull[:, f], len(used)) for f in range(settings.factors)], axis=1)
            w_sum[used] += g_w ** 2
            v_sum[used] += (g_v ** 2).mean(axis=1, keepdims=True)
            step = settings.rate / np.sqrt(w_sum[used])
            w[used] = shrunk(w[used] - step * g_w, step * settings.fit_l1)
            step = 0.1 * settings.rate / np.sqrt(v_sum[used])
            v[used] = shrunk(v[used] - step * g_v, step * settings.fit_l1)
    return machine


def shrunk(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Pulled towards zero: what the data do not hold up against stays exactly zero."""
    return np.sign(x) * np.maximum(0, np.abs(x) - by)


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the checksum of its id; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train_machine(docs: DataFrame, labels: DataFrame, settings: MachineSettings = MachineSettings()) -> Machine:
    """A machine from at most `most_rows` labelled rows that are not held out; only hashed terms reach the driver.

    A document with several labels counts as toxic if any says so; null labels and ids are left out.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.most_rows)
    # at most `most_rows` small rows, so the texts stay where they are
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # rows that share an id each count, so the bound is set once more on the hashed rows
    table = hashed_terms(marked, settings).orderBy(F.xxhash64("label", "terms")).limit(settings.most_rows).toArrow()
    label = table["label"].to_numpy().astype(float)
    terms = [np.asarray(t.values.to_numpy()) for t in table["terms"]]
    return fit_machine(terms, label, settings)


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, over its whole text.

    Null and empty texts hold no term and get the score of the bias alone; rows are independent, so repeated rows
    repeat their score; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    handle = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = handle.value
        hashed = Terms(fitted.dims, fitted.mask())
        for batch in sub_batches(batches, "text"):
            terms = [hashed.of(t) for t in text_values(batch, "text")]
            scores = fitted.scores(terms)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents, with all their columns, whose score is below 0.5; scored row by row without a join."""
    handle = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = handle.value
        hashed = Terms(fitted.dims, fitted.mask())
        for batch in sub_batches(batches, "text"):
            terms = [hashed.of(t) for t in text_values(batch, "text")]
            yield batch.filter(pa.array(fitted.scores(terms) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, train_machine(docs, labels))
