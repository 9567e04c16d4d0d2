"""Text quality by a byte-level convolutional network in numpy: filters over overlapping chunks of the whole document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import sub_batches, text_bytes

#: Symbols of the input: 256 bytes and the filling behind a text's end.
SYMBOLS = 257
FILL = 256
#: Neighbouring places whose maximum is taken first, and places worked on at a time.
BLOCK = 64
TILE = 64 * BLOCK


@dataclass(frozen=True)
class NetworkSettings:
    """`most_rows` bounds the labelled rows a fit reads and `row_chunks` the chunks of one of them (spread evenly over its
    whole length); those rows of the smallest hashed id are taken.  Scoring reads every chunk of every text."""

    #: Places of a filter in a chunk, and from one chunk to the next; both are multiples of BLOCK.
    chunk: int = 256
    step: int = 192
    width: int = 6
    filters: int = 16
    hidden: int = 16
    most_rows: int = 6000
    row_chunks: int = 6
    epochs: int = 12
    least_steps: int = 600
    rate: float = 0.004
    batch: int = 64
    decay: float = 1e-4
    seed: int = 11


@dataclass
class Network:
    """Per position and filter: relu(bias + sum of table[j, byte at j]); per chunk the maximum over its positions.

    A document is the maximum, the mean and the minimum of its chunks' maxima, through one hidden layer, to a probability.
    """

    settings: NetworkSettings
    table: np.ndarray
    bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.inner, self.inner_bias, self.outer, self.outer_bias]

    def paired(self) -> list[np.ndarray]:
        """Tables of two neighbouring symbols each, so that a place takes half the look-ups."""
        tables = []
        for j in range(0, self.settings.width, 2):
            table = self.table[j][:, None, :] + (self.table[j + 1][None] if j + 1 < self.settings.width else 0)
            tables.append(np.ascontiguousarray(np.broadcast_to(table, (SYMBOLS, SYMBOLS, table.shape[2]))).reshape(-1, table.shape[2]))
        return tables

    def maxima(self, texts: list[bytes], tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Largest filter answers of every chunk of every text, and the number of chunks of each text.

        Overlapping chunks share their places: a filter is answered once a place, block maxima make up the chunks.
        """
        s = self.settings
        counts = np.array([chunk_count(len(t), s) for t in texts], np.int64)
        places = (counts - 1) * s.step + s.chunk
        starts = np.cumsum(places) - places
        # the symbols behind a text's places are those of no text
        gap = s.width
        symbols = np.full(int(places.sum()) + gap * len(texts) + 1, FILL, np.int16)
        for k, text in enumerate(texts):
            low = int(starts[k]) + gap * k
            symbols[low:low + len(text)] = np.frombuffer(text, np.uint8)
        wanted = np.concatenate([np.arange(int(starts[k]) + gap * k, int(starts[k]) + gap * k + int(places[k]), BLOCK)
                                 for k in range(len(texts))])
        blocks = np.empty((len(wanted), s.filters), np.float32)
        total, more = np.empty((TILE, s.filters), np.float32), np.empty((TILE, s.filters), np.float32)
        within = np.arange(BLOCK)
        for low in range(0, len(wanted), TILE // BLOCK):
            at = (wanted[low:low + TILE // BLOCK, None] + within).ravel()
            n = len(at)
            for j, table in enumerate(tables):
                pairs = symbols[at + 2 * j].astype(np.int32) * SYMBOLS + symbols[at + 2 * j + 1]
                np.take(table, pairs, axis=0, out=more[:n] if j else total[:n], mode="clip")
                if j:
                    total[:n] += more[:n]
            blocks[low:low + TILE // BLOCK] = total[:n].reshape(-1, BLOCK, s.filters).max(axis=1)
        first = np.repeat(np.cumsum(places // BLOCK) - places // BLOCK, counts)
        number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = (first + number * (s.step // BLOCK))[:, None] + np.arange(s.chunk // BLOCK)
        return np.maximum(blocks[at].max(axis=1) + self.bias, 0), counts

    def pooled(self, maxima: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Maximum, mean and minimum over the chunks of each document."""
        starts = np.cumsum(counts) - counts
        return np.concatenate([np.maximum.reduceat(maxima, starts), np.add.reduceat(maxima, starts) / counts[:, None],
                               np.minimum.reduceat(maxima, starts)], axis=1)

    def margins(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled @ self.inner + self.inner_bias, 0) @ self.outer + self.outer_bias[0]

    def scores(self, texts: list[bytes], tables: list[np.ndarray] | None = None) -> np.ndarray:
        if not texts:
            return np.empty(0)
        maxima, counts = self.maxima(texts, tables or self.paired())
        return logistic(self.margins(self.pooled(maxima, counts)).astype(float))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def chunk_count(length: int, settings: NetworkSettings) -> int:
    return 1 + max(0, -(-(length - settings.chunk) // settings.step))


def cut(text: bytes, settings: NetworkSettings) -> np.ndarray:
    """All chunks of a text, `step` apart: the symbols of `chunk` places and of the rest of the last place's filter.

    Neighbours overlap and no byte is left out.  The last chunk is filled up; an empty text is one chunk of filling.
    """
    more, window = settings.width, settings.chunk + settings.width - 1
    symbols = np.full((chunk_count(len(text), settings) - 1) * settings.step + settings.chunk + more, FILL, np.int16)
    symbols[:len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(symbols, window)[::settings.step][:chunk_count(len(text), settings)]


def sampled(text: bytes, settings: NetworkSettings) -> np.ndarray:
    """At most `row_chunks` chunks spread evenly over the whole text, as bytes of 16-bit symbols."""
    chunks = cut(text, settings)
    if len(chunks) <= settings.row_chunks:
        return chunks
    return chunks[np.linspace(0, len(chunks) - 1, settings.row_chunks).round().astype(int)]


def fit_network(chunks: np.ndarray, counts: np.ndarray, labels: np.ndarray, settings: NetworkSettings) -> Network:
    """Adam steps on the logistic loss over shuffled batches of documents, both labels weighing the same in sum.

    Only the winning positions of a chunk carry a filter's gradient.  Without rows of both labels the network answers
    the labels' rate for every text.
    """
    rng = np.random.default_rng(settings.seed)
    rate = (labels.sum() + 1) / (len(labels) + 2)
    wide = 3 * settings.filters
    net = Network(settings, rng.normal(0, 0.15, (settings.width, SYMBOLS, settings.filters)).astype(np.float32),
                  np.zeros(settings.filters, np.float32), rng.normal(0, 0.2, (wide, settings.hidden)).astype(np.float32),
                  np.zeros(settings.hidden, np.float32), np.zeros(settings.hidden, np.float32),
                  np.array([np.log(rate / (1 - rate))], np.float32))
    if not 0 < labels.sum() < len(labels):
        return net
    net.outer[:] = rng.normal(0, 0.2, settings.hidden)
    net.outer_bias[0] = 0
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    starts = np.cumsum(counts) - counts
    steps = -(-len(labels) // settings.batch)
    epochs = max(settings.epochs, -(-settings.least_steps // steps))
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for low in range(0, len(order), settings.batch):
            rows = order[low:low + settings.batch]
            some = np.concatenate([np.arange(starts[r], starts[r] + counts[r]) for r in rows])
            grads = gradients(net, chunks[some], counts[rows], labels[rows], weight[rows])
            done += 1
            fade = 0.5 * (1 + np.cos(np.pi * done / (epochs * steps)))
            for p, g, (m, v) in zip(net.parts(), grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= settings.rate * fade * (m / (1 - 0.9 ** done) / (np.sqrt(v / (1 - 0.999 ** done)) + 1e-7)
                                             + settings.decay * p)
    return net


def gradients(net: Network, chunks: np.ndarray, counts: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted mean loss for all parts of the network."""
    width = net.settings.width
    span = chunks.shape[1] - width + 1
    total = net.table[0][chunks[:, :span]]
    for j in range(1, width):
        total += net.table[j][chunks[:, j:j + span]]
    best = total.argmax(axis=1)
    raw = np.take_along_axis(total, best[:, None, :], axis=1)[:, 0] + net.bias
    maxima = np.maximum(raw, 0)
    pooled = net.pooled(maxima, counts)
    inner = pooled @ net.inner + net.inner_bias
    active = np.maximum(inner, 0)
    error = ((logistic(active @ net.outer + net.outer_bias[0]) - labels) * weight / len(labels)).astype(np.float32)
    g_outer, g_outer_bias = active.T @ error, np.array([error.sum()], np.float32)
    g_active = np.outer(error, net.outer) * (inner > 0)
    g_inner, g_inner_bias = pooled.T @ g_active, g_active.sum(axis=0)
    g_pooled = g_active @ net.inner.T
    n = net.settings.filters
    starts, rows = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    g_max = (g_pooled[:, n:2 * n] / counts[:, None])[rows]
    for part, wins in ((g_pooled[:, :n], pooled[:, :n]), (g_pooled[:, 2 * n:], pooled[:, 2 * n:])):
        held = maxima == wins[rows]
        share = np.add.reduceat(held.astype(np.float32), starts)
        g_max += held * (part / share)[rows]
    g_max = g_max * (raw > 0)
    g_table = np.zeros_like(net.table)
    filters = np.broadcast_to(np.arange(n), best.shape)
    for j in range(width):
        symbols = np.take_along_axis(chunks, best + j, axis=1)
        g_table[j] = np.bincount((symbols.astype(np.int64) * n + filters).ravel(), g_max.ravel(), SYMBOLS * n).reshape(SYMBOLS, n)
    return [g_table, g_max.sum(axis=0), g_inner, g_inner_bias, g_outer, g_outer_bias]


def held_out(doc_id: Column) -> Column:
    """Rows whose id's checksum leaves 1 when divided by 3; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train_network(docs: DataFrame, labels: DataFrame, settings: NetworkSettings = NetworkSettings()) -> Network:
    """A network from at most `most_rows` labelled rows that are not held out; only their sampled chunks reach the driver.

    A document with several labels counts as good if any says so; null labels and ids are left out.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.most_rows)
    # at most `most_rows` small rows, so the texts stay where they are
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            chunks = [np.ascontiguousarray(sampled(t, settings)).tobytes() for t in text_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(chunks, pa.binary())], ["label", "chunks"])

    # rows that share an id each count, so the bound is set once more on the rows
    table = marked.mapInArrow(run, "label int, chunks binary").orderBy(F.xxhash64("chunks", "label")).limit(
        settings.most_rows).toArrow()
    labels_ = table["label"].to_numpy().astype(float)
    rows = [np.frombuffer(c.as_py(), np.int16).reshape(-1, settings.chunk + settings.width - 1) for c in table["chunks"]]
    chunks = np.concatenate([*rows, np.empty((0, settings.chunk + settings.width - 1), np.int16)])
    return fit_network(chunks, np.array([len(r) for r in rows], np.int64), labels_, settings)


def score_quality(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, over its whole text.

    Null and empty texts are one chunk of filling; rows are independent, so repeated rows repeat their score; other
    columns are not read; an empty table has no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    handle = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = handle.value
        tables = fitted.paired()
        for batch in sub_batches(batches, "text"):
            scores = fitted.scores(text_bytes(batch, "text"), tables)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, train_network(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
