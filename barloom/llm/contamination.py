"""Benchmark decontamination: a BM25 index of test items, searched by every passage with block-max WAND."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import lower_ascii, sub_batches, text_bytes

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD_JAVA = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HIT = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,first_word:bigint>>"


@dataclass(frozen=True)
class LeakSettings:
    """A passage of 2 * `stride` words is searched every `stride` words.  Items are indexed in parts of at most `stride`
    words, so every part stands whole in some passage; items with a part whose BM25 score reaches `share` of the score
    the part has with itself are verified by runs of `run` words: question and answer must each show
    `part` of their runs in the document, or both together `whole`.
    """

    stride: int = 64
    share: float = 0.5
    run: int = 5
    part: float = 0.5
    whole: float = 0.6
    k1: float = 1.2
    b: float = 0.75
    item_block: int = 8
    index_bytes: int = 32 << 20


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The words up to the last line, or else the last sentence, and those of it; without either all is question."""
    body = text.strip()
    cut = body.rfind(b"\n")
    if cut < 0:
        ends = [m.end() for m in re.finditer(rb"[.?!][\x20\x09-\x0d]", body)]
        cut = ends[-1] if ends else len(body)
    question, answer = words_of(body[:cut]), words_of(body[cut:])
    return (question, answer) if question else (answer, [])


def runs_found(words: list[bytes], run: int, inside: list[bytes]) -> tuple[int, int]:
    """How many runs of the words stand in `inside`, of how many; fewer words than `run` are one run."""
    size = min(run, len(words))
    if not size:
        return 0, 0
    there = set(zip(*(inside[k:] for k in range(size))))
    runs = list(zip(*(words[k:] for k in range(size))))
    return sum(r in there for r in runs), len(runs)


@dataclass
class ItemIndex:
    """Postings of entries by term, as shares of each entry's score with itself.

    An entry is an item of at most `stride` words or one of the equal parts of a longer one; `owner` has its item.  In
    what follows the search takes entries for items.  They are cut into blocks of `item_block`; for every term and block that holds it the largest share is kept
    (`block_at`, `block_max`, one run from `block_from[term]` to `block_from[term + 1]`).
    """

    settings: LeakSettings
    ids: list[int] = field(default_factory=list)
    parts: list[tuple[list[bytes], list[bytes]]] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)
    terms: dict[bytes, int] = field(default_factory=dict)
    items: list[list[int]] = field(default_factory=list)
    shares: list[list[float]] = field(default_factory=list)
    block_from: np.ndarray = None
    block_at: np.ndarray = None
    block_max: np.ndarray = None
    most: np.ndarray = None
    telling: np.ndarray = None
    needed: np.ndarray = None

    @classmethod
    def build(cls, rows: list[tuple[int, bytes]], holders: dict[bytes, int], n_items: int, mean_words: float,
              settings: LeakSettings) -> ItemIndex:
        """`holders` counts the items of the whole benchmark that hold a word."""
        index = cls(settings)
        for item_id, text in sorted(rows):
            parts = question_and_answer(text)
            words = parts[0] + parts[1]
            if not words:
                continue
            size = math.ceil(len(words) / math.ceil(len(words) / settings.stride))
            for low in range(0, len(words), size):
                index._add(Counter(words[low:low + size]), holders, n_items, mean_words)
            index.ids.append(item_id)
            index.parts.append(parts)
        index.most = np.array([max(s) for s in index.shares] + [0.0])
        index._choose_telling()
        index._block_maxima()
        return index

    def _add(self, counts: Counter, holders: dict[bytes, int], n_items: int, mean_words: float) -> None:
        s = self.settings
        length = s.k1 * (1 - s.b + s.b * sum(counts.values()) / mean_words)
        gain = {w: math.log(1 + (n_items - holders[w] + 0.5) / (holders[w] + 0.5)) * n * (s.k1 + 1) / (n + length)
                for w, n in counts.items()}
        total = sum(gain.values())
        for word, x in gain.items():
            term = self.terms.setdefault(word, len(self.terms))
            if term == len(self.items):
                self.items.append([])
                self.shares.append([])
            self.items[term].append(len(self.owner))
            self.shares[term].append(x / total)
        self.owner.append(len(self.ids))

    def _choose_telling(self) -> None:
        """Frequent terms are set aside while no item owes them more than half of what it needs: where the other
        terms of a passage cannot bring the rest to any item of a block, the block holds no hit for it."""
        common, telling = np.zeros(len(self.owner)), np.ones(len(self.items) + 1, bool)
        telling[-1] = False
        for term in sorted(range(len(self.items)), key=lambda t: -len(self.items[t])):
            after = common.copy()
            after[self.items[term]] += self.shares[term]
            if after.max(initial=0) > self.settings.share / 2:
                break
            common, telling[term] = after, False
        self.telling = telling
        size = self.settings.item_block
        owed = np.zeros(-(-len(self.owner) // size) * size)
        owed[:len(common)] = common
        self.needed = self.settings.share - owed.reshape(-1, size).max(axis=1) - 1e-9

    def _block_maxima(self) -> None:
        at, most, sizes = [], [], []
        for items, shares in zip(self.items, self.shares):
            top: dict[int, float] = {}
            for item, x in zip(items, shares):
                block = item // self.settings.item_block
                top[block] = max(x, top.get(block, 0.0))
            at += top.keys()
            most += top.values()
            sizes.append(len(top))
        self.block_from = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64), [sum(sizes)]])
        self.block_at, self.block_max = np.array(at, np.int64), np.array(most)

    def hopeful(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(passage, block) pairs whose block maxima can reach the threshold, for all passages of a text at once.

        A passage is two neighbouring steps of `stride` words; each distinct term counts once a step, so the sums
        bound the scores from above.
        """
        stride, blocks, terms = self.settings.stride, len(self.needed), len(self.items) + 1
        place = np.flatnonzero(self.telling[ids])
        steps = -(-len(ids) // stride)
        pairs = np.unique(place // stride * terms + ids[place])
        out, span = [], max(2, (1 << 22) // max(1, blocks))
        for low in range(0, steps, span - 1):
            high = min(steps, low + span)
            mine = pairs[np.searchsorted(pairs, low * terms):np.searchsorted(pairs, high * terms)]
            step, term = mine // terms - low, mine % terms
            begin = self.block_from[term]
            size = self.block_from[term + 1] - begin
            ends = np.cumsum(size)
            at = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
            sums = np.bincount(np.repeat(step, size) * blocks + self.block_at[at], self.block_max[at],
                               minlength=(high - low) * blocks).reshape(high - low, blocks)
            if high - low > 1:
                sums = sums[:-1] + sums[1:]
            passage, block = np.nonzero(sums >= self.needed)
            out += zip((passage + low).tolist(), block.tolist())
            if high == steps:
                break
        return out

    def search(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """WAND within one block: (item, share) of its items whose score from these distinct terms reaches the threshold.

        Lists stand at their next item; the pivot is the first list, in order of these items, at which the block
        maxima so far could reach the threshold, and no item before it can.
        """
        need, size = self.settings.share - 1e-9, self.settings.item_block
        first, stop = block * size, min((block + 1) * size, len(self.owner))
        lists = []
        for term in terms:
            items = self.items[term]
            at = bisect_left(items, first)
            if at < len(items) and items[at] < stop:
                where = bisect_left(self.block_at, block, self.block_from[term], self.block_from[term + 1])
                lists.append([items[at], at, float(self.block_max[where]), items, self.shares[term]])
        found = []
        while lists:
            lists.sort(key=lambda x: x[0])
            total, pivot = 0.0, -1
            for k, entry in enumerate(lists):
                total += entry[2]
                if total >= need:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            if lists[0][0] == item:
                score = sum(x[4][x[1]] for x in lists if x[0] == item)
                if score >= need:
                    found.append((item, score))
            to = item + (lists[0][0] == item)
            for entry in lists:
                if entry[0] < to:
                    entry[1] = bisect_left(entry[3], to, entry[1])
                    entry[0] = entry[3][entry[1]] if entry[1] < len(entry[3]) else stop
            lists = [x for x in lists if x[0] < stop]
        return found

    def leaks(self, text: bytes) -> list[dict]:
        """Verified hits of a whole text, each item once with the best of its passages that can be verified."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        s = self.settings
        get, none = self.terms.get, len(self.items)
        ids = np.array([get(w, none) for w in words])
        found: dict[int, dict[int, float]] = {}
        terms: dict[int, list[int]] = {}
        for passage, block in self.hopeful(ids):
            begin = passage * s.stride
            if passage not in terms:
                terms[passage] = [t for t in np.unique(ids[begin:begin + 2 * s.stride]).tolist() if t < none]
            for entry, score in self.search(terms[passage], block):
                scores = found.setdefault(self.owner[entry], {})
                scores[begin] = max(score, scores.get(begin, 0.0))
        hits = []
        for item, scores in sorted(found.items()):
            tried = (self._verified(item, score, begin, words) for begin, score in sorted(scores.items(), key=lambda x: (-x[1], x[0])))
            hits.append(next((h for h in tried if h), None))
        return [h for h in hits if h]

    def _verified(self, item: int, score: float, begin: int, words: list[bytes]) -> dict | None:
        s, (question, answer) = self.settings, self.parts[item]
        around = len(question) + len(answer)
        inside = words[max(0, begin - around):begin + 2 * s.stride + around]
        q, q_all = runs_found(question, s.run, inside)
        a, a_all = runs_found(answer, s.run, inside)
        q_part, a_part = q / q_all, a / a_all if a_all else q / q_all
        if (q_part >= s.part and a_part >= s.part) or (q + a) / (q_all + a_all) >= s.whole:
            return {"item_id": self.ids[item], "score": min(1.0, score), "question_overlap": q_part,
                    "answer_overlap": a_part, "first_word": begin}
        return None


def item_indexes(benchmark: DataFrame, settings: LeakSettings) -> Iterator[ItemIndex]:
    """Indexes over parts of the benchmark of about `index_bytes` each; document counts are those of all items."""
    items = benchmark.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"({WORD_JAVA})"), 1)
    size, n_items, mean = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)), F.count(F.lit(1)),
                                    F.coalesce(F.avg(F.size(words)), F.lit(0.0))).first()
    parts = max(1, math.ceil(size / settings.index_bytes))
    holders = items.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    for part in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        used = mine.select(F.explode(words).alias("word")).distinct()
        counts = {r["word"].encode(): r["n"] for r in holders.join(used, "word").toLocalIterator()}
        rows = [(r["item_id"], r["text"].encode()) for r in mine.toLocalIterator()]
        yield ItemIndex.build(rows, counts, n_items, max(1.0, mean), settings)


def with_leaks(docs: DataFrame, benchmark: DataFrame, column: str, settings: LeakSettings = LeakSettings()) -> DataFrame:
    """The documents, all columns kept, with an array column of verified benchmark hits.

    A null or empty text has none, and neither have items without words.  Rows are independent; whole texts are
    searched; each part of the benchmark index is broadcast under a size bound and takes one more pass.
    """
    out, names = docs.withColumn(column, F.array().cast(HIT)), docs.columns
    for index in item_indexes(benchmark, settings):
        out = _search(out, column, names, docs.sparkSession.sparkContext.broadcast(index))
    return out


def _search(docs: DataFrame, column: str, names: list[str], handle) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = docs.schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = handle.value
        for batch in sub_batches(batches, "text"):
            held = batch.column(column).to_pylist()
            hits = [old + index.leaks(t) for old, t in zip(held, text_bytes(batch, "text"))]
            kind = arrow.field(column).type
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(hits, kind)], [*names, column])

    return docs.mapInArrow(run, schema)


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings()) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word): one row per document and leaked item."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, "_leaks", settings)
    return found.select("doc_id", F.explode("_leaks").alias("hit")).select("doc_id", "hit.*")


def op9_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    return benchmark_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                           spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
