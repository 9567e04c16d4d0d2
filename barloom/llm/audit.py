"""Filter interaction audit: a sparse document-term matrix decides the word filters, and one small cube all filter orders."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import stored, sub_batches, text_bytes

FILTERS = "ABCDE"
MARKS = b"#$%&*|"
UPPER = np.zeros(256, np.int64)
UPPER[65:91] = 1
POINTS = (np.arange(256) & 0xC0 != 0x80).astype(np.int64)
MARKED = np.isin(np.arange(256), np.frombuffer(MARKS, np.uint8)).astype(np.int64)

#: One CSR shard a row: documents in order with byte statistics; `indptr` (64-bit), `columns` and `counts` (32-bit) are
#: compressed little-endian numbers, `words` those of the shard's own codes in order, parted by blanks.
SHARD = ("shard long, doc_ids array<{id}>, sources array<string>, digests array<binary>, upper array<bigint>, "
         "points array<bigint>, marked array<boolean>, indptr binary, columns binary, counts binary, n_words long, words binary")


@dataclass(frozen=True)
class AuditSettings:
    """The filters' limits, the bytes of text that one shard of the matrix takes (a longer text is a shard of its own), and
    the words of all shards that share a bucket of the dictionary."""

    least_words: int = 50
    distinct_percent: int = 65
    upper_percent: int = 5
    shard_bytes: int = 6 << 20
    bucket_words: int = 500_000


def _totals(table: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of table[byte] over runs of `sizes` bytes."""
    out = np.zeros(len(sizes), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(table[data], np.cumsum(sizes[some]) - sizes[some])
    return out


def _matrix(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """indptr, column codes, counts and the words of the codes, of one shard."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    coded = pa.array(itertools.chain.from_iterable(split), pa.binary(), size=int(sizes.sum())).dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    pairs, counts = np.unique(rows * max(len(words), 1) + codes, return_counts=True)
    at = pairs // max(len(words), 1)
    indptr = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(texts)))]).astype(np.int64)
    return indptr, (pairs - at * max(len(words), 1)).astype(np.int32), counts.astype(np.int32), words


def packed(values: np.ndarray | bytes) -> bytes:
    """Numbers or text as one zstandard frame: shards and dictionary rows are written and shuffled in this form."""
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(values if isinstance(values, bytes) else values.tobytes())


def unpacked(data: bytes, kind: str | None = None) -> np.ndarray | bytes:
    import zstandard
    plain = zstandard.ZstdDecompressor().decompress(data)
    return plain if kind is None else np.frombuffer(plain, kind)


def shard_matrix(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """indptr, codes and counts of a stored shard; codes are stored as steps, as those of one document ascend."""
    indptr, steps, counts = (unpacked(row.column(n)[0].as_py(), k) for n, k in (("indptr", "<i8"), ("columns", "<i4"), ("counts", "<i4")))
    return indptr, np.cumsum(steps, dtype=np.int64), counts


def _one_list(values, kind: pa.DataType) -> pa.Array:
    flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def local_shards(docs: DataFrame, settings: AuditSettings) -> DataFrame:
    """Shards of consecutive documents with codes that count within the shard, and the words of these codes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 33
        for batch in sub_batches(whole(batches, settings.shard_bytes), "text", settings.shard_bytes):
            texts = text_bytes(batch, "text")
            sizes = np.array([len(t) for t in texts], np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
            indptr, columns, counts, words = _matrix(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int64()), _one_list(batch.column("doc_id"), None), _one_list(batch.column("source"), None),
                _one_list([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                _one_list(_totals(UPPER, data, sizes), pa.int64()), _one_list(_totals(POINTS, data, sizes), pa.int64()),
                _one_list(_totals(MARKED, data, sizes) > 0, pa.bool_()),
                *(pa.array([packed(x)], pa.binary()) for x in (indptr, np.diff(columns, prepend=np.int32(0)), counts)),
                pa.array([len(words)], pa.int64()), pa.array([packed(b" ".join(words))], pa.binary())],
                ["shard", "doc_ids", "sources", "digests", "upper", "points", "marked", "indptr", "columns", "counts", "n_words",
                 "words"])
            shard += 1

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.coalesce(source, F.lit("")).alias("source"), "text")
    return rows.mapInArrow(run, SHARD.format(id=kind))


def whole(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches put together up to `most` bytes, so that shards don't end with every Arrow batch."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def word_ids(shards: DataFrame, settings: AuditSettings) -> DataFrame:
    """(shard, codes, ids), packed: the global dictionary, met by every shard's words.

    A shard deals each of its words once to buckets by the word's checksum, one row a shard and bucket.  A bucket's
    rows pass its dictionary in order of shards, so equal words get one id, different words never share one, and a
    repeated run gives the same ids.  Memory holds the words of one bucket, whose number grows with the table.
    """
    buckets = max(1, -(-int(shards.agg(F.sum("n_words")).first()[0] or 0) // settings.bucket_words))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, joined in zip(batch.column("shard").to_pylist(), batch.column("words").to_pylist()):
                words = unpacked(joined).split(b" ")
                if words == [b""]:
                    continue
                bucket = np.array([zlib.crc32(w) for w in words], np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]).tolist()
                codes, places = order.astype(np.int32), order.tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * (len(cuts) - 1), pa.int64()), pa.array(bucket[order[cuts[:-1]]]),
                    pa.array([packed(codes[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([packed(b" ".join([words[k] for k in places[a:b]])) for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    ["shard", "bucket", "codes", "words"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            out = []
            for bucket, joined in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if bucket != now:
                    now, known = bucket, {}
                places = [known.setdefault(w, len(known)) for w in unpacked(joined).split(b" ")]
                out.append(packed(np.array(places, np.int64) * buckets + bucket))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("codes"), pa.array(out, pa.binary())],
                                             ["shard", "codes", "ids"])

    dealt = shards.select("shard", "words").mapInArrow(deal, "shard long, bucket long, codes binary, words binary")
    placed = dealt.repartition("bucket").sortWithinPartitions("bucket", "shard")
    return placed.mapInArrow(number, "shard long, codes binary, ids binary")


def _assembled(docs: DataFrame, settings: AuditSettings, finish, schema) -> DataFrame:
    """`finish(shard row, indptr, columns as global ids, counts)` for every shard; `schema` is made from the type of doc_id."""
    shards = stored(local_shards(docs, settings), "audit-shards")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_batches()[0] if left.num_rows else None
        ids = np.zeros(row.column("n_words")[0].as_py(), np.int64)
        for codes, found in zip(right["codes"].to_pylist(), right["ids"].to_pylist()):
            ids[unpacked(codes, "<i4")] = unpacked(found, "<i8")
        indptr, columns, counts = shard_matrix(row)
        return pa.Table.from_batches([finish(row, indptr, ids[columns], counts)])

    rows = shards.drop("words").groupBy("shard")
    return rows.cogroup(word_ids(shards, settings).groupBy("shard")).applyInArrow(run, schema.format(id=kind))


def document_term_matrix(docs: DataFrame, settings: AuditSettings = AuditSettings()) -> DataFrame:
    """CSR shards over the whole table: (shard, doc_ids, indptr, columns, counts), about `shard_bytes` of text a row.

    Columns are global word ids: the same word has the same id in every shard.  Words are maximal runs of bytes other
    than blank and \\x09-\\x0D, case-sensitive; null texts count as empty and an empty text is an empty matrix row.
    """
    def finish(row: pa.RecordBatch, indptr: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [row.column("shard"), row.column("doc_ids"), _one_list(indptr, pa.int64()), _one_list(columns, pa.int64()),
             _one_list(counts, pa.int32())], ["shard", "doc_ids", "indptr", "columns", "counts"])

    return _assembled(docs, settings, finish, "shard long, doc_ids array<{id}>, indptr array<bigint>, columns array<bigint>, "
                                              "counts array<int>")


def matrix_flags(docs: DataFrame, settings: AuditSettings = AuditSettings()) -> DataFrame:
    """(doc_id, source, digest, a, b, c, d) of every document: row sums and numbers of nonzero entries decide a and b."""
    def finish(row: pa.RecordBatch, indptr: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        words, distinct = np.diff(total[indptr]), np.diff(indptr)
        flat = {c: row.column(c).flatten() for c in ("doc_ids", "sources", "digests", "upper", "points", "marked")}
        upper, points = flat["upper"].to_numpy(), flat["points"].to_numpy()
        return pa.RecordBatch.from_arrays([
            flat["doc_ids"], flat["sources"], flat["digests"], pa.array(words < settings.least_words),
            pa.array(100 * distinct < settings.distinct_percent * words),
            pa.array(100 * upper > settings.upper_percent * points), flat["marked"]],
            ["doc_id", "source", "digest", "a", "b", "c", "d"])

    return _assembled(docs, settings, finish,
                      "doc_id {id}, source string, digest binary, a boolean, b boolean, c boolean, d boolean")


def _mask(*flags: Column) -> Column:
    bits = [F.when(flag, 1 << k).otherwise(0) for k, flag in enumerate(flags)]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return total.cast("int")


def failure_cube(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail (bit 0 is A).

    Copies of a text fail E where a smaller id has the same text.  Copies collapse to counts before they meet: equal
    (text, part, flags, labels, id) first, then all ids but the smallest, so a text that holds a third of all rows is a few
    rows.  A document with several labels counts as good or toxic if any says so.
    """
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.coalesce(F.max("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic"))
    rows = flags.join(marks, flags["doc_id"] == marks["_id"], "left").select(
        "doc_id", "digest", F.col("source").alias("part"), _mask(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    kind = ["digest", "part", "mask", "good", "toxic"]
    each = rows.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    kinds = each.groupBy(*kind).agg(F.sum("n").alias("all"), least.alias("least"),
                                    F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    first = F.col("least.doc_id") == F.min("least.doc_id").over(W.partitionBy("digest"))
    # a row without an id has no smaller id to be compared with
    fresh = F.when(first, F.col("least.n")).otherwise(0) + F.col("nameless")
    split = kinds.select("part", "mask", "good", "toxic", "all", fresh.alias("fresh")).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct("mask", F.col("fresh").alias("n")),
            F.struct((F.col("mask") + 16).alias("mask"), (F.col("all") - F.col("fresh")).alias("n")))).alias("x"))
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("x.n")).otherwise(0)).alias("toxic"))


def order_rows(cube: DataFrame) -> DataFrame:
    """All 120 orders of the filters, step by step, for every part; needs the cube alone (32 entries a part at most)."""
    parts = cube.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(FILTERS)))
    steps = parts.select("part", "cells", F.explode(orders).alias("filter_order")).select(
        "part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bits(text: Column) -> Column:
        return _mask(*(F.instr(text, x) > 0 for x in FILTERS))

    steps = steps.withColumns({"own": bits(F.substring("filter_order", F.col("step"), F.lit(1))),
                               "before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    own, before = F.col("own"), F.col("before")

    def total(value: str, holds) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate("cells", zero, lambda s, x: s + F.when(holds(x["mask"]), x[value]).otherwise(zero))

    def here(mask: Column) -> Column:
        return (mask.bitwiseAND(own) > 0) & (mask.bitwiseAND(before) == 0)

    orders_first = F.aggregate("cells", F.lit(0).cast("long"), lambda s, x: s + F.when(
        x["mask"].bitwiseAND(own) > 0, x["n"] * (F.lit(120) / F.bit_count(x["mask"])).cast("long")).otherwise(0))
    return steps.select(
        "part", "filter_order", "step", total("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(own) > 0) & (m.bitwiseAND(before) > 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"), total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"), orders_first.alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, settings: AuditSettings = AuditSettings()) -> DataFrame:
    """One row per part, filter order and step: what each filter removes, and what others would have removed anyway.

    Null texts count as empty (and are copies of each other), null sources as the empty part; a document without an id is
    never a copy and has no label; repeated rows with one id are no copies of each other; other columns are not read.
    Empty tables have no rows.
    """
    return order_rows(failure_cube(matrix_flags(docs, settings), labels))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
counted AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
flagged AS (
  SELECT c.doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM counted c),
marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
cube AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
    count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM flagged LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p JOIN letters q ON q.x <> p.x JOIN letters r ON r.x NOT IN (p.x, q.x)
  JOIN letters s ON s.x NOT IN (p.x, q.x, r.x) JOIN letters t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
steps AS (
  SELECT filter_order, step, bits[step] AS own, list_sum(list_concat([0], bits[:step - 1]))::INT AS before
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
audited AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & (before + own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM cube, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM audited"""
