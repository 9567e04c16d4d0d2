"""Line deduplication on hashes: keep bitmaps per document instead of moved text (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import lower_ascii, stored

#: Lines of a table for which one more slice of a key is made.
SLICE_ROWS = 2_000_000
BLANKS = " \t\n\x0b\x0c\r"


def line_array(text: Column) -> Column:
    """The lines of a text cut at \\n; null and empty give one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """What makes two lines equal: blanks stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key has at least `min_chars` code points: (k1, k2) is a 128-bit hash of the key."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                        F.posexplode(line_array(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), "key").alias("k2"),
        "doc_id", "text_hash", "pos")


def line_statistics(hashes: DataFrame, slices: int) -> DataFrame:
    """Documents and first place of every key.

    Hashes are range-partitioned with their documents' slice, so a key in a third of all documents is spread
    over `slices` ranges; each range is sorted by document and position and streamed once.  A change of
    document is counted, the first row of a slice is its first occurrence; slices then meet as one row each.
    """
    ranged = hashes.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices))).repartitionByRange("k1", "k2", "slice")
    place = W.partitionBy("k1", "k2", "slice").orderBy("doc_id", "text_hash", "pos")
    streamed = ranged.select(
        "k1", "k2", "slice", "doc_id", "text_hash", "pos", F.row_number().over(place).alias("nth"),
        F.lag("doc_id").over(place).alias("before"))
    new_doc = (F.col("nth") == 1) | ~F.col("before").eqNullSafe(F.col("doc_id"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "pos")
    by_slice = streamed.groupBy("k1", "k2", "slice").agg(
        F.count(F.when(new_doc, 1)).alias("n_docs"), F.min(first).alias("first"))
    return by_slice.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.min("first").alias("first"))


def keep_bitmaps(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = True,
                 slices: int | None = None) -> DataFrame:
    """Compressed keep bitmaps: (doc_id, text_hash, words) with words = [(word, keep)] by ascending word.

    Bit `pos % 64` of word `pos // 64` is 0 where the line goes.  Words and documents that keep every line are
    left out.  A line goes if its key stands in at least `min_docs` documents; with `keep_first` its first place
    (smallest doc_id, nulls last, then position) stays.  Rows sharing a doc_id count as one document.  `slices`, into
    which the places of one key are dealt, grow with the table unless given, so that no slice outgrows a task.
    """
    hashes = stored(line_hashes(docs, min_chars), "line-hashes")
    if slices is None:
        slices = max(32, -(-hashes.count() // SLICE_ROWS))
    frequent = stored(line_statistics(hashes, slices).filter(F.col("n_docs") >= min_docs), "frequent-lines")
    gone = hashes.join(frequent, ["k1", "k2"])
    if keep_first:
        at = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
        gone = gone.filter(~(at & (F.col("pos") == F.col("first.pos"))))
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    words = gone.groupBy("doc_id", "text_hash", F.expr("pos div 64").alias("word")).agg(F.bit_or(bit).alias("drop"))
    return words.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("keep")))).alias("words"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(_row, _lines): each row as a struct, and (n_lines, n_dropped, kept), its text without the lines the bitmaps drop."""
    held = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    maps = bitmaps.select(F.col("doc_id").alias("_id2"), F.col("text_hash").alias("_hash2"),
                          F.map_from_entries("words").alias("_words"))
    joined = held.join(maps, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left")
    lines = line_array(F.col("_row.text"))
    kept = F.filter(lines, lambda _, i: F.coalesce(
        F.try_element_at(F.expr("_words"), F.floor(i / 64)), F.lit(-1)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))) != 0)
    counted = joined.select(
        "_row", F.size(lines).alias("n_lines"),
        F.when(F.col("_words").isNull(), lines).otherwise(kept).alias("kept"))
    return counted.select("_row", F.struct(
        F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept")).alias("_lines"))


def dedup_lines(docs: DataFrame, **settings) -> DataFrame:
    """Documents with their repeated lines taken out of `text`, every other column as it came (see `keep_bitmaps`).

    Null and empty texts are one empty line, whose key has no code points and so never goes while `min_chars` is
    1 or more; a null text comes back empty.  An empty table gives an empty table; extra columns pass through.
    """
    names = docs.columns
    out = apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), **settings))
    return out.select(*[F.col("_lines.kept").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in names])


def line_digest(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per document: lines, dropped lines and the SHA-256 of what stays; every place of a frequent line goes."""
    narrow = docs.select("doc_id", "text")
    out = apply_bitmaps(narrow, keep_bitmaps(narrow, min_docs=min_docs, min_chars=min_chars, keep_first=False))
    return out.select("_row.doc_id", "_lines.n_lines", "_lines.n_dropped",
                      F.sha2(F.col("_lines.kept").cast("binary"), 256).alias("kept_sha256"))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, lines, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
k as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
j as (select k.*, f.key is not null as gone from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""
