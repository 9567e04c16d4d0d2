"""SimHash near-duplicates: fingerprints, blocks that lose no close pair, bit-sliced comparison, components."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored, sub_batches, text_bytes
from barloom.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SEED = 42
#: Rows compared side by side at least, and rows of one key compared in one piece at most.
LANES = 256
BLOCK = 2048
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- fingerprints

def shingle_hashes(words: list[bytes], size: int) -> bytes:
    """XXH64 (big-endian) of every run of `size` words joined by a blank; fewer words make one run, none no hash."""
    from xxhash import xxh64_digest
    if not words:
        return b""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    ends = ends.tolist()[size - 1:] or ends.tolist()[-1:]
    return b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends)])


def majority_bits(hashes: np.ndarray, counts: np.ndarray, rows: int = 1 << 15) -> np.ndarray:
    """Packed bits set in over half of each text's hashes; `hashes` is [n, bytes], `counts` hashes per text.

    Bits are spread out for `rows` hashes at a time, so a text of any length takes the same memory.
    """
    ones = np.zeros((len(counts), 8 * hashes.shape[1]), np.int32)
    owner = np.repeat(np.arange(len(counts)), counts)
    for low in range(0, len(hashes), rows):
        mine = owner[low:low + rows]
        starts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        ones[mine[starts]] += np.add.reduceat(np.unpackbits(hashes[low:low + rows], axis=1), starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1)


def minima(hashes: np.ndarray, counts: np.ndarray, times: int) -> np.ndarray:
    """[n, times] smallest values of each text's hashes under `times` orders; all bits set for a text without hashes.

    Two texts agree in one order with a probability of the Jaccard similarity of their sets of hashes; repeats do not count.
    """
    rng = np.random.default_rng(SEED)
    flips, odd = rng.integers(0, 1 << 64, (2, times), np.uint64)
    out = np.full((len(counts), times), ALL)
    some = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[some]
    if len(some):
        for k in range(times):
            out[some, k] = np.minimum.reduceat((hashes ^ flips[k]) * (odd[k] | np.uint64(1)), starts)
    return out


def fingerprints(docs: DataFrame, *, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint): 64 bits as 16 hex digits over word runs, repeats included; no words give zeros.

    A-Z are lower-cased and words are runs of other than white space.  A null text counts as empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            packed = [shingle_hashes(WORD.findall(t.lower()), shingle) for t in text_bytes(batch, "text")]
            counts = np.array([len(p) // 8 for p in packed])
            bits = majority_bits(np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 8), counts)
            text = bits.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([text[k:k + 16] for k in range(0, len(text), 16)], pa.string())],
                ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


# ---------------------------------------------------------------- bit-sliced comparison

def _full_adder(a, b, c):
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def near_lanes(codes: np.ndarray, radius: int, tile: int = 256) -> np.ndarray:
    """Bit matrix [n, lanes / 64]: bit j of row i says that codes i and j differ in at most `radius` bits, i != j.

    Plane p holds bit p of all codes side by side, so one exclusive-or gives 64 lanes' difference in that bit.
    Four planes at a time enter bit-sliced counters through carry-save adders; a word of lanes is abandoned for
    a tile of rows once every count in it exceeds the radius.
    """
    n = len(codes)
    bits = np.unpackbits(codes, axis=1)
    width = -(-n // 64)
    padded = np.zeros((bits.shape[1], width * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    valid = np.packbits(np.arange(width * 64) < n, bitorder="little").view("<u8")
    flips = np.where(bits, ALL, np.uint64(0))
    levels = max(2, int(radius).bit_length())
    out = np.zeros((n, width), np.uint64)
    for low in range(0, n, tile):
        rows = np.arange(low, min(n, low + tile))
        alive = np.tile(valid, (len(rows), 1))
        alive[np.arange(len(rows)), rows // 64] &= ~(np.uint64(1) << (rows % 64).astype(np.uint64))
        flip = flips[rows]
        kept = np.arange(width)
        counter = [np.zeros_like(alive) for _ in range(levels)]
        over = np.zeros_like(alive)
        for p in range(0, len(planes), 4):
            x = [planes[p + k, kept] ^ flip[:, p + k, None] for k in range(4)]
            counter[0], two_a = _full_adder(counter[0], x[0], x[1])
            counter[0], two_b = _full_adder(counter[0], x[2], x[3])
            counter[1], carry = _full_adder(counter[1], two_a, two_b)
            for k in range(2, levels):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if p % 8 == 4 and p >= radius:
                alive &= ~(over | _exceeds(counter, radius))
                going = alive.any(axis=0)
                if not going.any():
                    break
                if 4 * going.sum() < 3 * len(going):
                    kept, alive, over = kept[going], alive[:, going], over[:, going]
                    counter = [c[:, going] for c in counter]
        out[rows[:, None], kept] = alive
    return out


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, spread over the bit-sliced counters, is above the radius."""
    above, same = np.zeros_like(counter[0]), np.full_like(counter[0], ALL)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            same = same & counter[k]
        else:
            above, same = above | (same & counter[k]), same & ~counter[k]
    return above


def lane_groups(near: np.ndarray) -> np.ndarray:
    """The smallest row number of each row's component in a symmetric bit matrix; -1 for rows without a neighbour."""
    n = len(near)
    label = np.full(n, -1)
    for seed in np.flatnonzero(near.any(axis=1)).tolist():
        if label[seed] >= 0:
            continue
        front = np.array([seed])
        while len(front):
            label[front] = seed
            reach = np.bitwise_or.reduce(near[front], axis=0)
            found = np.flatnonzero(np.unpackbits(reach.view(np.uint8), bitorder="little")[:n])
            front = found[label[found] < 0]
    return label


# ---------------------------------------------------------------- blocks and links

def band_keys(fingerprint: Column, n: int, radius: int, digits: int = 16) -> Column:
    """Keys such that fingerprints within `radius` bits share one: all choices of bands - radius from `bands` bands.

    At most `radius` bands can hold a differing bit, so the others agree.  More bands make longer keys and more
    tables; `n`, the number of fingerprints, only decides which of these complete schemes is cheapest.
    """
    for bands in range(radius + 1, digits + 1):
        size = [digits // bands + (k < digits % bands) for k in range(bands)]
        begin = [sum(size[:k]) for k in range(bands)]
        chosen = list(itertools.combinations(range(bands), bands - radius))
        shortest = min(sum(size[k] for k in c) for c in chosen)
        if n <= 64 * 16 ** shortest or bands >= radius + 4:
            break
    return F.array(*[F.concat(F.lit(f"{t}:"), *[F.substring(fingerprint, begin[k] + 1, size[k]) for k in c])
                     for t, c in enumerate(chosen)])


def block_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Star links (a, b) between close nodes; `nodes` has (node string, code binary, keys array<string>).

    Nodes sharing a key are compared in one block, short blocks of neighbouring keys together.  A key of more than
    BLOCK nodes is split into parts, and every two parts meet in a block of their own, so no task holds more than
    about 2 * BLOCK of its nodes.  A block gives one link from each node to the smallest of its component there: no
    link between different texts is lost, and no group is written out pair by pair.
    """
    rows = nodes.select("node", "code", F.explode("keys").alias("key"))
    crowded = stored(rows.groupBy("key").count().filter(F.col("count") > BLOCK).select(
        F.col("key").alias("hot"), F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")), "crowded-keys")
    split = rows.join(crowded, F.col("key") == F.col("hot"), "left")
    dealt = _met(split, "key").select("node", "code", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            names, at = np.unique(np.array(table["node"].to_pylist(), dtype=object), return_index=True)
            if len(names) < 2:
                continue
            code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(table.num_rows, -1)[at]
            label = lane_groups(near_lanes(code, radius))
            linked = np.flatnonzero((label >= 0) & (label != np.arange(len(label))))
            if len(linked):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[linked].tolist(), pa.string()), pa.array(names[label[linked]].tolist(), pa.string())],
                    ["a", "b"])

    sorted_rows = dealt.repartition("block").sortWithinPartitions("block")
    return sorted_rows.mapInArrow(run, "a string, b string").distinct()


def _met(rows: DataFrame, key: str) -> DataFrame:
    """The rows with their `block`: the key where `parts` is null, else one for every part that the row's part meets."""
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    meets = F.when(F.col("parts").isNull(), F.array(F.lit(""))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.concat(F.lit("/"), F.least(part, other), F.lit("/"), F.greatest(part, other))))
    return rows.withColumn("_meet", F.explode(meets)).withColumn("block", F.concat(key, "_meet"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks of at least two rows, short ones put together up to LANES rows."""
    held, size, rest = [], 0, None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        else:
            table = rest
        if table is None or not table.num_rows:
            continue
        key = table["block"].combine_chunks()
        change = np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)) + 1
        edges = np.concatenate([[0], change, [len(key)]])
        if batch is not None:
            rest = table.slice(int(edges[-2]))
            edges = edges[:-1]
        counts = np.diff(edges)
        wanted = np.repeat(counts >= 2, counts)
        whole = table.slice(0, int(edges[-1])).filter(pa.array(wanted))
        ends = np.cumsum(counts[counts >= 2])
        start = 0
        while start < whole.num_rows:
            k = np.searchsorted(ends, start + max(1, LANES - size))
            end = int(ends[min(k, len(ends) - 1)])
            held.append(whole.slice(start, end - start))
            size += end - start
            start = end
            if size >= LANES:
                yield pa.concat_tables(held)
                held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def group_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): nodes without a link are their own root."""
    found = stored(connected_components(links).withColumnRenamed("node", "_node"), "components")
    return nodes.select("node").join(found, F.col("node") == F.col("_node"), "left").select(
        "node", F.coalesce("root", "node").alias("root"))


# ---------------------------------------------------------------- exact similarity

#: Texts, and their bytes, of one group of candidates compared in one piece at most.
EXACT_BLOCK = 512
EXACT_BYTES = 16 << 20


def similar_groups(sets: list[np.ndarray], least: float) -> np.ndarray:
    """The smallest row number of each row's component among sets of a Jaccard similarity of `least` or more; -1 alone.

    Components are walked from row to row; a row is compared with all rows not yet reached through the lists of rows that
    hold each of its hashes.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    label, free = np.full(n, -1), sizes > 0
    terms, term = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    own = np.split(term, np.cumsum(sizes)[:-1])
    order = np.argsort(term, kind="stable")
    term, owner = term[order], np.repeat(np.arange(n), sizes)[order]
    begin = np.searchsorted(term, np.arange(len(terms) + 1))
    held = n
    for seed in range(n):
        if not free[seed]:
            continue
        free[seed], front = False, [seed]
        while front and free.any():
            row = front.pop()
            if 2 * free.sum() < held:
                held = free.sum()
                term, owner = term[free[owner]], owner[free[owner]]
                begin = np.searchsorted(term, np.arange(len(terms) + 1))
            size = begin[own[row] + 1] - begin[own[row]]
            ends = np.cumsum(size)
            at = np.repeat(begin[own[row]] - (ends - size), size) + np.arange(ends[-1])
            common = np.bincount(owner[at], minlength=n)
            found = np.flatnonzero(free & (common * (1 + least) >= least * (sizes + sizes[row]) - 1e-9))
            free[found] = False
            label[found] = label[seed] = seed if len(found) else label[seed]
            front += found.tolist()
    return label


def similar_links(texts: DataFrame, *, shingle: int, least: float) -> DataFrame:
    """Star links (a, b) between nodes of one `root` whose sets of word runs have a similarity of `least` or more.

    `texts` has (node, root, text).  A root of many or long texts is split into parts, and every two parts meet.
    """
    large = stored(texts.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).select(
        F.col("root").alias("large"), F.ceil(F.greatest(F.col("n") / EXACT_BLOCK, F.col("bytes") / EXACT_BYTES)).cast(
            "int").alias("parts")).filter("parts > 1"), "large-roots")
    dealt = _met(texts.join(large, F.col("root") == F.col("large"), "left"), "root").select("node", "text", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            names, at = np.unique(np.array(table["node"].to_pylist(), dtype=object), return_index=True)
            sets = [np.unique(np.frombuffer(shingle_hashes(WORD.findall(text.as_py().encode().lower()), shingle), ">u8").astype(np.uint64))
                    for text in (table["text"][k] for k in at.tolist())]
            label = similar_groups(sets, least)
            linked = np.flatnonzero((label >= 0) & (label != np.arange(len(label))))
            if len(linked):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[linked].tolist(), pa.string()), pa.array(names[label[linked]].tolist(), pa.string())],
                    ["a", "b"])

    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a string, b string").distinct()


# ---------------------------------------------------------------- the operator

def simhash_components(docs: DataFrame, *, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked, directly or through others, at `radius` bits or fewer.

    `component_id` is the smallest doc_id of the component; it is null only where no document of the component has
    an id.  Null and empty texts have fingerprint zero and are linked like any other; equal texts, and equal
    fingerprints, are one node; repeated rows each give a row.  Other columns are not read.
    """
    prints = stored(fingerprints(docs, shingle=shingle), "fingerprints")
    nodes = stored(prints.groupBy(F.col("fingerprint").alias("node")).agg(F.min("doc_id").alias("low")), "nodes")
    keyed = nodes.select("node", F.unhex("node").alias("code"), band_keys(F.col("node"), nodes.count(), radius).alias("keys"))
    rooted = stored(nodes.join(group_nodes(nodes, block_links(keyed, radius)), "node"), "rooted")
    lows = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "component-ids")
    named = stored(rooted.join(lows, "root").select(F.col("node").alias("fingerprint"), "component_id"), "named")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


# ---------------------------------------------------------------- one document of each near-duplicate group

#: Orders whose smallest hash gives a bit each, and bits that may differ.  At a Jaccard similarity of J each differs with
#: probability (1 - J) / 2: at 0.8 over 48 of 256 do in about two pairs of a million.
ORDERS = 256
WIDE_RADIUS = 48
#: Keys of so many smallest hashes each.  All of them differ in (1 - J ** 5) ** 24 of pairs: 0.00007 at 0.8.
KEYS = 24
KEY_ORDERS = 5


def sketches(rows: DataFrame, *, shingle: int) -> DataFrame:
    """(key, no_id, doc_id, node, code, keys) of (key, doc_id, text) rows.

    `node` names the lower-cased words in order, so equal texts share it; `code` holds a bit of the smallest hash of the
    word runs under each of ORDERS orders; `keys` name runs of these smallest hashes.  Both depend on the similarity of
    the sets of word runs alone, not on how the differing runs are spread over the text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            found = [WORD.findall(t.lower()) for t in text_bytes(batch, "text")]
            nodes = [hashlib.md5(b" ".join(words)).hexdigest() for words in found]
            code, keys = codes_and_keys([shingle_hashes(words, shingle) for words in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), pa.array(nodes, pa.string()),
                 pa.array([bytes(c) for c in code], pa.binary()), pa.array(keys, pa.list_(pa.string()))],
                ["key", "doc_id", "node", "code", "keys"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.select("key", "doc_id", "text").mapInArrow(
        run, f"key string, doc_id {kind}, node string, code binary, keys array<string>")
    return made.withColumn("no_id", F.col("doc_id").isNull())


def codes_and_keys(packed: list[bytes]) -> tuple[np.ndarray, list[list[str]]]:
    """Codes [n, ORDERS / 8] and keys of texts given as packed hashes; a text without hashes has no keys."""
    counts = np.array([len(p) // 8 for p in packed], dtype=np.int64)
    least = minima(np.frombuffer(b"".join(packed), ">u8").astype(np.uint64), counts, ORDERS)
    code = np.packbits((least >> np.uint64(32) & np.uint64(1)).astype(np.uint8), axis=1)
    mixed = np.tile(np.arange(1, KEYS + 1, dtype=np.uint64), (len(packed), 1))
    for k in range(KEY_ORDERS):
        mixed = (mixed ^ least[:, k:KEYS * KEY_ORDERS:KEY_ORDERS]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    digits = mixed.astype(">u8").tobytes().hex()
    size = 16 * KEYS
    return code, [[digits[at + k:at + k + 12] for k in range(0, size, 16)] if n else []
                  for at, n in zip(range(0, len(digits), size), counts.tolist())]


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, radius: int = WIDE_RADIUS, least: float = 0.8) -> DataFrame:
    """One document, with all its columns, of every group of near-duplicates: that of the smallest doc_id, nulls last.

    Documents are linked, directly or through others, where the Jaccard similarity of their sets of `shingle`-word runs
    is `least` or more.  Candidates share a key and differ in at most `radius` of 256 bits, as nearly all do at 0.8;
    they are compared exactly.  Texts without a word are equal to one another; rows equal in every column are one
    document; rows that only share a doc_id are not.  An empty table gives an empty table; extra columns pass through
    whatever their names.
    """
    names = docs.columns
    hashed = [F.to_json(f"`{c}`") if t.startswith("map") else F.col(f"`{c}`") for c, t in docs.dtypes]
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(*hashed).cast("string"))
    made = stored(sketches(docs.select(key.alias("key"), "doc_id", "text"), shingle=shingle), "sketches")
    low = F.min(F.struct("no_id", "doc_id", "key")).alias("low")
    nodes = stored(made.groupBy("node").agg(low, F.first("code").alias("code"), F.first("keys").alias("keys")), "nodes")
    maybe = connected_components(block_links(nodes.select("node", "code", "keys"), radius))
    wanted = stored(maybe.join(nodes, "node").select("node", "root", F.col("low.key").alias("_wanted")), "candidates")
    texts = stored(docs.select(key.alias("_key"), "text").join(wanted, F.col("_key") == F.col("_wanted")).select(
        "node", "root", "text"), "candidate-texts")
    rooted = group_nodes(nodes, similar_links(texts, shingle=shingle, least=least))
    kept = stored(nodes.select("node", "low").join(rooted, "node").groupBy("root").agg(F.min("low").alias("low")).select(
        F.col("low.key").alias("_kept")), "kept-documents")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), key.alias("_key"))
    one = rows.join(kept, F.col("_key") == F.col("_kept")).groupBy("_key").agg(F.first("_row").alias("_row"))
    return one.select("_row.*")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
