"""Byte-level BPE: encoding by cached pair merging over scanned slices, decoding, and their digests."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm import pretokens
from barloom.llm.common import sub_batches, text_values

#: Slices a worker remembers (two generations of this many; about 30 MB each).
CACHE = 150_000
#: Slices longer than this many bytes are merged with a heap.
LONG = 48


class Ranks:
    """A rank file: bytes of every id, and for each pair of ids the id it merges to (which is its rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.ranks = ranks
        self.pairs = {(ranks[t[:k]], ranks[t[k:]]): rank for t, rank in ranks.items()
                      for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = sorted((a << 32 | b, rank) for (a, b), rank in self.pairs.items())
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*keys))
        #: Decimal digits of every id and a blank, padded with zero bytes.
        self.decimals = np.zeros((self.size, len(str(self.size)) + 1), np.uint8)
        for k in range(self.size):
            digits = f"{k} ".encode()
            self.decimals[k, :len(digits)] = np.frombuffer(digits, np.uint8)
        self.digits = np.count_nonzero(self.decimals, axis=1)
        self.widths = np.array([len(t) for t in self.token])
        self.begins = np.cumsum(self.widths) - self.widths
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id each pair merges to, or `size` where it doesn't merge (as with the filler -1)."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at], self.size)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of slices of at most LONG bytes, merged side by side.

        Each round merges, in every slice, the leftmost of its lowest-ranked adjacent pairs.
        """
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        low = 0
        for width in (4, 8, 16, LONG):
            chosen = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if not len(chosen):
                continue
            raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in chosen.tolist()), np.uint8)
            count = sizes[chosen]
            ids = np.array(self.byte)[raw.reshape(-1, width)]
            ids[np.arange(width) >= count[:, None]] = -1
            done, open_rows, rank = ids, np.arange(len(ids)), self.pair_rank(ids[:, :-1], ids[:, 1:])
            while True:
                place = rank.argmin(axis=1)
                best = rank[np.arange(len(rank)), place]
                going = best < self.size
                if not going.all():
                    done[open_rows[~going], :ids.shape[1]] = ids[~going]
                    ids, rank, place, best, open_rows = (x[going] for x in (ids, rank, place, best, open_rows))
                if not len(ids):
                    break
                row = np.arange(len(ids))
                columns = np.arange(ids.shape[1])
                source = np.minimum(columns + (columns > place[:, None]), ids.shape[1] - 1)
                last = ids.shape[1] - 1
                ids = np.take_along_axis(ids, source, axis=1)
                ids[:, last] = -1
                ids[row, place] = best
                rank = np.take_along_axis(rank, np.minimum(source[:, :last], last - 1), axis=1)
                rank[:, last - 1] = self.size
                inner = place < last
                rank[row[inner], place[inner]] = self.pair_rank(best[inner], ids[row[inner], place[inner] + 1])
                inner = place > 0
                rank[row[inner], place[inner] - 1] = self.pair_rank(ids[row[inner], place[inner] - 1], best[inner])
                count[open_rows] -= 1
            flat = done.astype("<u4").tobytes()
            for i, at, n in zip(chosen.tolist(), range(0, len(flat), 4 * width), (4 * count).tolist()):
                out[i] = flat[at:at + n]
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        pairs, n = self.pairs, len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(pairs[p], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            rank, k, pair = heapq.heappop(heap)
            right = after[k]
            if not alive[k] or right >= n or (ids[k], ids[right]) != pair:
                continue
            ids[k], alive[right], after[k] = rank, False, after[right]
            if after[k] < n:
                before[after[k]] = k
                if (new := (rank, ids[after[k]])) in pairs:
                    heapq.heappush(heap, (pairs[new], k, new))
            if before[k] >= 0 and (new := (ids[before[k]], rank)) in pairs:
                heapq.heappush(heap, (pairs[new], before[k], new))
        return [i for i, keep in zip(ids, alive) if keep]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text); long texts are taken part by part."""
        ids, counts = [], np.zeros(len(texts), np.int64)
        for owners, parts in _portions(texts):
            some, sizes = self._encode(parts)
            ids.append(some)
            np.add.at(counts, owners, sizes)
        return np.concatenate([*ids, np.empty(0, np.uint32)]), counts

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined, offsets, first = pretokens.slices(texts)
        places = offsets.tolist()
        pieces = [joined[a:b] for a, b in zip(places, places[1:])]
        for separator in (first[1:] - 1).tolist():
            pieces[separator] = b""
        packed = self._cached(pieces)
        sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)])
        return np.frombuffer(b"".join(packed), "<u4"), np.diff(sizes[first])

    def _cached(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of every slice: from the cache, or merged once for all places of a new slice."""
        found = list(map(self.recent.get, pieces))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            fresh = {pieces[k]: None for k in missing}
            known = {p: self.older[p] for p in fresh if p in self.older}
            unknown = [p for p in fresh if p not in known]
            short = [p for p in unknown if len(p) <= LONG]
            known.update(zip(short, self.merge_many(short)))
            if len(self.recent) >= CACHE:
                self.older, self.recent = self.recent, {}
            self.recent.update(known)
            for p in unknown:
                if len(p) > LONG:
                    known[p] = np.array(self._merge_long([self.byte[b] for b in p]), "<u4").tobytes()
            for k in missing:
                found[k] = known[pieces[k]]
        return found

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text."""
        width = self.widths[ids]
        ends = np.cumsum(width)
        place = np.repeat(self.begins[ids] - (ends - width), width)
        place += np.arange(len(place))
        return _cut(self.bytes[place].tobytes(), np.concatenate([[0], ends]), counts)

    def decimal_texts(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The decimal ids of each text, each followed by one space."""
        digits = self.decimals[ids].ravel()
        return _cut(digits[digits != 0].tobytes(), np.concatenate([[0], np.cumsum(self.digits[ids])]), counts)


#: Characters whose boundaries are scanned at a time.
PORTION = 1 << 20


def _portions(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in order, in portions of about PORTION characters, with the number of the text each part is of.

    A text longer than that is cut before blanks that begin a token: those before a character that is no white space.
    """
    owners, parts, size = [], [], 0
    for k, text in enumerate(texts):
        begin = 0
        while True:
            end = len(text)
            if end - begin > PORTION:
                blank = re.compile(r" (?=\S)").search(text, begin + PORTION)
                end = blank.start() if blank else end
            owners.append(k)
            parts.append(text[begin:end])
            size += end - begin
            if size >= PORTION:
                yield owners, parts
                owners, parts, size = [], [], 0
            if end == len(text):
                break
            begin = end
    if parts:
        yield owners, parts


def _cut(joined: bytes, ends: np.ndarray, counts: np.ndarray) -> list[bytes]:
    at = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [joined[a:b] for a, b in zip(at, at[1:])]


@functools.cache
def load_ranks(path: str) -> Ranks:
    """A worker reads a vocabulary once."""
    return Ranks(path)


def encode_documents(docs: DataFrame, path: str, *, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, and ids with `keep_ids`) of every row.

    A null text counts as empty and has no ids; digests are then those of no bytes.  Rows are independent:
    repeated rows give repeated results, a null doc_id stays null, other columns are not read.  Whole texts
    are encoded; a run of any length inside a text is merged in n log n steps.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        for batch in sub_batches(batches, "text"):
            ids, counts = ranks.encode(text_values(batch, "text"))
            ids_sha = [hashlib.sha256(x[:-1]).hexdigest() for x in ranks.decimal_texts(ids, counts)]
            decoded_sha = [hashlib.sha256(x).hexdigest() for x in ranks.decode(ids, counts)]
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                       pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False)
