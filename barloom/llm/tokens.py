"""Token-id files: independent zstandard frames, one per document, with a trailing seek table.

Layout of a file: one frame per document (its ids, little-endian, 16 or 32 bits wide); a skippable frame with the
document index (ids and token counts); a skippable frame with the seek table of the public zstandard seekable
format (compressed size, decompressed size and checksum of every frame, then a nine-byte footer).  A reader
fetches footer, table and index, and then decompresses only the frames it wants, checking each.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import filesystem, shared_folder, stored, sub_batches, text_values

# Fixed values of the zstandard frame and seekable formats.
SKIPPABLE = 0x184D2A50
SEEK_SKIPPABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

#: Pieces of texts that a worker remembers.
CACHE = 1_000_000
#: Bytes of the texts that are encoded together.
PORTION = 4 << 20
#: ASCII signs alone.
SIGNS = re.compile(r"[!-/:-@\[-`{-~]+").fullmatch

# Classes of bytes for the places where texts are cut.
_BYTES = np.arange(256)
_ASCII = (_BYTES > 0x20) & (_BYTES < 0x7F)
_LETTER = ((_BYTES | 0x20) >= ord("a")) & ((_BYTES | 0x20) <= ord("z"))
#: An apostrophe may begin a token that holds letters.
_SIGN = _ASCII & ~_LETTER & ~((_BYTES >= ord("0")) & (_BYTES <= ord("9"))) & (_BYTES != ord("'"))
#: First bytes of characters that are no white space.
_SOLID = _ASCII | ((_BYTES >= 0xC3) & ~np.isin(_BYTES, [0xE1, 0xE2, 0xE3]))


def token_begins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks bytes of texts laid side by side where a token of the byte-level pattern must begin.

    These are each text's first byte, a blank before a character that is no white space, and, all in ASCII, a change
    between letters and signs, a line break behind a visible character, and a visible character behind such a break when
    that stands alone.  Each piece between such places gives the same tokens apart as within its text.
    """
    begins = np.zeros(len(data) + 1, bool)
    letter, sign, visible, line = _LETTER[data], _SIGN[data], _ASCII[data], data == 0x0A
    begins[1:-1] = letter[:-1] & sign[1:] | sign[:-1] & letter[1:] | visible[:-1] & line[1:]
    begins[2:-1] |= visible[:-2] & line[1:-1] & visible[2:]
    blank = (data[:-1] == 0x20) & _SOLID[data[1:]]
    # the byte behind a text's last one is not its own
    ends = offsets[1:] - 1
    blank[ends[(ends >= 0) & (ends < len(blank))]] = False
    begins[:-2] |= blank
    begins[offsets] = True
    return begins[:-1]


def byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies spell a printable byte as itself and the others, in order, from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(spare)) for b in range(256)}


class Encoder:
    """Whole texts to packed ids: texts are cut where a token must begin, and every new piece is encoded once.

    The pieces of a portion of texts are numbered by their text; only distinct ones are looked up, and the new ones are
    encoded together and kept in a cache of two generations.  A text that spells one of the vocabulary's added tokens is
    encoded whole, as the library gives such a token its id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.alphabet = byte_alphabet()
        #: The same model over pieces that are spelled already, parted by the letter of the zero byte.
        self.spelled = Tokenizer(self.tokenizer.model)
        self.spelled.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(self.alphabet[0])
        self.widths = np.zeros(self.size, np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.widths[k] = len(token)
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        first = steps.get("pre_tokenizer") or {}
        #: Whether texts may be cut as described and a run of letters or of signs is one piece of the model.
        self.byte_level = (first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get(
            "add_prefix_space") and steps.get("normalizer") is None)
        added = [t["content"] for t in steps.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known: dict[str, bytes] = {}
        #: The generation before.
        self.behind: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spelled(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of the model, many in one string of the library; the bytes that tokens spell part them again."""
        out: list[bytes] = []
        for low in range(0, len(pieces), 4000):
            joined = "\0".join(pieces[low:low + 4000]).encode()
            ids = np.array(self.spelled.encode_batch_fast(
                [joined.decode("latin-1").translate(self.alphabet)], add_special_tokens=False)[0].ids, "<u4")
            # no piece holds a zero byte
            ends = np.flatnonzero(np.frombuffer(joined + b"\0", np.uint8) == 0)
            ends -= np.arange(len(ends))
            cuts = (4 * (np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1)).tolist()
            packed = ids.tobytes()
            out += [packed[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, into the cache: letters or signs, with or without a blank, are pieces of the model at once."""
        single: list[str] = []
        others: list[str] = []
        for piece in pieces:
            body = piece[1:] if piece[0] == " " else piece
            (single if body.isalpha() or body == "\n" == piece or SIGNS(body) else others).append(piece)
        self.known.update(zip(single, self._spelled(single)))
        self.known.update(zip(others, self._whole(others)))

    def _packed(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, from the cache or learnt."""
        known, before = self.known, self.behind
        out = list(map(known.get, pieces))
        missing = [k for k, ids in enumerate(out) if ids is None]
        if not missing:
            return out
        if len(known) + len(missing) > CACHE // 2:
            self.behind, self.known = known, {}
            known = self.known
        known.update((p, before[p]) for p in (pieces[k] for k in missing) if p in before)
        fresh = [p for p in (pieces[k] for k in missing) if p not in known]
        self._learn(fresh)
        for k in missing:
            out[k] = known[pieces[k]]
        for piece in fresh:
            if len(piece) > 64:
                del known[piece]
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        if not self.byte_level or not texts:
            return self._whole(texts)
        whole = [k for k, t in enumerate(texts) if self.added and self.added.search(t)]
        plain = list(texts)
        for k in whole:
            plain[k] = ""
        held = pa.array(plain, pa.string())
        offsets = np.frombuffer(held.buffers()[1], np.int32, len(plain) + 1).astype(np.int64)
        text = held.buffers()[2]
        size = int(offsets[-1])
        if not size:
            out = [b""] * len(texts)
        else:
            begins = np.flatnonzero(token_begins(np.frombuffer(text, np.uint8, size), offsets))
            # the number of every text's first piece
            edges = np.searchsorted(begins, offsets)
            pieces = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, size).astype(np.int32)), text)
            coded = pieces.dictionary_encode()
            packed, place = self._packed(coded.dictionary.to_pylist()), coded.indices.to_numpy()
            sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            ids = np.frombuffer(b"".join(packed), "<u4")
            # the ids of every piece, one after the other
            counts = sizes[place]
            ends = np.concatenate([[0], np.cumsum(counts)])
            shift = (np.cumsum(sizes) - sizes)[place] - ends[:-1]
            data = ids[np.repeat(shift, counts) + np.arange(ends[-1])].tobytes()
            cuts = (4 * ends[edges]).tolist()
            out = [data[low:high] for low, high in zip(cuts, cuts[1:])]
        for k, ids in zip(whole, self._whole([texts[k] for k in whole])):
            out[k] = ids
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


@functools.cache
def load_encoder(path: str) -> Encoder:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def write_token_file(out, documents: Iterable[tuple[int | None, bytes]], width: int, level: int = 1) -> tuple[int, int]:
    """Writes (doc_id, packed 32-bit ids) to the open file `out`; returns numbers of documents and ids."""
    import xxhash
    import zstandard
    press = zstandard.ZstdCompressor(level=level)
    table, doc_ids, counts = [], [], []
    for doc_id, packed in documents:
        data = packed if width == 4 else np.frombuffer(packed, "<u4").astype("<u2").tobytes()
        frame = press.compress(data)
        out.write(frame)
        table.append(struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        doc_ids.append(doc_id)
        counts.append(len(data) // width)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    index = press.compress(known.tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes()
                           + np.array(counts, "<u4").tobytes())
    tail = index + struct.pack("<BI", width, len(index))
    out.write(struct.pack("<II", SKIPPABLE, len(tail)) + tail)
    body = b"".join(table) + struct.pack("<IBI", len(table), CHECKSUMS, SEEK_MAGIC)
    out.write(struct.pack("<II", SEEK_SKIPPABLE, len(body)) + body)
    return len(doc_ids), sum(counts)


class TokenFile:
    """Random access to one file; only the frames asked for are read and decompressed."""

    def __init__(self, source):
        import zstandard
        self.source, self.press = source, zstandard.ZstdDecompressor()
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        begin = size - 9 - 12 * frames
        table = np.frombuffer(self._at(begin, 12 * frames), "<u4").reshape(frames, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.plain, self.sums = table[:, 1], table[:, 2]
        self.width, length = struct.unpack("<BI", self._at(begin - 8 - 5, 5))
        index = self.press.decompress(self._at(begin - 8 - 5 - length, length))
        known = np.frombuffer(index, np.uint8, frames).tolist()
        ids = np.frombuffer(index, "<i8", frames, frames).tolist()
        self.doc_ids = [i if k else None for i, k in zip(ids, known)]
        self.counts = np.frombuffer(index, "<u4", frames, 9 * frames).astype(np.int64)

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document; raises ValueError if they fail their checksum."""
        import xxhash
        begin, end = int(self.starts[k]), int(self.starts[k + 1])
        data = self.press.decompress(self._at(begin, end - begin), max_output_size=int(self.plain[k]) or 1)
        if len(data) != self.plain[k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")


def write_tokens(docs: DataFrame, path: str, folder: str, *, end_id: int | None, docs_per_file: int = 8192) -> DataFrame:
    """Encodes every row and writes the files in ascending doc_id order; returns the manifest (part, file, n_docs, n_tokens).

    Rows are range-partitioned and sorted by doc_id, nulls first, rows sharing an id by the hash of their text; file
    k holds the k-th range.  A null text counts as empty.  A file appears under its name only when it is complete, so
    a task that is run again writes the same file anew.  An empty table writes no file.
    """
    parts = max(1, -(-docs.count() // docs_per_file))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = load_encoder(path), TaskContext.get()
        end = b"" if end_id is None else struct.pack("<I", end_id)
        width = 2 if max(encoder.size, end_id or 0) <= 0x10000 else 4
        fs, base = filesystem(folder)
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return

        def documents():
            for batch in sub_batches(_chain(head, batches), "text", PORTION):
                for doc_id, packed in zip(batch.column("doc_id").to_pylist(), encoder.encode_batch(text_values(batch, "text"))):
                    yield doc_id, packed + end

        name = f"{base}/part-{task.partitionId():06d}.ids.zst"
        partial = f"{base}/_{task.partitionId():06d}.{task.taskAttemptId()}"
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(partial) as out:
            n_docs, n_tokens = write_token_file(out, documents(), width)
        fs.move(partial, name)
        yield pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()], pa.int32()), pa.array([name.rsplit("/", 1)[1]]), pa.array([n_docs], pa.int64()),
             pa.array([n_tokens], pa.int64())], ["part", "file", "n_docs", "n_tokens"])

    return stored(ordered.mapInArrow(run, "part int, file string, n_docs bigint, n_tokens bigint"), "token-manifest")


def _chain(head, rest):
    yield head
    yield from rest


def read_tokens(manifest: DataFrame, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files, of all documents or of the asked ones only.

    `start` counts the ids of all documents before: those of earlier files (one manifest row each) and of earlier
    frames, both from counts alone.
    """
    return _read(manifest, folder, doc_ids, digest=False)


def _read(manifest: DataFrame, folder: str, doc_ids: list[int] | None, digest: bool) -> DataFrame:
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    wanted = None if doc_ids is None else set(doc_ids)
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with fs.open_input_file(f"{base}/{name}") as source:
                    file = TokenFile(source)
                    starts = start + np.cumsum(file.counts) - file.counts
                    chosen = [k for k, d in enumerate(file.doc_ids) if wanted is None or d in wanted]
                    for low in range(0, len(chosen), 512):
                        some = chosen[low:low + 512]
                        ids = [file.ids(k) for k in some]
                        values = [zlib.crc32(x.tobytes()) for x in ids] if digest else ids
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([file.doc_ids[k] for k in some], pa.int64()), pa.array(starts[some], pa.int64()),
                             pa.array([len(x) for x in ids], pa.int64()), pa.array(values, last[1])],
                            ["doc_id", "start", "n_tokens", last[0]])

    kind = "ids_crc32 bigint" if digest else "ids array<bigint>"
    count = max(1, manifest.count())
    return files.repartition(count, "file").mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {kind}")


def token_digest(docs: DataFrame, path: str, *, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the files and returns from them, per document, start, number and CRC-32 of the ids."""
    folder = folder or shared_folder(docs.sparkSession, "token-files")
    return _read(write_tokens(docs, path, folder, end_id=end_id), folder, None, digest=True)


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_digest(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
