import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from barloom.llm import bpe, pretokens, tokens
from barloom.llm.common import shared_folder

from .frames import awkward_texts, documents, empty

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(JSON)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def reference():
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS).ranks,
                                 special_tokens={})
    return encoding


HARD = ["'s's'sb it's ''s 're've\n'll", " \n x", "a  b   c \n\n d", "\u0085 x\x1f y", "<|endoftext|> a", "b<|endoftext|>", "<|endoftext |>", "x" * 5000, "ab" * 300 + "!" * 700,
        "日本語 テキスト", "12 34½ ٣", "trailing  ", "\n", "é́ combining", "﻿​ zero"]


def test_boundaries_are_those_of_the_pattern():
    import random
    import regex
    rng = random.Random(1)
    pattern = regex.compile(public_tokenizers.PATTERN)
    letters = list("  \n\t''srtelvmdaAé12½.,!漢😀\x1f\x85")
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(2000)]
    joined, offsets, first = pretokens.slices(texts)
    for k, text in enumerate(texts):
        at = offsets[first[k]:first[k + 1]]
        assert [joined[a:b].decode() for a, b in zip(at, at[1:])] == pattern.findall(text)


def test_encoders_equal_their_libraries(library, reference):
    texts = HARD + [t for t in awkward_texts() if t]
    ranks, encoder = bpe.load_ranks(RANKS), tokens.load_encoder(JSON)
    for _ in range(2):
        ids, counts = ranks.encode(texts)
        split = np.split(ids, np.cumsum(counts)[:-1])
        assert [x.tolist() for x in split] == [reference.encode_ordinary(t) for t in texts]
        assert ranks.decode(ids, counts) == [t.encode() for t in texts]
        assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == [library(t) for t in texts]


def test_long_texts_are_cut_where_tokens_begin(monkeypatch, reference):
    monkeypatch.setattr(bpe, "PORTION", 7)
    texts = [*HARD, "", *(t for t in awkward_texts() if t)]
    ids, counts = bpe.load_ranks(RANKS).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [reference.encode_ordinary(t) for t in texts]


def test_caches_stay_bounded(monkeypatch, library):
    monkeypatch.setattr(tokens, "CACHE", 5)
    monkeypatch.setattr(bpe, "CACHE", 5)
    encoder, ranks = tokens.Encoder(JSON), bpe.Ranks(RANKS)
    for k in range(50):
        text = f"one two{k} three{k}, four{k}?"
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library(text)
        ranks.encode([text])
    assert max(len(encoder.known), len(encoder.behind), len(ranks.recent), len(ranks.older)) < 20


def test_bpe_rows(spark, reference):
    import hashlib
    docs = documents(spark)
    got = bpe.encode_documents(docs, RANKS).collect()
    want = []
    for r in docs.collect():
        ids = reference.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest(), ids))
    assert sorted((str(r.doc_id), *list(r)[1:]) for r in got) == sorted(want)
    assert bpe.encode_documents(empty(docs), RANKS).count() == 0


def test_token_files(spark, library):
    docs = documents(spark)
    got = tokens.token_digest(docs, JSON, end_id=2).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
    rows = sorted(got, key=lambda r: r.start)
    ids_of = {}
    for r in docs.collect():
        ids_of.setdefault(r.doc_id, []).append(library(r.text or "") + [2])
    start, last = 0, -1
    for r in rows:
        assert (r.doc_id if r.doc_id is not None else -1) >= last
        last = r.doc_id if r.doc_id is not None else -1
        assert r.start == start
        start += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids_of[r.doc_id]]
    assert tokens.token_digest(empty(docs), JSON, end_id=2).count() == 0


def test_files_hold_the_order_and_give_single_documents(spark, library):
    texts = [f"text number {k}" for k in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts))[::-1], "doc_id long, text string")
    folder = shared_folder(spark, "token-test")
    manifest = tokens.write_tokens(docs, JSON, folder, end_id=2, docs_per_file=9)
    assert manifest.count() > 3 and manifest.agg({"n_docs": "sum"}).first()[0] == 50
    got = tokens.read_tokens(manifest, folder, [7, 31]).collect()
    before = [sum(len(library(t)) + 1 for t in texts[:k]) for k in (7, 31)]
    assert sorted((r.doc_id, r.start, r.ids) for r in got) == [
        (7, before[0], library(texts[7]) + [2]), (31, before[1], library(texts[31]) + [2])]


def test_damage_is_found_and_frames_are_independent():
    import zstandard
    data = [(k, np.arange(k + 1, dtype="<u4").tobytes()) for k in range(20)]
    out = io.BytesIO()
    assert tokens.write_token_file(out, data, 2) == (20, 210)
    raw = out.getvalue()

    def opened(content):
        source = pa.BufferReader(content)
        return tokens.TokenFile(source)

    file = opened(raw)
    assert file.ids(13).tolist() == list(range(14))
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(np.frombuffer(x, "<u4").astype("<u2").tobytes() for _, x in data)
    at = int(file.starts[13]) + 6
    broken = opened(raw[:at] + bytes([raw[at] ^ 0xFF]) + raw[at + 1:])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.ids(13)
    assert broken.ids(12).tolist() == list(range(13))
    with pytest.raises(ValueError):
        opened(raw[:-1] + b"\0")


def test_pieces_of_texts_side_by_side_give_the_librarys_ids(library):
    import random
    rng = random.Random(7)
    letters = list("   \n\n\t''srtelvmdaAzZé12½.,!_$漢😀\x00\x1c\x1f\x85\x0b\r\xa0\u1680\u2003\u2028\u3000\u180e\u0301\u200b")
    encoder = tokens.Encoder(JSON)
    for portion in range(60):
        texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))) for _ in range(80)]
        texts += HARD[portion % len(HARD):][:2]
        rng.shuffle(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_batch(texts)] == [library(t) for t in texts]
    assert encoder.encode_batch([]) == [] and encoder.encode_batch(["", ""]) == [b"", b""]


def test_words_are_learnt_apart_from_their_signs_and_line_breaks(library):
    words = [a + b for a in ("th", "re", "on", "ing", "sh") for b in ("er", "ou", "ble", "ati", "nd")]
    texts = [" ".join(f"{w}{sign}{v}" for w in words for v in words) for sign in (".\n", ",\n", "...\n", "$$$", "!!")]
    encoder = tokens.Encoder(JSON)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_batch(texts)] == [library(t) for t in texts]
    assert len(encoder.known) + len(encoder.behind) <= 2 * len(words) + 6


def test_the_cache_keeps_the_generation_before(monkeypatch, library):
    monkeypatch.setattr(tokens, "CACHE", 12)
    encoder = tokens.Encoder(JSON)
    learn, learnt = encoder._learn, []
    monkeypatch.setattr(encoder, "_learn", lambda pieces: learnt.extend(pieces) or learn(pieces))
    for text in ("x one two three four", "x one five six seven", "x one eight nine ten"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library(text)
    assert learnt.count(" one") == 1 and len(encoder.known) + len(encoder.behind) <= 12
