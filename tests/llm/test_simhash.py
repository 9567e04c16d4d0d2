import random
import re

import numpy as np
import pytest
import xxhash

from barloom.llm import simhash
from barloom.llm.components import connected_components

from .frames import documents, empty


def fingerprint(text, size=4):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    runs = [b" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, radius=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for k, d in enumerate(ids):
        if d is not None:
            low[find(k)] = min(d, low.get(find(k), d))
    return [low.get(find(k)) for k in range(len(ids))]


def near_texts(seed=2):
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(30, 200))] for _ in range(12)]
    out = []
    for base in bases:
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randint(0, 5000)}"
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [2048, 8])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    docs = documents(spark, near_texts() + [None, "", "\t", "one two", "ONE  two"])
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.simhash_components(docs).collect())
    rows = docs.collect()
    prints = [fingerprint(r.text) for r in rows]
    ids = [r.doc_id for r in rows]
    want = sorted((str(i), f"{p:016x}", str(c)) for i, p, c in zip(ids, prints, components(ids, prints)))
    assert got == want


def test_empty_table(spark):
    docs = empty(documents(spark))
    assert simhash.simhash_components(docs).count() == 0 and simhash.drop_near_duplicates(docs).count() == 0


@pytest.mark.parametrize("size, radius", [(8, 4), (8, 0), (8, 3), (32, 48), (8, 63)])
def test_bit_slices_equal_plain_distances(size, radius):
    rng = np.random.default_rng(size + radius)
    codes = rng.integers(0, 256, (300, size), dtype=np.uint8)
    for k in range(150, 300):
        codes[k] = codes[rng.integers(0, 150)]
        for _ in range(rng.integers(0, radius + 3)):
            codes[k, rng.integers(0, size)] ^= np.uint8(1 << rng.integers(0, 8))
    want = (np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2) <= radius) & ~np.eye(300, dtype=bool)
    near = simhash.near_lanes(codes, radius, tile=100)
    got = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :300].astype(bool)
    assert (got == want).all()


@pytest.mark.parametrize("n", [10, 10 ** 6, 10 ** 9, 10 ** 12])
def test_no_close_pair_misses_all_keys(spark, n):
    rng = random.Random(n)
    rows = []
    for k in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        rows.append((k, f"{a:016x}", f"{b:016x}"))
    frame = spark.createDataFrame(rows, "k long, a string, b string")
    keys = [simhash.band_keys(frame[c], n, 4).alias(c) for c in "ab"]
    assert frame.select(*keys).filter("not arrays_overlap(a, b)").count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)]
    star = [("hub", f"s{k:03d}") for k in range(50)]
    links = spark.createDataFrame(chain + star + [("lone", "lone"), ("b", "a"), ("a", "b")], "a string, b string")
    got = dict(tuple(r) for r in connected_components(links).collect())
    assert {got[f"c{k:03d}"] for k in range(61)} == {"c000"}
    assert {got[f"s{k:03d}"] for k in range(50)} | {got["hub"]} == {"hub"}
    assert got["a"] == got["b"] == "a" and "lone" not in got
    assert connected_components(links.filter("false")).count() == 0


def test_one_document_of_each_near_duplicate_group_stays(spark):
    rng = random.Random(9)
    clean = [" ".join(f"v{rng.randint(0, 400)}" for _ in range(rng.randint(20, 120))) for _ in range(60)]
    near = []
    for text in clean[:15]:
        words = text.split() * 3
        edited = list(words)
        edited[len(words) // 2] = "changed"
        near += [" ".join(words), " ".join(edited), " ".join(words).upper()]
    docs = documents(spark, clean[15:] + near)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    n = len(clean) - 15
    assert set(range(n)) <= set(ids)
    assert sorted(k for k in ids if k is not None and k >= n) == list(range(n, n + 45, 3))
    assert ids.count(1) == 2 and ids.count(5) == 1


def edited_pairs(kind, n=250, seed=11):
    """Texts and their appended, cut or scattered edits, at a Jaccard similarity of five-word runs of 0.80 to 0.85."""
    rng = random.Random(seed)
    pairs = []
    while len(pairs) < n:
        words = [f"u{rng.randint(0, 10 ** 6)}" for _ in range(rng.randint(60, 400))]
        other = list(words)
        if kind == "appended":
            other += [f"u{rng.randint(0, 10 ** 6)}" for _ in range(int(0.24 * len(words)) - 1)]
        elif kind == "cut":
            other = other[:int(0.82 * len(words))]
        else:
            for at in range(rng.randint(10, 40), len(words), 50):
                other[at] = "changed"
        a, b = (set(zip(*(w[k:] for k in range(5)))) for w in (words, other))
        if 0.8 <= len(a & b) / len(a | b):
            pairs.append((words, other))
    return pairs


@pytest.mark.parametrize("kind", ["appended", "cut", "scattered"])
def test_block_edits_share_a_key_and_stay_within_the_radius(kind):
    for words, other in edited_pairs(kind):
        packed = [simhash.shingle_hashes([w.encode() for w in x], 5) for x in (words, other)]
        code, keys = simhash.codes_and_keys(packed)
        assert set(keys[0]) & set(keys[1])
        assert np.bitwise_count(code[0] ^ code[1]).sum() <= simhash.WIDE_RADIUS


def test_appended_and_cut_copies_go(spark):
    pairs = [p for seed, kind in enumerate(("appended", "cut")) for p in edited_pairs(kind, 20, seed)]
    rows = [(k, " ".join(text)) for k, text in enumerate(t for p in pairs for t in p)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, len(rows), 2))


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block", [512, 8])
def test_only_links_of_the_true_similarity_count(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "EXACT_BLOCK", block)
    rng = random.Random(5)
    texts = []
    for share in [0.85, 0.9, 0.94, 0.98] * 6:
        words = [f"u{rng.randint(0, 10 ** 6)}" for _ in range(200)]
        for k in range(4):
            keep = int(200 * share ** k)
            texts.append(words[:keep] + [f"u{rng.randint(0, 10 ** 6)}" for _ in range(rng.randint(0, 40))])
    texts += [texts[0] + [f"x{k}"] for k in range(40)]
    sets = [set(zip(*(w[k:] for k in range(5)))) for w in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    between = [jaccard(a, b) for k, a in enumerate(sets) for b in sets[:k]]
    assert sum(0.65 <= x < 0.8 for x in between) > 20
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == sorted(set(root))
    groups = simhash.similar_groups([np.array(sorted(hash(x) & (1 << 62) - 1 for x in s), np.uint64) for s in sets], 0.8)
    assert np.where(groups < 0, np.arange(len(groups)), groups).tolist() == root
