import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm import merkle

from .frames import documents, empty

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """The root and, for every node, its (before, after) of each level, by plain recursion."""
    if len(nodes) <= 1:
        return (nodes[0] if nodes else None), [[] for _ in nodes]
    runs = [nodes[k:k + 8] for k in range(0, len(nodes), 8)]
    root, above = climb([digest("".join(r)) for r in runs])
    return root, [[("".join(runs[k // 8][:k % 8]), "".join(runs[k // 8][k % 8 + 1:])), *above[k // 8]] for k in range(len(nodes))]


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        low = [*row[:4], row[4].translate(UPPER) if row[4] is not None else None]
        cut = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        leaf = digest("".join(map(field, row)))
        groups.setdefault(row[2], []).append((row[0], leaf, digest("".join(map(field, low))) if cut else leaf))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(climb([r[1] for r in groups[lang]]))
    root, above = climb([t[0] for t in trees])
    out = []
    for lang, (subroot, paths), high in zip(langs, trees, above):
        for (doc_id, leaf, start), path in zip(groups[lang], paths):
            folded, proof = start, ""
            for before, after in path + high:
                folded, proof = digest(before + folded + after), proof + before + after
            out.append((str(doc_id), leaf, subroot, root, digest(proof), folded, folded == root))
    return sorted(out)


def answers(docs):
    rows = merkle.merkle_manifest(docs).withColumn("proof_sha256", F.sha2(merkle.proof_text(F.col("path")), 256))
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows.collect())


def random_rows(n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, k, k, k, k % 50]), rng.choice([None, "", "src"]), rng.choice(["en"] * 6 + ["de", None, "", "é"]),
             rng.choice([None, k]), rng.choice([None, "", "Ab", "lower", "ÀÉ Word " * rng.randint(1, 50)])) for k in range(n)]
    return rows + rows[:5] + [(3, "s", "one", 1, "A" * 200_000)]


KIND = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("digits", [1, 4])
def test_against_recursion(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "BLOCK", 8 ** digits)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 100)
    rows = random_rows(600, 5)
    assert answers(spark.createDataFrame(rows, KIND).repartition(5)) == brute(rows)


@pytest.mark.parametrize("n", [1, 9])
def test_small_groups(spark, n):
    rows = [(k, "s", "en", 1, f"Text {k}") for k in range(n)]
    assert answers(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, None, None, None, r.text) for r in docs.collect()]
    assert answers(docs) == brute(rows)
    assert answers(empty(docs)) == []
    names = docs.withColumns({c: F.lit(1) for c in ("node", "rank", "size", "block", "path", "nest", "_row", "_place", "kids")})
    assert answers(names) == brute(rows)


def test_sql_on_tables(spark, sf_dir):
    got = merkle.op11_merkle_manifest(spark, sf_dir)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(tuple(r) for r in got.collect()) == sorted(
        db.sql(f"SELECT {', '.join(got.columns)} FROM ({merkle.OP11_SQL})").fetchall())
