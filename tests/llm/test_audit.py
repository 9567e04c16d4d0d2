import itertools
import random
import re

import duckdb
from pyspark.sql import functions as F

from barloom.llm import audit

from .frames import documents, empty

SMALL = audit.AuditSettings(shard_bytes=3000, bucket_words=100)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """{(part, order, step): measures} by applying every order document by document."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = []
    for doc_id, part, text in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if doc_id is not None and any(
            o is not None and o < doc_id and (t or "") == text for o, _, t in docs) else set()
        rows.append((part or "", fails, doc_id is not None and doc_id in good, doc_id is not None and doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                shapley[name] += len(gone)
                failing = sum(name in r[1] for r in mine)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {name} for r in mine),
                                          sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def answers(spark, docs, labels, settings=SMALL):
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in audit.filter_audit(docs, frame, settings).collect()}


def random_docs(n, seed):
    rng = random.Random(seed)
    texts = [None, "", "copy of a copy", "A" * 9000, " \x0b\x0c\x1c\x85  ", "x " * 4000]
    for _ in range(n):
        vocabulary = [rng.choice(["a", "Bb", "Ä", "C#", "dd", "Éé", "x y"]) + str(rng.randint(0, 90)) for _ in range(60)]
        texts.append(rng.choice([" ", "\t", "\r\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))))
    rows = [(rng.choice([k, k, k, None]), rng.choice(["s", "s", "t", None, ""]), rng.choice(texts)) for k in range(2 * n)]
    rows += [(1, "s", "copy of a copy"), (1, "s", "copy of a copy"), (0, "u", "copy of a copy")]
    return rows


def test_against_all_orders(spark):
    docs = random_docs(60, 3)
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(100)] + [(3, 1, 1), (4, None, None), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3)
    assert answers(spark, frame, labels) == brute(docs, labels)


def test_awkward_rows(spark):
    docs = documents(spark).withColumns({c: F.lit("x") for c in ("part", "shard", "digest", "mask", "source", "word", "code")})
    rows = [(r.doc_id, "x", r.text) for r in docs.collect()]
    assert answers(spark, docs, []) == brute(rows, [])
    assert answers(spark, docs.drop("source"), []) == brute([(i, "", t) for i, _, t in rows], [])
    assert answers(spark, empty(docs), [(1, 1, 1)]) == {}
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert answers(spark, blank, []) == brute([(1, "", ""), (2, "", "")], [])


def test_matrix_is_global(spark):
    docs = random_docs(80, 9)
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(4)
    shards = audit.document_term_matrix(frame, SMALL).collect()
    assert len({s.shard for s in shards}) == len(shards) > 4
    counts, documents_of = {}, {}
    for s in shards:
        assert s.indptr[0] == 0 and s.indptr[-1] == len(s.columns) == len(s.counts) and len(s.indptr) == len(s.doc_ids) + 1
        for k in range(len(s.doc_ids)):
            part = slice(s.indptr[k], s.indptr[k + 1])
            assert len(set(s.columns[part])) == part.stop - part.start
            for column, n in zip(s.columns[part], s.counts[part]):
                counts[column] = counts.get(column, 0) + n
                documents_of[column] = documents_of.get(column, 0) + 1
    want, held = {}, {}
    for _, _, text in docs:
        words = WORD.findall(text or "")
        for w in words:
            want[w] = want.get(w, 0) + 1
        for w in set(words):
            held[w] = held.get(w, 0) + 1
    assert sorted(zip(counts.values(), documents_of.values())) == sorted((want[w], held[w]) for w in want)


def test_sql_on_tables(spark, sf_dir):
    got = audit.op13_filter_audit(spark, sf_dir)
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    assert sorted(tuple(r) for r in got.collect()) == sorted(
        db.sql(f"SELECT {', '.join(got.columns)} FROM ({audit.OP13_SQL})").fetchall())
