import hashlib
import random

import duckdb
import public_tokenizers
import tiktoken

import corpus_pipeline
from barloom.llm import bpe, queries


def fixture(spark, tmp):
    rng = random.Random(6)

    def text(n):
        return " ".join(f"w{rng.randint(0, 900)}" for _ in range(n))

    items = [(k, text(30) + ".\n" + text(8)) for k in range(10)]
    docs, clean = [], set()

    def add(t):
        docs.append((len(docs), t, "en", "src", len(t or "")))
        return len(docs) - 1

    for _ in range(60):
        clean.add(add("\n".join(text(rng.randint(20, 60)) for _ in range(3))))
    toxic = [add(text(40) + " moron " + text(40)) for _ in range(120)]
    plain = [add(text(80)) for _ in range(300)]
    clean |= set(plain)
    long = text(300)
    copies = [add(long), add(long), add(long.replace(long.split()[150], "other", 1))]
    leaks = [add(text(50) + " " + items[k][1] + " " + text(50)) for k in range(5)]
    lines = [add(text(30) + "\nCookie banner text\n" + text(30)) for _ in range(12)]
    add("")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp}/documents.parquet")
    marks = [(k, 1, 1) for k in toxic] + [(k, 1, 0) for k in plain]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")
    return docs, clean, toxic, copies, leaks, lines


def test_stages_do_their_work(spark, tmp_path):
    docs, clean, toxic, copies, leaks, lines = fixture(spark, str(tmp_path))
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = set(toxic) | set(copies[1:]) | set(leaks)
    assert set(rows) == {d[0] for d in docs} - gone
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")).ranks)
    first = True
    for doc_id, text, *_ in docs:
        if doc_id in rows:
            if doc_id in lines and not first:
                text = text.replace("\nCookie banner text", "")
            first = first and doc_id not in lines
            assert rows[doc_id].ids == encoding.encode_ordinary(text)
            assert rows[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_columns_and_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() == 0, name


def test_queries_equal_their_sql(spark, sf_dir):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    for name, sql in queries.ORACLES.items():
        want = con.sql(sql)
        got = queries.QUERIES[name](spark, sf_dir)
        assert sorted(want.columns) == sorted(got.columns), name
        columns = ", ".join(sorted(want.columns))
        assert sorted(map(str, con.sql(f"select {columns} from want").fetchall())) == sorted(
            str(tuple(r)) for r in got.select(*sorted(want.columns)).collect()), name
