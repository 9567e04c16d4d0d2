import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import lines

from .frames import documents, empty

BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_docs, keep_first):
    holders, first = defaultdict(set), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for pos, line in enumerate((text or "").split("\n")):
            holders[key_of(line)].add(doc_id)
            first.setdefault(key_of(line), (doc_id, text, pos))
    out = []
    for doc_id, text in rows:
        every = (text or "").split("\n")
        kept = [x for pos, x in enumerate(every) if not key_of(x) or len(holders[key_of(x)]) < min_docs
                or (keep_first and first[key_of(x)] == (doc_id, text, pos))]
        out.append((str(doc_id), len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out)


TEXTS = ([f"own line {k}\n  Shared Line\t\nÉtat\n\n{'x' * k}\nshared line" for k in range(12)]
         + [f"état\nÉtat\nother {k}" for k in range(3)] + [None, "", "\n", "Only shared line\nSHARED LINE", "\u00a0shared line"])


@pytest.mark.parametrize("keep_first", [False, True])
def test_against_brute_force(spark, keep_first):
    docs = documents(spark, TEXTS)
    out = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs, min_docs=4, keep_first=keep_first, slices=5)).select("_row.*", "_lines")
    got = sorted((str(r.doc_id), r["_lines"].n_lines, r["_lines"].n_dropped, r["_lines"].kept) for r in out.collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 4, keep_first)


def test_digest_and_columns(spark):
    docs = documents(spark, TEXTS)
    digest = lines.line_digest(docs, min_docs=4)
    want = [(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in
            brute([(r.doc_id, r.text) for r in docs.collect()], 4, False)]
    assert sorted((str(r[0]), *r[1:]) for r in digest.collect()) == sorted(want)
    out = lines.dedup_lines(docs, min_docs=4)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert lines.line_digest(empty(docs)).count() == 0 and lines.dedup_lines(empty(docs)).count() == 0


def test_long_documents_use_many_words(spark):
    text = "\n".join(["hot"] + [f"line {k}" for k in range(300)] + ["hot"])
    docs = spark.createDataFrame([(k, text + f"\n{k}") for k in range(11)], "doc_id long, text string")
    rows = lines.keep_bitmaps(docs, keep_first=False).collect()
    assert len(rows) == 11 and all(len(r.words) == 5 for r in rows)
    assert {r.n_dropped for r in lines.line_digest(docs).collect()} == {302}


def test_only_dataframe_operations(spark, sf_dir, capsys):
    lines.op6_line_dedup(spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_clashing_names(spark):
    names = ["_lines", "_row", "_key", "key", "_words", "_hash", "_id", "pos", "kept", "n_lines", "slice", "first"]
    docs = spark.createDataFrame([(k, "same line\nown %d" % k) for k in range(12)], "doc_id long, text string")
    wide = docs.withColumns({n: F.lit(n) for n in names})
    out = lines.dedup_lines(wide, min_docs=10)
    assert out.columns == wide.columns
    assert {r.doc_id: r.text for r in out.collect()} == {k: ("same line\n" if k == 0 else "") + f"own {k}" for k in range(12)}
    assert all(r[n] == n for r in out.collect() for n in names)
    one = lines.keep_bitmaps(docs, slices=1).count()
    assert one == lines.keep_bitmaps(docs, slices=7).count() == lines.keep_bitmaps(docs).count() == 11
