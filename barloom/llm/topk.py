"""Exact top-k by inner product: ball trees per shard, searched by branch and bound with a shared k-th score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored

SCALE = 1024
#: Vectors of a shard, queries of a block, and vectors of a leaf (expected and at most).
SHARD_ROWS = 16384
QUERY_ROWS = 4096
LEAF_ROWS = 64


def scaled_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, vector array<bigint>, dim): floor(scale * x) of every component as double.

    Rows with a null id, a null vector or a null or non-finite component take no part.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(~F.coalesce(bad, F.lit(True))).select(
        "vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("vector"),
        F.size("x").alias("dim"))


class BallTree:
    """Balls of vectors: a node is a run of rows with centre and radius; children halve it along its widest spread."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        self.ids, self.vectors = ids, vectors
        self.nodes: list[tuple[int, int, int, int]] = []
        self.centres, self.radii = [], []
        order = np.arange(len(ids))
        self._split(order, 0, len(ids), leaf)
        self.ids, self.vectors = ids[order], vectors[order]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def _split(self, order: np.ndarray, low: int, high: int, leaf: int) -> int:
        rows = self.vectors[order[low:high]].astype(float)
        centre = rows.mean(axis=0)
        away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        me = len(self.nodes)
        self.nodes.append((low, high, -1, -1))
        self.centres.append(centre)
        self.radii.append(away.max())
        if high - low > leaf and away.max() > 0:
            far = rows[away.argmax()]
            other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
            half = (high - low) // 2
            order[low:high] = order[low:high][np.argpartition(rows @ (other - far), half)]
            self.nodes[me] = (low, high, self._split(order, low, low + half, leaf),
                              self._split(order, low + half, high, leaf))
        return me

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of each query's k best rows that reach its floor, the query's own id left out.

        All queries go down together; a node is visited by those whose upper bound, centre . q + radius * |q|, still
        reaches their k-th score so far, the child with the larger bound first.  A bound equal to the k-th score
        is followed, as a smaller id may win the tie.
        """
        exact = int(np.abs(self.vectors).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
        if exact >= 2 ** 63:
            raise OverflowError("inner products do not fit in 64 bits")
        kind = np.float64 if exact < 2 ** 53 else np.int64
        rows, asked = self.vectors.astype(kind), queries.astype(kind)
        norms = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        bounds = queries.astype(float) @ self.centres.T + norms[:, None] * self.radii
        bounds += 1e-9 * (np.abs(bounds) + 1) * max(1, queries.shape[1])
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in query_ids]
        kth = floors.astype(float).copy()
        todo = [(0, np.arange(len(query_ids)))]
        while todo:
            node, who = todo.pop()
            who = who[bounds[who, node] >= kth[who]]
            if not len(who):
                continue
            low, high, left, right = self.nodes[node]
            if left < 0:
                scores = asked[who] @ rows[low:high].T
                for q, line in zip(who.tolist(), scores):
                    keep = np.flatnonzero((line >= kth[q]) & (self.ids[low:high] != query_ids[q]))
                    if len(keep):
                        best[q] = top(np.concatenate([best[q][0], line[keep].astype(np.int64)]),
                                      np.concatenate([best[q][1], self.ids[low:high][keep]]), k)
                        if len(best[q][0]) == k:
                            kth[q] = max(kth[q], best[q][0][-1])
                continue
            first = bounds[who, left] >= bounds[who, right]
            todo += [(right, who[first]), (left, who[~first]), (right, who[~first]), (left, who[first])]
        return best


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _found(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Searches one shard for one block of queries; the group holds both."""
    mine, asked = pdf[~pdf["is_query"]], pdf[pdf["is_query"]]
    empty = pd.DataFrame({"query_id": [], "copy": [], "score": [], "vec_id": []}).astype("int64")
    if not len(mine) or not len(asked):
        return empty
    tree = BallTree(mine["vec_id"].to_numpy(np.int64), np.array(mine["vector"].tolist(), np.int64).reshape(len(mine), -1))
    ids = asked["vec_id"].to_numpy(np.int64)
    got = tree.search(ids, np.array(asked["vector"].tolist(), np.int64).reshape(len(asked), -1), k,
                      asked["floor"].fillna(-np.inf).to_numpy(float))
    sizes = [len(s) for s, _ in got]
    return pd.DataFrame({"query_id": np.repeat(ids, sizes), "copy": np.repeat(asked["copy"].to_numpy(np.int64), sizes),
                         "score": np.concatenate([s for s, _ in got]), "vec_id": np.concatenate([i for _, i in got])})


def top_inner_products(vectors: DataFrame, queries: DataFrame, *, k: int = 10, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product for every query row.

    `queries` has the columns of `vectors` and is a stated set of them.  Rows are dealt to shards of about SHARD_ROWS
    and queries to blocks of about QUERY_ROWS, both by hash.  First every query is searched in one shard; its k-th
    score there is the floor that it carries into all other shards, whose trees skip every ball that cannot reach
    it.  Only vectors of one length are compared.  A row with the query's own vec_id is no candidate; other rows
    that repeat an id are candidates of their own, and a repeated query row has its own ranks.  Ties go to the
    smaller vec_id; with fewer candidates than k all are returned; no vectors give no rows.  Vectors so large that a score
    could leave 64 bits raise OverflowError.
    """
    rows = stored(scaled_vectors(vectors, scale).withColumn("copy", F.monotonically_increasing_id()), "vectors")
    asked = stored(scaled_vectors(queries, scale).withColumn("copy", F.monotonically_increasing_id()), "queries")
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))
    shard = F.pmod(F.xxhash64("copy", F.lit("shard")), F.lit(shards)).cast("int")
    kept = ["vec_id", "vector", "dim"]
    placed = rows.select(*kept, shard.alias("shard"))
    dealt = asked.select(*kept, "copy", shard.alias("home"),
                         F.pmod(F.xxhash64("copy", F.lit("block")), F.lit(blocks)).cast("int").alias("block"))
    schema = "query_id bigint, copy bigint, score bigint, vec_id bigint"

    def search(right: DataFrame, split: int) -> DataFrame:
        """Every shard meets its queries in groups (shard, block, dim); a shard's rows go once to each of its blocks."""
        own = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(split - 1)))).select(
            *kept, "shard", "block", F.lit(None).cast("bigint").alias("copy"), F.lit(None).cast("double").alias("floor"),
            F.lit(False).alias("is_query"))
        both = own.unionByName(right.select(*kept, "shard", "block", "copy", "floor", F.lit(True).alias("is_query")))
        return both.groupBy("shard", "block", "dim").applyInPandas(lambda pdf: _found(pdf, k), schema)

    per_home = max(1, math.ceil(blocks / shards))
    at_home = dealt.select(*kept, "copy", F.col("home").alias("shard"), (F.col("block") % per_home).alias("block"),
                           F.lit(None).cast("double").alias("floor"))
    first = stored(search(at_home, per_home), "first-shard")
    floors = first.groupBy("copy").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor"))
    away = dealt.join(floors, "copy", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rest = search(away.filter("shard <> home"), blocks)
    ranked = first.unionByName(rest).groupBy("query_id", "copy").agg(F.slice(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("lost"), "vec_id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.lost")).alias("score"))


def op2_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_inner_products(vectors, vectors.filter("vec_id % 100 = 0"))


OP2_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 10
"""
