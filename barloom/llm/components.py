"""Connected components of a link table by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star hangs every node's larger neighbours on its smallest one; small star the smaller ones and itself."""
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = links.unionByName(turned) if large else links
    least = stored(around.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("low")), "links-least")
    met = around.join(least, around.a == least.node)
    if large:
        new = met.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        new = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    return new.filter("a <> b").distinct()


def _oriented(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(
        F.xxhash64("b", "a").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; `root` is the component's smallest node.

    `links` has columns (a, b) of one ordered type without nulls.  Each round writes its links to the shared folder,
    so a lost executor costs one stage; the number of rounds grows with the logarithm of the longest chain.
    """
    links = stored(_oriented(links), "links")
    before = _state(links)
    while before[0]:
        links = stored(_star(_star(links, large=True), large=False), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))
