"""Merkle manifest of a dataset: leaves ranked per group, nodes nested by rank digits within bounded blocks, proofs unfolded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import lower_ascii, stored

#: Children of a node, and digits of a rank that one block nests: a block holds FAN ** DIGITS nodes at most.
FAN = 8
DIGITS = 4
BLOCK = FAN ** DIGITS
#: Most rows of one range of the ranking; a range is one task.
RANGE_ROWS = 1 << 18
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
ROW_BITS = 33


def encoded(col: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


def ranked(nodes: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with `rank` (from 0, in `order` within `group`, nulls first) and `size` (rows of the group), as longs.

    Rows are range-partitioned on all their order columns, so one group may fill many tasks; a row's rank is its place in
    its own range plus the group's rows in the ranges before, which are one small row a range and group.
    """
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.count()
    ranges = max(1, min(spread, -(-rows // BLOCK)), -(-rows // RANGE_ROWS))
    placed = nodes.repartitionByRange(ranges, group, *order).sortWithinPartitions(group, *order)
    placed = stored(placed.withColumn("_place", F.monotonically_increasing_id()), f"{name}-places")
    part = F.shiftright("_place", ROW_BITS)
    counts = placed.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    whole = W.partitionBy("_group")
    offsets = counts.select(
        "_group", "_part", "_first", F.sum("_rows").over(whole).alias("size"),
        (F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows")).alias("_before"))
    met = placed.join(offsets, placed[group].eqNullSafe(offsets["_group"]) & (part == F.col("_part")))
    return met.withColumn("rank", F.col("_place") - F.col("_first") + F.col("_before")).drop(
        "_place", "_group", "_part", "_first", "_before")


def _paths(kids: Column, grows: Column) -> Column:
    """Every child with the digests of the siblings before and after it; no entry where the group has no such level."""
    digests = F.transform(kids, lambda k: k["node"])

    def child(kid: Column, i: Column) -> Column:
        step = F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("before"),
                        F.array_join(F.slice(digests, i + 2, F.lit(FAN)), "").alias("after"))
        return F.struct(kid.alias("kid"), F.when(grows, F.array(step)).otherwise(F.array().cast(PATH)).alias("path"))

    return F.transform(kids, child)


def nest_blocks(nodes: DataFrame, group: str, carried: list[str]) -> DataFrame:
    """One row per (group, block of BLOCK consecutive ranks): (group, size, block, node, nest).

    Needs columns group, rank, size, node.  One shuffle by block; then the rank's digits are grouped away from the last
    to the first, each time nesting the child structs in order and hashing their digests.  Level j is hashed where the
    group has more than FAN ** j nodes.
    """
    digits = [f"_d{j}" for j in range(DIGITS)]
    rows = nodes.select(
        group, "size", F.floor(F.col("rank") / BLOCK).cast("long").alias("block"),
        *(F.shiftright(F.col("rank"), 3 * j).bitwiseAND(FAN - 1).cast("int").alias(d) for j, d in enumerate(digits)),
        F.struct("node", *carried).alias("nest"))
    rows = rows.repartition(group, "block")
    for j, digit in enumerate(digits):
        keys = [group, "size", "block", *digits[j + 1:]]
        kids = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(digit, "nest"))).alias("kids"))
        kids = kids.withColumn("kids", F.transform("kids", lambda k: k["nest"]))
        joined = F.array_join(F.transform("kids", lambda k: k["node"]), "")
        node = F.when(F.col("size") > FAN ** j, F.sha2(joined, 256)).otherwise(F.col("kids")[0]["node"])
        rows = kids.select(*keys, F.struct(node.alias("node"), F.col("kids")).alias("nest"))
    return rows.select(group, "size", "block", F.col("nest.node").alias("node"), "nest")


def nest_tiers(nodes: DataFrame, group: str, carried: list[str], name: str) -> list[DataFrame]:
    """Nested blocks tier by tier: the blocks of one are the nodes of the next, until every group is one block.

    Needs columns group, rank, size, node.
    """
    tiers = [stored(nest_blocks(nodes, group, carried), f"{name}-blocks")]
    while tiers[-1].filter("block > 0").limit(1).count():
        upper = tiers[-1].select(group, F.col("block").alias("rank"), F.ceil(F.col("size") / BLOCK).alias("size"), "node",
                                 F.col("block").alias("_place"))
        tiers.append(stored(nest_blocks(upper, group, ["_place"]), f"{name}-blocks"))
    return tiers


def unfold_tiers(tiers: list[DataFrame], group: str, carried: list[str], heads: DataFrame) -> DataFrame:
    """(group, node, carried..., path, head columns): each node with the siblings of every level up to its group's head.

    `heads` holds, for every group, `path` from its top node and further columns.  Rows come out of their nested block
    by explodes alone; what a block takes from above (one row a block) meets it by (group, block).
    """
    further = [c for c in heads.columns if c not in (group, "path")]
    above = heads.withColumn("_place", F.lit(0).cast("long"))
    for tier in reversed(tiers):
        above = above.withColumnsRenamed({group: "_group", "_place": "_block"})
        met = tier.drop("node").join(
            above, tier[group].eqNullSafe(above["_group"]) & (tier["block"] == above["_block"])).drop("_group", "_block")
        kept = carried if tier is tiers[0] else ["_place"]
        for j in reversed(range(DIGITS)):
            steps = F.explode(_paths(F.col("nest.kids"), F.col("size") > FAN ** j)).alias("step")
            met = met.select(group, "size", *further, steps, F.col("path").alias("above")).select(
                group, "size", *further, F.col("step.kid").alias("nest"), F.concat("step.path", "above").alias("path"))
        above = met.select(group, *(F.col(f"nest.{c}").alias(c) for c in ("node", *kept)), "path", *further)
        if tier is not tiers[0]:
            above = above.drop("node")
    return above


def folded(path: Column, digest: Column) -> Column:
    """The root recomputed from a digest and the siblings of every level."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def proof_text(path: Column) -> Column:
    return F.array_join(F.flatten(F.transform(path, lambda s: F.array(s["before"], s["after"]))), "")


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root, proof path and the check of a tampered copy, for every row.

    Returns (doc_id, leaf, subroot, root, path, tampered, folded_root, verified).  A leaf covers doc_id, source, lang,
    n_chars and text (absent columns count as null; other columns are not read).  Nulls are encoded as `-`, apart from
    empty values.  Rows of one lang ascend by doc_id (null first), rows sharing an id by their leaves; equal rows are
    leaves of their own.  Texts of any length are hashed whole.  An empty table has no rows.
    """
    values = {c: F.col(f"`{c}`") if c in docs.columns else F.lit(None).cast("string") for c in FIELDS}
    tampers = F.crc32(values["doc_id"].cast("string").cast("binary")) % 3 == 0
    changed = {**values, "text": lower_ascii(values["text"])}
    leaf, other = leaf_digest(*values.values()), leaf_digest(*changed.values())
    leaves = docs.select(values["doc_id"].alias("doc_id"), values["lang"].alias("lang"), leaf.alias("node"),
                         F.when(tampers, other).alias("tampered"))
    # the texts are hashed once; from here on rows are small, and a number tells equal rows apart
    leaves = stored(leaves.withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    carried = ["doc_id", "tampered"]
    tiers = nest_tiers(ranked(leaves, "lang", ["doc_id", "node", "_row"], "merkle"), "lang", carried, "merkle")
    langs = ranked(tiers[-1].select("lang", "node", F.lit(0).alias("_all")), "_all", ["lang"], "merkle-langs")
    roots = nest_tiers(langs, "_all", ["lang"], "merkle-langs")
    top = roots[-1].select("_all", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    heads = unfold_tiers(roots, "_all", ["lang"], top).select("lang", "path", F.col("node").alias("subroot"), "root")
    rows = unfold_tiers(tiers, "lang", carried, heads)
    rows = rows.withColumn("folded_root", folded(F.col("path"), F.coalesce("tampered", "node")))
    return rows.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "path", "tampered", "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    manifest = merkle_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return manifest.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
                           "folded_root", "verified")


def _tree_sql(name: str, leaves: str, group: str, levels: int = 12) -> str:
    """Levels of a tree as common table expressions: `{name}{j}` holds (group, idx, h, n) of level j."""
    steps = [f"{name}0 AS (SELECT {group} AS g, rank AS idx, node AS h, size AS n FROM {leaves})"]
    for j in range(levels):
        steps.append(f"""{name}{j + 1} AS (
  SELECT g, idx // {FAN} AS idx, CASE WHEN any_value(n) > {FAN ** j} THEN sha256(string_agg(h, '' ORDER BY idx))
    ELSE any_value(h) END AS h, any_value(n) AS n, list(h ORDER BY idx) AS kids
  FROM {name}{j} GROUP BY g, idx // {FAN})""")
    return ",\n".join(steps)


def _climb_sql(name: str, rows: str, out: str, proof: str, fold: str, levels: int = 12) -> str:
    """Every row of `rows` (g, idx, proof, fold) carried up the levels of a tree."""
    steps, source = [], rows
    for j in range(levels):
        place = f"(r.idx // {FAN ** j} % {FAN})"
        left, right = f"array_to_string(t.kids[:{place}], '')", f"array_to_string(t.kids[{place} + 2:], '')"
        grows = f"t.n > {FAN ** j}"
        steps.append(f"""{out}{j} AS (
  SELECT r.* EXCLUDE ({proof}, {fold}), CASE WHEN {grows} THEN {proof} || {left} || {right} ELSE {proof} END AS {proof},
    CASE WHEN {grows} THEN sha256({left} || {fold} || {right}) ELSE {fold} END AS {fold}
  FROM {source} r JOIN {name}{j + 1} t ON t.g IS NOT DISTINCT FROM r.g AND t.idx = r.idx // {FAN ** (j + 1)})""")
        source = f"{out}{j}"
    return ",\n".join(steps)


_ENCODED = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_FIELDS_SQL = " || ".join(_ENCODED.format(c) for c in FIELDS)
_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TABLE_SQL = ("SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN "
              "xor(a // 2, 3988292384) ELSE a // 2 END, x::BIGINT)) AS t")
_CRC_SQL = ("xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), "
            "lambda c, s: xor(c // 256, t[xor(c % 256, s) + 1]), 4294967295::BIGINT), 4294967295)")

OP11_SQL = f"""WITH crc AS ({_TABLE_SQL}),
leaves AS (
  SELECT doc_id, lang, sha256({_FIELDS_SQL}) AS node,
    CASE WHEN {_CRC_SQL} % 3 = 0 THEN sha256({_FIELDS_SQL.replace("text", _LOWER_SQL)}) END AS tampered
  FROM documents, crc),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, node) - 1 AS rank,
    count(*) OVER (PARTITION BY lang) AS size FROM leaves),
{_tree_sql("a", "numbered", "lang")},
langs AS (SELECT 0 AS all_langs, g AS lang, h AS node, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS rank,
  count(*) OVER () AS size FROM a12),
{_tree_sql("b", "langs", "all_langs")},
start AS (SELECT lang AS g, rank AS idx, doc_id, node AS leaf, '' AS proof, coalesce(tampered, node) AS fold FROM numbered),
{_climb_sql("a", "start", "c", "proof", "fold")},
met AS (SELECT 0 AS g, l.rank AS idx, c.doc_id, c.leaf, l.node AS subroot, c.proof, c.fold
  FROM c11 c JOIN langs l ON l.lang IS NOT DISTINCT FROM c.g),
{_climb_sql("b", "met", "d", "proof", "fold")}
SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root.h AS verified
FROM d11, (SELECT h FROM b12) root"""
