"""Exponential moving averages: the one recurrence no finite window expresses, as an associative scan.

Between two known values an average is an affine map of the one before: ``y' = A y + B``, with A and B from the decay, the
new value and the number of rows since the last known one.  Maps compose, so a series is cut into calendar blocks that are
worked on apart: windows within a block compose its rows, one row a block carries the whole block's map, these rows are
folded in order, and every row applies its own composition to the average its block begins with.  A series of any length is
spread over as many tasks as it has blocks; only the block rows of one series meet.

The order is a date or a whole number and unique within a series, so a block has at most ``BLOCK`` rows.  An order that
stands twice breaks that bound and every window, so it is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.frames import spread_series

c = F.col

#: Days, or whole numbers, of one block.
BLOCK = 128


def decay_of(decay: dict[str, float]) -> float:
    """The weight of a new value: given, or 2 / (span + 1)."""
    alpha = float(decay["alpha"]) if "alpha" in decay else 2.0 / (decay["span"] + 1.0)
    if not 0 < alpha < 0.995:
        raise ValueError(f"a decay must lie between 0 and 0.995: {decay}")
    return alpha


def _block(df: DataFrame, order: str) -> Column:
    kind = df.schema[order].dataType
    if isinstance(kind, T.DateType):
        return F.floor(F.unix_date(c(order)) / BLOCK)
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
        return F.floor(c(order) / BLOCK)
    raise ValueError(f"{order} must be a date or a whole number")


def exponential_averages(df: DataFrame, keys: list[str], order: str,
                         steps: Sequence[tuple[str, str, dict[str, float]]],
                         differences: Sequence[tuple[str, str, str]] = (), state: DataFrame | None = None) -> DataFrame:
    """Append recursive averages to every series.

    ``steps`` are ``(output, input, decay)`` evaluated in order, so a step may read
    an earlier output; a decay is ``{"span": n}`` or ``{"alpha": a}``.  ``differences`` are ``(output, left, right)`` evaluated as
    soon as both sides exist.  A missing value repeats the last average and halves
    nothing but its weight: the next observation meets a decayed past.

    ``state`` (see ``average_state``) holds the averages a series had before its first row here; without one, or for a series
    it lacks, the first known value starts the average.
    """
    if "_block" in df.columns or "_pos" in df.columns:
        raise ValueError("columns _block and _pos are made here")
    within = W.partitionBy(*keys, "_block").orderBy(order)
    repeated = F.lag(order).over(within) == c(order)
    rows = spread_series(df.withColumn("_block", _block(df, order)), *keys, "_block").withColumn(
        "_pos", F.when(repeated, F.raise_error(
            F.lit(f"a series has several rows of one {order}: aggregate or deduplicate it first"))).otherwise(
            F.row_number().over(within)))
    todo, pending = list(steps), list(differences)
    while todo or pending:
        for item in [d for d in pending if {d[1], d[2]} <= set(rows.columns)]:
            rows = rows.withColumn(item[0], c(item[1]) - c(item[2]))
            pending.remove(item)
        ready = [s for s in todo if s[1] in rows.columns]
        if ready:
            rows = _round(rows, keys, within, [(out, source, decay_of(decay)) for out, source, decay in ready], state)
            todo = [s for s in todo if s not in ready]
        elif todo or not {x for d in pending for x in d[1:]} <= set(rows.columns):
            raise ValueError(f"no input for {[s[0] for s in todo] + [d[0] for d in pending]}")
    added = [s[0] for s in steps] + [d[0] for d in differences]
    return rows.select(*df.columns, *added)


def _round(rows: DataFrame, keys: list[str], within, steps: list[tuple[str, str, float]], state: DataFrame | None) -> DataFrame:
    """One scan for all steps whose inputs exist."""
    columns = rows.columns
    sources = list(dict.fromkeys(source for _, source, _ in steps))
    number = {source: k for k, source in enumerate(sources)}
    so_far = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = within.rowsBetween(W.unboundedPreceding, -1)

    def known(k: int) -> Column:
        return c(f"_x{k}").isNotNull()

    rows = rows.select(*columns, *(F.nanvl(c(s).cast("double"), F.lit(None)).alias(f"_x{k}") for s, k in number.items()))
    rows = rows.select("*", *(F.max(F.when(known(k), c("_pos"))).over(before).alias(f"_last{k}") for k in number.values()))
    # the map of one row: the first known value of a block is the base that its later ones build on
    maps = {}
    for j, (_, source, alpha) in enumerate(steps):
        k = number[source]
        weight = F.pow(F.lit(1 - alpha), c("_pos") - c(f"_last{k}"))
        later = known(k) & c(f"_last{k}").isNotNull()
        maps[f"_a{j}"] = F.when(later, weight / (weight + alpha)).otherwise(1.0)
        maps[f"_b{j}"] = F.when(later, alpha * c(f"_x{k}") / (weight + alpha)).otherwise(0.0)
    rows = rows.withColumns(maps)
    rows = rows.select("*", *(F.product(f"_a{j}").over(so_far).alias(f"_p{j}") for j in range(len(steps))))
    rows = rows.select("*", *((c(f"_p{j}") * F.sum(c(f"_b{j}") / c(f"_p{j}")).over(so_far)).alias(f"_q{j}")
                              for j in range(len(steps))))
    # both the block rows and the final rows read this exchange, so the windows above run once
    rows = spread_series(rows, *keys, "_block")

    ends = [F.max("_pos").alias("n")]
    for k in number.values():
        ends += [F.min(F.when(known(k), c("_pos"))).alias(f"first{k}"), F.max(F.when(known(k), c("_pos"))).alias(f"seen{k}"),
                 F.min_by(f"_x{k}", F.when(known(k), c("_pos"))).alias(f"x{k}")]
    for j in range(len(steps)):
        ends += [F.max_by(f"_p{j}", "_pos").alias(f"p{j}"), F.max_by(f"_q{j}", "_pos").alias(f"q{j}")]
    blocks = rows.groupBy(*keys, "_block").agg(*ends)
    begun = _scan(blocks, keys, steps, number, state)
    met = rows.join(begun, [*keys, "_block"])
    out = []
    for j, (name, source, alpha) in enumerate(steps):
        k = number[source]
        base = _met(c(f"y{j}"), c(f"gap{k}") + c(f"first{k}"), c(f"x{k}"), alpha)
        out.append(F.when(c("_pos") >= c(f"first{k}"), c(f"_p{j}") * base + c(f"_q{j}")).otherwise(c(f"y{j}")).alias(name))
    return met.select(*columns, *out)


def _met(average: Column, gap: Column, value: Column, alpha: float) -> Column:
    """The average after a known value ``gap`` rows behind the last one."""
    weight = F.pow(F.lit(1 - alpha), gap)
    return F.when(average.isNull(), value).otherwise((weight * average + alpha * value) / (weight + alpha))


def _scan(blocks: DataFrame, keys: list[str], steps: list[tuple[str, str, float]], number: dict[str, int],
          state: DataFrame | None) -> DataFrame:
    """Every block's averages and gaps at its begin, and its first known values, by folding the block rows of a series."""
    fields = [f for f in blocks.columns if f not in keys]
    series = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_block", *[f for f in fields if f != "_block"]))).alias("_all"))
    first = [F.lit(None).cast("double").alias(f"y{j}") for j in range(len(steps))] + [
        F.lit(0).cast("long").alias(f"gap{k}") for k in number.values()]
    if state is not None:
        names = [f"{out}" for out, *_ in steps]
        held = state.select(*keys, *(c(n).alias(f"_s{j}") for j, n in enumerate(names)),
                            *(c(f"{n}_gap").alias(f"_g{j}") for j, n in enumerate(names)))
        series = series.join(held, keys, "left")
        lead = {k: j for j, (_, source, _) in reversed(list(enumerate(steps))) for k in [number[source]]}
        first = [c(f"_s{j}").alias(f"y{j}") for j in range(len(steps))] + [
            F.coalesce(c(f"_g{lead[k]}"), F.lit(0)).cast("long").alias(f"gap{k}") for k in number.values()]
    begin = F.struct(*first)
    kept = [f"first{k}" for k in number.values()] + [f"x{k}" for k in number.values()]

    def step(now: Column, block: Column) -> Column:
        at, after = now["at"], []
        for j, (_, source, alpha) in enumerate(steps):
            k = number[source]
            base = _met(at[f"y{j}"], at[f"gap{k}"] + block[f"first{k}"], block[f"x{k}"], alpha)
            after.append(F.when(block[f"first{k}"].isNull(), at[f"y{j}"]).otherwise(block[f"p{j}"] * base + block[f"q{j}"]).alias(f"y{j}"))
        for k in number.values():
            after.append(F.when(block[f"first{k}"].isNull(), at[f"gap{k}"] + block["n"]).otherwise(
                block["n"] - block[f"seen{k}"]).cast("long").alias(f"gap{k}"))
        return F.struct(F.struct(*after).alias("at"), F.array_append(now["begun"], at).alias("begun"))

    none = F.array().cast(T.ArrayType(T.StructType(
        [T.StructField(f"y{j}", T.DoubleType()) for j in range(len(steps))]
        + [T.StructField(f"gap{k}", T.LongType()) for k in number.values()])))
    begun = F.aggregate("_all", F.struct(begin.alias("at"), none.alias("begun")), step, lambda x: x["begun"])
    paired = series.select(*keys, F.explode(F.arrays_zip(c("_all").alias("block"), begun.alias("at"))).alias("_pair"))
    return paired.select(
        *keys, c("_pair.block._block").alias("_block"), *(c(f"_pair.block.{n}").alias(n) for n in kept),
        *(c(f"_pair.at.{f}").alias(f) for f in [f"y{j}" for j in range(len(steps))] + [f"gap{k}" for k in number.values()]))


def average_state(averaged: DataFrame, keys: list[str], order: str,
                  steps: Sequence[tuple[str, str, dict[str, float]]]) -> DataFrame:
    """One row a series: each average after the last row, and the number of rows since its input was last known.

    This is all that later rows need of the past; feed it to ``exponential_averages`` as ``state``.
    """
    after = W.partitionBy(*keys).orderBy(c(order).desc())
    placed = averaged.withColumn("_back", F.row_number().over(after) - 1)
    found = []
    for out, source, _ in steps:
        is_known = ~F.isnan(F.coalesce(c(source).cast("double"), F.lit(float("nan"))))
        found += [F.max_by(out, order).alias(out), F.coalesce(F.min(F.when(is_known, c("_back"))), F.count(F.lit(1)))
                  .cast("long").alias(f"{out}_gap")]
    return placed.groupBy(*keys).agg(*found)
