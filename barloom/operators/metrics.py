"""Conditional-aggregate building blocks for signal metrics.

A rule is a name, an optional threshold and a condition.  Every row is expanded to
the rules, and one map-side combined aggregate per rule yields both the numbers of
the matching rows and those of the whole slice.  A rule without a match still gets
its row: count 0, coverage 0, every other number NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.nulls import holds
from barloom.operators.ranking import grouped_median

c = F.col
Rule = tuple[str, float | None, Column]


def rule_item(rule: Column, threshold: float | None, hit: Column, **more: Column) -> Column:
    """One expanded rule: its text, threshold, sortable threshold and whether the row matches."""
    return F.struct(rule.alias("rule"), F.lit(threshold).cast("double").alias("threshold"),
                    F.lit(-1.0 if threshold is None else threshold).alias("_t"),
                    holds(hit).alias("hit"), *[v.alias(k) for k, v in more.items()])


def expand_rules(rows: DataFrame, rules: Sequence[Rule], yearly: tuple[str, Column] | None = None,
                 date: str = "trade_date") -> DataFrame:
    """One copy of the row per rule with ``rule``, ``threshold``, ``_t`` and ``hit``.

    ``yearly`` adds the rule ``<name>_year_<year>`` of the row's own year, so the
    years are further groups of the same single pass.
    """
    items = [rule_item(F.lit(name), threshold, cond) for name, threshold, cond in rules]
    if yearly:
        items.append(rule_item(yearly_name(yearly[0], date), None, yearly[1]))
    return rows.select("*", F.inline(F.array(*items)))


def yearly_name(name: str, date: str) -> Column:
    return F.concat(F.lit(f"{name}_year_"), F.year(date).cast("string"))


def explode_values(rows: DataFrame, name: str, values: Sequence) -> DataFrame:
    return rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def pool_scopes(rows: DataFrame, year: str = "test_year") -> DataFrame:
    """Count every row once for its year and once for the pooled scope.

    Adds ``scope`` and replaces the year by ``_year``, which is -1 when pooled.
    """
    items = F.array(F.struct(F.lit("year").alias("scope"), c(year).cast("int").alias("_year")),
                    F.struct(F.lit("aggregate").alias("scope"), F.lit(-1).alias("_year")))
    return rows.select(*[n for n in rows.columns if n != year], F.inline(items))


def scope_year() -> Column:
    return F.nullif(c("_year"), F.lit(-1)).alias("test_year")


def hit_count(extra: Column | None = None) -> Column:
    return F.count_if(c("hit") if extra is None else c("hit") & holds(extra))


def hit_mean(value: Column) -> Column:
    return F.avg(F.when(c("hit"), value))


def hit_rate(condition: Column) -> Column:
    return F.avg(F.when(c("hit"), holds(condition).cast("double")))


def rate(condition: Column) -> Column:
    """Share of rows for which the condition holds; unknown counts as no."""
    return F.avg(holds(condition).cast("double"))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def with_median(summary: DataFrame, rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Attach an exact median per key; keys without rows get NULL."""
    return summary.join(grouped_median(rows, keys, value, name), keys, "left")
