"""Rolling statistics over one time series per key, written as SQL expressions.

Every helper takes and returns SQL text, so a stage of dozens of columns is one
``selectExpr`` call.  All helpers of one :class:`Series` share a partition key and an
order: Spark plans a single exchange and a single sort for any number of them.

A series has one row per key and calendar date.  Its length is bounded by the
calendar (36,525 rows per century) and not by the volume of the raw data, which is
reduced to one row per key and date by partial aggregation before any window runs.
That bound is what makes one task per series safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def stage(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Append columns given as SQL text; none may exist yet."""
    return df.selectExpr("*", *[f"{sql} AS `{name}`" for name, sql in columns.items()])


def flag(condition: str) -> str:
    """1 when the condition holds, 0 when it is false or unknown."""
    return f"int(coalesce({condition}, false))"


def ratio(numerator: str, denominator: str) -> str:
    """Division that gives NULL for a zero or unknown denominator."""
    return f"try_divide({numerator}, {denominator})"


def spread_series(df: DataFrame, *key: str) -> DataFrame:
    """Place whole series, or blocks of them, by key into the session's number of shuffle partitions.

    The windows widen every row about tenfold.  AQE would size the partitions by the
    narrow input and merge them into too few tasks, so the count is fixed here.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *key)


class Series:
    """Window expressions for rows of ``key`` ordered by ``order``."""

    def __init__(self, key: str = "index_code", order: str = "trade_date"):
        self.base = f"PARTITION BY {key} ORDER BY {order}"
        self.row = f"({self.base})"
        self.so_far = f"({self.base} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def last(self, n: int) -> str:
        return f"({self.base} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def lag(self, x: str, k: int = 1) -> str:
        return f"lag({x}, {k}) OVER {self.row}"

    def lead(self, x: str, k: int = 1) -> str:
        return f"lead({x}, {k}) OVER {self.row}"

    def position(self) -> str:
        return f"row_number() OVER {self.row}"

    def over(self, call: str, n: int) -> str:
        """An aggregate call over the last n rows, however many exist."""
        return f"{call} OVER {self.last(n)}"

    def full(self, call: str, x: str, n: int) -> str:
        """An aggregate call over the last n rows, NULL until n known values exist."""
        return f"CASE WHEN count({x}) OVER {self.last(n)} = {n} THEN {call} OVER {self.last(n)} END"

    def mean(self, x: str, n: int) -> str:
        return self.full(f"avg({x})", x, n)

    def std(self, x: str, n: int) -> str:
        return self.full(f"stddev_samp({x})", x, n)

    def highest(self, x: str, n: int) -> str:
        return self.full(f"max({x})", x, n)

    def lowest(self, x: str, n: int) -> str:
        return self.full(f"min({x})", x, n)

    def values(self, x: str, n: int) -> str:
        """The last n values as a sorted array, NULL until n known values exist."""
        return f"CASE WHEN count({x}) OVER {self.last(n)} = {n} THEN sort_array(collect_list({x}) OVER {self.last(n)}) END"

    def change(self, x: str, k: int) -> str:
        return f"try_divide({x}, {self.lag(x, k)}) - 1"

    def crosses_up(self, x: str) -> str:
        """1 on the row where the value turns positive."""
        return flag(f"{x} > 0 AND {self.lag(x)} <= 0")

    def crosses_down(self, x: str) -> str:
        return flag(f"{x} < 0 AND {self.lag(x)} >= 0")

    def run_length(self, condition: str, position: str = "_pos") -> str:
        """Length so far of the current run of true rows, 0 on any other row.

        ``position`` is the row number in the same order.  The last row outside the
        run is a running maximum, so no gaps-and-islands grouping is needed.
        """
        inside = f"coalesce({condition}, false)"
        return (f"double(CASE WHEN {inside} THEN {position} - coalesce(max(CASE WHEN NOT {inside} "
                f"THEN {position} END) OVER {self.so_far}, 0) ELSE 0 END)")


def percent_rank_of_last(ordered: str, current: str) -> str:
    """Average-tie percentile rank of ``current`` inside a sorted array holding it: the mean of its first and last place."""
    first = f"array_position({ordered}, {current})"
    last = f"size({ordered}) + 1 - array_position(reverse({ordered}), {current})"
    return f"CASE WHEN {ordered} IS NOT NULL THEN ({first} + {last}) / 2D / size({ordered}) END"


def quantile_of(ordered: str, n: int, q: float) -> str:
    """Linear-interpolated quantile of a sorted array of n values."""
    at = q * (n - 1)
    low = int(at)
    part = at - low
    return (f"element_at({ordered}, {low + 1}) + {part!r}D * (element_at({ordered}, {min(low + 2, n)}) "
            f"- element_at({ordered}, {low + 1}))")
