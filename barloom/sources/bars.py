"""Normalisers for landed daily bars of indices, ETFs and futures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.nulls import to_number
from barloom.functions.text import normalized_date
from barloom.operators.frames import Series, stage

c = F.col

# --- Fixed values: header aliases of the landed tables.
INDEX_ALIASES = {
    "date": "trade_date", "日期": "trade_date", "开盘": "open", "开盘价": "open", "最高": "high",
    "最高价": "high", "最低": "low", "最低价": "low", "收盘": "close", "收盘价": "close",
    "成交量": "volume", "成交额": "amount", "成交金额": "amount", "涨跌幅": "pct_chg",
    "涨跌额": "change", "振幅": "amplitude",
}
ETF_ALIASES = {
    "date": "trade_date", "日期": "trade_date", "开盘": "open", "最高": "high", "最低": "low",
    "收盘": "close", "涨跌幅": "pct_chg", "成交量": "volume", "成交额": "amount", "换手率": "turnover",
}
FUTURES_ALIASES = {
    "date": "trade_date", "日期": "trade_date", "开盘价": "open", "最高价": "high", "最低价": "low",
    "收盘价": "close", "结算价": "settle", "成交量": "volume", "hold": "open_interest",
    "持仓量": "open_interest",
}
REQUIRED = ["trade_date", "open", "high", "low", "close"]

# --- Fixed values: default instruments (kind, code, name, category).
INSTRUMENTS = [
    ("index", "000852", "中证1000", None), ("index", "000300", "沪深300", None),
    ("index", "000905", "中证500", None), ("index", "000001", "上证指数", None),
    ("index", "399006", "创业板指", None), ("index", "000688", "科创50", None),
    ("etf", "159845", "中证1000ETF华夏", "中证1000ETF"), ("etf", "510300", "华泰柏瑞沪深300ETF", "沪深300ETF"),
    ("etf", "510500", "南方中证500ETF", "中证500ETF"), ("etf", "159915", "易方达创业板ETF", "创业板ETF"),
    ("etf", "588000", "华夏科创50ETF", "科创50ETF"),
    ("future", "IM0", "中证1000股指期货主力连续", "index_future"),
    ("future", "IC0", "中证500股指期货主力连续", "index_future"),
    ("future", "IF0", "沪深300股指期货主力连续", "index_future"),
    ("future", "CU0", "铜主力连续", "commodity"), ("future", "SC0", "原油主力连续", "commodity"),
    ("future", "AU0", "黄金主力连续", "commodity"),
]


def instruments(spark: SparkSession, rows: Sequence[tuple] | None = None) -> DataFrame:
    """Instrument dimension; a fixed handful of rows."""
    return spark.createDataFrame(list(rows or INSTRUMENTS),
                                 "kind string, code string, name string, category string")


def with_instrument(bars: DataFrame, dimension: DataFrame, code: str = "index_code") -> DataFrame:
    """Attach name and category; the size of the dimension decides how it is joined."""
    dim = dimension.select(c("code").alias(code), c("name").alias("_name"), c("category").alias("_category"))
    return bars.join(dim, code, "left").withColumnsRenamed(
        {"_name": "instrument_name", "_category": "instrument_category"})


def exchange_symbol(code: Column, kind: str = "index") -> Column:
    """Exchange-prefixed symbol of an index or ETF code."""
    if kind == "index":
        prefix = F.when(code.startswith("399"), "sz").otherwise("sh")
    else:
        prefix = F.when(code.startswith("5") | code.startswith("6"), "sh").otherwise("sz")
    return F.concat(prefix, code)


def rename_headers(raw: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Canonical column names; a table lacking a required column is refused."""
    out = raw.withColumnsRenamed({k: v for k, v in aliases.items() if k in raw.columns})
    missing = [n for n in REQUIRED if n not in out.columns]
    if missing:
        raise ValueError(f"bars are missing columns {missing}; got {raw.columns}")
    return out


def _between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        df = df.filter(c("trade_date") >= F.lit(start).cast("date"))
    return df.filter(c("trade_date") <= F.lit(end).cast("date")) if end else df


def _optional(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [(to_number(c(n)) if n in df.columns else F.lit(None).cast("double")).alias(n) for n in names]


def _given_or(df: DataFrame, computed: str) -> Column:
    return to_number(c("pct_chg")) if "pct_chg" in df.columns else F.expr(computed)


def normalize_index_bars(raw: DataFrame, start: str | None = None, end: str | None = None,
                         source: str = "landed") -> DataFrame:
    """Index bars: canonical types, previous close and percentage change.

    ``raw`` carries ``index_code`` (and optionally ``index_name``).  The date range is
    applied first: the first row of the range has no previous close.
    """
    df = rename_headers(raw, INDEX_ALIASES).withColumn("trade_date", normalized_date(c("trade_date")))
    df = _between(df, start, end)
    s = Series("index_code", "trade_date")
    prices = [to_number(c(n)).alias(n) for n in REQUIRED[1:]]
    name = c("index_name") if "index_name" in df.columns else F.lit(None).cast("string")
    origin = c("data_source") if "data_source" in df.columns else F.lit(source)
    given = ["pct_chg"] if "pct_chg" in df.columns else []
    base = df.select("trade_date", c("index_code").cast("string").alias("index_code"),
                     name.alias("index_name"), *prices, *given, *_optional(df, ["volume", "amount"]),
                     origin.alias("data_source"))
    out = stage(base, {"pre_close": s.lag("close"), "_chg": f"({s.change('close', 1)}) * 100"})
    return out.select("trade_date", "index_code", "index_name", *REQUIRED[1:], "pre_close",
                      _given_or(base, "_chg").alias("pct_chg"), "volume", "amount", "data_source")


def normalize_etf_bars(raw: DataFrame, start: str | None = None, end: str | None = None,
                       source: str = "landed") -> DataFrame:
    """ETF bars; as index bars with turnover and without a previous close."""
    df = rename_headers(raw, ETF_ALIASES).withColumn("trade_date", normalized_date(c("trade_date")))
    df = _between(df, start, end)
    s = Series("etf_code", "trade_date")
    name = c("etf_name") if "etf_name" in df.columns else F.lit(None).cast("string")
    origin = c("data_source") if "data_source" in df.columns else F.lit(source)
    given = ["pct_chg"] if "pct_chg" in df.columns else []
    base = df.select("trade_date", c("etf_code").cast("string").alias("etf_code"), name.alias("etf_name"),
                     *[to_number(c(n)).alias(n) for n in REQUIRED[1:]], *given,
                     *_optional(df, ["volume", "amount", "turnover"]), origin.alias("data_source"))
    out = stage(base, {"_chg": f"({s.change('close', 1)}) * 100"})
    return out.select("trade_date", "etf_code", "etf_name", *REQUIRED[1:],
                      _given_or(base, "_chg").alias("pct_chg"), "volume", "amount", "turnover", "data_source")


def normalize_futures_bars(raw: DataFrame, source: str = "landed") -> DataFrame:
    """Futures bars: no date range, change always recomputed, turnover value unknown.

    The change is taken in date order whatever the order of the landed rows.
    """
    df = rename_headers(raw, FUTURES_ALIASES).withColumn("trade_date", normalized_date(c("trade_date")))
    s = Series("future_code", "trade_date")
    text = [(c(n) if n in df.columns else F.lit(None)).cast("string").alias(n)
            for n in ("future_code", "future_name", "category")]
    origin = c("data_source") if "data_source" in df.columns else F.lit(source)
    base = df.select("trade_date", *text, *[to_number(c(n)).alias(n) for n in REQUIRED[1:]],
                     *_optional(df, ["settle", "volume", "open_interest"]), origin.alias("data_source"))
    out = stage(base, {"pct_chg": f"({s.change('close', 1)}) * 100", "amount": "cast(null as double)"})
    return out.select("trade_date", "future_code", "future_name", "category", *REQUIRED[1:], "settle",
                      "pct_chg", "volume", "open_interest", "amount", "data_source")


def first_source(sources: Sequence[DataFrame], code: str = "index_code", aliases: dict[str, str] | None = None,
                 start: str | None = None, end: str | None = None) -> DataFrame:
    """Per instrument, the rows of the first source (in given order) that has any in the asked range.

    Sources lacking a required column are skipped as a whole.  The winner is found
    from one tiny row per instrument and source; the bars themselves are only
    filtered, not shuffled by instrument.
    """
    usable = []
    for priority, raw in enumerate(sources):
        try:
            df = rename_headers(raw, aliases or INDEX_ALIASES)
        except ValueError:
            continue
        day = c("trade_date").cast("date")
        for bound, inside in ((start, lambda d, x: d >= x), (end, lambda d, x: d <= x)):
            if bound is not None:
                df = df.filter(inside(day, F.lit(bound).cast("date")))
        usable.append(df.withColumn("_priority", F.lit(priority)))
    if not usable:
        raise ValueError("no source has the required columns")
    rows = usable[0]
    for other in usable[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    winner = rows.groupBy(code).agg(F.min("_priority").alias("_priority"))
    return rows.join(winner, [code, "_priority"], "left_semi").drop("_priority")


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every calendar date of a closed range."""
    return spark.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("trade_date"))
