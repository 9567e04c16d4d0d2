"""Daily event features, rolled event features, candidates and answer parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.text import event_score, json_list, json_object_text
from barloom.operators.frames import Series, stage
from barloom.operators.upsert import head_per_group, not_yet_extracted
from barloom.schemas import EVENT_GROUPS, ROLL_WINDOWS, event_features

c = F.col

# --- Fixed values: the neutral placeholder of an unreadable answer.
NEUTRAL_EVENT = {
    "event_type": "其他", "event_stage": "确认", "expectation_level": "中性",
    "surprise_level": "符合预期", "affected_style": "全市场", "impact_direction": "中性",
    "impact_strength": "1",
}
NEUTRAL_NAME = "未识别事件"
NEUTRAL_REASON = "LLM解析失败，已按中性事件占位"
ANSWER_FIELDS = ["event_name", "event_type", "event_stage", "expectation_level", "surprise_level",
                 "affected_style", "impact_direction", "impact_strength", "reason"]


def event_group_rows(events: DataFrame, news: DataFrame) -> DataFrame:
    """Events with score and strength defaults and the keyword groups of their news."""
    groups = news.select(c("news_id").alias("source_ids"), c("matched_groups").alias("_groups"))
    scored = events.select("trade_date", "event_score", "impact_strength", "source_ids")
    return scored.join(groups, "source_ids", "left").select(
        "trade_date",
        F.coalesce(c("event_score").try_cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce(c("impact_strength").try_cast("double"), F.lit(1.0)).alias("strength"),
        json_list(F.coalesce(c("_groups"), F.lit("[]"))).alias("groups"))


def daily_event_features(events: DataFrame, news: DataFrame,
                         groups: list[str] | None = None) -> DataFrame:
    """One row per date: mean score over all events, summed score per group.

    Everything is one conditional aggregate, so a day that holds most of the
    events is reduced on the map side.
    """
    rows = event_group_rows(events, news)
    aggs = ["avg(score) AS event_score", "count(*) AS event_count",
            "count_if(score > 0) AS event_positive_count", "count_if(score < 0) AS event_negative_count",
            "max(strength) AS event_max_strength"]
    for group in EVENT_GROUPS if groups is None else groups:
        inside, p = f"array_contains(groups, '{group}')", f"event_{group}"
        aggs += [f"sum(CASE WHEN {inside} THEN score ELSE 0D END) AS {p}_score",
                 f"count_if({inside}) AS {p}_count",
                 f"count_if({inside} AND score > 0) AS {p}_positive_count",
                 f"count_if({inside} AND score < 0) AS {p}_negative_count",
                 f"coalesce(max(CASE WHEN {inside} THEN strength END), 0D) AS {p}_max_strength"]
    return rows.groupBy("trade_date").agg(*[F.expr(a) for a in aggs])


def attach_daily(market: DataFrame, daily: DataFrame, columns: list[str],
                 fill: float | None = 0.0) -> DataFrame:
    """Left join a per-date table on the trading calendar.

    ``daily`` has one row per calendar date, the bound behind the broadcast.  Days
    that are not trading days drop out.
    """
    joined = market.join(F.broadcast(daily.select("trade_date", *columns)), "trade_date", "left")
    if fill is None:
        return joined
    return joined.selectExpr(*[f"`{n}`" for n in market.columns],
                             *[f"coalesce(double(`{n}`), {float(fill)!r}D) AS `{n}`" for n in columns])


def roll_events(df: DataFrame, columns: list[str] | None = None, windows: list[int] | None = None,
                key: str = "index_code", order: str = "trade_date") -> DataFrame:
    """Sums (maxima for strengths) of event columns over the last n trading rows."""
    s = Series(key, order)
    out: dict[str, str] = {}
    for n in windows or ROLL_WINDOWS:
        for name in columns or event_features():
            reducer = "max" if name.endswith("_max_strength") else "sum"
            out[f"{name}_roll_{n}d"] = s.over(f"{reducer}(coalesce(double({name}), 0D))", n)
    return stage(df, out)


def news_candidates(news: DataFrame, events: DataFrame, start_date: str | None = None,
                    end_date: str | None = None, include_unmatched: bool = True,
                    limit_per_day: int | None = None, limit: int | None = None,
                    tie: str = "news_id") -> DataFrame:
    """News still to be turned into events, newest first, matched before unmatched."""
    rows = not_yet_extracted(news, events)
    if start_date:
        rows = rows.filter(c("trade_date") >= F.lit(start_date).cast("date"))
    if end_date:
        rows = rows.filter(c("trade_date") <= F.lit(end_date).cast("date"))
    matched = F.coalesce(c("matched_groups") != "[]", F.lit(False))
    if not include_unmatched:
        rows = rows.filter(matched)
    rank = [F.when(matched, 0).otherwise(1).asc(), c("publish_time").desc(), c(tie).desc()]
    if limit_per_day:
        rows = head_per_group(rows, ["trade_date"], limit_per_day, *rank)
    rows = rows.orderBy(c("trade_date").desc(), *rank)
    return rows.limit(limit) if limit else rows


def recent_candidates(news: DataFrame, events: DataFrame, limit: int = 30, tie: str = "news_id") -> DataFrame:
    """Daily mode: the newest unprocessed items, matched or not."""
    return news_candidates(news, events, limit=limit, include_unmatched=True, tie=tie)


def history_candidates(news: DataFrame, events: DataFrame, start_date: str, end_date: str,
                       limit_per_day: int = 20, limit: int | None = None,
                       include_unmatched: bool = False, tie: str = "news_id") -> DataFrame:
    """History mode: a date range, matched items only, a fixed number a day."""
    return news_candidates(news, events, start_date, end_date, include_unmatched, limit_per_day,
                           limit, tie)


def _strength_number(raw: Column) -> Column:
    """Integer of a quoted or bare strength; a quoted decimal is unreadable."""
    quoted = F.schema_of_variant(raw) == "STRING"
    text = F.try_variant_get(raw, "$", "string")
    number = F.try_variant_get(raw, "$", "double").try_cast("int")
    return F.when(quoted, F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("int"))).otherwise(number)


def parse_event_answers(responses: DataFrame, news: DataFrame, response: str = "response") -> DataFrame:
    """Turn landed answers into event rows; an unreadable answer becomes a neutral event.

    The score uses the strength clamped to 1..5, the stored strength is the given one.
    """
    meta = news.select("news_id", "trade_date", "title", "matched_keywords", "matched_groups")
    body = json_object_text(c(response))
    rows = responses.select("news_id", body.alias("_body"), F.try_parse_json(body).alias("_v")) \
        .join(meta, "news_id")
    ok = c("_v").isNotNull()
    fields = {n: F.try_variant_get(c("_v"), f"$.{n}", "string") for n in ANSWER_FIELDS}
    strength = _strength_number(F.try_variant_get(c("_v"), "$.impact_strength", "variant"))
    strength = F.coalesce(F.nullif(strength, F.lit(0)), F.lit(1))

    def field(name: str) -> Column:
        return F.when(ok, fields[name]).otherwise(F.lit(NEUTRAL_EVENT[name]))

    reason = F.when(fields["reason"] != "", fields["reason"])
    name = F.when(ok, F.coalesce(fields["event_name"], F.lit(""))).otherwise(
        F.coalesce(F.nullif(c("title"), F.lit("")), F.lit(NEUTRAL_NAME)))
    score = event_score(fields["impact_direction"], strength, fields["expectation_level"],
                        fields["event_stage"], fields["surprise_level"])
    return rows.select(
        "trade_date", F.substring(name, 1, 200).alias("event_name"),
        *[field(n).alias(n) for n in ANSWER_FIELDS[1:7]],
        F.when(ok, strength).otherwise(1).alias("impact_strength"),
        F.when(ok, score).otherwise(0.0).alias("event_score"),
        F.when(ok, F.coalesce(reason, c("_body"))).otherwise(NEUTRAL_REASON).alias("llm_reason"),
        c("news_id").alias("source_ids"),
        F.to_json(json_list(c("matched_keywords"))).alias("matched_keywords"),
        F.to_json(json_list(c("matched_groups"))).alias("matched_groups"))


#: Re-extraction keeps the first date and name of an event: both are outside the
#: columns an existing row may change.
EVENT_UPSERT = {"keys": ["source_ids"], "immutable": ["trade_date", "event_name"]}
