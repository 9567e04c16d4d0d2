"""Normalisers for landed news tables and link extraction from home pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.nulls import blank_to_null
from barloom.functions.text import (absolute_url, keep_by_keywords, keyword_groups, matched_groups,
                                    matched_keywords, news_id, stable_news_id)
from barloom.operators.upsert import head_per_group

c = F.col

# --- Fixed values: candidate headers, source names, limits.
TITLE_COLUMNS = ["title", "标题", "新闻标题"]
CONTENT_COLUMNS = ["content", "内容", "新闻内容", "detail", "详情"]
URL_COLUMNS = ["url", "链接", "新闻链接"]
CALENDAR_TITLE_COLUMNS = ["事件", "title", "指标名称", "名称"]
CALENDAR_URL = "https://finance.baidu.com/calendar"
TRANSCRIPT_KEY, TRANSCRIPT_SOURCE = "cctv_news", "CCTV新闻联播"
CALENDAR_KEY, CALENDAR_SOURCE = "baidu_economic_calendar", "百度股市通经济日历"
NEWS_SOURCES = {"东方财富财经新闻": "https://finance.eastmoney.com/",
                "新浪财经": "https://finance.sina.com.cn/", "财联社网页": "https://www.cls.cn/"}
TITLE_LIMIT, MIN_LINK_TEXT, MAX_ITEMS = 500, 6, 80


def first_known(df: DataFrame, candidates: Sequence[str]) -> Column:
    """First non-blank text among the candidate columns the table has."""
    have = [blank_to_null(c(f"`{n}`")) for n in candidates if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def _news_rows(df: DataFrame, source: str, groups: dict[str, list[str]], mode: str) -> DataFrame:
    text = F.concat_ws("\n", c("_title"), c("_content"))
    kept = df.filter(c("_title").isNotNull() & keep_by_keywords(text, groups, mode))
    return kept.select(
        "news_id", F.lit(source).alias("source"), c("_day").cast("timestamp").alias("publish_time"),
        c("_day").alias("trade_date"), F.substring("_title", 1, TITLE_LIMIT).alias("title"),
        c("_content").alias("content"), c("_url").alias("url"),
        F.to_json(matched_keywords(text, groups)).alias("matched_keywords"),
        F.to_json(matched_groups(text, groups)).alias("matched_groups"))


def normalize_transcripts(raw: DataFrame, day: str = "trade_date", groups: dict | None = None,
                          mode: str = "match", source: str = TRANSCRIPT_SOURCE) -> DataFrame:
    """Broadcast transcripts: blank titles drop out, content falls back to the title."""
    title = first_known(raw, TITLE_COLUMNS)
    df = raw.withColumns({
        "_day": c(day).cast("date"), "_title": title,
        "_content": F.coalesce(first_known(raw, CONTENT_COLUMNS), title),
        "_url": F.coalesce(first_known(raw, URL_COLUMNS), F.lit("")),
    }).withColumn("news_id", stable_news_id(F.lit(TRANSCRIPT_KEY), c("_day"), c("_title"), c("_url")))
    return _news_rows(df, source, keyword_groups(groups), mode)


def normalize_calendar(raw: DataFrame, columns: Sequence[str] | None = None, day: str = "trade_date",
                       groups: dict | None = None, mode: str = "match",
                       source: str = CALENDAR_SOURCE) -> DataFrame:
    """Economic calendar: the content joins every known value of the row."""
    names = list(columns or [n for n in raw.columns if n != day])
    content = F.concat_ws(" | ", *[c(f"`{n}`").cast("string") for n in names])
    df = raw.withColumns({
        "_day": c(day).cast("date"), "_title": first_known(raw, CALENDAR_TITLE_COLUMNS),
        "_content": content, "_url": F.lit(CALENDAR_URL),
    }).withColumn("news_id", stable_news_id(F.lit(CALENDAR_KEY), c("_day"), c("_title"), c("_content")))
    return _news_rows(df, source, keyword_groups(groups), mode)


# Inside a tag: anything but an angle bracket; after an equals sign a value in double quotes, in single quotes or bare.
# Every repetition is possessive, so a page is read once from left to right, whatever it holds.
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s<>"'][^\s<>]*+)"""
INSIDE = rf"(?:[^<>=]++|=\s*+{VALUE}?+)*+"
#: A whole tag, a closing bracket within a quoted value included; a bracket that opens no tag is text.
TAG = rf"(?s)<(?=[a-zA-Z/!?]){INSIDE}>"
#: An opening anchor tag and what follows up to the end tag or the next anchor (which ends it as well).
ANCHOR = rf"(?is)<a(?=[\s/]){INSIDE}>((?:[^<]++|<(?!/?a[\s/>]))*+)"


def attribute_pattern(tag: str, name: str) -> str:
    """Pattern of an opening tag up to the value of its attribute `name`; a name within another's value doesn't count."""
    edge = r"""[\s/"']"""
    return rf"""(?is)<{tag}(?={edge})(?:[^<>=\s/"']++|{edge}(?!{name}\s*+=)|=\s*+{VALUE}?+)*+{edge}{name}\s*+=\s*+"""


HREF = "^" + attribute_pattern("a", "href") + rf"({VALUE})"
#: entities in links and texts; the ampersand is decoded last
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#38;", "&"),
            ("&amp;", "&")]


def decoded(markup: Column) -> Column:
    """Common entities as characters."""
    for entity, char in ENTITIES:
        markup = F.replace(markup, F.lit(entity), F.lit(char))
    return markup


def visible_text(markup: Column) -> Column:
    """Text of a fragment: tags dropped, common entities decoded, blanks collapsed."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(markup, TAG, " ")), r"\s+", " "))


def unquoted(value: Column) -> Column:
    return F.when(value.startswith('"') | value.startswith("'"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def anchors(markup: Column) -> Column:
    """All anchors of a fragment with a target, in order, as (href, body); targets without quotes, entities decoded.

    One linear pass; the parts of each anchor are cut from its own match.
    """
    whole = F.regexp_extract_all(markup, F.lit(ANCHOR), F.lit(0))
    parts = F.transform(whole, lambda x: F.struct(
        F.trim(decoded(unquoted(F.regexp_extract(x, HREF, 1)))).alias("href"), F.regexp_extract(x, ANCHOR, 1).alias("body")))
    return F.filter(parts, lambda x: x["href"] != "")


def page_links(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Every anchor of a page with its position, raw target and visible text."""
    rows = pages.select(*keep, F.posexplode(anchors(c(html))))
    return rows.select(*keep, "pos", c("col.href").alias("href"), visible_text(c("col.body")).alias("text"))


def extract_links(pages: DataFrame, groups: dict | None = None, mode: str = "match",
                  max_items: int = MAX_ITEMS, source: str = "source", page_url: str = "url",
                  order: Sequence[str] = ("page_id", "pos"), min_text: int = MIN_LINK_TEXT) -> DataFrame:
    """Keyword-matching links of news home pages, the first ``max_items`` a source.

    The cap is the feature itself.  It is applied per map task before the shuffle,
    so a source with most of the pages is not gathered.
    """
    groups = keyword_groups(groups)
    names = [n for n in dict.fromkeys([source, page_url, *order]) if n != "pos"]
    links = page_links(pages, keep=names).filter((c("href") != "") & (F.char_length("text") >= min_text))
    links = links.filter(keep_by_keywords(c("text"), groups, mode))
    capped = head_per_group(links, [source], max_items, *[c(n).asc() for n in order])
    full = capped.withColumn("link", absolute_url(c("href"), c(page_url)))
    return full.select(
        news_id(c(source).cast("string"), c("link"), c("text")).alias("news_id"), c(source).alias("source"),
        *[c(n) for n in order if n != source], F.substring("text", 1, TITLE_LIMIT).alias("title"),
        c("text").alias("content"), c("link").alias("url"),
        F.to_json(matched_keywords(c("text"), groups)).alias("matched_keywords"),
        F.to_json(matched_groups(c("text"), groups)).alias("matched_groups"))
