"""Forum list pages, post details, comments and page-quality flags from landed HTML."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.nulls import blank_to_null, lenient_int
from barloom.functions.text import board_code, comment_id, post_id
from barloom.operators.upsert import latest_per_key
from barloom.sources.markup import comment_nodes
from barloom.sources.news import INSIDE, anchors, attribute_pattern, visible_text

c = F.col

# --- Fixed values: site addresses, boards, page markers, limits.
FORUM_ORIGIN = "https://guba.eastmoney.com"
FORUM_SOURCE = "eastmoney_guba"
CHALLENGE_WORDS = ["验证码", "安全验证", "访问过于频繁", "请完成验证", "滑块", "人机验证", "captcha",
                   "verify", "verification"]
FORBIDDEN_MARKS = ["403 forbidden", "microsoft-iis/10.0"]
BOARDS = [
    ("中证1000吧", FORUM_ORIGIN + "/list,zssh000852.html", "中证1000"),
    ("沪深300ETF华泰柏瑞吧", FORUM_ORIGIN + "/list,of510300.html", "沪深300ETF"),
    ("中证500ETF南方吧", FORUM_ORIGIN + "/list,of510500.html", "中证500ETF"),
    ("创业板ETF易方达吧", FORUM_ORIGIN + "/list,of159915.html", "创业板ETF"),
    ("科创50ETF华夏吧", FORUM_ORIGIN + "/list,sh588000.html", "科创50ETF"),
]
TITLE_LIMIT, AUTHOR_LIMIT, MIN_COMMENTS = 500, 100, 3


def select_boards(df: DataFrame, name: str | None = None) -> DataFrame:
    """All boards, or those of one board name or topic."""
    return df.filter((c("bar_name") == name) | (c("topic") == name)) if name else df


def boards(spark: SparkSession, name: str | None = None) -> DataFrame:
    """Configured boards, optionally one by board name or topic."""
    return select_boards(spark.createDataFrame(BOARDS, "bar_name string, url string, topic string"), name)


def page_flags(pages: DataFrame, html: str = "html") -> DataFrame:
    """Mark challenge pages and forbidden pages by their visible text."""
    text = F.lower(visible_text(c(html)))

    def any_of(words: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [text.contains(w) for w in words])

    return pages.withColumns({
        "is_challenge": F.coalesce(any_of(CHALLENGE_WORDS), F.lit(False)).cast("int"),
        "is_forbidden": F.coalesce(any_of(FORBIDDEN_MARKS), F.lit(False)).cast("int"),
    })


def list_page_posts(pages: DataFrame, html: str = "html", bar_name: str = "bar_name",
                    list_url: str = "url", order: str = "page_id", min_title: int = 1,
                    marker: str = "/news,", origin: str = FORUM_ORIGIN,
                    id_fallback: str = "url") -> DataFrame:
    """Posts listed on board pages; a post seen twice keeps its last occurrence.

    Read and reply counts are taken from the list row around the link.
    """
    # table rows and the stretches between them; only a table row carries counts
    segments = F.split(c(html), r"(?i)(?=<tr\b)|(?<=</tr>)")
    listed = pages.select(order, bar_name, list_url, F.posexplode(segments).alias("_row", "_html"))
    links = listed.select(order, bar_name, list_url, "_row", "_html", F.posexplode(anchors(c("_html"))).alias("_pos", "_link"))
    url = F.when(c("_link.href").startswith("//"), F.concat(F.lit("https:"), c("_link.href"))) \
        .when(c("_link.href").startswith("/"), F.concat(F.lit(origin), c("_link.href"))) \
        .otherwise(c("_link.href"))

    def count_of(kind: str) -> Column:
        pattern = rf'(?is)^<tr\b.*class\s*=\s*["\'][^"\']*\b{kind}\b[^"\']*["\'][^>]*>\s*([\d,]+)'
        return lenient_int(F.nullif(F.regexp_extract(c("_html"), pattern, 1), F.lit("")))

    posts = links.select(
        order, bar_name, c(list_url).alias("_list"), "_row", "_pos", url.alias("url"),
        visible_text(c("_link.body")).alias("_title"),
        count_of("read").alias("read_count"), count_of("reply").alias("comment_count"))
    posts = posts.filter((F.char_length("_title") >= min_title) & c("url").contains(origin.split("://")[-1] + marker))
    mine = board_code(c("_list"))
    posts = posts.filter(mine.isNull() | c("url").contains(F.concat(F.lit(marker), mine, F.lit(","))))
    rows = posts.select(
        post_id(c("url"), id_fallback).alias("post_id"), F.lit(FORUM_SOURCE).alias("source"),
        c(bar_name).alias("bar_name"), F.substring("_title", 1, TITLE_LIMIT).alias("title"),
        c("_title").alias("content"), "read_count", "comment_count", "url", order, "_row", "_pos")
    return latest_per_key(rows, ["post_id"], c(order), c("_row"), c("_pos")).drop(order, "_row", "_pos")


def json_text_field(html: Column, name: str) -> Column:
    """Value of a quoted field of JSON embedded in a page; NULL when empty."""
    value = F.regexp_extract(html, rf'"{name}"\s*:\s*"([^"]*)"', 1)
    return F.when(value != "", value)


def json_int_field(html: Column, name: str) -> Column:
    return lenient_int(F.regexp_extract(html, rf'"{name}"\s*:\s*(\d+)', 1))


def element_markup(html: Column, opening: str) -> Column:
    """What the first element whose opening tag matches holds, nested elements of its name included.

    The text from the tag on is cut where a tag of the same name begins or ends; a walk over the cuts
    counts the depth, and the element ends at the cut that brings it to zero, or with the page.
    """
    at = F.regexp_instr(html, F.lit(opening))
    rest = F.when(at > 0, F.substring(html, at, F.length(html)))
    name = F.regexp_extract(rest, r"^<(\w+)", 1)
    pieces = F.split(rest, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"(?![\w-]))")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

    def step(at: Column, piece: Column) -> Column:
        depth = at["depth"] + F.when(piece.startswith("</"), -1).when(piece.startswith("<"), 1).otherwise(0)
        seen = at["seen"] + 1
        closed = (at["end"] == 0) & (depth == 0) & piece.startswith("</")
        return F.struct(depth.alias("depth"), seen.alias("seen"), F.when(closed, at["seen"]).otherwise(at["end"]).alias("end"))

    end = F.aggregate(pieces, start, step, lambda x: F.when(x["end"] > 0, x["end"]).otherwise(x["seen"]))
    return F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), end), ""), rf"^<{INSIDE}>", "")


def class_text(html: Column, *names: str) -> Column:
    """Visible text of the first element carrying one of the classes, whatever is nested in it."""
    word = rf"(?<![\w-])(?:{'|'.join(names)})(?![\w-])"
    value = rf"""(?:"[^"<>]*?{word}[^"]*+"|'[^'<>]*?{word}[^']*+'|{word}(?=[\s>]))"""
    opening = attribute_pattern(r"\w++", "class") + value + INSIDE + ">"
    return blank_to_null(visible_text(element_markup(html, opening)))


def post_details(pages: DataFrame, html: str = "html") -> DataFrame:
    """Detail fields of a post page; what a page does not give stays NULL."""
    page = c(html)
    time = F.coalesce(json_text_field(page, "post_publish_time"), class_text(page, "time")) \
        .try_cast("timestamp_ntz")
    content = F.coalesce(json_text_field(page, "post_content"), json_text_field(page, "post_abstract"),
                         class_text(page, "newstext", "stockcodec", "article-body"))
    return pages.withColumns({
        "d_title": json_text_field(page, "post_title"), "d_publish_time": time,
        "d_trade_date": time.cast("date"), "d_content": content,
        "d_read_count": json_int_field(page, "post_click_count"),
        "d_comment_count": json_int_field(page, "post_comment_count"),
        "d_like_count": json_int_field(page, "post_like_count"),
    })


def apply_details(posts: DataFrame, details: DataFrame, key: str = "post_id") -> DataFrame:
    """Override list values by the non-empty detail values."""
    fields = [n[2:] for n in details.columns if n.startswith("d_")]
    joined = posts.join(details.select(key, *[f"d_{n}" for n in fields]), key, "left")
    return joined.withColumns({
        n: F.coalesce(c(f"d_{n}"), c(n)) if n in posts.columns else c(f"d_{n}") for n in fields
    }).drop(*[f"d_{n}" for n in fields])


def admitted_posts(posts: DataFrame) -> DataFrame:
    """Detail rows count only with a publish time."""
    return posts.filter(c("publish_time").isNotNull())


def commented_posts(posts: DataFrame, minimum: int = MIN_COMMENTS) -> DataFrame:
    """Posts whose comments are worth parsing."""
    return posts.filter(F.coalesce(c("comment_count"), F.lit(0)) >= minimum)


def comment_time(text: Column, year: int) -> Column:
    """Timestamp in a comment; one without a year gets the given year."""
    full = F.regexp_extract(text, r"(20\d{2}-\d{2}-\d{2}\s+\d{2}:\d{2}(?::\d{2})?)", 1)
    short = F.regexp_extract(text, r"(\d{2}-\d{2}\s+\d{2}:\d{2})", 1)
    chosen = F.when(full != "", full).when(short != "", F.concat(F.lit(f"{year}-"), short))
    return F.regexp_replace(chosen, r"\s+", " ").try_cast("timestamp_ntz")


NODES = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("text", T.StringType()),
                                  T.StructField("content", T.StringType()), T.StructField("author", T.StringType())]))


@F.pandas_udf(NODES)
def _comment_nodes(html: pd.Series) -> pd.Series:
    return html.map(comment_nodes)


def page_comments(pages: DataFrame, year: int, html: str = "html", post: str = "post_id",
                  bar_name: str = "bar_name", url: str = "url") -> DataFrame:
    """Comments of post pages: distinct contents of at least two characters, the first of each kept.

    The extent of a comment depends on how its markup nests, so each page is parsed once, in Arrow batches.
    """
    rows = pages.select(post, bar_name, url, F.explode(_comment_nodes(c(html))).alias("_node"))
    text = c("_node.text")

    def number(words: str) -> Column:
        return lenient_int(F.regexp_extract(text, rf"(?i)(?:{words})[^\d]*(\d+)", 1))

    parsed = rows.select(
        post, bar_name, url, c("_node.index").alias("_index"), text.alias("_text"), c("_node.content").alias("content"),
        blank_to_null(F.substring("_node.author", 1, AUTHOR_LIMIT)).alias("author"), comment_time(text, year).alias("publish_time"),
        number("like|赞").alias("like_count"), number("reply|回复").alias("reply_count"))
    parsed = parsed.filter((F.char_length("_text") >= 2) & (F.char_length("content") >= 2))
    firsts = parsed.groupBy(post, "content").agg(F.min("_index").alias("_index"))
    kept = parsed.join(firsts, [post, "content", "_index"], "left_semi")
    return kept.select(
        comment_id(c(post), c("author"), c("publish_time"), c("content"), c("_index")).alias("comment_id"),
        c(post).alias("post_id"), F.lit(FORUM_SOURCE).alias("source"), c(bar_name).alias("bar_name"),
        "publish_time", c("publish_time").cast("date").alias("trade_date"), "author", "content",
        "like_count", "reply_count", c(url).alias("url"))
