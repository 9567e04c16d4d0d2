"""Identifiers, keyword and lexicon matching, event scoring and text parsing.

Whole texts are searched in place with ``contains``; nothing is truncated before
matching.  Only the stored title, event name and prompt are cut to their limits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: keyword groups, lexicons, score multipliers, prompt labels.
KEYWORD_GROUPS = {
    "index_style": ["中证1000", "中证2000", "小盘", "小微盘", "微盘", "成长股"],
    "liquidity": ["降准", "降息", "流动性", "逆回购", "MLF", "LPR", "社融", "信贷", "货币政策"],
    "policy_market": ["证监会", "活跃资本市场", "IPO", "再融资", "减持", "融券", "转融通",
                      "量化交易", "程序化交易", "印花税"],
    "growth_industry": ["人工智能", "AI", "半导体", "芯片", "算力", "机器人", "新能源", "储能",
                        "军工", "创新药"],
    "macro": ["GDP", "CPI", "PPI", "PMI", "出口", "消费", "房地产", "汇率", "美联储", "美债"],
}
POSITIVE_WORDS = ["涨", "牛", "利好", "反弹", "突破", "看多", "机会", "上涨", "拉升"]
NEGATIVE_WORDS = ["跌", "熊", "利空", "回调", "破位", "看空", "风险", "下跌", "兑现"]
DIRECTION_FACTOR = {"利多": 1.0, "利空": -1.0, "中性": 0.0}
EXPECTATION_FACTOR = {"预期不足": 1.5, "中性": 1.0, "预期充分": 0.7, "极度过热": 0.2}
STAGE_FACTOR = {"传闻": 0.6, "发酵": 0.9, "确认": 1.0, "落地": 0.8, "兑现": 0.4}
SURPRISE_FACTOR = {"超预期": 1.8, "符合预期": 1.0, "不及预期": -0.8, "尚未落地": 0.8}
PROMPT_LABELS = ("关键词分组：", "命中关键词：", "标题：", "内容：")
PROMPT_NONE = "无"
PROMPT_LIMIT = 4000


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _joined_sha1(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *[_text(p) for p in parts]))


def news_id(source: Column, url: Column, title: Column) -> Column:
    return _joined_sha1(source, url, title)


def stable_news_id(source: Column, day: Column, title: Column, url: Column) -> Column:
    return _joined_sha1(source, day, title, url)


def post_id(url: Column, fallback: str = "sha1") -> Column:
    """``board:number`` from a post URL, else the URL or its digest."""
    pattern = r"/news,([^,]+),(\d+)\.html"
    board, number = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    return F.when(number != "", F.concat_ws(":", board, number)).otherwise(
        F.sha1(url) if fallback == "sha1" else url)


def comment_id(post: Column, author: Column, time: Column, content: Column, index: Column) -> Column:
    return _joined_sha1(post, author, time, content, index)


def board_code(url: Column) -> Column:
    """Board code of a list URL, NULL when the URL names none."""
    code = F.regexp_extract(url, r"list,([^._]+)", 1)
    return F.when(code != "", code)


def absolute_url(href: Column, page_url: Column) -> Column:
    """Resolve a link target against the page it was found on."""
    scheme = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    origin = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    bare = F.regexp_replace(page_url, r"[?#].*$", "")
    folder = F.when(bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*$"), F.concat(bare, F.lit("/"))) \
        .otherwise(F.regexp_replace(bare, r"[^/]*$", ""))
    return (F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("/"), F.concat(origin, href))
            .when(href.startswith("#"), F.concat(F.regexp_replace(page_url, "#.*$", ""), href))
            .when(href.startswith("?"), F.concat(bare, href))
            .otherwise(F.concat(folder, href)))


def keyword_groups(groups: dict[str, list[str]] | None = None,
                   legacy: list[str] | None = None) -> dict[str, list[str]]:
    """Configured groups; a bare keyword list becomes the group ``legacy``."""
    if groups:
        return groups
    if legacy is not None:
        return {"legacy": legacy}
    return KEYWORD_GROUPS


def matched_keywords(text: Column, groups: dict[str, list[str]]) -> Column:
    """Sorted distinct keywords found as substrings."""
    words = sorted({w for ws in groups.values() for w in ws if w})
    hits = [F.when(text.contains(w), F.lit(w)) for w in words]
    return F.array_sort(F.array_compact(F.array(*hits))) if hits \
        else F.array().cast("array<string>")


def matched_groups(text: Column, groups: dict[str, list[str]]) -> Column:
    """Groups with at least one keyword in the text, in configured order."""
    hits = []
    for name, words in groups.items():
        found = reduce(lambda a, b: a | b, [text.contains(w) for w in words if w], F.lit(False))
        hits.append(F.when(found, F.lit(name)))
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def keep_by_keywords(text: Column, groups: dict[str, list[str]], mode: str = "match") -> Column:
    if mode == "all":
        return F.lit(True)
    return F.coalesce(F.size(matched_groups(text, groups)) > 0, F.lit(False))


def lexicon_score(text: Column, positive: list[str] | None = None,
                  negative: list[str] | None = None) -> Column:
    """Distinct positive words present minus distinct negative words present."""
    source = _text(text)

    def present(words: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [source.contains(w).cast("int") for w in words], F.lit(0))

    return present(POSITIVE_WORDS if positive is None else positive) - \
        present(NEGATIVE_WORDS if negative is None else negative)


def json_list(value: Column) -> Column:
    """Text items of a JSON array; anything else is an empty list."""
    items = F.from_json(value, "array<string>")
    return F.filter(F.coalesce(items, F.array().cast("array<string>")),
                    lambda x: x.isNotNull() & (x != ""))


def _factor(values: dict[str, float], key: Column, default: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def clamped_strength(strength: Column) -> Column:
    """Integer strength in 1..5; zero, missing or unreadable strength is 1."""
    whole = strength.try_cast("double").try_cast("int")
    return F.least(F.greatest(F.coalesce(whole, F.lit(1)), F.lit(1)), F.lit(5))


def event_score(direction: Column, strength: Column, expectation: Column, stage: Column,
                surprise: Column) -> Column:
    """Signed score of an event; a surprise below expectation flips the sign."""
    return (_factor(DIRECTION_FACTOR, direction, 0.0) * clamped_strength(strength)
            * _factor(EXPECTATION_FACTOR, expectation, 1.0) * _factor(STAGE_FACTOR, stage, 1.0)
            * _factor(SURPRISE_FACTOR, surprise, 1.0))


def json_object_text(text: Column) -> Column:
    """First ``{`` to last ``}`` of a free-form answer, NULL when it is no JSON object."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(F.when(body != "", body)).isNotNull(), body)


def prompt_text(groups: Column, keywords: Column, title: Column, content: Column,
                template: str = "{news_text}", limit: int = PROMPT_LIMIT) -> Column:
    """Fill a prompt template with one news item, cut to ``limit`` characters."""
    def listed(items: Column) -> Column:
        joined = F.concat_ws(", ", items)
        return F.when(joined == "", PROMPT_NONE).otherwise(joined)

    parts = [listed(groups), listed(keywords), _text(title), _text(content)]
    lines = [F.concat(F.lit(label), part) for label, part in zip(PROMPT_LABELS, parts)]
    body = F.substring(F.concat_ws("\n", *lines), 1, limit)
    before, _, after = template.partition("{news_text}")
    return F.concat(F.lit(before), body, F.lit(after))


def normalized_date(value: Column) -> Column:
    """Calendar date of a date-like text; unreadable text gives NULL."""
    return F.coalesce(value.try_cast("date"), F.to_date(F.try_to_timestamp(value.cast("string"), F.lit("yyyyMMdd"))))
