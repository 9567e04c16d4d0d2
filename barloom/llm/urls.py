"""URL filters: longest matching rule, else naive Bayes over segmented host and path words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import lower_ascii, stored

# Host, path and verdict of the rules.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

# Host words that mark a training url as unwanted; every other undecided url trains as wanted.
SEED_WORDS = [
    "spam", "pills", "casino", "viagra", "porn", "xxx", "poker", "betting", "escort", "adult", "warez", "crack", "torrent",
]

LONGEST_WORD = 20
#: Letters of a name whose parts are listed at a time, and parts into which the urls of one host are dealt.
PORTION = 2000
SALTS = 16


@dataclass(frozen=True)
class UrlSettings:
    """`prior` is the belief that an undecided url is unwanted; `smoothing` the pseudo-count of every word."""

    seeds: tuple[str, ...] = tuple(SEED_WORDS)
    prior: float = 0.1
    smoothing: float = 0.1
    longest: int = LONGEST_WORD


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(host: Column, path: Column, rules=None) -> Column:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain, and a path that starts with its path."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(RULES if rules is None else rules, key=lambda r: len(r[0] + r[1])):
        inside = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        fits = F.when(inside, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def letter_runs(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def unigram_counts(pages: DataFrame, longest: int) -> DataFrame:
    """(word, n) over the titles and url paths of all pages, and over the parts of hyphenated host names.

    Names written in one piece give no evidence, as those are what is to be split.
    """
    parts = F.filter(F.split(F.col("host"), r"\."), lambda p: p.contains("-"))
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    words = F.concat(letter_runs(title), letter_runs(F.col("path")), letter_runs(F.array_join(parts, " ")))
    return pages.select(F.explode(words).alias("word")).filter(F.length("word") <= longest).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))


def split_name(name: str, counts: dict[str, int], total: int, longest: int) -> list[str]:
    """The most probable words of a name; a run that is no word costs 10 / total for its first letter, a tenth more each."""
    best, back = [0.0], [0]
    log_total = math.log(total + 1)
    for end in range(1, len(name) + 1):
        score, cut = -math.inf, end - 1
        for begin in range(max(0, end - longest), end):
            n = counts.get(name[begin:end])
            gain = math.log(n) - log_total if n else math.log(10) - log_total - math.log(10) * (end - begin)
            if best[begin] + gain > score:
                score, cut = best[begin] + gain, begin
        best.append(score)
        back.append(cut)
    words, end = [], len(name)
    while end:
        words.append(name[back[end]:end])
        end = back[end]
    return words[::-1]


def segmented_names(names: DataFrame, unigrams: DataFrame, longest: int) -> DataFrame:
    """(name, words) of distinct names: all their parts of up to `longest` letters meet the unigram table, and one
    Viterbi pass a name takes those that are words.  No dictionary is held on the driver or in a task; parts travel
    with a digest of their name, so the work on a name grows with its length.
    """
    total = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keyed = names.filter(F.length("name") > 0).withColumn("key", F.md5(F.col("name").cast("binary")))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, name in zip(batch.column("key").to_pylist(), batch.column("name").to_pylist()):
                for low in range(0, len(name), PORTION):
                    parts = list({name[i:i + n] for i in range(low, min(low + PORTION, len(name)))
                                  for n in range(1, min(longest, len(name) - i) + 1)})
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(parts)), pa.array(parts)], ["key", "word"])

    parts = keyed.select("key", "name").mapInArrow(grams, "key string, word string")
    found = parts.join(unigrams, "word").groupBy("key", "word").agg(F.first("n").alias("n"))
    known = found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"name": frame["name"], "words": [
                split_name(n, dict(c) if c is not None else {}, total, longest)
                for n, c in zip(frame["name"], frame["counts"])]})

    return keyed.join(known, "key", "left").select("name", "counts").mapInPandas(cut, "name string, words array<string>")


def judge_urls(pages: DataFrame, *, rules=None, settings: UrlSettings = UrlSettings()) -> DataFrame:
    """(page_id, host, path, rule, verdict, probability): the longest fitting rule decides, else naive Bayes.

    Host labels are split into words by unigram Viterbi; path words are runs of letters.  The classes are learnt
    from all urls that no rule decides: one whose host words hold a seed word is unwanted, every other wanted.
    `probability` is that of the unwanted class; at 0.5 or more a url is blocked.  A null url, or one without ://,
    has empty host and path, no words, and so the prior: it is allowed.  Repeated rows each give a row, an empty
    table gives none, and a null page_id stays null.  Columns other than page_id, url and html are not read.
    """
    raw = pages.select("page_id", "html", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    unigrams = stored(unigram_counts(raw, settings.longest), "unigrams")
    urls = raw.select("page_id", "host", "path", rule_verdict(F.col("host"), F.col("path"), rules).alias("fit"))
    names = urls.select(F.explode(letter_runs(F.col("host"))).alias("name")).distinct()
    split = stored(segmented_names(names, unigrams, settings.longest), "segmented-names")

    shapes = urls.filter("fit is null").select("host", "path").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    hosts = shapes.select("host").distinct()
    host_words = hosts.select("host", F.explode(letter_runs(F.col("host"))).alias("name")).join(split, "name").groupBy(
        "host").agg(F.flatten(F.collect_list("words")).alias("host_words"))
    # the urls of a host with a third of all rows meet its words in several tasks
    dealt = shapes.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)))
    spread = host_words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    shaped = stored(dealt.join(spread, ["host", "salt"], "left").select(
        "host", "path", "n", F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words"),
        letter_runs(F.col("path")).alias("path_words")), "url-words").withColumn(
        "unwanted", F.arrays_overlap("host_words", F.array(*map(F.lit, settings.seeds))))
    tokens = shaped.select("host", "path", "n", "unwanted", F.explode(F.concat(
        F.transform("host_words", lambda w: F.concat(F.lit("h:"), w)),
        F.transform("path_words", lambda w: F.concat(F.lit("p:"), w)))).alias("token"))
    counts = stored(tokens.groupBy("token").agg(
        F.sum(F.when(F.col("unwanted"), F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("unwanted"), 0).otherwise(F.col("n"))).alias("good")), "token-counts")
    bad, good, kinds = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)),
                                  F.count(F.lit(1))).first()
    a = settings.smoothing
    weight = F.log((F.col("bad") + a) / (bad + a * kinds)) - F.log((F.col("good") + a) / (good + a * kinds))
    odds = tokens.join(counts.select("token", weight.alias("weight")), "token").groupBy("host", "path").agg(
        F.sum("weight").alias("evidence"))
    prior = math.log(settings.prior / (1 - settings.prior))
    chance = (1 / (1 + F.exp(-(F.lit(prior) + F.coalesce("evidence", F.lit(0.0)))))).alias("probability")
    scored = stored(odds.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "evidence"), "url-odds")
    judged = urls.join(scored, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return judged.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(chance >= 0.5, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("fit").isNull(), chance).alias("probability"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
