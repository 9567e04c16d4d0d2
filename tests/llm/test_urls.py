import re

from barloom.llm import urls


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "http://A.B.Example.NET/en/1?x#y", "http://example.net/EN/", "https://net/", "https://net",
        "http://badexample.com/de/", "http://x.example.com/de/a", "http://x.example.com/de", "http://w.org/fr/1", "http://org/fr/",
        "http://example.net/en", "a://b://c/d", "http://É.com/é?q", "http://h\nx/p\nq?z", "http://spamfarm.example.com/en/1",
        "http://spam-farm.example.org/en/2", "http://quiet-garden.example.org/en/3", "http://h?x/y", "http://h#x/y",
        "http://" + "longname" * 30 + ".com/" + "p" * 2000]


def pages(spark):
    rows = [(k, u, f"<title>spam farm quiet garden {k}</title>", "clash") for k, u in enumerate(URLS * 3)]
    rows += [(None, "http://x.net/", None, "clash"), (0, None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def test_hosts_paths_and_rules(spark):
    frame = pages(spark)
    got = urls.judge_urls(frame).collect()
    assert len(got) == frame.count()
    seen = {(r.page_id, r.host, r.path, r.rule) for r in got}
    for r in frame.collect():
        host, path = parse(r.url)
        assert (r.page_id, host, path, rule_of(host, path)[0]) in seen
    for r in got:
        rule, verdict = rule_of(r.host, r.path)
        assert r.verdict == verdict if rule else (r.verdict == "block") == (r.probability >= 0.5)
    assert urls.judge_urls(frame.filter("false")).count() == 0


def test_naive_bayes_blocks_split_names(spark):
    verdicts = {r.host: r.verdict for r in urls.judge_urls(pages(spark)).collect() if r.rule is None}
    assert verdicts["spamfarm.example.com"] == "block" and verdicts["spam-farm.example.org"] == "block"
    assert verdicts["quiet-garden.example.org"] == "allow" and verdicts[""] == "allow"


def test_segmentation_is_the_best_of_all():
    import itertools
    import math
    counts, total = {"spam": 50, "farm": 30, "far": 5, "m": 2, "spa": 8, "mfarm": 1}, 100

    def gain(word):
        n = counts.get(word)
        return math.log(n / (total + 1)) if n else math.log(10 / (total + 1)) - math.log(10) * len(word)

    for name in ("spamfarm", "farmspam", "xspam", "mmm", "spafar", ""):
        ways = []
        for size in range(len(name) + 1):
            for cuts in itertools.combinations(range(1, len(name)), size):
                edges = [0, *cuts, len(name)]
                ways.append(sum(gain(name[a:b]) for a, b in zip(edges, edges[1:]) if b > a))
        got = urls.split_name(name, counts, total, 20)
        assert math.isclose(sum(map(gain, got)), max(ways)) and "".join(got) == name


def brute(rows, settings=urls.UrlSettings()):
    """Verdict and probability of (url, html) rows: word counts, best segmentation and naive Bayes without Spark."""
    import math
    from collections import Counter

    def letters(text):
        return re.findall(r"[^\W\d_]+", text.lower())

    places = [parse(u) for u, _ in rows]
    unigrams = Counter()
    for (host, path), (_, html) in zip(places, rows):
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", html or "")
        words = letters(title[1] if title else "") + letters(path)
        words += [w for part in host.split(".") if "-" in part for w in letters(part)]
        unigrams.update(w for w in words if len(w) <= settings.longest)
    total = sum(unigrams.values())
    bad, good, tokens = Counter(), Counter(), []
    for host, path in places:
        words = [w for name in letters(host) for w in urls.split_name(name, unigrams, total, settings.longest)]
        tokens.append([f"h:{w}" for w in words] + [f"p:{w}" for w in letters(path)])
        if rule_of(host, path)[0] is None:
            (bad if set(words) & set(settings.seeds) else good).update(tokens[-1])
    kinds, a, out = len(set(bad) | set(good)), settings.smoothing, []
    for (host, path), found in zip(places, tokens):
        if rule_of(host, path)[0] is not None:
            out.append((host, path, None))
            continue
        odds = math.log(settings.prior / (1 - settings.prior)) + sum(
            math.log((bad[t] + a) / (sum(bad.values()) + a * kinds)) - math.log((good[t] + a) / (sum(good.values()) + a * kinds))
            for t in found)
        out.append((host, path, round(1 / (1 + math.exp(-odds)), 9)))
    return sorted(out, key=str)


def test_whole_result_by_brute_force(spark):
    import random
    rng = random.Random(8)
    words = ["spam", "farm", "quiet", "garden", "casino", "pills", "news", "shop", "green", "house", "xx", "q"]
    rows = []
    for k in range(300):
        name = "".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        host = rng.choice([name, "-".join(rng.sample(words, 2)), "hot.example"]) + rng.choice([".com", ".org", ".net", ""])
        rows.append((f"http://{host}/{rng.choice(['en', 'fr', 'de', ''])}/{rng.choice(words)}/{k % 9}",
                     f"<title>{' '.join(rng.choice(words) for _ in range(4))}</title>"))
    rows += [(None, None), ("", "<p>"), rows[0], rows[0]]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = [(r.host, r.path, None if r.probability is None else round(r.probability, 9)) for r in urls.judge_urls(frame).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_very_long_hosts(spark):
    rows = [(1, "http://" + "spamfarm" * 7500 + ".example.com/a", "<title>spam farm spam farm</title>"), (2, "http://spamfarm.com/", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: len(r.host) for r in urls.judge_urls(frame).collect() if r.probability is not None} == {1: 60_012, 2: 12}
