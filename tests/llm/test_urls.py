import math
import re
from collections import Counter

from pyspark.sql import functions as F

from densel.llm import urls

URLS = ["http://a.example.net/en/1", "https://example.net/en/", "http://x.net/de", "http://EXAMPLE.com/de/2?x=/en/", "ftp://b.org/fr/3#t",
        "http://b.org/en/3", "nothing", None, "://", "http://notexample.net/en/9", "http://b.org/fr", "a://b://c.org/fr/",
        "http://é.example.com/de/ü\n", "http://x.net?q", "http://org/fr/", "", "http://u:p@h.net:80/"]


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")


def ruled(host, path):
    best = None
    for kind, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (kind, h + p)
    return best


def test_rules(spark):
    rows = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(rows).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = split(u)
        rule = ruled(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[1]), u
        assert got[i].verdict == (rule[0] if rule else got[i].verdict) and got[i].verdict in ("allow", "block")


def gram_list(url):
    s = "".join("0" if c.isascii() and c.isdigit() else c if c.isascii() and (c.islower() or c in urls.MARKS) else "*"
                for c in (url or "").translate({c: c + 32 for c in range(65, 91)}))
    s = "^" * (urls.ORDER - 1) + s + "$"
    return [s[i:i + urls.ORDER] for i in range(len(s) - urls.ORDER + 1)]


def brute_ratio(counts):
    """Log ratio of a gram under the two Witten-Bell models."""
    def p(c, gram):
        if not gram:
            return 1 / urls.SYMBOLS
        context, lower = gram[:-1], p(c, gram[1:])
        followers = Counter()
        for g, n in counts.items():
            tail = g[len(g) - len(gram):]
            if tail[:-1] == context:
                followers[tail[-1]] += n[c]
        total, kinds = sum(followers.values()), sum(v > 0 for v in followers.values())
        return (followers[gram[-1]] + kinds * lower) / (total + kinds) if total else lower

    return lambda g: math.log(p(0, g)) - math.log(p(1, g))


def test_models_against_brute_force(spark):
    allow, block = ["http://a.org/fr/1", "http://b.org/fr/22"], ["http://a.net/", "http://ccc.net/x", "é"]
    other = ["zzz", "http://b.org/en/"]
    counts = {}
    for u in other + allow + block:
        for g in gram_list(u):
            counts.setdefault(g, [0, 0])
            counts[g][0] += u in allow
            counts[g][1] += u in block
    frame = spark.createDataFrame([(g, *n) for g, n in counts.items()], "gram string, allow long, block long")
    got = {r.gram: r.ratio for r in urls.log_ratios(frame).collect()}
    want = brute_ratio(counts)
    assert got.keys() == counts.keys()
    assert all(abs(got[g] - want(g)) < 1e-9 for g in got)
    made = urls.train(spark.createDataFrame([(u, "allow") for u in allow] + [(u, "block") for u in block], "url string, verdict string"))
    assert {r.gram: [r.allow, r.block] for r in made.collect()} == {g: n for g, n in counts.items() if any(n)}
    score = urls.scores(spark.createDataFrame([(u,) for u in other], "url string"), frame.select("gram").join(
        urls.log_ratios(frame), "gram")).collect()
    assert all(abs(r.score - sum(map(want, gram_list(r.url))) / len(gram_list(r.url))) < 1e-9 for r in score)


def test_threshold(spark):
    rows = [(x / 10, "allow" if x > 3 else "block") for x in range(-10, 11)] + [(0.9, "block")]
    limit = urls.calibrated(spark.createDataFrame(rows, "score double, verdict string"))
    assert 0.3 < limit <= 0.4
    assert urls.calibrated(spark.createDataFrame([(1.0, "allow")], "score double, verdict string")) == 0.0


def test_learns_from_the_rules(spark):
    rows = [(i, f"http://h{i % 7}.example.{d}/{lang}/{i}") for i, (d, lang) in enumerate(
        [("net", "de"), ("org", "fr"), ("net", "en"), ("com", "de"), ("org", "en"), ("com", "fr")] * 60)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"))
    by = {(r["d"], r["verdict"]): r["n"] for r in got.filter("rule is null").groupBy(
        F.regexp_extract("url", r"example\.(\w+)", 1).alias("d"), "verdict").agg(F.count("*").alias("n")).collect()}
    assert by.get(("org", "allow"), 0) > 50


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
    assert [r.verdict for r in urls.judge(spark.createDataFrame([(1, None), (1, None)], "page_id long, url string")).collect()] == ["allow"] * 2
