"""URL filter: host and path rules, and a ratio of two character language models for the URLs without a rule.

Native throughout: regular expressions, grouped counts, windows over small tables and one broadcast
join with a table of bounded size.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densel.llm.tables import written

#: Symbols of the models: a-z, 0 for every digit, these marks, ^ and $ for the ends, * for all else.
MARKS = "./?#=&%:@+-_~"
SYMBOLS = len(string.ascii_lowercase) + 1 + len(MARKS) + 3
#: Longest n-gram: contexts of up to two symbols, so that the table of ratios has at most SYMBOLS ** 3 rows.
ORDER = 3

URLS_PER_TASK = 20_000

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits, else nulls: its host or a subdomain, path by prefix."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def symbols(url: Column) -> Column:
    """A URL in the models' symbols with its ends marked; a null URL is empty."""
    s = F.translate(ascii_lower(F.coalesce(url, F.lit(""))), "123456789", "000000000")
    s = F.regexp_replace(s, r"[^a-z0./?#=&%:@+\-_~]", "*")
    return F.concat(F.lit("^" * (ORDER - 1)), s, F.lit("$"))


def grams(url: Column) -> Column:
    """The n-gram that ends at each symbol of a URL and at its end."""
    s = symbols(url)
    return F.transform(F.sequence(F.lit(1), F.length(s) - F.lit(ORDER - 1)), lambda i: F.substring(s, i, ORDER))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log probability of a gram's last symbol after its context, accepted less rejected model.

    ``counts`` has gram, allow and block, its counts in either class (0 for grams that are only scored).
    Each model is smoothed by Witten and Bell from the longest context down: a context gives its unseen
    symbols the share of its distinct symbols, and a context never seen leaves all to the shorter one;
    below all is the uniform distribution over the symbols.
    """
    kinds = ("allow", "block")
    lower = None
    for k in range(1, ORDER + 1):
        level = (counts.groupBy(F.substring("gram", ORDER - k + 1, k).alias("g"))
                 .agg(*[F.sum(c).alias(c) for c in kinds]))
        context = Window.partitionBy(F.substring("g", 1, k - 1)) if k > 1 else Window.partitionBy(F.lit(0))
        for c in kinds:
            level = level.withColumns({f"n_{c}": F.sum(c).over(context),
                                       f"t_{c}": F.sum((F.col(c) > 0).cast("long")).over(context)})
        if lower is None:
            level = level.withColumns({f"l_{c}": F.lit(1.0 / SYMBOLS) for c in kinds})
        else:
            below = lower.select(F.col("g").alias("_g"), *[F.col(f"p_{c}").alias(f"l_{c}") for c in kinds])
            level = level.join(below, F.substring("g", 2, k - 1) == F.col("_g")).drop("_g")
        for c in kinds:
            seen = F.col(f"n_{c}") + F.col(f"t_{c}")
            level = level.withColumn(f"p_{c}", F.when(
                seen > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"l_{c}")) / seen).otherwise(F.col(f"l_{c}")))
        lower = level.select("g", "p_allow", "p_block")
    return lower.select(F.col("g").alias("gram"), (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def train(labelled: DataFrame) -> DataFrame:
    """Counts (gram, allow, block) of ``labelled`` (url, verdict)."""
    exploded = labelled.select("verdict", F.explode(grams(F.col("url"))).alias("gram"))
    return exploded.groupBy("gram").agg(*[F.sum((F.col("verdict") == c).cast("long")).alias(c) for c in ("allow", "block")])


def scores(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """(url, score): mean log ratio over a URL's symbols and its end. ``urls`` holds distinct URLs."""
    exploded = urls.select("url", F.explode(grams(F.col("url"))).alias("gram"))
    # at most SYMBOLS ** ORDER rows, whatever the input
    return exploded.join(F.broadcast(ratios), "gram").groupBy("url").agg(F.avg("ratio").alias("score"))


def calibrated(scored: DataFrame, step: float = 1e-3) -> float:
    """The threshold with the best balanced accuracy on ``scored`` (score, verdict); 0 if a class is missing.

    Scores are counted in steps, so the search runs over a bounded table. Of equally good thresholds the
    one closest to 0 is taken, then the lower.
    """
    bins = scored.groupBy(F.floor(F.col("score") / step).alias("bin")).agg(
        *[F.sum((F.col("verdict") == c).cast("long")).alias(c) for c in ("allow", "block")])
    up = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    below = lambda c: F.try_divide(F.coalesce(F.sum(c).over(up), F.lit(0)), F.sum(c).over(whole))
    block_below, allow_above = below("block"), F.lit(1.0) - below("allow")
    best = (bins.select("bin", (block_below + allow_above).alias("good")).filter("good is not null")
            .orderBy(F.desc("good"), F.abs("bin"), "bin").first())
    return best["bin"] * step if best else 0.0


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Add host, path, rule, verdict and score to ``pages`` (any columns; clashing ones are replaced).

    A URL with a rule gets the rule's verdict. The others are allowed if their score reaches the
    calibrated threshold: the length-normalised log-likelihood difference of a model of the URLs that
    rules allow and one of those that they block, each distinct URL once. Four fifths of those URLs
    (by crc32) train the models, the rest calibrates. A null URL scores as an empty one; without URLs
    of either class all models are uniform and URLs without a rule are allowed.
    """
    spare = pages.drop("host", "path", "rule", "verdict", "score", "_u")
    rule, verdict = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    distinct = (spare.select(F.coalesce("url", F.lit("")).alias("url")).distinct().withColumn("verdict", verdict)
                .withColumn("calibrates", F.crc32("url") % 5 == 0))
    # a URL becomes some fifty rows, so few megabytes of URLs make a large task: dealt out by rows
    urls = written(distinct, "urls")
    urls = urls.repartition(max(1, urls.count() // URLS_PER_TASK), "url")
    labelled = urls.filter("verdict is not null")
    trained = train(labelled.filter("not calibrates"))
    scored_only = urls.select(F.explode(grams(F.col("url"))).alias("gram")).distinct().select(
        "gram", F.lit(0).cast("long").alias("allow"), F.lit(0).cast("long").alias("block"))
    counts = trained.unionByName(scored_only).groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    ratios = written(log_ratios(counts), "url-ratios")
    scored = written(scores(urls, ratios), "url-scores")
    limit = calibrated(labelled.filter("calibrates").join(scored, "url"))
    out = spare.withColumn("_u", F.coalesce("url", F.lit(""))).join(
        scored.withColumnRenamed("url", "_u"), "_u", "left").drop("_u")
    return out.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "rule": rule,
                            "verdict": F.coalesce(verdict, F.when(F.col("score") >= limit, "allow").otherwise("block"))})
