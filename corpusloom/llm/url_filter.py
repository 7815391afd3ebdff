"""URL filters: rules first, then a character language-model ratio.

A rule is a host suffix with a path prefix; the longest that fits decides. Where
none fits, two variable-order Markov models of URL characters decide, one of
the URLs that rules allow and one of those they block. Orders 3, 2 and 1 are
blended by Witten-Bell weights, so a context counts as much as it has been
seen. A URL's score is its log-likelihood difference over its length; the
threshold is where two normal fits to held-out scores of either side balance.

Characters fold to 48 symbols, so a model has at most 48**3 rows whatever the
input: the only broadcast. All of it is DataFrame operations.

Edge cases: a null URL, or one without ``://``, has empty host and path; a URL
without characters is allowed unless a rule fits; with one side unseen every
undecided URL takes the other side's verdict, with neither ``allow``; equal URLs
get equal verdicts; every row of the input is returned, also repeated ones, with
its other columns; columns named like the five results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import width, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One of five labelled URLs, by hash, sets the threshold; the others train.
HELD_OUT = 5


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def by_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, as host + path, and its verdict; ``rules``: (verdict, host, path)."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # later, longer ones go outermost
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def grams(url: Column) -> Column:
    """Each character with the two before it; symbols: a-z, digits, ten marks, ~ for the rest, ^ before the start."""
    folded = F.regexp_replace(F.translate(url, UPPER, LOWER), r"[^a-z0-9/.\-_?=&#:%]", "~")
    return F.when(F.length(url) > 0, F.transform(F.sequence(F.lit(1), F.length(url)), lambda i: F.substring(F.concat(F.lit("^^"), folded), i, F.lit(3))))


def markov(counts: DataFrame) -> DataFrame:
    """gram, p_a, p_b: chance of its last character after the first two, on either side; ``counts``: gram, a, b."""
    parts = counts.select("gram", "a", "b", F.substring("gram", 1, 2).alias("ctx"), F.substring("gram", 2, 1).alias("mid"), F.substring("gram", 3, 1).alias("last"))
    both = lambda df, *keys: df.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    seen = lambda df, key, n: df.groupBy(key).agg(*(f(x).alias(f"{x}_{m}{n}") for x in "ab" for m, f in (("n", F.sum), ("t", lambda c: F.sum((F.col(c) > 0).cast("int"))))))
    pairs, ones = both(parts, "mid", "last"), both(parts, "last")
    total = ones.agg(F.sum("a").alias("a_n1"), F.sum("b").alias("b_n1"), F.count(F.lit(1)).alias("symbols")).first()
    rows = parts.join(seen(parts, "ctx", 3), "ctx").join(seen(pairs, "mid", 2), "mid")
    rows = rows.join(pairs.select("mid", "last", F.col("a").alias("a2"), F.col("b").alias("b2")), ["mid", "last"]).join(ones.select("last", F.col("a").alias("a1"), F.col("b").alias("b1")), "last")

    def chance(x: str) -> Column:
        p = (F.col(f"{x}1") + 0.5) / F.lit(float(total[f"{x}_n1"] or 0) + 0.5 * (total["symbols"] or 1))
        for n, own in ((2, F.col(f"{x}2")), (3, F.col(x))):
            t = F.greatest(F.col(f"{x}_t{n}"), F.lit(1))  # an unseen context leaves all to the lower order
            p = (own + t * p) / (F.col(f"{x}_n{n}") + t)
        return p

    return rows.select("gram", chance("a").alias("p_a"), chance("b").alias("p_b"))


RESULTS = ("host", "path", "rule", "verdict", "score")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (null where no character was scored)."""
    if url in RESULTS:
        raise ValueError(f"the URL's column cannot be named {url}")
    taken = pages.select(*(f"`{c}`" for c in pages.columns if c not in RESULTS)).withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    rule, said = by_rule(rules)
    each = pages.filter(F.col(url).isNotNull()).groupBy(F.col(url).alias("url")).agg(F.count(F.lit(1)).alias("n"))
    each = each.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("said", said)
    each = written(each.select("url", "n", "said", (F.conv(F.left(F.md5("url"), F.lit(8)), 16, 10).cast("long") % HELD_OUT == 0).alias("held")), "url-each")

    # The table of URLs is small to read and large to score, so it is dealt out anew.
    split = each.repartition(width(pages.sparkSession)).select("url", "n", "said", "held", F.explode(grams(F.col("url"))).alias("gram"))
    trains = ~F.col("held")
    counts = written(split.groupBy("gram").agg(*(F.sum(F.when((F.col("said") == v) & trains, F.col("n")).otherwise(0)).alias(x) for x, v in (("a", "allow"), ("b", "block")))), "url-grams")
    model = markov(counts).select("gram", (F.ln("p_a") - F.ln("p_b")).alias("ratio"))
    scored = written(split.join(F.broadcast(model), "gram").groupBy("url", "said", "held", "n").agg((F.sum(F.col("ratio").cast("decimal(20,9)")).cast("double") / F.count(F.lit(1))).alias("score")), "url-scores")

    fit = {r["said"]: r for r in scored.filter("said is not null").filter("held").groupBy("said").agg(F.avg("score").alias("m"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("s")).collect()}
    known = {r["said"] for r in each.filter("said is not null and not held").select("said").distinct().collect()}
    if len(known) == 2:
        a, b = fit.get("allow"), fit.get("block")
        at = (a["m"] * (b["s"] + 1e-9) + b["m"] * (a["s"] + 1e-9)) / (a["s"] + b["s"] + 2e-9) if a and b else 0.0
        guess = F.when(F.col("score") < at, "block").otherwise("allow")
    else:
        guess = F.lit(min(known, default="allow"))
    judged = taken.join(scored.select(F.col("url").alias(url), "score"), url, "left").withColumn("rule", rule).withColumn("verdict", F.coalesce(said, guess))
    return judged
