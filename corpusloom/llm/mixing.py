"""Mixing sources to target weights by entropy balancing.

Every document is read 0, 1 or 2 times. Its copies follow the base law
Binomial(2, 1/2), tilted exponentially by the words it brings: the least
change of the law, in relative entropy, that brings each source's expected
words to its target. The convex dual has one multiplier a source; its
gradient and curvature are sums over documents, computed by Spark in each
Newton round over the exact histogram (source, size, documents). The rate of a
document is 2 * sigmoid(lambda * size / mean size of its source).

Rates become copies by sequential Poisson sampling: the whole part is taken,
then documents in the order u / fraction (u: a hash of id and text) get one more
copy until the source's words reach its target, to half a document. No source is
sorted: the place in the order is a number of 53 bits, and the one at which the
target is met is found ten bits at a time, each round summing the words of 1,024
steps of what is left, until a step holds at most ``EDGE`` documents. Rows equal in id and
text, which share a place, are told apart by 53 bits more, of a row number. Sums are
decimal, so neither order of summation nor partitioning changes a result.

Edge cases: null text counts 0 words; a null source is a source of its own,
last in order; a source of 0 words has target 0; an empty table gives an empty
result; rows with equal ids are mixed one by one; extra columns are kept out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this number go to joins as a broadcast; beyond it Spark picks the join.
BROADCAST_SOURCES = 10_000
#: Documents of a source that are put in order one by one; bits of a place, and bits a round.
EDGE, PLACE, DIGIT = 1000, 53, 10


def water_fill(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets by weight of ``share`` times all words, none above ``most`` times its size."""
    caps = [most * s for s in sizes]
    targets = [0.0] * len(sizes)
    free, left = list(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > caps[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = caps[i]
        left -= sum(caps[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return targets


def _beside(df: DataFrame, params: list[tuple], schema: str) -> DataFrame:
    """``df`` with its source's row of ``params``."""
    side = df.sparkSession.createDataFrame(params, schema)
    return df.join(F.broadcast(side) if len(params) <= BROADCAST_SOURCES else side, "key")


def _rate(lam, size, mean):
    """2 * sigmoid(lam * size / mean); a lam of +-1e308 means all or nothing."""
    x = F.least(F.greatest(lam * size / mean, F.lit(-700.0)), F.lit(700.0))
    return F.when(lam > 1e300, F.lit(2.0)).when(lam < -1e300, F.lit(0.0)).otherwise(2.0 / (1.0 + F.exp(-x)))


def dual(histogram: DataFrame, sizes: dict[str, int], docs: dict[str, int], targets: dict[str, float], rounds: int = 100) -> dict[str, float]:
    """The multiplier of each source by safeguarded Newton rounds (every fourth one halves the bracket); ``histogram``: key, size, n.

    Targets are met to half a word, or a part in ten million; a source that does not get there in ``rounds`` is an error.
    """
    lam, low, high, live = {}, {}, {}, set()
    for k, s in sizes.items():
        if s == 0 or targets[k] <= 0:
            lam[k] = -1e308
        elif targets[k] >= 2.0 * s * (1 - 1e-12):
            lam[k] = 1e308
        else:
            p = targets[k] / (2.0 * s)
            lam[k] = math.log(p / (1 - p))
            low[k], high[k] = -math.inf, math.inf
            live.add(k)
    mean = {k: max(sizes[k] / max(docs[k], 1), 1e-9) for k in sizes}
    for i in range(rounds + 1):
        if not live:
            break
        if i == rounds:
            raise RuntimeError(f"no multiplier after {rounds} rounds for {len(live)} sources")
        part = _beside(histogram, [(k, lam[k], mean[k]) for k in sorted(live)], "key string, lam double, mean double")
        rate = _rate(F.col("lam"), F.col("size"), F.col("mean"))
        curve = rate * (2.0 - rate) / 2.0 * F.col("size") * F.col("size") / F.col("mean")
        sums = part.groupBy("key").agg(F.sum((rate * F.col("size") * F.col("n")).cast("decimal(28,6)")).alias("words"), F.sum((curve * F.col("n")).cast("decimal(28,6)")).alias("slope")).collect()
        for r in sums:
            k, gap, slope = r["key"], float(r["words"]) - targets[r["key"]], float(r["slope"])
            if abs(gap) <= max(0.5, 1e-7 * targets[k]):
                live.discard(k)
                continue
            if gap > 0:
                high[k] = lam[k]
            else:
                low[k] = lam[k]
            step = lam[k] - gap / slope if slope > 0 else math.nan
            if not low[k] < step < high[k] or i % 4 == 3:
                a, b = low[k], high[k]
                step = (a + b) / 2 if math.isfinite(a) and math.isfinite(b) else lam[k] * 2 + (1 if gap < 0 else -1) * 4
            lam[k] = step
    return lam


def _cuts(rated: DataFrame, targets: dict[str, float], edge: int = EDGE) -> dict[str, tuple]:
    """For each source the step at which its words meet the target: bits and value of place, bits and value of tie, words before the step, words to add in all."""
    first = rated.groupBy("key").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"), F.count("place").alias("n")).collect()
    room = {r["key"]: targets[r["key"]] - float(r["sure"] or 0) for r in first}
    at = {r["key"]: [0, 0, 0, 0, 0] for r in first}  # bits, prefix, bits of tie, prefix of tie, words before
    at.update({k: [PLACE, -1, 0, 0, 0] for k in at if room[k] <= 0})  # nobody is taken
    live = {r["key"] for r in first if r["n"] > edge and room[r["key"]] > 0}
    while live:
        part = _beside(rated.filter("place is not null"), [(k, *at[k][:4]) for k in sorted(live)], "key string, b1 int, p1 long, b2 int, p2 long").filter(_AT)
        finer = F.expr(f"CASE WHEN b1 < {PLACE} THEN shiftright(place, greatest({PLACE} - b1 - {DIGIT}, 0)) ELSE shiftright(tie, greatest({PLACE} - b2 - {DIGIT}, 0)) END")
        steps = part.groupBy("key", finer.alias("step")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))  # at most 2 ** DIGIT a source
        left = _beside(steps, [(k, room[k] - at[k][4]) for k in sorted(live)], "key string, left double")
        left = left.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        for r in left.groupBy("key").agg(F.max(F.when(F.col("before") < F.col("left"), F.struct("step", "before", "n"))).alias("c")).collect():
            k, c = r["key"], r["c"]
            a = at[k]
            i = 0 if a[0] < PLACE else 2
            a[i], a[i + 1], a[4] = min(PLACE, a[i] + DIGIT), c["step"], a[4] + int(c["before"])
            if c["n"] <= edge or a[2] == PLACE:
                live.discard(k)
    return {k: (*at[k], room[k]) for k in at}


_AHEAD = f"shiftright(place, {PLACE} - b1) < p1 OR (shiftright(place, {PLACE} - b1) = p1 AND b2 > 0 AND shiftright(tie, {PLACE} - b2) < p2)"
_AT = f"shiftright(place, {PLACE} - b1) = p1 AND (b2 = 0 OR shiftright(tie, {PLACE} - b2) = p2)"


def mix(documents: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, edge: int = EDGE) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate for each row of ``documents``."""
    if most != 2.0:
        raise ValueError("the base law has two draws a document")
    sized = written(
        documents.select(
            "doc_id",
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("z")).alias("key"),  # "z" comes after every "s..."
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64("doc_id", "text", F.lit("mix")).alias("u"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix-sizes",
    )
    histogram = written(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    by_source = sorted(histogram.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs")).collect(), key=lambda r: r["key"].encode())
    keys = [r["key"] for r in by_source]
    sizes, docs = {r["key"]: int(r["words"]) for r in by_source}, {r["key"]: int(r["docs"]) for r in by_source}
    filled = water_fill([sizes[k] for k in keys], [float(weights[i % len(weights)]) for i in range(len(keys))], share, most)
    targets = dict(zip(keys, filled, strict=True))
    lam = dual(histogram, sizes, docs, targets)
    mean = {k: max(sizes[k] / max(docs[k], 1), 1e-9) for k in keys}

    rated = _beside(sized, [(k, sizes[k], targets[k], lam[k], mean[k]) for k in keys], "key string, source_size long, target double, lam double, mean double")
    rate = _rate(F.col("lam"), F.col("size"), F.col("mean"))
    u = (F.shiftrightunsigned("u", 11) + 1) / F.lit(float(2**PLACE))
    rated = rated.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("order", F.when(F.col("rate") > F.col("whole"), u / (F.col("rate") - F.col("whole"))))
    place = F.least(F.floor(F.col("order") / (F.col("order") + 1.0) * float(2**PLACE)).cast("long"), F.lit(2**PLACE - 1))
    rated = rated.withColumn("place", place).withColumn("tie", F.shiftrightunsigned(F.xxhash64("row", F.lit("tie")), 64 - PLACE))

    cuts = _cuts(rated, targets, edge)
    dealt = _beside(rated, [(k, *cuts[k][:4], float(cuts[k][4]), cuts[k][5]) for k in keys], "key string, b1 int, p1 long, b2 int, p2 long, used double, room double")
    out = ["doc_id", "size", "source_size", "target", "rate"]
    at = F.coalesce(F.expr(_AT), F.lit(False))
    plain = dealt.filter(~at).select(*out, (F.col("whole") + F.when(F.expr(_AHEAD), 1).otherwise(0)).cast("int").alias("copies"))
    # Only the documents of the step that the target falls into are ordered one by one.
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("key").orderBy("place", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = dealt.filter(at).withColumn("ahead", ahead).select(*out, (F.col("whole") + F.when(F.col("used") + F.col("ahead") + F.col("size") / 2.0 <= F.col("room"), 1).otherwise(0)).cast("int").alias("copies"))
    return plain.unionByName(last).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
