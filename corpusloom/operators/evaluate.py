"""Evaluation: splits, coverage and refusal, answer verdicts, floors, percentiles, decay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import forget, small, stored

#: Default salt of the stable split; a question set keeps its own by passing it.
SALT, DEV_SHARE = "corpusloom-split-v1", 0.5


def bucket(id: Column, salt: str = SALT) -> Column:
    """A number in 0..1 that depends on the id alone."""
    return F.conv(F.left(F.sha2(F.concat(F.lit(f"{salt}:"), id), 256), F.lit(8)), 16, 10).cast("double") / 4294967295.0


def side(id: Column, salt: str = SALT, share: float = DEV_SHARE) -> Column:
    return F.when(bucket(id, salt) < share, "dev").otherwise("test")


def any_of(text: Column, wanted: Column) -> Column:
    """Some of the wanted strings stand in the text, whatever the case."""
    low = F.lower(text)
    return F.exists(wanted, lambda t: F.contains(low, F.lower(t)))


def answer_verdict(answer: Column, sources: Column, expect: Column, reject: Column) -> Column:
    said, held = any_of(answer, expect), any_of(sources, expect)
    return F.when(any_of(answer, reject), "CONTRADICTED").when(said & held, "OK").when(held, "NOT_USED").when(said, "UNGROUNDED").otherwise("MISSED")


def shares(rows: DataFrame, passed: str, target: float = 0.8) -> DataFrame:
    hit = F.sum(F.col(passed).cast("int"))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.coalesce(hit, F.lit(0)).cast("long").alias("hits"), (hit / F.count(F.lit(1))).alias("value"), (hit / F.count(F.lit(1)) >= target).alias("pass"))


def breakdown(rows: DataFrame, by: list[str], target: float = 0.8) -> DataFrame:
    """Coverage of the questions in scope and refusal of the others, by ``by``; ``rows``: in_scope, covered, refused and those."""
    inside = F.col("in_scope")
    made = rows.groupBy(*by).agg(F.sum(inside.cast("long")).alias("n_in_scope"), F.sum((~inside).cast("long")).alias("n_refusable"), F.try_divide(F.sum(F.when(inside, F.col("covered").cast("int"))), F.sum(inside.cast("int"))).alias("coverage"), F.try_divide(F.sum(F.when(~inside, F.col("refused").cast("int"))), F.sum((~inside).cast("int"))).alias("refusal"))
    return made.withColumn("pass", (F.coalesce("coverage", F.lit(1.0)) >= target) & (F.coalesce("refusal", F.lit(1.0)) >= target))


def split_summary(rows: DataFrame, id: str = "id", by: tuple[str, ...] = ("area", "in_scope"), salt: str = SALT, share: float = DEV_SHARE) -> DataFrame:
    """How many questions of each area and scope are on either side of the split."""
    return rows.groupBy(side(F.col(id).cast("string"), salt, share).alias("side"), *by).agg(F.count(F.lit(1)).alias("n"))


def memory_budget(parts: DataFrame, limit_mb: float) -> DataFrame:
    """total_mb, limit_mb, share and fits of ``parts`` (name, mb): what a deployment holds at once against its limit."""
    total = F.coalesce(F.sum("mb"), F.lit(0.0))
    return parts.agg(total.alias("total_mb"), F.lit(float(limit_mb)).alias("limit_mb"), (total / limit_mb).alias("share"), (total <= limit_mb).alias("fits"))


#: Distinct places of a grid, its sketch's accuracy, and values that one task sorts for a place.
GRID, ACCURACY, SORTED = 200, 4000, 100_000


def at_places(values: DataFrame, column: str, wanted: dict[str, Callable[[Column], Column]], by: list[str] = (), most: int | None = None) -> DataFrame:
    """``by``, n, and for each name the value at a place (from 0, a function of n) of the sorted values, nulls left out.

    Each place has a bracket of values, at first all of them. While one holds more than ``most`` values, a mergeable sketch of what is in it gives a
    grid; the new bracket is the grid around the place, with more room than the sketch can err, and what lies below
    it is counted. In the end only the brackets' values are sorted. Nothing but sketches and counts is gathered, whatever the size of a group.
    """
    most, keys = most or SORTED, list(by)
    v = values.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("v"), F.lit(0).alias("all"))
    keys = keys or ["all"]
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("place")) for name, place in wanted.items())))
    start = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = stored(start.select("*", each.alias("w")).select(*keys, "n", "w.name", "w.place", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("size")), "places")
    inside = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    about = [*keys, "n", "name", "place", "lo", "hi"]
    while state.filter((F.col("size") > most) & (F.col("lo") < F.col("hi"))).limit(1).count():
        wide = state.filter((F.col("size") > most) & (F.col("lo") < F.col("hi")))
        grid = v.join(small(wide), keys).filter(inside).groupBy(*about, "below", "size").agg(F.percentile_approx("v", F.array(*(F.lit(i / GRID) for i in range(GRID + 1))), F.lit(ACCURACY)).alias("cuts"))
        at = F.floor((F.col("place") - F.col("below")) / F.col("size") * GRID).cast("int")
        cut = lambda i, default: F.coalesce(F.when((i >= 0) & (i <= GRID), F.get("cuts", i)), F.col(default))
        closer = grid.select(*keys, "n", "name", "place", cut(at - 2, "lo").alias("lo"), cut(at + 3, "hi").alias("hi"))
        counted = v.join(small(closer), keys).groupBy(*about).agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(inside).alias("size"))
        then = stored(state.join(wide.select(*keys, "name"), [*keys, "name"], "left_anti").unionByName(counted), "places")
        done = then.agg(F.sum("size")).first()[0] >= state.agg(F.sum("size")).first()[0]
        forget(state)
        state = then
        if done:  # a sketch of few distinct values cannot narrow further
            break
    ordered = Window.partitionBy(*keys, "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    held = v.join(small(state), keys).filter(inside).groupBy(*keys, "n", "name", "place", "below", "v").agg(F.count(F.lit(1)).alias("k"))
    found = held.withColumn("upto", F.col("below") + F.sum("k").over(ordered)).filter(F.col("upto") > F.col("place")).groupBy(*keys, "n", "name").agg(F.min("v").alias("v"))
    return found.groupBy(*keys, "n").agg(*(F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in wanted)).drop("all")


def by_index(values: DataFrame, column: str, shares_: dict[str, float], by: list[str] = (), back: int = 0, most: int | None = None) -> DataFrame:
    """Percentiles by place, not interpolated: the sorted values at floor(n * p) - ``back``, between the first and the last."""
    place = lambda p: lambda n: F.greatest(F.least(F.floor(n * p) - back, n - 1), F.lit(0))
    return at_places(values, column, {name: place(p) for name, p in shares_.items()}, by, most)


def sweep_range(scores: DataFrame, column: str = "score", points: int = 9, most: int | None = None) -> DataFrame:
    """Floors to try: even steps from the 10th to the 90th percentile (interpolated)."""
    place = lambda p, up: lambda n: F.ceil((n - 1) * p) if up else F.floor((n - 1) * p)
    ends = at_places(scores, column, {f"{name}{up}": place(p, up) for name, p in (("a", 0.1), ("b", 0.9)) for up in (0, 1)}, most=most)
    between = lambda name, p: F.col(f"{name}0") + (F.col(f"{name}1") - F.col(f"{name}0")) * ((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p))
    q = ends.select(between("a", 0.1).alias("a"), between("b", 0.9).alias("b"))
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / (points - 1))
    return q.select(F.posexplode(at).alias("step", "floor"))


def floor_sweep(best: DataFrame, floors: list[float]) -> DataFrame:
    """Share of questions whose best score reaches each floor, by in_scope; ``best``: score, in_scope."""
    tried = best.withColumn("floor", F.explode(F.array(*map(F.lit, floors))))
    return tried.groupBy("floor").agg(*(F.avg(F.when(F.col("in_scope") == s, (F.col("score") >= F.col("floor")).cast("double"))).alias(n) for s, n in ((True, "coverage"), (False, "answered_anyway"))))


def decay(samples: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """Mean of the first and the last quarter of each series and the relative fall between."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    quarter = F.greatest(F.floor(n / 4), F.lit(1))
    rows = samples.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(order))).withColumn("q", quarter).withColumn("n", n)
    early, late = F.avg(F.when(F.col("i") <= F.col("q"), F.col(value))), F.avg(F.when(F.col("i") > F.col("n") - F.col("q"), F.col(value)))
    return rows.groupBy(*by).agg(early.alias("early"), late.alias("late"), ((early - late) / early).alias("decay"))


def argmax_accuracy(choices: DataFrame) -> DataFrame:
    """acc and acc_norm: share of questions whose best choice, plain or by length, is gold; ``choices``: question_id, choice, score, n_chars, gold."""
    best = lambda s: F.max_by("gold", F.struct(s, -F.col("choice")))
    each = choices.groupBy("question_id").agg(best(F.col("score")).alias("a"), best(F.col("score") / F.col("n_chars")).alias("b"))
    return each.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("a").cast("double")).alias("acc"), F.avg(F.col("b").cast("double")).alias("acc_norm"))


def log_normalisers(logits: DataFrame, by: list[str]) -> DataFrame:
    """``by``, norm: the logarithm of the sum of exp(logit) of each segment, from its greatest logit on, so that nothing overflows; nulls are left out."""
    given = logits.filter("logit IS NOT NULL")
    top = given.groupBy(*by).agg(F.max("logit").alias("top"))
    return given.join(top, by).groupBy(*by, "top").agg(F.sum(F.exp(F.col("logit") - F.col("top"))).alias("s")).select(*by, (F.col("top") + F.ln("s")).alias("norm"))


def continuation_scores(logits: DataFrame, sequences: DataFrame, prompts: DataFrame) -> DataFrame:
    """question_id, choice, score, n_scored: log-probability of what follows the prompt in each choice's sequence.

    ``logits``: question_id, choice, position, token, logit, a row a token of the vocabulary, as they stand after that position;
    ``sequences``: question_id, choice, position (from 0), token of prompt and continuation together; ``prompts``: question_id,
    position, token of the prompt by itself. The tokens of both need not agree up to the prompt's end, so the continuation begins where they first differ, or where the
    prompt ends. The first token of all has nothing before it and is not scored; a choice without anything to score has minus infinity; a token without a logit makes its choice's score null.
    """
    key = ["question_id", "choice"]
    both = sequences.join(prompts.withColumnRenamed("token", "said"), ["question_id", "position"], "left")
    begins = both.groupBy(*key).agg(F.coalesce(F.min(F.when(~F.col("token").eqNullSafe(F.col("said")), F.col("position"))), F.max("position") + 1).alias("begins"))
    scored = sequences.join(begins, key).filter((F.col("position") >= F.col("begins")) & (F.col("position") > 0)).select(*key, (F.col("position") - 1).alias("position"), "token")
    asked = logits.join(scored.select(*key, "position"), [*key, "position"], "left_semi")
    own = scored.join(asked, [*key, "position", "token"], "left").join(log_normalisers(asked, [*key, "position"]), [*key, "position"], "left")
    each = own.groupBy(*key).agg(F.sum(F.col("logit") - F.col("norm")).alias("score"), F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("logit").isNull()).alias("lost"))
    every = begins.select(*key).join(each, key, "left")
    return every.select(*key, F.when(F.coalesce("lost", F.lit(0)) == 0, F.coalesce("score", F.lit(float("-inf")))).alias("score"), F.coalesce("n_scored", F.lit(0)).alias("n_scored"))
