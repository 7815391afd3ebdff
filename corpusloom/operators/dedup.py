"""Exact and near duplicates by word runs.

Near duplicates are found exactly, without a cap: two sets of similarity t or
more share one of their rarest runs, so only a prefix of each set, rarest
first, is looked up (prefix filter); what meets is verified. Equal sets are one
text to begin with, so copies never pair up. A third of the runs, by hash, tells which sets can
be similar to any; theirs are shuffled once, and what only one of these holds stays
behind there, since no two have it in common.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import find_all, let
from ..session import ship
from .tables import forget, small, stored

RUN, SIMILAR = 5, 0.75


def shingles(text: Column, n: int = RUN) -> Column:
    """Distinct runs of ``n`` lower-case words; all of them as one where there are fewer."""
    ws = find_all(F.lower(text), r"(?U)\w+")
    runs = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(n))))).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_distinct(let(ws, runs)))


def exact(documents: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of each text, with sha256 and copies; partial minima make it one light shuffle."""
    hashed = documents.select(F.col(order).alias("id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def _sets(documents: DataFrame, block: str | None, id: str, text: str) -> DataFrame:
    """row, id, block, s, n, k1, k2 of each document, stored: a number of its own, its runs and how many, and 128 bits of hash that stand for them."""
    key = F.coalesce(F.col(block).cast("string"), F.lit("")) if block else F.lit("")
    each = documents.select(F.col(id).alias("id"), key.alias("block"), shingles(F.coalesce(F.col(text), F.lit(""))).alias("s"))
    return stored(each.withColumns({"n": F.size("s"), "k1": F.xxhash64("s"), "k2": F.xxhash64("s", F.lit("k2")), "row": F.monotonically_increasing_id()}), "dedup-sets")


def near_pairs(documents: DataFrame, block: str | None = None, similar: float = SIMILAR, id: str = "doc_id", text: str = "text") -> DataFrame:
    """a < b, jaccard: pairs of different sets at or over ``similar``, each set by its first id, within equal ``block``."""
    return _pairs(_sets(documents, block, id, text), similar)


#: Row numbers that may be broadcast: some 50 MB.
ROWS = 2_000_000


def _of_rows(df: DataFrame, rows: DataFrame, others: DataFrame) -> DataFrame:
    """``df`` of the stored ``rows``, which are all but ``others``. Runs are not shuffled for it unless both are too many to broadcast."""
    if others.count() < rows.count():
        return df.join(small(others, ROWS), "row", "left_anti")
    return df.join(small(rows, ROWS), "row", "left_semi")


def _firsts(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``every`` with the first row of each set, and the numbers of these rows."""
    full = every.filter((F.col("n") > 0) & F.col("id").isNotNull())
    firsts = stored(full.groupBy("block", "k1", "k2").agg(F.min(F.struct("id", "row"))["row"].alias("row")).select("row"), "dedup-firsts")
    return _of_rows(full, firsts, stored(full.select("row").join(firsts, "row", "left_anti"), "dedup-others")), firsts


#: Part of a set's runs by which its first ones are more than the prefix filter asks for, so that similar sets share as many of them.
MORE = 0.1


def _in_company(sets: DataFrame, rows: DataFrame, similar: float) -> DataFrame:
    """``sets`` without those that are similar to none.

    If x and y have c runs in common, then in any order, such as that of the hashes themselves, the first |x| - c + m of x and |y| - c + m of y have m in common.
    So with m a tenth of a set (the lesser one's is at least ``similar`` times the other's), a set is left out if fewer of its first runs occur in another set's.
    """
    more = F.greatest(F.ceil(F.col("n") * MORE - 1e-9), F.lit(1))
    first = F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + more).cast("int"))
    lead = sets.select("row", "block", F.explode(first).alias("h")).select("row", F.xxhash64("block", "h").alias("h"))
    met = lead.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h"))).filter("df > 1").groupBy("row").agg(F.count(F.lit(1)).alias("met"))
    need = F.greatest(F.ceil(F.col("n") * (MORE * similar) - 1e-6), F.lit(1))
    company = stored(met.join(sets.select("row", "n"), "row").filter(F.col("met") >= need).select("row"), "dedup-company")
    return _of_rows(sets, company, stored(rows.join(company, "row", "left_anti"), "dedup-alone"))


def _pairs(every: DataFrame, similar: float) -> DataFrame:
    sets = _in_company(*_firsts(every), similar)
    # Runs are shuffled once, as (run, row); those of one set alone stay behind there, and go on neither to the prefixes nor to the check.
    df = F.count(F.lit(1)).over(Window.partitionBy("h")).cast("int")
    often = sets.select("row", F.explode("s").alias("h")).withColumn("df", df).filter("df > 1")
    ordered = often.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("known")).join(every.select("row", "block", "id", "n"), "row")
    # Runs of one set alone come first in the order; the prefix is what is left of it after them.
    room = F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + 1 - (F.col("n") - F.size("known"))
    known = stored(ordered.withColumn("room", room.cast("int")).filter("room > 0").withColumn("known", F.col("known.h")), "dedup-known")
    prefix = stored(known.select("block", "id", "row", "n", F.explode(F.slice("known", F.lit(1), F.col("room"))).alias("h")), "dedup-prefix")
    a, b = (prefix.select("block", "h", F.col("id").alias(x), F.col("row").alias(f"row_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    meet = a.join(b, ["block", "h"]).filter((F.col("a") < F.col("b")) & (F.col("n_a") >= similar * F.col("n_b")) & (F.col("n_b") >= similar * F.col("n_a"))).drop("h").distinct()
    left, right = (known.select(F.col("row").alias(f"row_{x}"), F.col("known").alias(f"s_{x}")) for x in "ab")
    both = small(stored(meet, "dedup-meet")).join(left, "row_a").join(right, "row_b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    scored = both.select("block", "a", "b", (common / (F.col("n_a") + F.col("n_b") - common)).alias("jaccard"))
    return scored.filter(F.col("jaccard") >= similar - 1e-12)


#: Pairs of a component that one task folds, and rounds on the whole graph before components are looked for.
FOLDED, EASY_ROUNDS = 200_000, 3


def components(edges: DataFrame) -> DataFrame:
    """id, root: the least id of each one's component; ``edges``: a, b. Rounds double the reach, as stars about least neighbours grow.

    A round joins every larger neighbour of a node with the node's least neighbour (large star), then every smaller one (small star); a node
    meets its own neighbours only, and their number is the number of edges.
    """

    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        met = both.join(least, "a")
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    shape = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = stored(edges.select("a", "b"), "components")
    before = None
    while before != (before := shape(now)):
        then = stored(star(star(now, True), False), "components")
        forget(now)
        now = then
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _round(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Decides all whose earlier neighbours are decided, or one of whose earlier neighbours stays."""
    seen = pairs.join(state.select(F.col("id").alias("a"), F.col("kept").alias("by")), "a").groupBy("b").agg(F.max(F.coalesce("by", F.lit(False))).alias("hit"), F.max(F.col("by").isNull()).alias("open"))
    return stored(state.join(seen.withColumnRenamed("b", "id"), "id", "left").select("id", F.coalesce("kept", F.when(F.coalesce("hit", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))).alias("kept")), "dedup-state")


def _fold(pairs: DataFrame) -> DataFrame:
    """id, kept of components of up to ``FOLDED`` pairs, each in one task, in order of id; ``pairs``: root, a, b, all of them open.

    An open one has no neighbour that stays, so its decided neighbours say nothing more.
    """
    kind = pairs.schema["a"].dataType.simpleString()

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        before: dict = {}
        for a, b in zip(group["a"], group["b"], strict=True):
            before.setdefault(b, []).append(a)
            before.setdefault(a, [])
        kept: dict = {}
        for x in sorted(before):
            kept[x] = not any(kept[y] for y in before[x])
        return pd.DataFrame({"id": list(kept), "kept": list(kept.values())})

    return pairs.groupBy("root").applyInPandas(fold, f"id {kind}, kept boolean")


def near_keep(documents: DataFrame, block: str | None = None, similar: float = SIMILAR, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, kept: in order of id, a document stays unless it is similar to an earlier one that stays."""
    every = _sets(documents, block, id, text)
    pairs = stored(_pairs(every, similar).select("a", "b"), "dedup-pairs")
    firsts = every.groupBy("block", "k1", "k2").agg(F.min("id").alias("first"))
    known = every.join(firsts, ["block", "k1", "k2"]).select("id", "first", (F.col("n") == 0).alias("bare"))
    state = greedy(pairs)
    return known.join(state.withColumnRenamed("id", "first"), "first", "left").select("id", (F.col("bare") | ((F.col("id") == F.col("first")) & F.coalesce("kept", F.lit(True)))).alias("kept"))


def greedy(pairs: DataFrame) -> DataFrame:
    """id, kept of all in ``pairs`` (a < b): in order of id, whoever has no earlier neighbour that stays.

    A few rounds decide nearly all, on a graph that is only as large as the similar pairs. What is left are long chains of
    revisions: their components are found in a number of rounds that goes with the logarithm of their length, and each is
    folded in order of id in one task. Components of more than ``FOLDED`` pairs go on in rounds. Each round's table is removed after the next.
    """
    ship(pairs.sparkSession)
    state = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().withColumn("kept", F.lit(None).cast("boolean")), "dedup-state")
    rounds = 0
    while state.filter("kept is null").limit(1).count():
        rounds += 1
        if rounds == EASY_ROUNDS + 1:
            hit = pairs.join(state.filter("kept").select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"), F.lit(True).alias("hit")).distinct()
            now = stored(state.join(hit, "id", "left").select("id", F.coalesce("kept", F.when(F.col("hit"), F.lit(False))).alias("kept")), "dedup-state")
            forget(state)
            state = now
            open_ = state.filter("kept is null").select("id")  # none of these has an earlier neighbour that stays
            left = stored(pairs.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").join(open_.withColumnRenamed("id", "b"), "b", "left_semi"), "dedup-left")
            rooted = stored(left.join(components(left).withColumnRenamed("id", "a"), "a"), "dedup-rooted")
            size = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= FOLDED).select("root")
            solved = _fold(rooted.join(size, "root"))
            then = stored(state.join(solved.withColumnRenamed("kept", "solved"), "id", "left").select("id", F.coalesce("kept", "solved").alias("kept")), "dedup-state")
        else:
            then = _round(pairs, state)
        forget(state)
        state = then
    return state
