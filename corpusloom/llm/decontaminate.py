"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short, documents long, so similarity says little and
containment is asked: the share of an item's five-word runs that a document
has. Items are partitioned by size, by powers of two, and the partition is part
of the key of the search: an item is found through its MinHash sketch, the least
hashes of its runs, and each partition has its own greatest sketch hash. A run of
a document asks only those partitions whose items the document is large enough to
contain and whose sketches reach up to its hash. Before it asks, a Bloom filter of all sketch
hashes lets go nearly every run that no item has. Candidates are verified by exact
containment.

An item of n runs needs at least n - ceil(t n) + 1 of them in its sketch for one of
any t n to be among them; the sketch has that many, but at most ``SKETCH``. So
sketches miss nothing up to 39 runs at t = 0.8, and beyond that a document that has the part
c of the rarer runs with a chance of (1 - c) ** SKETCH, 3 in a million at 0.8. Runs that
more than ``COMMON`` items share (phrases of questions) come last in the order, so
that a document that holds such a phrase is not held against all of them. Items of
equal runs are searched once.

All of it is DataFrame operations; the items' tables are broadcast only up to a
checked size in bytes.

Edge cases: null text is empty; an item without words is contained in nothing;
an item of fewer than five words is looked for as one run of its length;
documents and items are answered row by row, so equal texts, equal ids and null
ids (of either) give a row for each pair of rows; very long texts are taken whole;
no items or no documents give an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shingles import let, runs, words
from .store import written

RUN, SKETCH, COMMON = 5, 8, 64
#: What may be broadcast.
BROADCAST_BYTES = 32 * 1024**2
#: The largest bitmap of sketch hashes, half a MB in the plan.
BLOOM_BITS = 1 << 22


def _may_broadcast(df: DataFrame, array: str | None = None) -> DataFrame:
    """A broadcast hint, if the stored rows, at 64 bytes and 8 an element of ``array``, are few enough."""
    size = df.agg((F.count(F.lit(1)) * 64 + (F.coalesce(F.sum(F.size(array)), F.lit(0)) * 8 if array else F.lit(0))).alias("n")).first()["n"]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _hashes(text: Column, lengths: list[int]) -> Column:
    return let(words(text), lambda w: F.concat(*(runs(w, n) for n in lengths)))


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set, item_id) of each item row; set, run, h, n_item, part of each distinct set of runs."""
    size = F.size("w")
    by_length = F.when(size >= RUN, runs(F.col("w"), RUN))
    for n in range(1, RUN):
        by_length = by_length.when(size == n, runs(F.col("w"), n))
    rows = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(size > 0).select("item_id", F.least(size, F.lit(RUN)).alias("run"), F.array_sort(by_length).alias("h"))
    rows = written(rows, "bench-items")
    sets = written(rows.select("run", "h").distinct().select(F.monotonically_increasing_id().alias("set"), "run", "h", F.size("h").alias("n_item"), F.floor(F.log2(F.size("h"))).cast("int").alias("part")), "bench-sets")
    return rows.join(sets, ["run", "h"]).select("set", "item_id"), sets


def _sketches(sets: DataFrame, threshold: float) -> DataFrame:
    """set, n_item, part, hash: the runs by which an item is found."""
    each = sets.select("set", "n_item", "part", F.explode("h").alias("hash"))
    shared = each.groupBy("hash").agg((F.count(F.lit(1)) > COMMON).alias("common"))
    need = F.least(F.lit(SKETCH), F.col("n_item") - F.ceil(threshold * F.col("n_item") - 1e-9) + 1)
    place = F.row_number().over(Window.partitionBy("set").orderBy("common", "hash"))
    return written(each.join(shared, "hash").withColumn("place", place).filter(F.col("place") <= need).select("set", "n_item", "part", "hash"), "bench-sketch")


def _bloom(sketch: DataFrame):
    """A test of a hash column: whether both of its bits are set by some hash of ``sketch``.

    The bitmap has 16 to 32 bits a hash, at most ``BLOOM_BITS``; past that it lets more through, never less.
    """
    n = sketch.count()
    bits = min(BLOOM_BITS, 1 << max(10, (16 * n).bit_length()))
    places = lambda h: (F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 31), F.lit(bits)))
    each = sketch.select(F.explode(F.array(*places(F.col("hash")))).alias("bit"))
    mask = F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))")
    words_ = dict(each.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("at")).agg(mask.alias("mask")).collect())  # BLOOM_BITS / 64 rows at most
    bitmap = F.split(F.lit(",".join(str(words_.get(i, 0)) for i in range(bits // 64))), ",").cast("array<bigint>")
    held = lambda bit: F.get(bitmap, F.shiftright(bit, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))) != 0

    def test(h: Column) -> Column:
        a, b = places(h)
        return held(a) & held(b)

    return test


def contained(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, text_key, item_id, n_item, n_shared, containment of each item in a document at or over ``threshold``."""
    items, sets = _items(benchmark)
    lengths = sorted({r["run"] for r in sets.select("run").distinct().collect()} | {RUN})  # at most RUN of them
    docs = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    sketch = _sketches(sets, threshold)
    parts = sorted(sketch.groupBy("part").agg(F.min("n_item").alias("least"), F.max("hash").alias("top")).collect())  # one row a power of two
    asks = F.array_compact(F.array(*(F.when((F.col("n") >= threshold * p["least"] - 1e-9) & (F.col("hash") <= p["top"]), F.lit(p["part"])) for p in parts))) if parts else F.array().cast("array<int>")
    runs_ = docs.select("text_key", _hashes(F.col("text"), lengths).alias("h")).select("text_key", F.size("h").alias("n"), F.explode("h").alias("hash"))
    probes = runs_.filter(_bloom(sketch)(F.col("hash"))).select("text_key", "n", "hash", F.explode(asks).alias("part"))
    met = probes.join(_may_broadcast(sketch), ["part", "hash"]).filter(F.col("n") >= threshold * F.col("n_item") - 1e-9)
    candidates = written(met.select("text_key", "set").distinct(), "bench-candidates")

    keys = written(candidates.select("text_key").distinct(), "bench-keys")
    wanted = docs.join(_may_broadcast(keys), "text_key", "left_semi").select("doc_id", "text_key", _hashes(F.col("text"), lengths).alias("h"))
    pairs = wanted.join(_may_broadcast(candidates), "text_key").join(_may_broadcast(sets.select("set", "n_item", F.col("h").alias("item_h")), "item_h"), "set")
    pairs = pairs.withColumn("n_shared", F.size(F.array_intersect("item_h", "h"))).withColumn("containment", F.col("n_shared") / F.col("n_item"))
    held = pairs.filter(F.col("containment") >= threshold - 1e-12)
    return held.join(_may_broadcast(written(items, "bench-members")), "set").select("doc_id", "text_key", "item_id", "n_item", "n_shared", "containment")


def clean(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``documents`` without those that contain an item."""
    hits = written(contained(documents, benchmark, threshold).select(F.col("text_key").alias("__hit")).distinct(), "bench-hits")
    return documents.join(_may_broadcast(hits), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("__hit"), "left_anti")
