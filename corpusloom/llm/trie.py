"""Conversation prefix trie: MSD radix partitioning over dictionary-encoded turns, multikey quicksort where buckets are small.

Turns are (role, text); each distinct one gets a number from a stored dictionary, and a conversation is a sequence of
numbers. Conversations with the same sequence are one member with a weight. A bucket holds the members that share a prefix,
and is a node. Buckets of more than ``LOCAL`` turns are dealt by their next turn, all at once, with one
shuffle for each level (radix, most significant digit first); the others are sorted in one task each by multikey
quicksort, whose recursion emits their nodes. A bucket of one long conversation is a chain, which is written
row by row from running sums of words. Leaves and saved tokens of the dealt nodes are summed from the deepest level up.

Positions come from a sort by range over all partitions, so one conversation may fill many of them. The
list of conversations that end at a node is hashed in order: by pieces of ``PIECE`` ids, whose texts then pass through
one running SHA-256. Frequent turns meet the dictionary in a join whose large side is split where it is skewed (AQE).
There are as many rounds as the deepest bucket of over ``LOCAL`` turns has shared turns; equal conversations need none.

Edge cases: null role or text is empty; equal turn numbers are ordered by role, then by the SHA-256 of role and text, and repeated rows
stay; rows with a null conv_id belong to no conversation; a conversation may have no turns (after rebuilding) and then ends at
the root; an empty table has no nodes; texts of any length count whole; extra columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import ranged, streamed, with_last
from .store import forget, width, written

LOCAL = 1024
PIECE = 4096
WORD = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long"


def _numbered(part: int, rows: Iterator[dict]) -> Iterator[dict]:
    """Place and running words of each turn within its conversation, as far as this partition knows."""
    conv, n, words, first = None, 0, 0, None
    for r, is_last in with_last(rows):
        if r["conv_id"] != conv:
            conv, n, words = r["conv_id"], 0, 0
            first = first if first is not None else conv
        n += 1
        words += r["words"]
        yield {"conv_id": conv, "part": part, "pos": n, "words": r["words"], "cum": words, "key": r["key"], "edge": is_last or conv == first, "ends": is_last}


def encoded_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, id, words, cum): turns in order as numbers of a dictionary, with running sums of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    placed = written(streamed(ranged(turns, "conv_id", "turn", "role", "key").drop("turn", "role"), _numbered, "conv_id long, part int, pos long, words long, cum long, key binary, edge boolean, ends boolean"), "trie-turns")
    by_part = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edges = placed.filter("edge").groupBy("conv_id", "part").agg(F.max(F.when(F.col("ends"), F.col("pos"))).alias("n"), F.max(F.when(F.col("ends"), F.col("cum"))).alias("w"))
    before = edges.select("conv_id", "part", F.sum("n").over(by_part).alias("n0"), F.sum("w").over(by_part).alias("w0")).filter("n0 > 0")  # one row a partition at most
    words = written(placed.groupBy("key").agg(F.count(F.lit(1)).alias("_")).select("key", F.monotonically_increasing_id().alias("id")), "trie-dictionary")
    moved = placed.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("n0", F.lit(0))).alias("pos"), "words", (F.col("cum") + F.coalesce("w0", F.lit(0))).alias("cum"), "key")
    out = written(moved.join(words, "key").select("conv_id", "pos", "id", "words", "cum"), "trie-encoded")
    forget(placed, words)
    return out


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group of ids: turns as before, and (conv_id, n, words) of all, turnless ones too.

    The first h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % heads.
    """
    first = [F.max(F.when(F.col("pos") == i, F.col("cum"))) for i in range(1, heads)]
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max("cum").alias("total"), F.array(F.lit(0).cast("long"), *first).alias("cums"))
    convs = convs.select("*", F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("cums").alias("base_cums"))
    took, own = F.least("h", F.coalesce("base_n", F.lit(0))), F.least("h", "n")
    plan = convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", took.alias("took"), (F.get("cums", own.cast("int"))).alias("skipped"), F.coalesce(F.get("base_cums", took.cast("int")), F.lit(0)).alias("head"), (took + F.col("n") - own).alias("n"), "total"
    )
    plan = written(plan.withColumn("total", F.col("total") - F.col("skipped") + F.col("head")), "trie-plan")
    kept = turns.join(plan.select("conv_id", "h", "took", "skipped", "head"), "conv_id").filter(F.col("pos") > F.col("h"))
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("took")).alias("pos"), "id", "words", (F.col("cum") - F.col("skipped") + F.col("head")).alias("cum"))
    head = turns.filter((F.col("pos") < heads) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "took"), "base").filter(F.col("pos") <= F.col("took"))
    return written(kept.unionByName(head.select("conv_id", "pos", "id", "words", "cum")), "trie-rebuilt"), plan.select("conv_id", "n", F.col("total").alias("words"))


def _sha(ids: str) -> str:
    return hashlib.sha256(ids.encode()).hexdigest()


MEMBER = "rep long, weight long, n long, words long, ends string"


def _grouped(part: int, rows: Iterator[dict]) -> Iterator[dict]:
    """Members out of conversations sorted by sequence and id; those that may go on in another partition as pieces of ids."""
    same: tuple | None = None
    held: list[int] = []
    seq, opened, info = 0, True, {}

    def close(whole: bool) -> dict:
        ids = ",".join(map(str, held))
        done = {"rep": held[0], "weight": len(held), "part": part, "seq": seq, "open": not whole} | info
        return done | ({"ends": _sha(ids)} if whole else {"ids": ids})

    for r, is_last in with_last(rows):
        now = (r["x"], r["y"], r["n"])
        if same is not None and now != same:
            yield close(not opened)
            held, opened = [], False
            seq += 1
        elif len(held) >= PIECE:
            yield close(False)
            held, opened = [], True
            seq += 1
        same, info = now, {k: r[k] for k in ("x", "y", "n", "words")}
        held.append(r["conv_id"])
        if is_last:
            yield close(False)


def _chained(_part: int, rows: Iterator[dict]) -> Iterator[dict]:
    """Members out of pieces in order."""
    now: dict | None = None
    for r, is_last in with_last(rows):
        same = (r["x"], r["y"], r["n"])
        if now is not None and now["same"] != same:
            yield {k: now[k] for k in ("rep", "weight", "n", "words")} | {"ends": now["sha"].hexdigest()}
            now = None
        if now is None:
            now = {"same": same, "rep": r["rep"], "weight": 0, "n": r["n"], "words": r["words"], "sha": hashlib.sha256()}
        elif now["weight"]:
            now["sha"].update(b",")
        now["sha"].update(r["ids"].encode())
        now["weight"] += r["weight"]
        if is_last:
            yield {k: now[k] for k in ("rep", "weight", "n", "words")} | {"ends": now["sha"].hexdigest()}


def members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(rep, weight, n, words, ends) of each distinct sequence: its least conversation, how many, turns, words, hash of all their ids in order."""
    digest = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("pos", "id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit("y"), "pos")).alias("y"))
    known = convs.join(digest, "conv_id", "left").select("conv_id", "n", "words", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    made = written(streamed(ranged(known, "x", "y", "n", "conv_id"), _grouped, f"{MEMBER}, part int, seq int, open boolean, x long, y long, ids string"), "trie-groups")
    names = ["rep", "weight", "n", "words", "ends"]
    open_ = made.filter("open").select("x", "y", "n", "part", "seq", "rep", "weight", "words", "ids")
    chained = streamed(open_.repartition("x", "y", "n").sortWithinPartitions("x", "y", "n", "part", "seq"), _chained, MEMBER)
    out = written(made.filter(~F.col("open")).select(*names).unionByName(chained.select(*names)), "trie-members")
    forget(made)
    return out


def sorted_nodes(bucket: list[tuple], depth: int, parent: int | None, last_words: int) -> list[list]:
    """Nodes of a bucket by multikey quicksort: [conv, depth, parent's conv, weight, children, leaves, saved, member that ends here], the bucket's own first.

    ``bucket``: (rep, weight, ids, words) of the members' turns after the shared ``depth``.
    """
    nodes: list[list] = []
    above: list[int] = []

    def node(some: list[tuple], at: int, up: int, words: int) -> None:
        weight = sum(m[1] for m in some)
        ends = next((m[0] for m in some if len(m[2]) == at), None)
        nodes.append([min(m[0] for m in some), depth + at, parent if up < 0 else nodes[up][0], weight, 0, 0, (weight - 1) * words, ends])
        above.append(up)
        if up >= 0:
            nodes[up][4] += 1
        rest = [m for m in some if len(m[2]) > at]
        if rest:
            stack.append((rest, at, len(nodes) - 1))

    stack: list[tuple[list[tuple], int, int]] = []
    node(bucket, 0, -1, last_words)
    while stack:
        some, at, up = stack.pop()
        pivot = some[len(some) // 2][2][at]
        less, more = [m for m in some if m[2][at] < pivot], [m for m in some if m[2][at] > pivot]
        stack += [(x, at, up) for x in (less, more) if x]
        equal = [m for m in some if m[2][at] == pivot]
        node(equal, at + 1, up, equal[0][3][at])
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        x = nodes[i]
        x[5] += x[4] == 0
        if above[i] >= 0:
            nodes[above[i]][5] += x[5]
            nodes[above[i]][6] += x[6]
    return nodes


def _local(_part: int, rows: Iterator[dict]) -> Iterator[dict]:
    names = [c.split()[0] for c in NODE.split(", ")]

    def emit(key: tuple, bucket: list[tuple], info: dict) -> Iterator[dict]:
        for i, x in enumerate(sorted_nodes(bucket, key[0], info["up_conv"], info["last"])):
            yield dict(zip(names, x, strict=True)) | {"up": info["up"] if i == 0 else None, "level": key[0] if i == 0 else None}

    now, bucket, info = None, [], {}
    for r in rows:
        key = (r["level"], r["bucket"])
        if now is not None and key != now:
            yield from emit(now, bucket, info)
            bucket = []
        now, info = key, r
        if not bucket or bucket[-1][0] != r["rep"]:
            bucket.append((r["rep"], r["weight"], [], []))
        if r["pos"] is not None:
            bucket[-1][2].append(r["id"])
            bucket[-1][3].append(r["words"])
    if now is not None:
        yield from emit(now, bucket, info)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the conversations: the columns of the contract, ``ends_sha256`` with them."""
    spark = turns.sparkSession
    group = members(turns, convs)
    rows = written(turns.join(group.select(F.col("rep").alias("conv_id")), "conv_id").withColumnRenamed("conv_id", "rep").sortWithinPartitions("pos"), "trie-rows")
    none = F.lit(None).cast("long")
    now = group.select(F.lit(-1).cast("long").alias("up"), F.lit(-1).cast("long").alias("id"), none.alias("up_conv"), F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("cum"), "rep", "weight", "n", F.col("words").alias("total"))
    level, dealt, local, chains = 0, [], [], []
    while True:
        stats = now.groupBy("up", "id").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n") - level).alias("size"), F.sum("weight").alias("n_convs"), F.min("rep").alias("conv"), F.max("up_conv").alias("up_conv"), F.max("last").alias("last"), F.max(F.when(F.col("n") == level, F.col("rep"))).alias("end_rep"))
        kind = F.when(F.col("size") <= LOCAL, "local").when(F.col("m") == 1, "chain").otherwise("deal")
        stats = written(stats.withColumns({"kind": kind, "node": F.monotonically_increasing_id()}), "trie-buckets")
        kinds = {r[0] for r in stats.select("kind").distinct().collect()}
        known = now.join(stats.select("up", "id", "kind", "node", "conv"), ["up", "id"])
        if "local" in kinds:
            local.append(written(known.filter(F.col("kind") == "local").select(F.lit(level).cast("long").alias("level"), F.col("conv").alias("bucket"), "up", "up_conv", "last", "rep", "weight", "n"), "trie-local"))
        if "chain" in kinds:
            chains.append((level, written(known.filter(F.col("kind") == "chain"), "trie-chain")))
        if "deal" not in kinds:
            break
        dealt.append(stats.filter(F.col("kind") == "deal"))
        on = known.filter((F.col("kind") == "deal") & (F.col("n") > level)).select(F.col("node").alias("up"), F.col("conv").alias("up_conv"), "rep", "weight", "n", "total")
        step = rows.filter(F.col("pos") == level + 1).select("rep", "id", F.col("words").alias("last"), "cum")
        before, now = now, written(on.join(step, "rep"), "trie-level")
        forget(before)
        level += 1

    schema = f"{NODE}, up long, level long"
    names = [c.split()[0] for c in NODE.split(", ")]
    parts: list[DataFrame] = []
    if local:
        few = local[0]
        for x in local[1:]:
            few = few.unionByName(x)
        turn = rows.select(F.col("rep"), "pos", "id", "words")
        going = few.filter(F.col("n") > F.col("level")).join(turn, "rep").filter(F.col("pos") > F.col("level"))
        ended = few.filter(F.col("n") == F.col("level")).select("*", none.alias("pos"), none.alias("id"), none.alias("words"))
        every = going.unionByName(ended).repartition(width(spark), "level", "bucket").sortWithinPartitions("level", "bucket", "rep", "pos")
        parts.append(written(streamed(every, _local, schema), "trie-local-nodes"))
    for at, chain in chains:
        saved = lambda words: (F.col("weight") - 1) * words
        first = chain.select(F.col("rep").alias("conv_id"), F.lit(at).cast("long").alias("depth"), F.col("up_conv").alias("parent_conv_id"), F.col("weight").alias("n_convs"), F.lit(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved(F.col("total") - F.col("cum") + F.col("last")).alias("saved_tokens"), none.alias("end_rep"), "up", F.lit(at).cast("long").alias("level"))
        rest = chain.select("rep", "weight", "n", "total").join(rows.filter(F.col("pos") > at), "rep")
        rest = rest.select(F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("weight").alias("n_convs"), (F.col("pos") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved(F.col("total") - F.col("cum") + F.col("words")).alias("saved_tokens"), F.when(F.col("pos") == F.col("n"), F.col("rep")).alias("end_rep"), none.alias("up"), none.alias("level"))
        parts.append(first.unionByName(rest))
    for at in range(len(dealt) - 1, -1, -1):
        kids = [p.filter(F.col("level") == at + 1).select("up", "n_leaves", "saved_tokens") for p in parts]
        below = kids[0]
        for k in kids[1:]:
            below = below.unionByName(k)
        sums = below.groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        own = dealt[at].join(sums, "node").select(F.col("conv").alias("conv_id"), F.lit(at).cast("long").alias("depth"), F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("saved") + (F.col("n_convs") - 1) * F.col("last")).alias("saved_tokens"), "end_rep", "up", F.lit(at).cast("long").alias("level"))
        parts.append(written(own, "trie-dealt-nodes"))
    nodes = spark.createDataFrame([], NODE)
    for p in parts:
        nodes = nodes.unionByName(p.select(*names))
    ends = group.select(F.col("rep").alias("end_rep"), F.col("ends").alias("ends_sha256"))
    with_end = nodes.filter(F.col("end_rep").isNotNull()).join(ends, "end_rep").drop("end_rep")
    return with_end.unionByName(nodes.filter(F.col("end_rep").isNull()).drop("end_rep").withColumn("ends_sha256", F.lit(_sha(""))))
