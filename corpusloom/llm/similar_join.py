"""N-gram Jaccard join: an LSH forest of MinHash paths, with exact verification.

Words are lower-cased runs of letters, digits and underscores; a text's set is
its runs of five words (all words where there are fewer). Texts of equal sets
are one class from the start, so copies cost one line each.

A set has one path of ``DEEPEST`` minima in each of ``TREES`` trees. The sorted paths
of a tree are its trie, a node is a prefix, and nodes of one text cost nothing:
a text that is alone at the shortest prefix in every tree is done at once.
Prefixes are matched longest first and shortened in steps. At each prefix the
pairs that first meet there are verified, and each text's recall is measured: its
links, over those that are to be expected from what the links found are worth
(one of similarity s is missed with chance (1 - s^d)^TREES at prefix d) and one
more link at the threshold. A text whose recall has come to ``RECALL`` is
shortened no further, though others may still find it. So texts of dense groups
stop at long prefixes and meet few strangers; texts with few links go on to the
shortest prefix, at which a pair at the threshold meets with chance ``SURE``.

A pair has one home: the longest prefix it shares, in the first tree where it
does. Nodes are dealt in pairs of blocks, so a large node makes more tasks, not
larger ones. First the paths alone meet (256 bytes a text): all equal minima of a
pair estimate its similarity, and only texts with a pair of its home here that is
not far below the threshold (``FAR``, over five standard errors) send their
shingles. Those are intersected exactly; sums for each text leave the task, never
pairs. Links give the classes.

Edge cases: null text is empty; texts without a word link to equal texts only;
repeated rows and equal ids with other texts are taken row by row; very long
texts are taken whole; an empty table gives an empty result; other columns are
not read. A class is named by its least id; one of null ids only by a text's hash.
Where ids repeat, unlike classes may bear one name; ``class_key`` tells them apart.
Sets are told apart by 128 bits of hash and numbered without collisions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .graph import components
from .grouped import dealt, whole_groups
from .hashing import Words, mixed, shingle_hashes
from .store import forget, written

WORD = re.compile(r"\w+")
TREES, DEEPEST, STEP, SURE, RECALL = 16, 8, 2, 0.9995, 0.999
#: Similarity by minima below which a pair is not verified, as a part of the threshold.
FAR = 0.75
#: Texts of one block; two blocks meet in a task.
BLOCK = 256
#: Pairs looked at in one array operation.
CHUNK = 16_384
#: Rows of (id, hash) that may be broadcast: 16 MB.
BROADCAST_ROWS = 500_000
KEY = ("node", "lo", "hi")


def depth(threshold: float, trees: int = TREES, deepest: int = DEEPEST, sure: float = SURE) -> int:
    """The longest prefix at which a pair at ``threshold`` meets in some tree with chance ``sure``."""
    k = deepest
    while k > 1 and met(threshold, k, trees) < sure:
        k -= 1
    return k


def met(similarity, d: int, trees: int):
    """The chance that a pair shares a prefix of ``d`` in some tree."""
    return 1 - (1 - similarity**d) ** trees


def prefixes(threshold: float, trees: int = TREES, deepest: int = DEEPEST, sure: float = SURE) -> list[int]:
    """Prefix lengths, longest first."""
    last = depth(threshold, trees, deepest, sure)
    return [*range(deepest, last, -STEP), last]


def shingle_set(text: str, words: Words, n: int = 5) -> np.ndarray:
    return np.unique(shingle_hashes(words.hashes(WORD.findall(text.lower())), n))


def paths(shingles: np.ndarray, trees: int = TREES, deepest: int = DEEPEST) -> np.ndarray:
    """16 bits of each minimum: a row a tree."""
    m = trees * deepest
    a = mixed(np.arange(1, m + 1, dtype=np.uint64)) | np.uint64(1)
    b = mixed(np.arange(m + 1, 2 * m + 1, dtype=np.uint64))
    least = np.full(m, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, (shingles[at : at + 512, None] * a + b).min(axis=0))
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16).reshape(trees, deepest)


def prefix_hashes(path: np.ndarray, d: int) -> np.ndarray:
    """One number for the first ``d`` steps of each path (texts, trees, steps)."""
    out = np.zeros(path.shape[:2], dtype=np.uint64)
    for i in range(d):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + path[:, :, i])
    return out


_halves: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def home_pairs(at: np.ndarray, ends: np.ndarray, tree: np.ndarray, side: np.ndarray, apart: np.ndarray, active: np.ndarray, path: np.ndarray, d: int, longer: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows i, j of the pairs whose home is their group's node: no prefix of ``longer`` steps in common, and this the first tree with one of ``d``.

    ``side`` tells the two blocks of a group that is ``apart``; pairs of two texts that are not ``active`` are left out.
    """
    here, deep = prefix_hashes(path, d), prefix_hashes(path, longer) if longer else None
    few_i, few_j, out_i, out_j = [], [], [], []
    for s, e in zip(at, ends, strict=True):
        n = e - s
        if n < 2 or not active[s:e].any():
            continue
        if n <= 24 and not apart[s]:
            if n not in _halves:
                _halves[n] = np.triu_indices(n, 1)
            few_i.append(_halves[n][0] + s)
            few_j.append(_halves[n][1] + s)
            continue
        rows = np.arange(s, e)
        a, b = (rows[~side[s:e]], rows[side[s:e]]) if apart[s] else (rows, rows)
        fits = active[a][:, None] | active[b][None, :]
        if not apart[s]:
            fits &= np.triu(np.ones((n, n), dtype=bool), 1)
        for t in range(int(tree[s])):
            fits &= here[a, t][:, None] != here[b, t][None, :]
        if deep is not None:
            for t in range(path.shape[1]):
                fits &= deep[a, t][:, None] != deep[b, t][None, :]
        i, j = np.nonzero(fits)
        out_i.append(a[i])
        out_j.append(b[j])
    if few_i:
        fi, fj = np.concatenate(few_i), np.concatenate(few_j)
        for c in range(0, len(fi), CHUNK):
            i, j = fi[c : c + CHUNK], fj[c : c + CHUNK]
            ok = (active[i] | active[j]) & ((here[i] == here[j]).argmax(axis=1) == tree[i])
            i, j = i[ok], j[ok]
            if deep is not None:
                ok = ~(deep[i] == deep[j]).any(axis=1)
                i, j = i[ok], j[ok]
            out_i.append(i)
            out_j.append(j)
    if not out_i:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def estimated(path: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Share of equal minima of each pair."""
    flat, out = path.reshape(len(path), -1), np.zeros(len(i))
    for c in range(0, len(i), CHUNK):
        out[c : c + CHUNK] = (flat[i[c : c + CHUNK]] == flat[j[c : c + CHUNK]]).mean(axis=1)
    return out


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share, exactly."""
    g = len(sets)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    if not len(owner):
        return np.zeros((g, g))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    total = np.zeros((g, g), dtype=np.float64)
    wide = int(column.max()) + 1 if len(column) else 0
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, wide, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((g, min(4096, wide - at)), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        total += m @ m.T
    return total


def shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles the sets i and j share, for each pair."""
    if len(i) > 2 * len(sets):
        return common(sets)[i, j]
    out = np.zeros(len(i))
    for k, (a, b) in enumerate(zip(i, j, strict=True)):
        x, y = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
        place = np.searchsorted(y, x)
        place[place == len(y)] = 0
        out[k] = np.count_nonzero(y[place] == x)
    return out


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's component under the pairs i, j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        then = root.copy()
        np.minimum.at(then, i, low)
        np.minimum.at(then, j, low)
        then = then[then]
        if (then == root).all():
            return root
        root = then


def _columns(table: pa.Table, at: np.ndarray, trees: int, deepest: int) -> dict[str, np.ndarray]:
    got = {c: table.column(c).to_numpy() for c in ("node", "tree", "lo", "hi", "block", "rep")}
    got["active"] = np.asarray(table.column("active").to_pylist(), dtype=bool)
    got["path"] = np.frombuffer(b"".join(table.column("path").to_pylist()), dtype=np.uint16).reshape(-1, trees, deepest)
    got["apart"], got["side"] = got["lo"] != got["hi"], got["block"] == got["hi"]
    got["at"], got["ends"] = at, np.r_[at[1:], table.num_rows]
    return got


def _pairs(x: dict[str, np.ndarray], d: int, longer: int | None) -> tuple[np.ndarray, np.ndarray]:
    return home_pairs(x["at"], x["ends"], x["tree"], x["side"], x["apart"], x["active"], x["path"], d, longer)


MEMBER = "node long, tree int, lo int, hi int, block int, rep long, active boolean, copies long, path binary"


def hopeful(d: int, longer: int | None, floor: float, trees: int, deepest: int):
    """mapInArrow: of the texts of each node those with a pair at home here whose minima agree on ``floor`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, KEY):
            x = _columns(table, at, trees, deepest)
            i, j = _pairs(x, d, longer)
            near = estimated(x["path"], i, j) >= floor
            wanted = np.zeros(table.num_rows, dtype=bool)
            wanted[i[near]] = wanted[j[near]] = True
            yield from table.filter(pa.array(wanted)).to_batches()

    return run


def linked(d: int, longer: int | None, later: list[int], threshold: float, trees: int, deepest: int):
    """mapInArrow: for each text of a node its links there.

    a; b: a's least partner by links within the task; links: partners, copies counted; found: partners;
    missing: links that one found stands for, less itself, at each of the ``later`` prefixes and this one.
    """
    steps = [d, *later]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, KEY):
            x = _columns(table, at, trees, deepest)
            i, j = _pairs(x, d, longer)
            if not len(i):
                continue
            sets = [np.frombuffer(s, dtype=np.uint64) for s in table.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets], dtype=np.float64)
            group = np.searchsorted(at, i, side="right") - 1
            order = np.argsort(group, kind="stable")
            i, j, group = i[order], j[order], group[order]
            both = np.zeros(len(i))
            cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for s, e in zip(cut, np.r_[cut[1:], len(i)], strict=True):
                lo, hi = at[group[s]], x["ends"][group[s]]
                both[s:e] = shared(sets[lo:hi], i[s:e] - lo, j[s:e] - lo)
            alike = both / (sizes[i] + sizes[j] - both)
            ok = (alike >= threshold - 1e-12) & (x["rep"][i] != x["rep"][j])
            i, j, alike = i[ok], j[ok], alike[ok]
            if not len(i):
                continue
            n, copies = table.num_rows, table.column("copies").to_numpy().astype(np.float64)
            sums = lambda of_i, of_j: np.bincount(i, weights=of_i, minlength=n) + np.bincount(j, weights=of_j, minlength=n)  # noqa: E731, B023
            one = np.ones(len(i))
            links, found = sums(copies[j], copies[i]), sums(one, one)
            missing = np.stack([sums(m, m) for m in (1 / met(alike, s, trees) - 1 for s in steps)], axis=1)
            rows = np.flatnonzero(found)
            root = local_roots(n, i, j)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x["rep"][rows]), pa.array(x["rep"][root[rows]]), pa.array(links[rows].astype(np.int64)), pa.array(found[rows].astype(np.int64)), pa.array(list(missing[rows]), type=pa.list_(pa.float64()))],
                names=["a", "b", "links", "found", "missing"],
            )

    return run


def classes(documents: DataFrame, threshold: float = 0.8, n: int = 5, trees: int = TREES, deepest: int = DEEPEST, sure: float = SURE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, text_key, class_key (the class itself), class_id (its name, the least id), n_links (documents at or over the threshold)."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in batches:
            keys, found = [], []
            for t in part.column("text").to_pylist():
                s = shingle_set(t, words, n)
                keys.append(xxhash.xxh3_128_digest(s.tobytes() if len(s) else b"\0" + t.encode("utf-8", "surrogatepass")))
                found.append(paths(s, trees, deepest).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(keys, type=pa.binary()), pa.array(found, type=pa.binary())], names=["doc_id", "text_key", "set_key", "path"])

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in batches:
            made = [shingle_set(t, words, n).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(made, type=pa.binary())], names=["rep", "shingles"])

    signed = written(docs.select("doc_id", "text_key", "text").mapInArrow(sign, "doc_id long, text_key long, set_key binary, path binary"), "lsh-signed")
    sets = written(
        signed.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("path").alias("path"))
        .select(F.monotonically_increasing_id().alias("rep"), "set_key", "copies", "path", F.coalesce("id", F.col("first.text_key")).alias("id"), F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")),
        "lsh-sets",
    )
    steps = prefixes(threshold, trees, deepest, sure)

    def nodes(rows: DataFrame, d: int) -> DataFrame:
        """``rows`` with the node of ``d`` steps they are in, in each of their trees; the path's bytes sort and cut as its steps do."""
        at = F.substring(F.col("path"), F.col("tree") * (2 * deepest) + 1, F.lit(2 * d))
        return rows.withColumn("node", F.xxhash64("tree", at))

    # At the shortest prefix: who is not alone, and where.
    every = nodes(sets.filter(F.length("path") > 0).select("rep", "path", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")), steps[-1]).select("rep", "tree", "node")
    full = every.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    company = every.join(full, "node").groupBy("rep").agg(F.collect_set("tree").alias("trees"))
    alive = written(sets.join(company, "rep").select("rep", "doc_id", "text_key", "copies", "path", "trees"), "lsh-alive")

    few = alive.count() <= BROADCAST_ROWS
    wanted = alive.select("rep", "doc_id", "text_key")
    texts = docs.join(F.broadcast(wanted) if few else wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["text_key"] == wanted["text_key"])).select("rep", "text")
    shingles = written(texts.mapInArrow(shingle, "rep long, shingles binary").dropDuplicates(["rep"]), "lsh-shingles")

    found, passing = None, []
    for k, d in enumerate(steps):
        longer, later = (steps[k - 1] if k else None), steps[k + 1 :]
        members = alive.select("rep", "copies", "path", "trees")
        if found is None:
            members = members.withColumn("active", F.lit(True))
        else:  # links found, over those found and those that may be missing
            mine = found.groupBy("a").agg(F.sum("found").alias("found"), F.sum(F.element_at("missing", -len(later) - 2)).alias("missing"))
            members = members.join(mine.withColumnRenamed("a", "rep"), "rep", "left")
            more = float(1 / met(threshold, longer, trees) - 1)
            members = members.withColumn("active", F.col("found").isNull() | (F.col("found") / (F.col("found") + F.col("missing") + more) < recall)).drop("found", "missing")
        placed = nodes(members.withColumn("tree", F.explode("trees")).drop("trees"), d)
        alone = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("active").alias("open")).filter("n > 1 and open").select("node", "n")
        placed = placed.join(alone, "node").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", F.col("tree").cast("int").alias("tree"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "active", "copies", "path")
        near = written(dealt(placed, *KEY).mapInArrow(hopeful(d, longer, FAR * threshold, trees, deepest), MEMBER), f"lsh-near-{d}")
        sent = dealt(near.join(shingles, "rep"), *KEY)
        step = written(sent.mapInArrow(linked(d, longer, later, threshold, trees, deepest), "a long, b long, links long, found long, missing array<double>"), f"lsh-links-{d}")
        passing.append(near)
        found = step if found is None else found.unionByName(step)
    forget(shingles, *passing)

    final = written(components(found.select("a", "b")).withColumnRenamed("node", "rep"), "lsh-final")
    names = final.join(sets.select("rep", "id"), "rep").groupBy("root").agg(F.min("id").alias("class_id"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    each = sets.select("set_key", "rep", "id", "copies").join(links.withColumnRenamed("a", "rep"), "rep", "left").join(final.join(names, "root"), "rep", "left")
    each = each.select("set_key", F.coalesce("root", "rep").alias("class_key"), F.coalesce("class_id", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "text_key", "set_key").join(each, "set_key").select("doc_id", "text_key", "class_key", "class_id", "n_links")


def one_of_each(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``documents`` with one of each class: the least id (and text) of the class; of rows equal in both the least by its other columns."""
    given = documents.columns
    found = written(classes(documents, threshold), "lsh-classes")
    keep = written(found.groupBy("class_key").agg(F.min(F.struct("doc_id", "text_key")).alias("k"), F.count(F.lit(1)).alias("n")).select("k.doc_id", "k.text_key"), "lsh-keep").select(F.col("doc_id").alias("keep_id"), F.col("text_key").alias("keep_text"))
    drop = found.join(keep, found["doc_id"].eqNullSafe(keep["keep_id"]) & (found["text_key"] == keep["keep_text"]), "left_anti").select("doc_id", "text_key").distinct()
    drop = written(drop, "lsh-drop").select(F.col("doc_id").alias("drop_id"), F.col("text_key").alias("drop_text"))
    keyed = documents.withColumn("__text_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    small = drop.count() <= BROADCAST_ROWS
    left = keyed.join(F.broadcast(drop) if small else drop, keyed["doc_id"].eqNullSafe(drop["drop_id"]) & (keyed["__text_key"] == drop["drop_text"]), "left_anti")
    if found.groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count():  # repeated rows: one stays
        row = F.struct(*(F.col(f"`{c}`") for c in sorted(given)))
        left = left.groupBy("doc_id", "__text_key").agg(F.min(row).alias("__row")).select("__row.*")
    return left.select(*given)
