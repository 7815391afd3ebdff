"""Document fingerprints by consistent weighted sampling.

A text's terms are its words (between runs of ASCII white space), a term's weight is
1 + ln(times it occurs). For each of K samples a term has its own r, c ~ Gamma(2,1)
and b ~ U(0,1), all hashed from the term, and with weight w

    t = floor(ln w / r + b),  ln a = ln c - r (t - b) - r

The least ln a over all terms is the sample: two texts share it with a chance
equal to the generalised Jaccard similarity of their weights. A fingerprint is
16 bits of each sample, in hex. Parameters are stored in single precision, so equal
texts have equal fingerprints wherever the same NumPy build computes them; the
logarithms of another build may differ in a last bit and so, rarely, in a sample.

``with_edits`` also meets each document with the next one by id. Documents are
dealt to ranges of (id, SHA-256 of the text), cut at quantiles; an id that holds
several quantiles is cut by its texts' hashes. The first document of each range is
found beforehand and sent to the range before it as well: one shuffle of the texts,
no global sort. A range is sorted by Spark, which may spill, and read as a stream of
``CHUNK`` documents at a time, so its size does not matter.

Edge cases: null text is empty; texts without a word share one fingerprint
(likeness 1 among them, 0 to others); rows with equal ids are ordered by the
text's SHA-256 (rows equal in both share a range); null ids come first; a lone
document is its own next; very long texts are taken whole, terms in blocks; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .hashing import Words, mixed

SAMPLES = 64
#: Terms whose parameters are held at once.
BLOCK = 2048
#: Documents of one range, until there are MOST_RANGES of them, then more; documents whose terms are drawn together.
RANGE_DOCS, MOST_RANGES, CHUNK = 128, 50_000, 128
_C2 = np.uint64(0xD1B54A32D192ED03)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def parameters(terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, b and ln c of each term (rows) and sample (columns)."""
    x = mixed(terms)[:, None] + (np.arange(1, k + 1, dtype=np.uint64) * _GOLDEN)[None, :]
    z1, z2 = mixed(x), mixed(x ^ _C2)
    low, s40, s16, m24 = np.uint64(0xFFFF), np.uint64(40), np.uint64(16), np.uint64(0xFFFFFF)
    u = lambda z: (z.astype(np.float64) + 0.5) * 2.0**-24
    r = -np.log(u(z1 >> s40) * u((z1 >> s16) & m24))
    c = np.log(-np.log(u(z2 >> s40) * u((z2 >> s16) & m24)))
    b = (((z1 & low) << s16 | (z2 & low)).astype(np.float64) + 0.5) * 2.0**-32
    return r.astype(np.float32), b.astype(np.float32), c.astype(np.float32)


def samples(bags: list[tuple[np.ndarray, np.ndarray]], k: int = SAMPLES) -> np.ndarray:
    """The k 16-bit samples of each bag (distinct term hashes, counts); zeros for an empty bag."""
    best = np.full((len(bags), k), np.inf, dtype=np.float32)
    if bags and any(len(t) for t, _ in bags):
        owner = np.repeat(np.arange(len(bags)), [len(t) for t, _ in bags])
        counts = np.concatenate([n for _, n in bags])
        terms, place = np.unique(np.concatenate([t for t, _ in bags]), return_inverse=True)
        order = np.argsort(place, kind="stable")
        place, owner, counts = place[order], owner[order], counts[order]
        for start in range(0, len(terms), BLOCK):
            r, b, c = parameters(terms[start : start + BLOCK], k)
            plain = c + r * b - r
            lo, hi = np.searchsorted(place, [start, start + BLOCK])
            back = np.argsort(owner[lo:hi], kind="stable")
            rows, own, n = place[lo:hi][back] - start, owner[lo:hi][back], counts[lo:hi][back]
            a = plain[rows]
            more = np.flatnonzero(n > 1)
            if len(more):
                rm, bm = r[rows[more]], b[rows[more]]
                t = np.floor(np.log1p(np.log(n[more].astype(np.float64))).astype(np.float32)[:, None] / rm + bm)
                a[more] = c[rows[more]] - rm * (t - bm) - rm
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            best[own[first]] = np.minimum(best[own[first]], np.minimum.reduceat(a, first, axis=0))
    bits = mixed(best.view(np.uint32).astype(np.uint64))
    out = (bits % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
    out[~np.isfinite(best).all(axis=1)] = 0
    return out


def bag(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(words.hashes(text.encode("utf-8", "surrogatepass").split()), return_counts=True)


def as_text(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the beginning of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def cut_points(quantiles: list[int]) -> tuple[list[int], list[int]]:
    """Bounds (id, least 32 bits of hash) from ids at equal steps: an id that comes m times is cut into m parts."""
    keys, hashes = [], []
    for k, m in sorted(Counter(quantiles).items()):
        keys += [k] * m
        hashes += [(i << 32) // m for i in range(m)]
    return keys, hashes


def _bucket(key: Column, h: Column, bounds: tuple[list[int], list[int]]) -> Column:
    """How many of the sorted ``bounds`` are at most (key, h): a coarse step, then a fine one."""
    n = len(bounds[0])
    if not n:
        return F.lit(0)
    step = max(1, math.isqrt(n))
    array = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    below = lambda ks, hs: F.size(F.filter(ks, lambda b, i: (b < key) | ((b == key) & (F.get(hs, i) <= h))))
    coarse = below(*(array(x[::step]) for x in bounds))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + below(*(F.slice(array(x), (coarse - 1) * step + 1, F.lit(step)) for x in bounds)))


RESULT = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _met(keys: list[int], texts: list[str], after: str, words: Words, k: int) -> pa.RecordBatch:
    """Results of neighbours ``texts``, of which the last is followed by ``after``."""
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    changed = [edited(t, f) for t, f in zip(texts, [*texts[1:], after], strict=True)]
    made = samples([bag(t, words) for t in [*texts, after, *changed]], k)  # terms in common are drawn once
    prints, changes = made[: len(texts) + 1], made[len(texts) + 1 :]
    return pa.RecordBatch.from_arrays([
        pa.array(keys, type=pa.int64()), pa.array([len(t) for t in texts], type=pa.int64()), pa.array([sha(t) for t in changed]),
        pa.array([as_text(x) for x in prints[:-1]]), pa.array([as_text(x) for x in changes]), pa.array(likeness(prints[:-1], changes)), pa.array(likeness(prints[:-1], prints[1:])),
    ], names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def with_edits(documents: DataFrame, k: int = SAMPLES) -> DataFrame:
    """One row a document: its fingerprint, its edited text's, and their likeness."""
    ship(documents.sparkSession)
    spark, least = documents.sparkSession, -(2**63)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).select(F.coalesce("doc_id", F.lit(least)).alias("key"), "text")
    n = docs.count()
    ranges = min(MOST_RANGES, max(1, n // RANGE_DOCS))
    bounds: tuple[list[int], list[int]] = ([], [])
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        bounds = cut_points([int(b) for b in docs.agg(F.percentile_approx("key", at, F.lit(max(10_000, 10 * ranges))).alias("q")).first()["q"]])
    hashed = docs.withColumn("sha", F.unhex(F.sha2("text", 256)))
    dealt = hashed.withColumn("bucket", _bucket(F.col("key"), F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long"), bounds))
    # The first document of each range (one row a range) goes to the range before as well; the very first to the last one.
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct("key", "sha")).alias("f")).select("bucket", "f.*").orderBy("bucket").collect()
    before = [(r["bucket"], firsts[i - 1]["bucket"], r["key"], bytes(r["sha"])) for i, r in enumerate(firsts)]
    guests = spark.createDataFrame(before, "bucket int, before int, key long, sha binary")
    own = dealt.join(F.broadcast(guests), ["bucket", "key", "sha"], "left")
    to = lambda b, guest: F.struct(F.col(b).cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    sent = own.withColumn("to", F.explode(F.when(F.col("before").isNotNull(), F.array(to("bucket", False), to("before", True))).otherwise(F.array(to("bucket", False))))).select("to.bucket", "to.guest", "key", "sha", "text")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bucket, keys, texts = Words(), None, [], []
        for part in batches:
            for b, guest, key, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "guest", "key", "text")), strict=True):
                if b != bucket:
                    bucket, keys, texts = b, [], []
                if guest:
                    if texts:  # rows equal to the first of the next range came along; one is enough
                        yield _met(keys, texts, text, words, k)
                    keys, texts = [], []
                    continue
                if len(texts) == CHUNK:
                    yield _met(keys, texts, text, words, k)
                    keys, texts = [], []
                keys.append(key)
                texts.append(text)

    made = sent.repartition("bucket").sortWithinPartitions("bucket", "guest", "key", "sha").select("bucket", "guest", "key", "text").mapInArrow(meet, RESULT)
    return made.select(F.when(F.col("key") != least, F.col("key")).alias("doc_id"), *made.columns[1:])
