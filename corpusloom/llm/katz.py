"""LM scoring: a Katz backoff bigram model over words.

Tokens are words (runs of non-blank characters, A-Z lower-cased) and one end a
text. Good-Turing discounts d_r hold for counts up to 5, from counts of counts:

    P(w | h) = d_c c(hw) / (c(h) + EPS)     if c(hw) > 0
             = alpha(h) P(w)                otherwise, or P(w) if h is unknown
    P(w)     = d_c c(w) / N                 if c(w) > 0
             = what is left of 1            for the one class of unknown words

alpha(h) makes each distribution sum to 1 exactly; EPS leaves a little where all
that follows h is frequent. The model is evaluated recursively for each token.

Tables are partitioned and never leave the executors:
  blocks    about ``block_tokens`` tokens of texts, as numbers of a dictionary
  words     by hash: each word's count and number, sent back to its blocks
  bigrams   by history: counts, discounts and what each document asks of them
Every table is arrays, packed by zstd, so a block costs one row a partition, not
one a token. What cannot be known within a history's partition, the discounts,
enters as counts of each discounted rank and is applied at the end. Histories
that hold over 1/(4 P) of all tokens, of which there are at most 4 P, are dealt
to several partitions by the following word; their sums meet on the driver.

There is a partition for every ``PART_BYTES`` of text (as many as the session's shuffle
width at least), so none grows with the input. What comes to the driver is a few
numbers a partition and a hot history.

Edge cases: null text is empty, a text of one end token; with no training text
N is 0, every token is unknown and score equals the sum of log10 1; counts too
few for Good-Turing fall back to absolute discounting by 1/2; texts of any
length are scored whole; repeated rows are scored each; null ids do not train.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .store import width, written

RANKS, EPS = 5, 0.01
BLOCK_TOKENS, PART_BYTES = 2_000_000, 64 * 1024**2
#: Parts that a very frequent history's followers are dealt to.
SALT = 16
END, START = b" end", b" start"  # no word holds a blank
ROW = "block long, part int, kind int, data binary"
TOKENS, WORDS, STATS, DOCS, PAIRS, SUMS, HOT, TOP = range(8)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: like bytes of neighbours side by side, then zstd."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind == "u" and a.dtype.itemsize > 1 and len(a):
            top = int(a.max())
            a = a.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)
        out.append(struct.pack("<4sQ", a.dtype.str.encode().ljust(4), len(a)))
        out.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = struct.unpack_from("<I", raw)[0], 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<4sQ", raw, at)
        kind, at = np.dtype(kind.decode().strip()), at + 12
        a = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size).T
        out.append(np.ascontiguousarray(a).view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def narrow(top: int) -> type:
    """The lesser unsigned type that holds numbers up to ``top``."""
    return np.uint32 if top < 2**32 else np.uint64


def discounts(counts: np.ndarray) -> np.ndarray:
    """d_1 .. d_5 by Good-Turing from n_1 .. n_6, or by taking off 1/2 for a rank to which these give none between 0 and 1."""
    r = np.arange(1, RANKS + 1)
    n = counts.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        top = (RANKS + 1) * n[RANKS] / n[0]
        found = ((r + 1) * n[1 : RANKS + 1] / (r * n[:RANKS]) - top) / (1 - top)
    return np.where((found > 0) & (found < 1), found, (r - 0.5) / r)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class _Local(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def encode(parts: int, block_tokens: int):
    """mapInArrow: texts to blocks of word numbers, and each block's dictionary by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks = TaskContext.get().partitionId(), 0
        local, ids, texts, lengths, waiting = _Local({END: 0}), [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal local, ids, texts, lengths, waiting, blocks
            block, blocks = (task << 24) + blocks, blocks + 1
            tokens, n = np.concatenate(texts), np.array(lengths, dtype=np.uint64)
            known, train, doc = (np.array([x[i] for x in ids], dtype=t) for i, t in ((0, np.uint8), (1, np.uint8), (2, np.int64)))
            counts = np.bincount(tokens[np.repeat(train, n.astype(np.int64)) > 0], minlength=len(local)).astype(np.uint64)
            hashes = np.fromiter(map(word_hash, local), dtype=np.uint64, count=len(local))
            rows = [(block, -1, TOKENS, pack(tokens.astype(np.uint64), n, known, train, doc))]
            part = (hashes % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((hashes, part))
            for p, at in zip(*np.unique(part[order], return_index=True), strict=True):
                own = order[at : at + int((part == p).sum())]
                rows.append((block, int(p), WORDS, pack(hashes[own], own.astype(np.uint64), counts[own])))
            local, ids, texts, lengths, waiting = _Local({END: 0}), [], [], [], 0
            return _batch(rows)

        for batch in batches:
            for doc, text, train in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "train")), strict=True):
                words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                words.append(END)
                texts.append(np.fromiter((local[w] for w in words), dtype=np.int64, count=len(words)))
                ids.append((doc is not None, train, doc or 0))
                lengths.append(len(words))
                waiting += len(words)
                if waiting >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=["block", "part", "kind", "data"])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["block", "part", "kind", "data"])


def number_words(parts: int):
    """By hash: counts over all blocks, and for each block its words' numbers and counts (0, 0 if no training text has it)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        p = int(group["part"].iloc[0])
        found = [unpack(d) for d in group["data"]]
        hashes, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([f[2] for f in found]).astype(np.float64), minlength=len(hashes)).astype(np.uint64)
        order = np.argsort(-counts.astype(np.int64), kind="stable")
        number = np.empty(len(hashes), dtype=np.uint64)
        number[order] = np.arange(len(hashes), dtype=np.uint64) * np.uint64(parts) + np.uint64(p + 2)
        number[counts == 0] = 0
        rows, at = [], 0
        for block, f in zip(group["block"], found, strict=True):
            own = place[at : at + len(f[0])]
            at += len(f[0])
            rows.append((int(block), p, WORDS, pack(number[own], f[1].astype(np.uint64), counts[own])))
        ranks = np.bincount(np.minimum(counts, RANKS + 2).astype(np.int64), minlength=RANKS + 3)[1 : RANKS + 2]
        top = order[: 4 * parts]
        rows.append((-1, p, STATS, pack(np.r_[counts.sum(), (counts > 0).sum()].astype(np.int64), ranks.astype(np.int64))))
        rows.append((-1, p, TOP, pack(number[top], counts[top])))
        return _frame(rows)

    return run


def over(least: float):
    """The numbers of words with more than ``least`` occurrences."""

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups:
            for data in group["data"]:
                number, count = unpack(data)
                yield pd.DataFrame({"number": number[count > least].astype(np.int64)})

    return run


def unigram(counts: np.ndarray, norm: float, d: np.ndarray, unknown: float) -> np.ndarray:
    """P(w) of words with these training counts."""
    c = counts.astype(np.int64)
    taken = np.r_[1.0, d, 1.0][np.minimum(c, RANKS + 1)]
    return np.where(c > 0, taken * c / max(norm, 1), unknown)


def ask(parts: int, total: int, norm: float, kinds: int, starts: int, d: np.ndarray, unknown: float, hot: np.ndarray):
    """A block's tokens with their numbers: sums of each document, and its bigrams by history; ``norm`` divides the model's counts, ``total`` those of the base score."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        block = int(group["block"].iloc[0])
        tokens, lengths, known, train, doc = unpack(group.loc[group["kind"] == TOKENS, "data"].iloc[0])
        size = int(tokens.max()) + 1
        found = [unpack(data) for data in group.loc[group["kind"] == WORDS, "data"]]
        kind = narrow(max((int(x.max()) for f in found for x in (f[0], f[2]) if len(x)), default=0) + starts)
        number, count = np.zeros(size, dtype=kind), np.zeros(size, dtype=kind)
        for n, own, c in found:
            number[own], count[own] = n, c
        del found
        lengths = lengths.astype(np.int64)
        first = np.r_[0, np.cumsum(lengths)[:-1]]
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        each = lambda of_word: np.add.reduceat(of_word[tokens], first)
        sums = [each((count > 0).astype(np.int64)), each(np.log10((count.astype(np.float64) + 0.1) / (total + 0.1 * (kinds + 1))))]
        w, cw = number[tokens], count[tokens]
        h, ch = np.concatenate([w[:1], w[:-1]]), np.concatenate([cw[:1], cw[:-1]])
        h[first], ch[first] = 1, starts
        alone = ch == 0
        p1 = np.zeros(len(w))
        p1[alone] = np.log10(unigram(count, norm, d, unknown))[tokens[alone]]
        rows = [(block, -1, DOCS, pack(known, doc, lengths, *sums, np.add.reduceat(p1, first)))]
        go = np.flatnonzero(~alone)
        del p1, alone, tokens
        h, w = h[go], w[go]
        part = (h % kind(parts)).astype(np.int32)
        if len(hot):
            often = np.isin(h, hot.astype(kind))
            part[often] = (h[often].astype(np.int64) + 7 * (w[often] % kind(SALT)).astype(np.int64)) % parts
        order = np.lexsort((w, h, part))
        part, h, w, go = part[order], h[order], w[order], go[order]
        ch, cw, owner = ch[go], cw[go], owner[go]
        del order, go
        for p, at in zip(*np.unique(part, return_index=True), strict=True):
            to = int(np.searchsorted(part, p, side="right"))
            hs, ws = h[at:to], w[at:to]
            new_h = np.r_[True, hs[1:] != hs[:-1]]
            new = new_h | np.r_[True, ws[1:] != ws[:-1]]
            pairs, heads = np.flatnonzero(new), np.flatnonzero(new_h)
            distinct = hs[heads]
            rows.append((block, int(p), PAIRS, pack(
                np.diff(distinct, prepend=kind(0)), ch[at:to][heads], np.diff(np.r_[np.flatnonzero(new_h[pairs]), len(pairs)]).astype(np.uint64),
                ws[pairs], cw[at:to][pairs], np.diff(np.r_[pairs, to - at]).astype(np.uint64), owner[at:to].astype(np.uint64), train,
            )))
        return _frame(rows)

    return run


def answer(norm: float, d: np.ndarray, unknown: float, hot: np.ndarray):
    """A part of the histories: each document's sums over seen bigrams, what it asks of unseen ones, counts of counts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        h, ch, w, cw, times, docs, trains, n_docs, n_pairs = ([] for _ in range(9))
        for data in group["data"]:
            dh, c, followers, ws, cws, k, own, train = unpack(data)
            followers = followers.astype(np.int64)
            own_h = np.cumsum(dh.astype(np.uint64))
            h.append(np.repeat(own_h.astype(narrow(int(own_h[-1]))), followers)), ch.append(np.repeat(c, followers))
            w.append(ws), cw.append(cws), times.append(k.astype(np.int32)), docs.append(own.astype(np.int32)), trains.append(train > 0)
            n_docs.append(len(train)), n_pairs.append(len(ws))
        trained = [np.add.reduceat(t[o].astype(np.int32), np.r_[0, np.cumsum(k)[:-1]]) for t, o, k in zip(trains, docs, times, strict=True)]
        h, ch, w, cw = map(np.concatenate, (h, ch, w, cw))
        order = np.lexsort((w, h))
        hs, ws = h[order], w[order]
        new = np.r_[True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])]
        pair = np.empty(len(order), dtype=np.int32 if len(order) < 2**31 else np.int64)
        pair[order] = np.cumsum(new, dtype=pair.dtype) - 1
        c = np.bincount(pair, weights=np.concatenate(trained)).astype(np.int64)
        one = order[new]
        u_h, u_ch, u_cw = hs[new], ch[one].astype(np.float64), cw[one]
        del h, ch, w, cw, order, hs, ws, new, trained
        p1 = unigram(u_cw, norm, d, unknown)
        heads = np.flatnonzero(np.r_[True, u_h[1:] != u_h[:-1]])
        history = np.cumsum(np.r_[True, u_h[1:] != u_h[:-1]]) - 1
        below = np.add.reduceat(np.where(c > 0, p1, 0.0), heads)
        ranks = np.stack([np.add.reduceat((c == r).astype(np.int64), heads) for r in range(1, RANKS + 1)])
        with np.errstate(divide="ignore"):
            value = np.where(c > 0, np.log10(np.maximum(c, 1)) - np.log10(u_ch + EPS), 0.0)
        is_hot = np.isin(u_h[heads].astype(np.uint64), hot)
        rows = [(-1, part, STATS, pack(np.bincount(np.minimum(c, RANKS + 2), minlength=RANKS + 3)[1 : RANKS + 2].astype(np.int64)))]
        if is_hot.any():
            rows.append((-1, part, HOT, pack(u_h[heads][is_hot].astype(np.uint64), below[is_hot], *ranks[:, is_hot])))
        a = 0
        for block, own, k, nd, np_ in zip(group["block"], docs, times, n_docs, n_pairs, strict=True):
            mine = pair[a : a + np_]
            token = np.repeat(mine, k)
            sums = np.bincount(own, weights=value[token], minlength=nd)
            rank = [np.bincount(own[c[token] == r], minlength=nd).astype(np.uint64) for r in range(1, RANKS + 1)]
            miss = np.flatnonzero(c[token] == 0)
            asked, slot = np.unique(history[token[miss]], return_inverse=True)
            lower = np.bincount(own[miss], weights=np.log10(p1[token[miss]]), minlength=nd)
            rows.append((int(block), part, SUMS, pack(sums + lower, *rank, own[miss].astype(np.uint64), slot.astype(np.uint64), u_h[heads][asked], u_ch[heads][asked], below[asked], *(x[asked].astype(np.uint64) for x in ranks))))
            a += np_
        return _frame(rows)

    return run


RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def total_up(d2: np.ndarray, hot: dict[int, tuple]):
    """A block's documents: sums over all parts, with the discounts and backoff weights now known."""
    weight = np.arange(1, RANKS + 1) * (1 - d2)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        known, doc, lengths, n_known, base, score = unpack(group.loc[group["kind"] == DOCS, "data"].iloc[0])
        score = score.copy()
        for data in group.loc[group["kind"] == SUMS, "data"]:
            sums, *rest = unpack(data)
            rank, (own, slot, h, ch, below), left = rest[:RANKS], rest[RANKS : RANKS + 5], rest[RANKS + 5 :]
            score += sums + np.log10(d2) @ np.stack(rank).astype(np.float64)
            if len(own):
                left, below = np.stack(left).astype(np.float64), below.copy()
                for i in np.flatnonzero(np.isin(h.astype(np.uint64), np.array(list(hot), dtype=np.uint64))) if hot else ():
                    below[i], left[:, i] = hot[int(h[i])][0], hot[int(h[i])][1]
                alpha = (EPS + weight @ left) / (ch + EPS) / np.maximum(1 - below, 1e-12)
                score += np.bincount(own.astype(np.int64), weights=np.log10(alpha)[slot], minlength=len(score))
        return pd.DataFrame({"doc_id": pd.arrays.IntegerArray(doc.astype(np.int64), known == 0), "n_tokens": lengths, "n_known": n_known, "base_score": base, "score": score})

    return run


def score(documents: DataFrame, block_tokens: int = BLOCK_TOKENS, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of ``documents`` (doc_id, text, train)."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("train"), F.lit(False)).alias("train"))
    shape = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if("train").alias("starts")).first()
    starts, parts = shape["starts"], max(width(spark), math.ceil(shape["bytes"] / part_bytes))
    blocks = written(docs.mapInArrow(encode(parts, block_tokens), ROW), "katz-blocks")
    words = written(blocks.filter(F.col("kind") == WORDS).groupBy("part").applyInPandas(number_words(parts), ROW), "katz-words")

    total = kinds = 0
    n_r = np.zeros(RANKS + 1, dtype=np.int64)
    for r in words.filter(F.col("kind") == STATS).select("data").collect():  # one row a part
        s, ranks = unpack(bytes(r["data"]))
        total, kinds, n_r = total + int(s[0]), kinds + int(s[1]), n_r + ranks
    d1 = discounts(n_r)
    left = float((n_r[:RANKS] * np.arange(1, RANKS + 1) * (1 - d1)).sum()) / total if total else 1.0
    if total and left <= 0:  # no rare word at all: as for a history
        left = EPS / (total + EPS)
    often = words.filter(F.col("kind") == TOP).select("data").mapInPandas(over(total / (4 * parts)), "number long").collect() if total else []  # at most 4 * parts
    often = np.array(sorted(r["number"] for r in often), dtype=np.uint64)
    often = np.r_[often, np.uint64(1)] if starts > total / (4 * parts) else often
    norm = total if left > EPS / (total + EPS) or not total else total + EPS

    met = blocks.filter(F.col("kind") == TOKENS).unionByName(words.filter(F.col("kind") == WORDS)).groupBy("block").applyInPandas(ask(parts, total, norm, kinds, starts, d1, left, often), ROW)
    met = met.select("block", F.when(F.col("kind") == PAIRS, F.col("part")).otherwise(-1 - F.pmod("block", F.lit(parts))).cast("int").alias("part"), "kind", "data")

    def route(group: pd.DataFrame) -> pd.DataFrame:
        return group[["block", "part", "kind", "data"]] if group["part"].iloc[0] < 0 else answer(norm, d1, left, often)(group)

    found = written(met.groupBy("part").applyInPandas(route, ROW), "katz-sums")
    n_r2, hot = np.zeros(RANKS + 1, dtype=np.int64), {}
    for r in found.filter(F.col("kind").isin(STATS, HOT)).select("kind", "data").collect():  # a row or two a part
        if r["kind"] == STATS:
            n_r2 += unpack(bytes(r["data"]))[0]
        else:
            h, below, *ranks = unpack(bytes(r["data"]))
            for i, x in enumerate(h):
                b, k = hot.get(int(x), (0.0, np.zeros(RANKS)))
                hot[int(x)] = (b + below[i], k + np.array([q[i] for q in ranks], dtype=np.float64))
    out = found.filter(F.col("kind").isin(DOCS, SUMS)).groupBy("block").applyInPandas(total_up(discounts(n_r2), hot), RESULT)
    return out.withColumn("train_tokens", F.lit(total).cast("long"))
