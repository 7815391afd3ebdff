"""PII: fixed shapes of personal data, and the terms around them that give them away.

Base kinds (email, ip, card, phone) are fixed shapes, leftmost and non-overlapping each; what fails its check (parts, digits,
Luhn) is dropped. Every base value is a protected entity e, known by its kind and its letters and digits. Terms are runs of letters and digits,
lower-cased. The corpus tells how much a term t anywhere in the texts of e discloses of it:

    IC(e) = -log2 p(e)      PMI(e; t) = log2 (p(e | t) / p(e))      p over documents

PMI reaches IC where t comes with e only, so t exceeds the threshold where PMI >= ``DISCLOSED`` * IC and the pair was seen
in two different surroundings at least (copies of a passage are one; a surrounding is the ``AROUND`` words on either side of e, and one of them counts for a term
further away in the same text). Where a term of that kind stands in a text of e, it is generalised to its class (number, code, word) if the class
itself stays below the threshold for e, else removed.

One pass finds the base spans, their surroundings and all terms of the texts that have any, one row a document; it is stored. Terms are counted in all documents
by counters within the tasks. An entity of a single surrounding discloses nothing and is left aside before it meets terms; of the others, only terms that are
rare enough to reach the threshold at all are paired with it: PMI >= share * IC asks for n(t) <= n(e) * (N / n(e)) ^ (1 - share). Pairs are counted as (entity, term) with partial
sums; those over the threshold go back to their documents, by the row's number.

Edge cases: null text is empty; empty texts have no spans; repeated rows are judged one by one; a null doc_id is kept; texts of any length are read
whole, in time proportional to length; tables without entities give base columns without spans; other columns are left aside by ``find`` and kept by
``sanitised``, but for one named like its results, which is replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .store import forget, written

KINDS = ("email", "ip", "card", "phone", "general", "removed")
AROUND = 8
DISCLOSED = 0.9
#: Distinct terms that a task counts before it hands them on.
COUNTED = 200_000

WORD = re.compile(r"[^\W_]+")
LOCAL_PART, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The other shapes (fixed values); a match can only begin where its run of digits does, which keeps long runs linear.
SHAPES = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
SPAN = "struct<start:int,rank:int,end:int>"
NEAR = "struct<entity:string,term:string,low:long,high:long>"
TERMS = "struct<term:string,at:array<struct<start:int,end:int>>>"


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _ip(s: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in s.split(".")))


def _card(s: str) -> bool:
    d = _digits(s)
    return 14 <= len(d) <= 19 and luhn(d)


CHECKS = {"ip": _ip, "card": _card, "phone": lambda s: 10 <= len(_digits(s)) <= 15}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the email shape: for each @ the longest run before it and the domain after it."""
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and LOCAL_PART.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            after = m.end()
        at = text.find("@", max(at + 1, after))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), in order."""
    found = [(s, 0, e) for s, e in emails(text)]
    for kind, shape in SHAPES.items():
        found += [(m.start(), KINDS.index(kind), m.end()) for m in shape.finditer(text) if CHECKS[kind](m[0])]
    return sorted(found)


def entity(rank: int, value: str) -> str:
    return f"{KINDS[rank]} {value.lower() if rank == 0 else _digits(value) if rank != 1 else value}"


def term_class(term: str) -> str:
    return "<number>" if term.isdecimal() else "<word>" if term.isalpha() else "<code>"


def _before(text: str, start: int) -> list[tuple[int, int]]:
    """Places of the last words before ``start``."""
    size = 32 * AROUND
    while True:
        low = max(0, start - size)
        found = [(m.start(), m.end()) for m in WORD.finditer(text, low, start)]
        if low and found and found[0][0] == low:
            found = found[1:]  # may begin earlier
        if len(found) >= AROUND or not low:
            return found[-AROUND:]
        size *= 4


def _after(text: str, end: int) -> list[tuple[int, int]]:
    found = []
    for m in WORD.finditer(text, end):
        found.append((m.start(), m.end()))
        if len(found) == AROUND:
            break
    return found


def _free(spans: list[tuple[int, int, int]]):
    """Whether a stretch meets no span."""
    covered: list[list[int]] = []
    for s, _, e in spans:
        if covered and s < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    begins = [c[0] for c in covered]

    def free(s: int, e: int) -> bool:
        i = bisect_right(begins, e - 1) - 1
        return i < 0 or covered[i][1] <= s

    return free


def near_terms(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Entities, and the terms within the surroundings of each; ``low`` and ``high``: least and greatest hash of the pair's surroundings in this text."""
    free = _free(spans)
    hashes: dict[tuple[str, str], set] = {}
    for s, rank, e in spans:
        words = [(a, b) for a, b in _before(text, s) + _after(text, e) if free(a, b)]
        terms = [text[a:b].lower() for a, b in words]
        h = int.from_bytes(hashlib.blake2b("\n".join(terms).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
        who = entity(rank, text[s:e])
        hashes.setdefault((who, ""), set()).add(h)  # the entity by itself
        for t in terms:
            for key in ((who, t), (who, term_class(t))):
                hashes.setdefault(key, set()).add(h)
    return [{"entity": who, "term": t, "low": min(hs), "high": max(hs)} for (who, t), hs in hashes.items()]


def all_terms(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Terms of the whole text but those inside of a base span, with their places; classes have none."""
    free = _free(spans)
    places: dict[str, list] = {}
    for m in WORD.finditer(text):
        if free(m.start(), m.end()):
            t = m[0].lower()
            places.setdefault(t, []).append({"start": m.start(), "end": m.end()})
    return [{"term": t, "at": at} for t, at in places.items()] + [{"term": c, "at": []} for c in {term_class(t) for t in places}]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[r]}:{s}:{e}" for s, r, e in spans)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        rows = []
        for text in texts:
            text = text or ""
            spans = base_spans(text)
            counts = Counter(r for _, r, _ in spans)
            rows.append({"digest": hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), **{f"n_{k}": counts[i] for i, k in enumerate(KINDS[:4])}, "base": [{"start": s, "rank": r, "end": e} for s, r, e in spans], "base_sha256": hashlib.sha256(joined(spans).encode()).hexdigest(), "near": near_terms(text, spans) if spans else [], "terms": all_terms(text, spans) if spans else []})
        span = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
        near = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("low", pa.int64()), ("high", pa.int64())]))
        terms = pa.list_(pa.struct([("term", pa.string()), ("at", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))
        col = lambda name, kind: pa.array([r[name] for r in rows], kind)
        yield pa.RecordBatch.from_arrays([ids, col("digest", pa.binary()), *(col(f"n_{k}", pa.int64()) for k in KINDS[:4]), col("base", span), col("base_sha256", pa.string()), col("near", near), col("terms", terms)], names=["id", "digest", *(f"n_{k}" for k in KINDS[:4]), "base", "base_sha256", "near", "terms"])


def _terms(text: str) -> set[str]:
    """Distinct terms and their classes, over slices of long texts that end between words."""
    found: set[str] = set()
    at, size = 0, 1 << 20
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            while end < len(text) and WORD.match(text, end):
                end = WORD.match(text, end).end()
        found.update(WORD.findall(text, at, end))
        at = end
    terms = {t.lower() for t in found}
    return terms | {term_class(t) for t in terms}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64())], names=["term", "n"])
        docs.clear()
        return made

    for batch in batches:
        for text in batch.column(0).to_pylist():
            docs.update(_terms(text or ""))
            if len(docs) >= COUNTED:
                yield out()
    if docs:
        yield out()


def document_counts(documents: DataFrame) -> DataFrame:
    """(term, n): documents that hold a term, classes included, over all documents."""
    ship(documents.sparkSession)
    return documents.select("text").mapInArrow(_counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosures(pairs: DataFrame, counts: DataFrame, documents: int, share: float = DISCLOSED) -> DataFrame:
    """(entity, term, kind) over the threshold. ``pairs``: a row for each document, entity and term of its text, term '' for the entity itself."""
    seen = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"), (F.min("low") != F.max("high")).alias("twice"))
    alone = seen.filter("term = ''").select("entity", F.col("both").alias("n_entity"))
    rated = seen.filter("term != '' AND twice").join(alone, "entity").join(counts, "term")
    p = F.col("n_entity") / F.lit(float(max(1, documents)))
    pmi, ic = F.log2(F.col("both") / F.col("n") / p), -F.log2(p)
    over = written(rated.filter((ic > 0) & (pmi >= share * ic)).select("entity", "term"), "pii-over")
    of = F.when(F.col("term").rlike(r"^\p{Nd}+$"), "<number>").when(F.col("term").rlike(r"^\p{L}+$"), "<word>").otherwise("<code>")
    classes = over.filter(F.col("term").startswith("<")).select("entity", F.col("term").alias("class"), F.lit(True).alias("too"))
    terms = over.filter(~F.col("term").startswith("<")).withColumn("class", of)
    return terms.join(classes, ["entity", "class"], "left").select("entity", "term", F.when(F.col("too"), "removed").otherwise("general").alias("kind"))


def find(documents: DataFrame, id: str = "doc_id", text: str = "text", share: float = DISCLOSED) -> DataFrame:
    """(``id``, digest, n_email, n_ip, n_card, n_phone, base_sha256, found): ``found`` has all spans as (start, rank, end), in order."""
    ship(documents.sparkSession)
    kind = documents.schema[id].dataType.simpleString()
    docs = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS[:4])
    made = written(docs.mapInArrow(_found, f"id {kind}, digest binary, {counts}, base array<{SPAN}>, base_sha256 string, near array<{NEAR}>, terms array<{TERMS}>").withColumn("row", F.monotonically_increasing_id()), "pii-found")
    size, held = max(1, made.count()), written(document_counts(docs), "pii-terms")
    near = made.filter(F.size("near") > 0).select("row", F.inline("near"))
    seen = near.filter("term = ''").groupBy("entity").agg(F.count(F.lit(1)).alias("ne"), F.min("low").alias("a"), F.max("high").alias("z")).filter("a <> z")
    most = F.col("ne") * F.pow(F.lit(float(size)) / F.col("ne"), F.lit(1 - share)) * (1 + 1e-9)
    known = written(near.filter("term = ''").join(seen.select("entity", most.alias("most")), "entity").select("row", "entity", "low", "high", "most"), "pii-known")
    bound = known.groupBy("row").agg(F.max("most").alias("bound"))
    terms = made.filter(F.size("terms") > 0).join(bound, "row").select("row", "bound", F.inline("terms"))
    rare = written(terms.join(held, "term").filter(F.col("n") <= F.col("bound")).select("row", "term", "n", "at"), "pii-rare")
    far = known.join(rare.select("row", "term", "n"), "row").filter(F.col("n") <= F.col("most")).select("row", "entity", "term", F.col("low").alias("far"))
    close = near.filter("term <> ''").join(known.select("entity").distinct(), "entity").select("row", "entity", "term", "low", "high")
    met = far.join(close, ["row", "entity", "term"], "left").select("row", "entity", "term", F.coalesce("low", "far").alias("low"), F.coalesce("high", "far").alias("high"))
    pairs = met.unionByName(known.select("row", "entity", F.lit("").alias("term"), "low", "high"))
    over = written(disclosures(pairs, held, size, share), "pii-disclosures")
    rank = F.when(F.col("kind") == "general", KINDS.index("general")).otherwise(KINDS.index("removed"))
    ranked = known.join(over, "entity").groupBy("row", "term").agg(F.max(rank).alias("rank"))
    told = rare.join(ranked, ["row", "term"]).select("rank", "row", F.inline("at"))
    spans = told.groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("more"))  # of one text
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))))
    return made.join(spans, "row", "left").select(F.col("id").alias(id), "digest", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", every.alias("found"))


def spelled(found: str = "found") -> F.Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` without its spans: base values and generalised terms by a mark, removed ones by nothing; of spans that overlap, the first counts and hides them all."""
    out, at = [], 0
    for s, r, e in spans:
        if s >= at:
            out.append(text[at:s])
            word = text[s:e].lower()
            out.append("" if KINDS[r] == "removed" else f"[{term_class(word).strip('<>').upper()}]" if KINDS[r] == "general" else f"[{KINDS[r].upper()}]")
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitised(documents: DataFrame, id: str = "doc_id", text: str = "text", share: float = DISCLOSED) -> DataFrame:
    """``documents`` with ``text`` sanitised; equal texts are sanitised alike."""
    found = find(documents, id, text, share).filter(F.size("found") > 0).groupBy("digest").agg(F.first("found").alias("found"))
    names = documents.columns
    keyed = documents.withColumn("__digest", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    both = keyed.join(found.select(F.col("digest").alias("__digest"), F.col("found").alias("__found")), "__digest", "left")
    schema = both.select(*names).schema

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None or not f else masked(t, [(x["start"], x["rank"], x["end"]) for x in f]) for t, f in zip(b.column(text).to_pylist(), b.column("__found").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(text).type) if n == text else b.column(n) for n in names], names=names)

    return both.select(*names, "__found").mapInArrow(mask, schema)
