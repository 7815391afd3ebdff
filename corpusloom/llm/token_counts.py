"""Token counts: the exact histogram of encoded lengths.

Every whole text is encoded once with a public byte-level BPE vocabulary (its path
is a parameter, the file goes to the executors with the job); documents are counted
by encoded length, the histogram is stored, and sums along the
histogram answer totals, quantiles and truncated totals for every context
limit without another look at a text.

Edge cases: a null or empty text has 0 tokens; special-token strings in a text
are ordinary text; an empty table gives an empty histogram; repeated rows count
each; other columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .store import written

#: The split pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths of one block of the running sums.
BLOCK = 1024
_loaded: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str, pattern: str = PATTERN):
    """One encoder a worker process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def length_histogram(documents: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length (stored)."""
    path = vocabulary or default_vocabulary()
    ship(documents.sparkSession)
    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(SparkFiles.get(name))
        seen: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                seen[len(encode.encode_ordinary(t)) if t else 0] += 1
        if seen:
            yield pd.DataFrame({"n_tokens": list(seen), "n_docs": list(seen.values())})

    part = documents.select(F.col(text).alias("text")).mapInPandas(count, "n_tokens long, n_docs long")
    return written(part.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "token-histogram")


def running(histogram: DataFrame) -> DataFrame:
    """The histogram with sums along it; a row answers every limit from its length up to the next row's.

    docs_longer: documents over the limit; tokens_to: tokens of those within it;
    truncated_total: tokens left when every document is cut at n_tokens;
    quantile: share of documents within it. Sums run within blocks of lengths;
    only one row a block meets in the last step.
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    marked = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = marked.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    before, whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.join(blocks, "block").withColumn("docs_to", F.col("d0") + F.sum("n_docs").over(within)).withColumn("tokens_to", F.col("t0") + F.sum(tokens).over(within))
    rows = rows.withColumn("docs_longer", F.col("total_docs") - F.col("docs_to"))
    return rows.select("n_tokens", "n_docs", "docs_longer", "tokens_to", (F.col("tokens_to") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"), (F.col("docs_to") / F.col("total_docs")).alias("quantile"), "total_docs", "total_tokens")


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``."""
    row = sums.filter(F.col("n_tokens") <= limit).agg(F.max_by(F.struct("tokens_to", "docs_longer"), "n_tokens").alias("r")).first()["r"]
    if row is None:
        first = sums.agg(F.max("total_docs").alias("n")).first()["n"]
        return int(limit * (first or 0))
    return int(row["tokens_to"] + limit * row["docs_longer"])


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that at least a share ``q`` of the documents does not exceed."""
    return sums.filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n")).first()["n"]
