"""The ``opN_<name>`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan as S

    found = S.scan_all(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["rank"] < len(S.BASE))
    return found.select("doc_id", *(count(k) for k in S.BASE), F.sha2(S.joined(base), 256).alias("base_sha256"), S.joined(F.col("secrets")).alias("spans"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .similar_join import classes

    return classes(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


#: The rules of the contract: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contained

    found = contained(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"), "containment")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, _table(spark, sf_dir, "labels")))
    return found.drop("text")


def _third(column: str = "doc_id", by: int = 3):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(by))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import predict, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(_third() == 1, F.lit(False)))
    network = train(docs.filter(_third() != 1).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text"), network)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import length_histogram, running

    return running(length_histogram(_table(spark, sf_dir, "documents")))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(_third(by=10) != 0, F.lit(False)).alias("train"))
    held = F.coalesce(_third(by=10) == 0, F.lit(False)).alias("held_out")
    return score(docs).select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import with_edits

    return with_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damage, repair

    return repair(damage(_table(spark, sf_dir, "conversations")), gone="gone")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import encoded_turns, rebuilt, trie

    return trie(*rebuilt(encoded_turns(_table(spark, sf_dir, "conversations"))))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find, spelled

    return find(_table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spelled().alias("spans"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_source_mix, op3_jaccard_join, op4_url_filter, op5_decontamination, op6_toxicity, op7_language_id, op8_token_counts, op9_lm_score, op10_fingerprint, op11_conversation_repair, op12_prefix_trie, op13_pii)}
ORACLES = {
    "op1_secret_scan": oracles.secret_scan(),
    "op3_jaccard_join": oracles.jaccard_join(),
    "op4_url_filter": oracles.url_filter(URL_RULES),
    "op5_decontamination": oracles.decontamination(),
    "op11_conversation_repair": oracles.conversation_repair(),
    "op12_prefix_trie": oracles.prefix_trie(),
}
