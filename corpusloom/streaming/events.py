"""Event-time operators: the same functions on a stream and on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    df = events.withWatermark("ts", late) if events.isStreaming else events
    w = df.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    df = events.withWatermark("ts", late) if events.isStreaming else events
    s = df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


#: Order of an answer's events (fixed value).
PROTOCOL = r"^language (refused |stage sources stage (token )*(safety )?|stage refused )done $"


def follows_protocol(frames: DataFrame) -> DataFrame:
    """answer_id, valid: its events (answer_id, seq, event) come in the order of the protocol."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event"))), lambda x: F.concat(x["event"], F.lit(" "))), "")
    return frames.groupBy("answer_id").agg(F.rlike(names, F.lit(PROTOCOL)).alias("valid"))


def run_to_end(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """A stream's result over all its input so far, as a table in ``path``."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")


def answered_to_end(queries: DataFrame, answer, path: str, trigger: dict | None = None) -> DataFrame:
    """A stream of queries through a batch operator such as a search of an index, each micro-batch as a whole.

    ``answer``: a function of a batch. A batch's rows lie in a folder of its number and are written over
    if it is run again, so each query is answered once whatever is lost on the way.
    """

    def each(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = queries.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return queries.sparkSession.read.parquet(f"{path}/out").drop("batch")
