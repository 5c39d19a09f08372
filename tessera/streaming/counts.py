"""Incremental counts over streams: windowed event counts with late data, and term counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.tokenizers import tokenize
from tessera.session import scratch


def windowed_counts(stream: DataFrame, time: str, group: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """``start, group, n``: events by time window. In append mode (``write_available``) a window comes out once it is closed, and events later than ``late`` behind the newest
    are dropped; in complete mode (``run_available``) every window is kept and no event is too late."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), group, "n")


def term_counts(stream: DataFrame, text: str = "text", rule: str = "alpha3") -> DataFrame:
    """``form, freq`` of all texts seen so far."""
    return stream.select(F.explode(tokenize(F.col(text), rule)).alias("form")).groupBy("form").agg(F.count("*").alias("freq"))


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process what is there and stop. Each batch's result goes to a folder of its own below the shared one; the last one is read back, so nothing passes through the driver."""
    spark, path, last = stream.sparkSession, scratch(stream.sparkSession, "stream"), [-1]

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result/{number}")
        last[0] = number

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/result/{last[0]}") if last[0] >= 0 else spark.createDataFrame([], stream.schema)


def write_available(stream: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and append finished windows to Parquet at ``path``."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "stream")).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
