"""Structured Streaming twins of tumbling statistics (W2, A2), interaction counts (A5), first occurrences (S5) and idempotent inserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.tables import append_new


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def tumbling_counts(stream: DataFrame, at: str, kind: str, value: str, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Rows and mean value by window and type; what is later than ``late`` is dropped, so state is bounded."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value")).select(F.col("window.start").alias("win_start"), kind, "n", "avg_value")


def hopping_counts(stream: DataFrame, at: str, keys: Sequence[str], width: str = "6 days", stride: str = "3 days", late: str = "1 day") -> DataFrame:
    """Rows by overlapping window and keys."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width, stride), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("win_start"), *keys, "n")


def interaction_counts(stream: DataFrame, at: str, width: str = "7 days", late: str = "1 day", kinds: Sequence[str] = ("r", "t", "q")) -> DataFrame:
    """Edges by window: counts by kind of each (src, trg)."""
    rows = stream.withWatermark(at, late).groupBy(F.window(at, width), "src", "trg")
    return rows.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("a")).select(F.col("window.start").alias("win_start"), "src", "trg", *kinds, "a")


def first_occurrences(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """A row of each key, the first that arrives; a key is remembered until the watermark has passed it, so that state is bounded.

    Rows of one key that are further apart than ``late`` are two occurrences."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def appended(stream: DataFrame, out: str, key: str, checkpoint: str) -> StreamingQuery:
    """Inserts the rows whose key the table doesn't have, one for each key, batch by batch, over what there is.

    A batch that is run again, after a failure or from a new checkpoint, finds its keys in the table and adds nothing."""
    insert = lambda batch, _: append_new(batch, out, key)
    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_parquet(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """An exactly-once sink, run over what there is."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
