"""The two incremental behaviours: merged partial counts and skipping what was captured before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_url_key(pages: DataFrame) -> DataFrame:
    """The url without its query part identifies a page."""
    return pages.withColumn("url_key", F.split("url", r"\?")[0])


def skip_captured(pages: DataFrame, captured: DataFrame) -> DataFrame:
    """Batch: pages whose key is not in the sink yet."""
    return with_url_key(pages).join(with_url_key(captured).select("url_key").distinct(), "url_key", "left_anti")


def stream_new_pages(pages: DataFrame, seen_at: str, horizon: str) -> DataFrame:
    """Stream: the first page per key; a key is remembered for `horizon` of event time."""
    return with_url_key(pages).withWatermark(seen_at, horizon).dropDuplicatesWithinWatermark(["url_key"])


def capture_new_pages(pages: DataFrame, path: str, checkpoint: str, seen_at: str) -> StreamingQuery:
    """Stream: append to the folder `path` the first page of each key it does not hold yet, however long ago it was captured.

    The folder itself is what is remembered, so neither late rows nor a restart, with the checkpoint or without it, bring
    a key twice, and no state grows in memory. A trigger that is repeated skips what it had written before. Of the rows
    of a key in one trigger the earliest stays, ties by the other columns. One query writes a folder at a time.
    """
    keyed = with_url_key(pages)
    spark, others = pages.sparkSession, [c for c in keyed.columns if c not in ("url_key", seen_at)]
    spark.createDataFrame([], keyed.schema).write.mode("ignore").parquet(path)

    def keep(batch: DataFrame, epoch: int) -> None:
        earliest = F.min(F.struct(F.col(seen_at).isNull().alias("_none"), seen_at, *others)).alias("_row")
        first = batch.filter("url_key IS NOT NULL").groupBy("url_key").agg(earliest)
        captured = batch.sparkSession.read.schema(keyed.schema).parquet(path).select("url_key")
        rows = first.join(captured, "url_key", "left_anti").select("url_key", "_row.*").select(*keyed.columns)
        rows.write.mode("append").parquet(path)

    return keyed.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts; each trigger merges its partial counts into the state store."""
    return rows.groupBy(*keys).count()


def keep_latest_counts(counts: DataFrame, checkpoint: str, path: str, output_mode: str = "complete") -> StreamingQuery:
    """Write every new total, so that the folder holds the counts over all input so far."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (
        counts.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(write)
        .trigger(availableNow=True).start()
    )
