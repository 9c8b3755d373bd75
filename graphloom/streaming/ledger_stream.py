"""A version log as a stream: new versions are appended to the ledger batch by batch, and late events are counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.ledger import append, changed_versions


def append_stream(events: DataFrame, path: str, checkpoint: str, key: str, order: list[str], signature: str) -> StreamingQuery:
    """Appends the changed versions of each micro-batch to the ledger folder; a batch that is run again writes nothing twice, since its id is stored with the rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) and not spark.read.parquet(path).where(F.col("batch") == batch_id).isEmpty():
            return
        append(changed_versions(batch, key, order, signature).withColumn("batch", F.lit(batch_id)).withColumn("entry_type", F.lit("object")), path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """(window_start, kind, n) of a stream or a table; a stream drops what comes later than the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")
