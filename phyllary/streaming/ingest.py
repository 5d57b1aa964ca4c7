"""Records that keep arriving: identity keys, redeliveries dropped, counts by source, merged tables kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phyllary.operators.identity import identity_key, with_codes
from phyllary.operators.merge import merged_records


def read_arrivals(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def keyed(arrivals: DataFrame) -> DataFrame:
    """arrivals with physical_key and codes dropped again; the same for streams and tables."""
    return with_codes(arrivals).withColumn("physical_key", identity_key()).drop("__cat", "__holder", "__sid", "__src")


def without_redeliveries(arrivals: DataFrame, time: str = "ingested_at", late: str = "2 days") -> DataFrame:
    """The first delivery of each source's record of a specimen; a redelivery counts as one if it comes within the watermark. State is
    kept no longer than that."""
    return keyed(arrivals).withWatermark(time, late).dropDuplicatesWithinWatermark(["physical_key", "source", "source_record_id"])


def arrivals_by_source(arrivals: DataFrame, time: str = "ingested_at", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """How many records each source delivered in each window; a window is final when the watermark has passed it."""
    counts = arrivals.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "source").agg(F.count("*").alias("records"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "source", "records")


def sink(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there, once, into Parquet; the checkpoint folder remembers what is done, so a restart goes on from there."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def keep_merged(arrivals: DataFrame, store: str, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """A table of merged specimens that follows the stream.

    Every batch adds its records to <store>/records (in a folder of its own, so a batch that is run again replaces itself), then merges
    anew and writes <store>/merged as the version of the batch; the newest version is the table.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{store}/records/batch={number}")
        merged_records(spark.read.parquet(f"{store}/records").drop("batch"), order).write.mode("overwrite").parquet(f"{store}/merged/version={number}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
