"""Hits that keep arriving: searches on a stream of records, and counts by time window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..session import shared_dir
from ..tables import table


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    batch = table(spark, sf_dir, name)
    files = batch.inputFiles()
    single = len(files) == 1 and files[0].rstrip("/").endswith(f"/{name}.parquet")
    reader = spark.readStream.schema(batch.schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else reader.parquet(f"{sf_dir}/{name}.parquet")


def windowed_counts(hits: DataFrame, every: str = "1 day", late: str = "60 days") -> DataFrame:
    """(window_start, strand, hits) of hits with a time, by tumbling windows of ``scanned_at``; hits later than ``late`` are dropped on a stream."""
    timed = hits.where(F.col("scanned_at").isNotNull()).withWatermark("scanned_at", late)
    counts = timed.groupBy(F.window("scanned_at", every).alias("_w"), F.coalesce("strand", F.lit(".")).alias("strand")).agg(F.count(F.lit(1)).alias("hits"))
    return counts.select(F.col("_w.start").alias("window_start"), "strand", "hits")


def run_to_table(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream over all there is; of each key the row of the last batch.

    Batches are written under the folder the cluster shares, with their number, so a batch that is repeated after a
    failure replaces itself.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    started.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/rows")
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("batch").desc()))
    return rows.withColumn("_last", last).where(F.col("_last") == 1).drop("_last", "batch")
