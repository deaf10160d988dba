"""Incremental ingest of raw invoice-line CSV files with Structured Streaming.

The same cleaning as the batch ingest (SC1-SC4, PR1-PR8), applied to files
as they land in a folder.  Each micro-batch writes its cleaned lines to the
curated table (by batch and month) and unparseable lines to a quarantine
table, replacing what a failed attempt of the same batch left; progress is
kept beside the curated table, so a restarted query resumes without
re-reading files.  ``availableNow`` processes what is there and stops.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcycle.sources.raw_sales import RAW_COLUMNS, clean_sales
from tillcycle.sources.tables import FACT_COLUMNS


def raw_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
    return (spark.readStream.option("header", True).option("encoding", "ISO-8859-1")
            .option("maxFilesPerTrigger", max_files).schema(schema).csv(folder))


def batch_writer(curated: str, quarantine: str):
    """Writes a micro-batch into a folder of its own per batch id, replacing
    it: a batch that is retried after a failure leaves no second copy.  The
    batch is cleaned once for both tables."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        cleaned = clean_sales(batch).persist()
        try:
            (cleaned.where(~F.col("_bad_date")).select(*FACT_COLUMNS)
             .withColumn("invoice_month", F.date_format("invoice_date", "yyyy-MM"))
             .write.mode("overwrite").partitionBy("invoice_month").parquet(f"{curated}/batch_id={batch_id}"))
            (cleaned.where(F.col("_bad_date")).drop("_bad_date")
             .write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}"))
        finally:
            cleaned.unpersist()
    return write_batch


def start_ingest(spark: SparkSession, folder: str, curated: str, quarantine: str,
                 name: str = "raw_sales_ingest", available_now: bool = True,
                 progress: str | None = None):
    """Start the streaming ingest; returns the StreamingQuery.  Progress is
    kept in ``progress`` (beside the curated table by default), so that a
    restart in a new session goes on where the last one stopped."""
    ckpt = os.path.join(progress or curated.rstrip("/") + "_progress", name)
    w = raw_stream(spark, folder).writeStream.foreachBatch(batch_writer(curated, quarantine)) \
        .option("checkpointLocation", ckpt).queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
