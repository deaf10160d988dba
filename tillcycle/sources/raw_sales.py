"""Raw invoice-line CSV -> cleaned fact table -> curated Parquet (SC1-SC4, PR1-PR8)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcycle.sources.stored import VersionedTable
from tillcycle.sources.tables import FACT_COLUMNS

# The raw header names of the retail CSV and their snake-case
# renames (the five fused names), as the cleaned table expects them.
RAW_COLUMNS = ["InvoiceNo", "StockCode", "Description", "Quantity",
               "InvoiceDate", "UnitPrice", "CustomerID", "Country"]
FUSED_RENAMES = {"invoiceno": "invoice_no", "stockcode": "stock_code",
                 "invoicedate": "invoice_date", "unitprice": "unit_price",
                 "customerid": "customer_id"}

# Accepted timestamp layouts, tried in order (month-first like the source data).
TIMESTAMP_FORMATS = ["M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss",
                     "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd",
                     "M/d/yyyy"]

# A sliced refresh: lines of a slice and of a task, and the number of slices, each of
# which reads the source tables again.
SLICE_LINES, LINES_PER_TASK, MAX_SLICES = 4_000_000, 500_000, 6


def read_raw_sales(spark: SparkSession, path: str) -> DataFrame:
    """SC1: header CSV in latin-1, every column read as a string (no inference
    pass over the data, so the read is a single parallel scan)."""
    hdr = spark.read.option("header", True).option("encoding", "ISO-8859-1") \
        .option("enforceSchema", False).csv(path).columns  # header only, no data job
    schema = T.StructType([T.StructField(c, T.StringType()) for c in hdr])
    return (spark.read.option("header", True).option("encoding", "ISO-8859-1")
            .option("mode", "PERMISSIVE").schema(schema).csv(path))


def normalise_columns(df: DataFrame) -> DataFrame:
    """PR1 + PR2: strip / lower / space->underscore, then the fused renames."""
    names = [re.sub(" ", "_", c.strip().lower()) for c in df.columns]
    names = [FUSED_RENAMES.get(n, n) for n in names]
    return df.toDF(*names)


def parse_timestamp(col: str):
    """PR3: first format that parses wins; NULL when none does."""
    s = F.trim(F.col(col))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in TIMESTAMP_FORMATS]) \
        .cast("timestamp_ntz")


def clean_sales(raw: DataFrame) -> DataFrame:
    """PR1-PR8 on a raw frame; adds ``_bad_date`` for the quarantine split."""
    df = normalise_columns(raw)
    qty_d = F.trim(F.col("quantity")).try_cast("double")
    price = F.coalesce(F.trim(F.col("unit_price")).try_cast("double"), F.lit(0.0))
    qty = F.coalesce(F.coalesce(qty_d, F.lit(0.0)).try_cast("int"), F.lit(0))
    out = df.select(
        F.col("invoice_no").cast("string").alias("invoice_no"),
        parse_timestamp("invoice_date").alias("invoice_date"),
        F.trim(F.col("stock_code").cast("string")).alias("stock_code"),
        F.trim(F.coalesce(F.col("description"), F.lit(""))).alias("description"),
        qty.alias("quantity"),
        price.alias("unit_price"),
        F.coalesce(F.col("customer_id").cast("string"), F.lit("UNKNOWN")).alias("customer_id"),
        F.col("country").cast("string").alias("country"),
        F.col("invoice_date").alias("_raw_invoice_date"),
    )
    out = out.withColumn("revenue", F.col("quantity") * F.col("unit_price"))
    return out.withColumn("_bad_date", F.col("invoice_date").isNull())


def curated(df: DataFrame, partitions: int = 64) -> DataFrame:
    """The rows of the curated table as they are written, partitioned by invoice month
    so period filters prune whole directories.

    Rows are range-partitioned on invoice_date first: each task then holds
    one contiguous time slice and writes into one or two month directories,
    so the file count stays ~ tasks + months (not tasks x months) and every
    file's min/max statistics cover a narrow date range.  ``partitions``
    bounds the tasks (AQE merges small ones): set it to the input's size over
    what a task should hold.
    """
    return (df.select(*FACT_COLUMNS).repartitionByRange(partitions, "invoice_date")
            .withColumn("invoice_month", F.date_format("invoice_date", "yyyy-MM")))


def write_curated(df: DataFrame, path: str, mode: str = "overwrite",
                  partitions: int = 64) -> None:
    """SC2: the curated table as a plain folder, replaced in place."""
    curated(df, partitions).write.mode(mode).partitionBy("invoice_month").parquet(path)


def date_slices(df: DataFrame, dates: DataFrame, lines: int, most: int) -> tuple[list[DataFrame], int]:
    """``df`` in slices that follow one another by day, and the number of lines in ``dates``.

    ``dates``, any frame with an invoice_date, decides the slices' sizes, not their rows: every row
    is in one slice, those without a date in the first.  A slice has about ``lines`` lines, or more
    where that would take over ``most`` slices; a day is not cut.  The driver gets one row per day.
    """
    day, at = F.to_date("invoice_date"), F.col("invoice_date")
    days = dates.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy("day") \
        .select(F.col("day").cast("string"), "n").collect()           # no day comes first
    total, cuts, held = sum(r.n for r in days), [], 0
    k = min(most, -(-total // lines))
    for r in days:
        if r.day is not None and held and held * k >= total:
            cuts.append(F.lit(r.day).cast("timestamp_ntz"))
            held = 0
        held += r.n
    if not cuts:
        return [df], total
    within = [at.isNull() | (at < cuts[0]), *[(at >= a) & (at < b) for a, b in zip(cuts, cuts[1:])], at >= cuts[-1]]
    return [df.where(w) for w in within], total


def refresh_curated(table: VersionedTable, df: DataFrame, partitions: int = 64, dates: DataFrame | None = None) -> int:
    """SC4: full refresh of the curated table; readers see the old one until it is whole.

    With ``dates`` (see `date_slices`) the rows are derived and written slice by slice, so that the
    disk holds the shuffles of one slice at a time, and tasks follow the lines (``partitions`` at least).
    """
    if dates is None:
        return table.refresh(curated(df, partitions), ("invoice_month",))
    slices, lines = date_slices(df, dates, SLICE_LINES, MAX_SLICES)
    tasks = -(-max(partitions, -(-lines // LINES_PER_TASK)) // len(slices))
    return table.refresh((curated(s, tasks) for s in slices), ("invoice_month",))


def read_facts(spark: SparkSession, path: str | VersionedTable) -> DataFrame:
    """SC3: the explicit 9-column projection over the curated table."""
    rows = path.read() if isinstance(path, VersionedTable) else spark.read.parquet(path)
    return rows.select(*FACT_COLUMNS)


def ingest(spark: SparkSession, csv_path: str, out_path: str,
           quarantine_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SC1-SC4: read, clean, split off unparseable dates, write, re-read.

    Returns (facts, quarantine).  The reference raises on an unparseable
    date; here such lines go to the quarantine output instead.
    """
    cleaned = clean_sales(read_raw_sales(spark, csv_path))
    good = cleaned.where(~F.col("_bad_date"))
    bad = cleaned.where(F.col("_bad_date")).drop("_bad_date")
    write_curated(good, out_path)
    if quarantine_path:
        bad.write.mode("overwrite").parquet(quarantine_path)
        bad = spark.read.parquet(quarantine_path)
    return read_facts(spark, out_path), bad
