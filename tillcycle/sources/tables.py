"""Readers for the star-schema test tables and the ``fact_sales`` view over them.

Mapping (one invoice line per order line):

    invoice_no  = l_orderkey          invoice_date = l_shipdate
    stock_code  = l_partkey           description  = p_name
    quantity    = -l_quantity for return-flag 'R', else l_quantity
    unit_price  = l_extendedprice / l_quantity
    customer_id = o_custkey           country      = n_name
    revenue     = quantity * unit_price

Scale notes.  lineitem is the fact; orders is the only other table that
grows at the same rate, so lineitem->orders is a shuffle (sort-merge) join
on the order key, which AQE may still demote.  part and customer grow with
the scale factor too and are joined the same way, customer to the orders, of
which there are fewer than lines; only ``nation`` (25 rows, fixed by the
schema) is broadcast.  Every dimension key is a foreign key
that always resolves (the generator guarantees referential integrity), so a
dimension join neither drops nor multiplies lines; therefore a dimension is
joined only when the caller asks for one of its columns.  A KPI that reads
``revenue`` and ``customer_id`` never pays for the part or nation joins.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACT_COLUMNS = ["invoice_no", "invoice_date", "stock_code", "description",
                "quantity", "unit_price", "customer_id", "country", "revenue"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fact_sales(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, *,
               part_attrs: dict[str, str] | None = None,
               where: Column | None = None, only: DataFrame | None = None,
               lines_per_task: int | None = None) -> DataFrame:
    """The ``fact_sales`` relation built from the source tables, with the
    ``columns`` asked for (all nine if none are named).

    The columns decide the joins: orders is joined for customer_id (and
    country), part for description and ``part_attrs`` (part columns under new
    names, e.g. ``{"brand": "p_brand"}``, for a coarser grain), customer and
    nation for country.  ``where`` is a predicate over lineitem columns applied
    at the scan (pushed down).  ``only`` is a frame of at most a few stock_codes
    (a top-k result): lines of other codes go before any dimension is joined.
    ``lines_per_task`` sizes the orders join by the lines (counted from the
    files' footers), so that a task sorts no more of them on larger tables.
    """
    wanted = list(columns or FACT_COLUMNS)
    description, country = "description" in wanted, "country" in wanted
    customer = "customer_id" in wanted
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_shipdate")
    if where is not None:
        li = li.where(where)
    if only is not None:
        keys = F.broadcast(only.select(F.col("stock_code").alias("_only")))
        li = li.join(keys, li.l_partkey.cast("string") == F.col("_only"), "left_semi")
    if customer or country:
        orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        if country:   # joined to the orders, so that the lines are not dealt by customer as well
            cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
            orders = orders.join(cust, orders.o_custkey == cust.c_custkey).drop("c_custkey")
        if lines_per_task:
            tasks = max(1, -(-li.count() // lines_per_task))
            li, orders = li.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
        df = li.join(orders, li.l_orderkey == orders.o_orderkey)
    else:
        df = li

    part_cols: dict[str, str] = {}
    if description:
        part_cols["description"] = "p_name"
    part_cols.update(part_attrs or {})
    if part_cols:
        part = read_table(spark, sf_dir, "part").select(
            "p_partkey", *[F.col(src).alias(dst) for dst, src in part_cols.items()])
        df = df.join(part, df.l_partkey == part.p_partkey)

    if country:
        nation = read_table(spark, sf_dir, "nation").select(
            "n_nationkey", F.col("n_name").alias("country"))
        # nation has 25 rows by construction: a fixed-size broadcast.
        df = df.join(F.broadcast(nation), df.c_nationkey == nation.n_nationkey)

    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")) \
        .otherwise(F.col("l_quantity")).cast("int")
    cols = [
        F.col("l_orderkey").cast("string").alias("invoice_no"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("invoice_date"),
        F.col("l_partkey").cast("string").alias("stock_code"),
    ]
    if description:
        cols.append(F.col("description"))
    cols += [
        qty.alias("quantity"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
    ]
    if customer or country:
        cols.append(F.col("o_custkey").cast("string").alias("customer_id"))
    if country:
        cols.append(F.col("country"))
    cols += [F.col(c) for c in (part_attrs or {})]
    out = df.select(*cols).withColumn("revenue", F.col("quantity") * F.col("unit_price"))
    return out.select(*wanted, *(part_attrs or {}))


FACT_SALES_SQL = """
fact_sales AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS invoice_no,
         CAST(l.l_shipdate AS TIMESTAMP) AS invoice_date,
         CAST(l.l_partkey AS VARCHAR) AS stock_code,
         p.p_name AS description,
         p.p_brand AS brand,
         CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS INTEGER) AS quantity,
         l.l_extendedprice / l.l_quantity AS unit_price,
         CAST(o.o_custkey AS VARCHAR) AS customer_id,
         n.n_name AS country,
         CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS INTEGER)
           * (l.l_extendedprice / l.l_quantity) AS revenue
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""
