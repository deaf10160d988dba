"""Data-quality findings over a fact frame (AG8-AG12, SO6).

One aggregate pass computes every null count and both negative counts; the
duplicate-line count is a second, partially aggregated pass over the
(invoice, stock_code) pairs.  Missing columns are a schema check only (no job).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcycle.sources.tables import FACT_COLUMNS


def dq_findings(df: DataFrame, expected: list[str] | None = None,
                key_cols: tuple[str, str] = ("invoice_no", "stock_code"),
                with_rows: bool = False) -> DataFrame:
    """Findings with a positive count: finding_type, column_name, n.

    finding types: missing_columns (column_name = sorted, comma-joined),
    nulls (per column), negative_quantity, negative_unit_price,
    duplicate_invoice_lines (rows minus distinct key pairs: first kept);
    ``with_rows`` adds the number of rows itself (AG8).
    """
    expected = list(expected or FACT_COLUMNS)
    actual = {c.lower(): c for c in df.columns}
    missing = sorted(set(expected) - set(actual))
    present = [c for c in expected if c in actual]

    def finding(kind, column, n):
        return F.struct(F.lit(kind).alias("finding_type"),
                        F.lit(column).cast("string").alias("column_name"),
                        n.cast("long").alias("n"))

    checks = [finding("nulls", c, F.count_if(F.col(actual[c]).isNull())) for c in present]
    if with_rows:
        checks.append(finding("rows", None, F.count(F.lit(1))))
    for col, kind in (("quantity", "negative_quantity"), ("unit_price", "negative_unit_price")):
        if col in actual:
            checks.append(finding(kind, None, F.count_if(F.col(actual[col]) < 0)))
    rows = df.agg(F.array(*checks).alias("c")).select(F.inline("c"))

    if all(k in actual for k in key_cols):
        dups = df.groupBy(*[actual[k] for k in key_cols]).agg(F.count(F.lit(1)).alias("c")) \
            .agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("n")) \
            .select(F.lit("duplicate_invoice_lines").alias("finding_type"),
                    F.lit(None).cast("string").alias("column_name"), "n")
        rows = rows.unionByName(dups)
    if missing:
        spark = df.sparkSession
        miss = spark.createDataFrame(
            [("missing_columns", ",".join(missing), len(missing))],
            "finding_type string, column_name string, n long")
        rows = miss.unionByName(rows)
    return rows.where(F.col("n") > 0)
