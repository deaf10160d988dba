"""FI1/FI2: as-of visibility and period filters, applied to the relation.

The reference splices ``invoice_date <= as_of`` into SQL text.  Here the
bound is a filter on the fact relation itself, so every query built on the
view sees it, and Catalyst pushes it to the Parquet scan (row-group and,
for the month-partitioned curated table, directory pruning).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcycle.params import as_date


def ts_lit(day, end_of_day: bool = False) -> Column:
    """A timestamp_ntz literal for ``day`` at 00:00 (or the last microsecond)."""
    d = as_date(day)
    t = dt.datetime(d.year, d.month, d.day)
    if end_of_day:
        t = t + dt.timedelta(days=1) - dt.timedelta(microseconds=1)
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def as_of_view(facts: DataFrame, as_of, mode: str = "bounded",
               end_of_day: bool = False, date_col: str = "invoice_date") -> DataFrame:
    """Bounded mode hides everything after ``as_of``; omniscient shows all."""
    if mode == "omniscient":
        return facts
    if mode != "bounded":
        raise ValueError(f"unknown mode {mode!r}")
    return facts.where(F.col(date_col) <= ts_lit(as_of, end_of_day))


def in_period(facts: DataFrame, start, end, end_of_day: bool = False,
              date_col: str = "invoice_date") -> DataFrame:
    """``date BETWEEN start AND end``; ``end`` at midnight unless end_of_day."""
    return facts.where(F.col(date_col).between(ts_lit(start), ts_lit(end, end_of_day)))
