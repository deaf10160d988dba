from tillcycle.sources.tables import fact_sales, read_table
from tillcycle.sources.raw_sales import (
    clean_sales, ingest, read_facts, read_raw_sales, write_curated,
)

__all__ = ["fact_sales", "read_table", "clean_sales", "ingest", "read_facts",
           "read_raw_sales", "write_curated"]
