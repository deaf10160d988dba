"""The corpus pipeline over `documents`: quality rules, line dedup, SimHash near-dedup, mixing
sources to target weights, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame, called with all rows its predecessor kept;
all but the last return the columns of `documents`.  SQL can't express fingerprints and the
tokenizer, so there is no ORACLE_SQL; tests hold every stage against a plain version.

In every stage columns beside those of `documents` are carried as they are, whatever their
names, by all stages but packing; a null text counts as empty, a null source as a source of its own, a
null doc_id as an id of no other row; rows that repeat others are documents of their own, until
near-dedup leaves one of each group; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcycle.llm import line_dedup, line_quality, packing, simhash_dedup, source_mix
from tillcycle.llm.common import columns, table, unused, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and so do lines above their host's limit."""
    return line_quality.clean(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the one of the largest id; `n_chars` follows.
    A document that has no other line stays, empty."""
    kept, _, dropped = added = unused(docs, "kept_text", "n_lines", "n_dropped")
    out = line_dedup.dedup(docs, added=tuple(added))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length(kept).cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(kept)).select(*columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that of the smallest id."""
    return simhash_dedup.keep_first(docs, shingle=4, max_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return source_mix.mixed_documents(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("simhash_dedup", near_dedup),
          ("source_mix", mix_sources), ("packing", pack_documents)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
