"""KPIs of overlapping periods from mergeable sets stored per day (AG1, EV1).

Distinct counts of overlapping periods cannot be added up, so counting them from the lines sends a
line to every period it lies in.  Here the lines are read once, when they arrive: each key (an invoice,
a customer) gets a dense number, and a day keeps the set of its keys as bitmaps over these numbers
beside its sums.  A period's set is the OR of its days' bitmaps: a period costs days x buckets rows,
however many lines they hold, and its counts are exact.  Sketches per day are the option where the
numbering is not wanted; their error is that of HyperLogLog.

Numbers: keys are dealt by hash into slices of about ``PER_SLICE`` keys (the slices are counted at the
first append) and numbered inside their slice, so no window holds more than a slice; keys of later
appends go on from their slice's last number.  A bitmap covers 32,768 numbers of one slice.  The order
is that of the first day a key is seen on: keys of the same days share bitmaps, and a day has few.
Bitmaps meet in as many partitions as they fill (``SETS_PER_TASK``, ``KEYS_PER_TASK``).

Defined cases: a null key is a key like any other (the sketches skip it); days may come in several
appends, in any order; a retried append adds nothing; one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillcycle.plans.derived import assign_runs, grouped_kpis_from_totals, moment, run_calendar
from tillcycle.session import bounded_broadcast, cut_lineage
from tillcycle.sources.stored import AppendLog

PER_SLICE = 1 << 19
SETS_PER_TASK, KEYS_PER_TASK = 8_192, 500_000
#: What is counted, and the fact column that holds its keys.
MEASURES = {"orders": "invoice_no", "customers": "customer_id"}
IDS_SCHEMA = "measure string, key string, slice int, number long, slices int"
SETS_SCHEMA = "moment timestamp_ntz, measure string, slice int, bucket long, bits binary"
SUMS_SCHEMA = "moment timestamp_ntz, rev double, lines long, returns long"


def number_keys(keys: DataFrame, known: DataFrame, per_slice: int = PER_SLICE) -> DataFrame:
    """(measure, key, slice, number, slices) for the (measure, key) rows that ``known`` lacks, in the
    order of their first moment if they have one."""
    first_seen = F.min("moment") if "moment" in keys.columns else F.lit(None).cast("timestamp_ntz")
    keys = keys.groupBy("measure", "key").agg(first_seen.alias("first")).alias("k")
    same = (F.col("k.measure") == F.col("o.measure")) & F.col("k.key").eqNullSafe(F.col("o.key"))
    new = cut_lineage(keys.join(known.select("measure", "key").alias("o"), same, "left_anti"))
    # one row per measure and per (measure, slice)
    first = known.groupBy("measure").agg(F.max("slices").alias("before"))
    sizes = new.groupBy("measure").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(first), "measure", "left")
    sizes = sizes.select("measure", F.coalesce("before", F.ceil(F.col("n") / per_slice)).cast("int").alias("slices"))
    last = known.groupBy("measure", "slice").agg(F.max("number").alias("last"))
    dealt = new.join(F.broadcast(sizes), "measure") \
        .withColumn("slice", F.expr("pmod(xxhash64(key), slices)").cast("int"))
    own = F.row_number().over(W.partitionBy("measure", "slice").orderBy("first", "key"))
    return dealt.withColumn("own", own).join(last, ["measure", "slice"], "left").select(
        "measure", "key", "slice", (F.coalesce("last", F.lit(0)) + F.col("own")).cast("long").alias("number"), "slices")


def day_bitmaps(seen: DataFrame, ids: DataFrame, tasks: int | None = None) -> DataFrame:
    """(moment, measure, slice, bucket, bits) of (moment, measure, key) rows; ids number from 1."""
    same = (F.col("s.measure") == F.col("i.measure")) & F.col("s.key").eqNullSafe(F.col("i.key"))
    placed = seen.alias("s").join(ids.alias("i"), same).select(
        "s.moment", "s.measure", "i.slice", F.bitmap_bucket_number("i.number").alias("bucket"),
        F.bitmap_bit_position("i.number").alias("bit"))
    if tasks:   # the narrow rows meet, not the bitmaps of every task
        placed = placed.repartition(tasks, "moment", "measure", "slice", "bucket")
    return placed.groupBy("moment", "measure", "slice", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


class DaySets:
    """The numbers, bitmaps and sums of all appended lines, in a folder that several sessions may open."""

    def __init__(self, spark, path: str, per_slice: int = PER_SLICE):
        self.per_slice = per_slice
        self._ids, self._sets, self._sums = (AppendLog(spark, f"{path}/{name}", schema) for name, schema in (
            ("ids", IDS_SCHEMA), ("sets", SETS_SCHEMA), ("sums", SUMS_SCHEMA)))

    def append(self, facts: DataFrame, part: str) -> bool:
        """Adds lines (invoice_no, customer_id, invoice_date, quantity, revenue), read once; False
        if ``part`` is there already.  The numbers are committed first, the sums last: a writer that
        is lost in between goes on where it stopped when retried."""
        pre = cut_lineage(facts.groupBy(moment(F.col("invoice_date")).alias("moment"), *MEASURES.values()).agg(
            F.sum("revenue").alias("rev"), F.count(F.lit(1)).alias("lines"),
            F.count_if(F.col("quantity") < 0).alias("returns")))
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).cast("string").alias("key"))
                          for m, c in MEASURES.items()])
        seen = pre.select("moment", F.inline(pairs)).distinct()
        tasks = max(1, -(-len(MEASURES) * pre.count() // KEYS_PER_TASK))
        self._ids.append(number_keys(seen, self._ids.read(), self.per_slice), "all", part)
        self._sets.append(day_bitmaps(seen, self._ids.read(), tasks), "all", part)
        return self._sums.append(pre.groupBy("moment").agg(
            F.sum("rev").alias("rev"), F.sum("lines").alias("lines"), F.sum("returns").alias("returns")), "all", part)

    def sums(self) -> DataFrame:
        return self._sums.read().select("moment", "rev", "lines", "returns")

    def sets(self) -> DataFrame:
        return self._sets.read().select("moment", "measure", "slice", "bucket", "bits")


def period_counts(sets: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, measure, n): exact distinct keys of each run's period, from bitmaps alone.
    Bitmaps meet by bucket; days that the same runs see are merged before they fan out to these."""
    tasks = max(1, -(-sets.count() // SETS_PER_TASK))
    bucket = ["measure", "slice", "bucket"]
    alike = sets.repartition(tasks, *bucket).join(F.broadcast(run_calendar(runs)), "moment") \
        .groupBy(*bucket, "runs").agg(F.bitmap_or_agg("bits").alias("bits"))
    merged = alike.select(F.explode("runs").alias("run_id"), *bucket, "bits").groupBy("run_id", *bucket).agg(
        F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("run_id", "measure").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def run_kpis_from_sets(store: DaySets, runs: DataFrame) -> DataFrame:
    """The rows of ``derived.run_kpis``, without going back to the lines."""
    counts = period_counts(store.sets(), runs).groupBy("run_id").pivot("measure", list(MEASURES)).agg(F.first("n"))
    totals = assign_runs(store.sums(), runs, "moment").groupBy("run_id").agg(
        F.sum("rev").alias("rev"), F.sum("lines").alias("lines"), F.sum("returns").alias("returns"))
    wide = cut_lineage(totals.join(counts, "run_id"))
    customers = wide.select("run_id", F.lit("unique_customers").alias("name"),
                            F.col("customers").cast("double").alias("value"), F.lit("customers").alias("unit"))
    period = bounded_broadcast(runs.select("run_id", F.concat_ws(
        "/", F.col("period_start").cast("string"), F.col("period_end").cast("string")).alias("period")))
    return grouped_kpis_from_totals(wide, ["run_id"]).unionByName(customers).join(period, "run_id")


def day_sketches(facts: DataFrame, lg_size: int = 12) -> DataFrame:
    """(moment, measure, sketch): HyperLogLog sketches of 2^lg_size registers, mergeable like the sets."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).cast("string").alias("key")) for m, c in MEASURES.items()])
    return facts.select(moment(F.col("invoice_date")).alias("moment"), F.inline(pairs)).groupBy("moment", "measure").agg(
        F.hll_sketch_agg("key", lg_size).alias("sketch"))


def period_estimates(sketches: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, measure, n): estimated distinct keys of each run's period."""
    return assign_runs(sketches, runs, "moment").groupBy("run_id", "measure").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
