import datetime as dt
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tillcycle.functions.parts import list_parts, numbered
from tillcycle.operators.statements import StatementRefused, Statements
from tillcycle.sources.stored import AppendLog, VersionedTable


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="tillcycle-stores-")


# ---- statements
def lines(session):
    rows = [(dt.datetime(2011, m, 1), f"s{m % 2}", m) for m in range(1, 11)]
    return session.createDataFrame(rows, "invoice_date timestamp_ntz, stock_code string, quantity int")


def statements(spark, mode="bounded"):
    return Statements(spark, {"fact_sales": (lines, "invoice_date")}, "2011-06-01", "2011-02-01", mode)


def test_statements_see_no_later_rows(spark):
    sql = """WITH f AS (SELECT * FROM fact_sales WHERE invoice_date >= :start)
             SELECT stock_code, SUM(quantity) AS q FROM f WHERE quantity <> :skip AND quantity <= (SELECT MAX(quantity) FROM fact_sales)
             GROUP BY stock_code"""
    rows, evidence = statements(spark).run("sums", sql, {"skip": 3})
    assert {r.stock_code: r.q for r in rows.collect()} == {"s0": 12, "s1": 5}
    e = evidence.collect()[0]
    assert e.run_at == "sums" and e.rows == 2 and "s1" in e.result_preview
    assert e.params == ["mode=bounded", "as_of=2011-06-01", "skip=3", "start=2011-02-01"] and ":skip" in e.sql
    rows, _ = statements(spark, "omniscient").run("sums", sql, {"skip": 3})
    assert {r.stock_code: r.q for r in rows.collect()} == {"s0": 30, "s1": 21}


def test_statements_that_reach_beyond_the_views_are_refused(spark, folder):
    lines(spark).write.parquet(f"{folder}/raw")
    spark.sql("DROP TABLE IF EXISTS raw_sales")
    lines(spark).createOrReplaceTempView("raw_view")
    lines(spark).write.mode("overwrite").option("path", f"{folder}/tbl").saveAsTable("raw_sales")
    st = statements(spark)
    try:
        for sql in ("SELECT * FROM raw_sales", f"SELECT * FROM parquet.`{folder}/raw`", "SELECT * FROM raw_view",
                    "SELECT * FROM fact_sales WHERE quantity IN (SELECT quantity FROM raw_sales)",
                    "WITH fact_sales AS (SELECT * FROM raw_sales) SELECT * FROM fact_sales",
                    "SELECT f.* FROM fact_sales f JOIN raw_sales r ON f.stock_code = r.stock_code",
                    "DROP TABLE raw_sales", "INSERT INTO raw_sales SELECT * FROM fact_sales", "CREATE TABLE x AS SELECT 1",
                    "CACHE TABLE fact_sales", "SET spark.sql.ansi.enabled=false", "SELEC 1", "SELECT nothing FROM fact_sales"):
            with pytest.raises(StatementRefused):
                st.query(sql)
        assert spark.table("raw_sales").count() == 10
    finally:
        spark.sql("DROP TABLE IF EXISTS raw_sales")
        spark.catalog.dropTempView("raw_view")
    with pytest.raises(StatementRefused, match="fixed by the run"):
        st.query("SELECT :as_of", {"as_of": "2099-01-01"})
    assert st.query("SELECT 1 AS x UNION ALL SELECT * FROM VALUES (2)").count() == 2


# ---- refreshes
def test_a_failed_refresh_leaves_the_old_table(spark, folder):
    t = VersionedTable(spark, f"{folder}/t")
    assert not t.exists()
    with pytest.raises(FileNotFoundError):
        t.read()
    rows = spark.range(100)
    assert t.refresh(rows.limit(10)) == 1 and t.refresh(rows) == 2
    with pytest.raises(Exception, match="lost"):
        t.refresh(rows.where(F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).isNull()).otherwise(True)))
    assert VersionedTable(spark, f"{folder}/t").read().count() == 100 and t.version() == 2
    assert t.read(1).count() == 10
    t.refresh(rows.limit(3))
    assert t.drop_old(keep=2) == 1 and t.version() == 3 and t.read().count() == 3 and t.read(2).count() == 100
    assert not any(v == 1 for v, _ in t._versions())


def test_refreshes_at_once_get_numbers_of_their_own(spark, folder):
    a, b = VersionedTable(spark, f"{folder}/t"), VersionedTable(spark, f"{folder}/t")
    a._pointers.names = lambda: []          # a listed the pointers before b wrote its own
    assert b.refresh(spark.range(1)) == 1 and a.refresh(spark.range(2)) == 2
    assert b.read().count() == 2
    open(os.path.join(folder, "t", "_pointers", "000000000009"), "w").close()   # its writer died
    assert b.version() == 2 and b.refresh(spark.range(5)) == 10 and b.read().count() == 5


def dated(spark):
    """Facts of nine days, one of which has half of the lines; some come twice, some have no date."""
    days = [dt.datetime(2011, 1, 28 + d) if d < 4 else dt.datetime(2011, 2, d - 3, 9, 30) for d in range(9)]
    rows = [(str(i), days[2] if i % 2 else days[i % 9] if i % 14 else None, f"s{i % 7}", None if i % 5 else "x", i, 0.5, "c", "UK", i / 2)
            for i in range(180)]
    return spark.createDataFrame(rows + rows[:20], "invoice_no string, invoice_date timestamp_ntz, stock_code string, description string, "
                                 "quantity int, unit_price double, customer_id string, country string, revenue double")


def test_date_slices_hold_every_row_once(spark):
    from tillcycle.sources.raw_sales import date_slices
    df = dated(spark)
    for lines_, most in ((10, 6), (10, 100), (50, 3), (1000, 6), (1, 1)):
        slices, n = date_slices(df, df, lines_, most)
        parts = [s.collect() for s in slices]
        assert n == 200 and len(parts) <= max(1, min(most, -(-200 // lines_))) and all(parts)
        assert sorted(map(str, sum(parts, []))) == sorted(map(str, df.collect()))
        spans = [[r.invoice_date for r in p if r.invoice_date] for p in parts]
        assert all(max(a) < min(b) for a, b in zip([s for s in spans if s], [s for s in spans if s][1:]))
    assert len(date_slices(df, df, 10, 6)[0]) > 2
    assert [s.count() for s in date_slices(df, df.where("invoice_date is null"), 1, 6)[0]] == [200]    # sizes only
    assert sum(s.count() for s in date_slices(df, df.where("quantity < 30"), 1, 9)[0]) == 200
    assert date_slices(df, df.limit(0), 10, 6)[1] == 0


def test_a_sliced_refresh_writes_what_a_whole_one_does(spark, folder, monkeypatch):
    from tillcycle.sources import raw_sales
    monkeypatch.setattr(raw_sales, "SLICE_LINES", 10)
    monkeypatch.setattr(raw_sales, "LINES_PER_TASK", 5)
    df, t = dated(spark), VersionedTable(spark, f"{folder}/t")
    assert raw_sales.refresh_curated(t, df, 4) == 1 and raw_sales.refresh_curated(t, df, 4, df) == 2
    whole, sliced = (sorted(map(str, t.read(v).select(*raw_sales.FACT_COLUMNS).collect())) for v in (1, 2))
    assert whole == sliced == sorted(map(str, df.collect()))
    late = df.where(F.when(F.col("invoice_date") > "2011-02-04", F.raise_error(F.lit("lost")).isNull()).otherwise(True))
    with pytest.raises(Exception, match="lost"):
        raw_sales.refresh_curated(t, late, 4, df)               # the slices before were written
    assert t.version() == 2 and sorted(os.listdir(f"{folder}/t")) == sorted(["_pointers", *(v for _, v in t._versions())])


def test_a_refresh_leaves_no_shuffle_files(spark, folder):
    from tillcycle.session import FREED
    from tillcycle.sources.raw_sales import refresh_curated
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    before, set_before = shuffled(), spark.conf.get(FREED)
    t = VersionedTable(spark, f"{folder}/t")
    for _ in range(2):
        refresh_curated(t, dated(spark).repartition(7, "stock_code"), 4)
    for _ in range(50):                                         # they are removed by another thread
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before and spark.conf.get(FREED) == set_before


# ---- appends
def test_appends(spark, folder):
    log = AppendLog(spark, f"{folder}/log", "id long, v string")
    assert log.read().count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    lost = log.stage(rows, "r1", "0")
    assert log.read().count() == 0
    assert log.append(rows, "r1") and not log.append(rows, "r1") and not log.commit("r1", "0", lost)
    assert sorted(tuple(r) for r in log.read().collect()) == [(1, "a"), (2, None)]
    assert log.append(rows, "r1", "1") and log.append(rows, "r 2/=", "0")
    assert AppendLog(spark, f"{folder}/log", "id long, v string").read().count() == 6
    assert {(r["_run"], r["_part"]) for r in log.committed().collect()} == {("r1", "0"), ("r1", "1"), ("r 2/=", "0")}


def test_two_writers_of_one_part(spark, folder):
    log = AppendLog(spark, f"{folder}/log", "id long")
    a, b = log.stage(spark.range(3), "r", "0"), log.stage(spark.range(3, 8), "r", "0")
    assert log.commit("r", "0", b) and not log.commit("r", "0", a)
    assert sorted(r.id for r in log.read().collect()) == [3, 4, 5, 6, 7]


# ---- lists in parts
def test_list_parts(spark):
    rows = [("hot", i, f"v{i}") for i in range(1003)] + [("one", 5, "x"), (None, 2, "b"), (None, 1, "a")]
    df = spark.createDataFrame(rows, "g string, k long, v string").repartition(5)
    for slices in (1, 7, 64):
        got = list_parts(df, ["g"], ["k"], "v", bound=100, slices=slices).collect()
        by = {(r.g, r.part): r["items"] for r in got}
        assert max(len(x) for x in by.values()) == 100 and all(r.n == len(r["items"]) for r in got)
        hot = [x for p in range(11) for x in by[("hot", p)]]
        assert hot == [f"v{i}" for i in range(1003)]
        assert by[("one", 0)] == ["x"] and by[(None, 0)] == ["a", "b"] and len(by) == 13
    assert sorted(r.pos for r in numbered(df.where("g = 'hot'"), ["g"], ["k"]).collect()) == list(range(1003))
    assert list_parts(df.limit(0), ["g"], ["k"], "v").count() == 0


def test_cycle_reads_a_versioned_table(spark, folder):
    from tillcycle.sources.raw_sales import read_facts, refresh_curated
    from tillcycle.sources.tables import fact_sales
    t = VersionedTable(spark, f"{folder}/curated")
    refresh_curated(t, fact_sales(spark, SF_SMALL))
    assert read_facts(spark, t).count() == fact_sales(spark, SF_SMALL).count()


# ---- fields of several types
def test_union_records(spark):
    from tillcycle.operators.unions import union_records
    rows = [("a", '{"quantity": 5, "acceptance_criteria": ["x", 2], "finding_type": "schema_drift", "reported_value": 1.5}'),
            ("b", '{"quantity": " 7.5 ", "acceptance_criteria": "x", "finding_type": "new", "reported_value": true}'),
            ("c", '{"quantity": "n/a", "acceptance_criteria": null, "finding_type": ["other"], "reported_value": null}'),
            ("d", '{"quantity": [1], "acceptance_criteria": []}'), ("e", "no json"), ("f", None), ("g", "[1]")]
    got = {r.id: tuple(r)[1:] for r in union_records(spark.createDataFrame(rows, "id string, payload_json string")).collect()}
    none = (None, [], "other", "")
    assert got == {"a": (5.0, ["x", "2"], "schema_drift", "1.5"), "b": (7.5, ["x"], "other", "true"),
                   "c": none, "d": none, "e": none, "f": none, "g": none}
