"""Versioned tables: nothing is lost by a failing write, emptied files are noticed, repairs touch only what is wrong."""

import os

import pytest
from pyspark.sql import functions as F

from hitloom import schema
from hitloom.config import SiteRules
from hitloom.operators import aggregates
from hitloom.plans import catalog
from hitloom.plans.refresh import Warehouse
from hitloom.sources import storage
from hitloom.sources.versions import CommitConflict, Store

SF = "/root/testdata/sf0.001"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "date string, x int")


def content(df):
    return sorted((r.date, r.x) for r in df.collect())


def test_commits_switch_all_tables_at_once(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    first = store.begin()
    first.write("a", frame(spark, ("d1", 1), ("d2", 2)))
    first.write("b", frame(spark, ("d1", 10)))
    assert store.snapshot().tables == {}
    first.commit()
    old = store.snapshot()
    second = store.begin()
    second.write("a", frame(spark, ("d2", 3)), ["d1", "d2"])
    assert content(second.read("a", None)) == [("d2", 3)]
    assert content(store.read("a", None)) == [("d1", 1), ("d2", 2)]
    other = store.begin()
    other.write("b", frame(spark, ("d9", 9)))
    second.commit()
    with pytest.raises(CommitConflict):
        other.commit()
    assert content(store.read("a", None)) == [("d2", 3)] and content(store.read("b", None)) == [("d1", 10)]
    assert content(store.read("a", None, snapshot=old)) == [("d1", 1), ("d2", 2)]
    assert store.snapshot().dates("a") == ["d2"]
    assert content(store.read("a", None, ["d2", "never"])) == [("d2", 3)]
    gone = store.vacuum(keep=1, min_age_seconds=0)
    assert len(gone) == 2  # the first version of a, and what the loser of the conflict wrote
    assert content(store.read("a", None)) == [("d2", 3)]


def test_a_write_that_dies_midway_leaves_the_old_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    storage.replace_partitions(frame(spark, ("d1", 1), ("d2", 2)), path)
    broken = frame(spark, ("d1", 7), ("d2", 0)).repartition(2, "x").withColumn("x", F.when(F.col("x") > 0, F.col("x")).otherwise(F.raise_error(F.lit("dies")).cast("int")))
    with pytest.raises(Exception, match="dies"):
        storage.replace_partitions(broken, path, ["d1", "d2"])
    assert content(storage.read_table(spark, path)) == [("d1", 1), ("d2", 2)]
    storage.replace_partitions(frame(spark, ("d1", 7)), path, ["d2"])
    assert content(storage.read_table(spark, path)) == [("d1", 7)]


def line(path="/en", agent="Googlebot", day=1):
    return f'1.1.1.1 - - [0{day}/Jan/2024:10:00:00 +0000] "GET {path} HTTP/1.1" 200 10 "-" "{agent}"\n'


@pytest.fixture()
def site(spark, tmp_path, monkeypatch):
    # Two of the tables stand for all of them: what is tested here is how they are written.
    monkeypatch.setattr(aggregates, "TABLES", {n: aggregates.TABLES[n] for n in ("daily", "hourly")})
    raw = tmp_path / "raw logs+100%"
    raw.mkdir()
    for day, n in ((1, 2), (2, 1), (3, 3)):
        (raw / f"site_access_2024-01-0{day}_000000.log").write_text(line(day=day) * n)
    (raw / "site_access_2024-01-04_000000.log").write_text("")
    return Warehouse(spark, str(tmp_path / "wh"), SiteRules.default("example.com")), raw


def hits(w):
    return {r.date: r.hits for r in w.table("daily").collect()}


def test_an_ingest_that_fails_late_changes_nothing(site, monkeypatch):
    w, raw = site
    w.ingest(str(raw))
    assert hits(w) == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-03": 3}
    (raw / "site_access_2024-01-01_000000.log").write_text(line() * 9)
    before = w.store.snapshot()
    monkeypatch.setattr(w, "refresh_search", lambda *a: 1 / 0)  # the requests and the other tables are written by then
    with pytest.raises(ZeroDivisionError):
        w.ingest(str(raw))
    assert w.store.snapshot() == before and w.parsed().count() == 6
    monkeypatch.delattr(w, "refresh_search")
    assert w.ingest(str(raw)) == ["2024-01-01"]
    assert hits(w)["2024-01-01"] == 9 and w.parsed().count() == 13


def test_a_file_cut_to_nothing_is_noticed(site):
    w, raw = site
    w.ingest(str(raw))
    (raw / "site_access_2024-01-02_000000.log").write_text("")
    assert w.changed_dates(str(raw)) == ["2024-01-02"]
    assert w.ingest(str(raw)) == ["2024-01-02"] and w.changed_dates(str(raw)) == []
    assert hits(w) == {"2024-01-01": 2, "2024-01-03": 3}
    assert w.dates() == ["2024-01-01", "2024-01-03"]
    os.remove(raw / "site_access_2024-01-03_000000.log")
    assert w.changed_dates(str(raw)) == [] and w.parsed().count() == 5  # deleted files keep their rows


def test_rebuild_by_range_and_aggregates_only(site):
    w, raw = site
    w.ingest(str(raw))
    assert w.rebuild(str(raw), "2024-01-02") == ["2024-01-02", "2024-01-03", "2024-01-04"]
    assert w.rebuild(date_to="2024-01-01") == ["2024-01-01"]
    assert hits(w) == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-03": 3}


def test_hours_of_another_zone_are_stored(site, spark):
    w, raw = site
    w = Warehouse(spark, w.root, w.rules, time_zone="Asia/Tokyo")
    w.ingest(str(raw))
    assert {r.hour_local.hour for r in w.table("hourly").collect()} == {19}


@pytest.mark.parametrize("path, date", [
    ("/x/site_access_2024-01-03_000000.log", "2024-01-03"), ("/x/site_access_2024-01-09_1/site_access_2024-01-03_2.log", "2024-01-03"),
    ("/x/site_access_2024-01-09_1/part-0.gz", "2024-01-09"), ("/site_access_2024-01-09_1/y/part-0", ""), ("/x/other.log", ""),
])
def test_the_file_name_decides_the_date(spark, path, date):
    assert spark.range(1).select(storage.file_date(F.lit(path)).alias("d")).first().d == date


def test_search_data_is_replaced_by_date(site, spark):
    w, raw = site
    w.ingest(str(raw))
    rows = [("2024-01-01", "https://h/en", None, 3, 5, 0.1, 2.0), ("2024-01-07", "https://h/en", None, 1, 1, 0.1, 2.0)]
    perf = spark.createDataFrame(rows, schema.SEARCH_PERF)
    assert w.load_search(perf) == ["2024-01-01", "2024-01-07"]
    assert {(r.date, r.page, r.clicks) for r in w.table("gsc_daily").collect()} == {("2024-01-01", "/en", 3)}
    w.load_search(perf.limit(0), ["2024-01-01"])
    assert w.table("gsc_daily").count() == 0 and w.dates("search_perf") == ["2024-01-07"]
    assert w.missing_search_dates() == []


def test_coverage_and_periods_open_no_file(site, monkeypatch):
    w, raw = site
    w.ingest(str(raw))
    monkeypatch.setattr(w.store, "read", None)
    assert w.dates() == ["2024-01-01", "2024-01-02", "2024-01-03"] and w.latest_ingested() == "2024-01-03"
    assert w.default_range() == ("2024-01-01", "2024-01-03") and w.last_days(2) == ("2024-01-02", "2024-01-03")
    assert w.comparison("2024-01-03", "2024-01-03") == ("2024-01-03", "2024-01-03", "2024-01-02", "2024-01-02")
    assert w.missing_search_dates() == []


def test_country_type_is_repaired_file_by_file(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "wh"), catalog.RULES)
    parsed = catalog.parsed(spark, SF)
    with w.change() as change:
        old = parsed.where(F.col("date") < "2024-01-11").withColumn("country", F.length("country"))
        change.write("parsed", old)
        change.write("parsed", parsed.where(F.col("date") >= "2024-01-11"))
    with pytest.raises(Exception):
        w.parsed().select("country").distinct().collect()
    want = sorted(map(str, parsed.withColumn("country", F.when(F.col("date") < "2024-01-11", F.length("country").cast("string")).otherwise(F.col("country"))).collect()))
    assert w.fix_country_type() == [f"2024-01-{d:02d}" for d in range(1, 11)]
    assert sorted(map(str, w.parsed().collect())) == want
    number = w.store.snapshot().number
    assert w.fix_country_type() == [] and w.store.snapshot().number == number
