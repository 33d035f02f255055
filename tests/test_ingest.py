"""Files to tables: change detection, partition replacement, rollups, search join."""

import os

import pytest

from hitloom.config import SiteRules
from hitloom.operators import aggregates, search_join
from hitloom.plans import catalog
from hitloom.plans.refresh import Warehouse
from hitloom.sources import derived
from hitloom.streaming.tail import load_new_files

SF = "/root/testdata/sf0.001"


def text_line(path="/en", agent="Googlebot", day=1):
    return f'1.1.1.1 - - [0{day}/Jan/2024:10:00:00 +0000] "GET {path} HTTP/1.1" 200 10 "-" "{agent}"\n'.encode("latin-1")


def write(folder, name, *content):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(b"".join(content))


@pytest.fixture()
def warehouse(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    write(raw, "site_access_2024-01-01_000000.log", text_line(), text_line("/a"), b"garbage\n")
    write(raw, "site_access_2024-01-01_120000.log", text_line("/b\xff", "Mozilla/5.0".ljust(5)))
    write(raw, "site_access_2024-01-02_000000.log", text_line(day=2))
    write(raw, "site_access_2024-01-03_000000.log")
    write(raw, "undated.log", text_line("/never"))
    return Warehouse(spark, str(tmp_path / "wh"), SiteRules.default("example.com")), str(raw)


def hits(w):
    return {r.date: r.hits for r in w.table("daily").collect()}


def test_ingest_again_and_changed(warehouse):
    w, raw = warehouse
    assert w.changed_dates(raw) == ["2024-01-01", "2024-01-02"]  # an empty file has nothing to load
    w.ingest(raw)
    assert hits(w) == {"2024-01-01": 3, "2024-01-02": 1}
    assert w.ingest(raw) == []
    write(raw, "site_access_2024-01-02_000000.log", text_line(day=2), text_line("/new", "curl/7.1", 2))
    assert w.ingest(raw) == ["2024-01-02"]
    assert hits(w) == {"2024-01-01": 3, "2024-01-02": 2}
    assert w.manifest().count() == 3
    assert {r.path for r in w.parsed().select("path").collect()} >= {"/b�", "/new"}


def test_stream_loads_new_files(warehouse, tmp_path):
    w, raw = warehouse
    load_new_files(w, raw, str(tmp_path / "cp"))
    assert hits(w) == {"2024-01-01": 3, "2024-01-02": 1}
    write(raw, "late_access_2024-01-02_230000.log", text_line("/late", day=2))
    load_new_files(w, raw, str(tmp_path / "cp"))
    assert hits(w) == {"2024-01-01": 3, "2024-01-02": 2}


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_rollups_give_the_same_tables(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "wh"), catalog.RULES)
    w.load_parsed(catalog.raw_lines(spark, SF))
    w.load_search(derived.search_perf(spark, SF))
    dates = [r.date for r in w.parsed().select("date").distinct().collect()]
    w.refresh(dates)
    for name, build in aggregates.TABLES.items():
        assert rows(w.table(name)) == rows(build(w.parsed())), name
    assert rows(w.table("gsc_daily")) == rows(search_join.gsc_daily(w.parsed(), w.search_perf()))
    assert w.backfill_search() == []
    w.fix_country_type()
    assert w.parsed().count() == 1000


def test_search_join_edges(spark):
    parsed = spark.createDataFrame(
        [("d1", "/A/", True, "Googlebot"), ("d1", "/a", False, None), ("d2", "/a", True, "Googlebot"),
         ("d3", "/x", False, None)], "date string, path string, is_bot boolean, bot_family string")
    perf = spark.createDataFrame(
        [("d1", "https://h/a", None, 1, 10, 0.1, 3.0), ("d1", "https://h/a/", None, 2, 0, 0.0, 0.0),
         ("d1", "https://h/a?x=1", None, 4, 0, 0.0, 12.0), ("d1", "https://h/a", "q", 9, 9, 1.0, 1.0),
         ("d1", "https://h/z", None, 5, 50, 0.1, 2.0), ("d2", "https://h/", None, 0, 0, 0.0, 0.0)],
        "date string, page string, query string, clicks long, impressions long, ctr double, position double")
    got = {(r.date, r.page): (r.clicks, r.crawl_hits, r.is_indexed)
           for r in search_join.gsc_daily(parsed, perf).collect()}
    assert got == {("d1", "/a"): (1, 2, True), ("d1", "/a/"): (2, 2, False), ("d1", "/a?x=1"): (4, 2, True),
                   ("d1", "/z"): (5, 0, True), ("d2", "/"): (0, 0, False), ("d2", "/a"): (0, 1, False)}
    deduped = {(r.date, r.page): r.clicks for r in search_join.gsc_daily(parsed, perf, dedupe_pages=True).collect()}
    assert deduped[("d1", "/a")] == 7
