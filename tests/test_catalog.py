"""Named queries over small event tables built here."""

import datetime

import pytest
from pyspark.sql import functions as F

from hitloom.plans import catalog

FIRST = datetime.datetime(2024, 1, 1, 12)


def events(spark, folder, days, per_day=20):
    """An events table with the same number of requests on every day."""
    rows = [(i, FIRST + datetime.timedelta(days=i % days, seconds=i), i % 13, ("view", "error", "signup")[i % 3], i / 4, f'{{"k": {i % 24}}}')
            for i in range(days * per_day)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["period_default7", "period_last_n", "period_compare"])
def test_every_period_query_gives_all_ranges(spark, tmp_path, name):
    found = {tuple(r) for r in catalog.queries()[name](spark, events(spark, tmp_path, 16)).select("period", "date_from", "date_to", "hits").collect()}
    assert found == {("default7", "2024-01-10", "2024-01-16", 140), ("last14", "2024-01-03", "2024-01-16", 280),
                     ("current", "2024-01-10", "2024-01-16", 140), ("previous", "2024-01-03", "2024-01-09", 140)}


@pytest.mark.parametrize("name", ["period_default7", "period_last_n", "period_compare"])
def test_a_range_without_requests_has_no_row(spark, tmp_path, name):
    found = {tuple(r) for r in catalog.queries()[name](spark, events(spark, tmp_path, 3)).select("period", "date_from", "hits").collect()}
    assert found == {("default7", "2024-01-01", 60), ("last14", "2023-12-21", 60), ("current", "2023-12-28", 60)}


@pytest.fixture
def parses(monkeypatch):
    """A list that grows by one with every parse that a query plans."""
    calls, parse = [], catalog.enrich.parse_lines
    monkeypatch.setattr(catalog.enrich, "parse_lines", lambda raw: calls.append(1) or parse(raw))
    return calls


def test_the_search_tables_come_from_stored_requests(spark, tmp_path, parses):
    found = catalog.queries()["cov_backfill_missing"](spark, events(spark, tmp_path, 18))
    assert [r[0] for r in found.collect()] == ["2024-01-15", "2024-01-16", "2024-01-17", "2024-01-18"]
    assert len(parses) == 1


def test_a_deep_page_counts_stored_requests(spark, tmp_path, parses):
    found = catalog.queries()["rows_page_deep"](spark, events(spark, tmp_path, 18, per_day=40))
    assert [r.bytes_sent for r in found.collect()] == sorted((i * 25 for i in range(720)), reverse=True)[650:700]
    assert len(parses) == 1 and all("/parsed/version=" in f for f in found.inputFiles())


def test_countries_are_repaired_after_one_parse(spark, tmp_path, parses):
    found = catalog.queries()["fix_country_type"](spark, events(spark, tmp_path, 18))
    assert {r.country for r in found.collect()} == {"2", "US", "JP", "DE", "FR", None}
    assert found.groupBy().sum("n").first()[0] == 360 and len(parses) == 1


def test_both_writes_of_a_sink_share_one_parse(spark, tmp_path, parses):
    found = catalog.queries()["sink_parsed"](spark, events(spark, tmp_path, 18))
    hits = {r.date: r.hits for r in found.collect()}
    assert len(hits) == 18 and hits["2024-01-14"] == 20 and hits["2024-01-15"] < 20 and len(parses) == 1
