"""Named queries against their SQL, and plan shapes that matter at scale."""

import os

import pytest
from check_queries import compare, database
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hitloom.operators import filters, query
from hitloom.operators.filters import FilterSpec
from hitloom.operators.query import QuerySpec
from hitloom.plans import catalog, periods, presets, reports

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), entry.oracle_sql()
# One of each kind by default; HITLOOM_ALL=1 runs all of them.
SAMPLE = (
    "parse_line", "parse_request", "daily", "hourly", "wasted_crawl_daily", "bot_top_urls_daily", "ai_crawler_daily",
    "gsc_daily", "gsc_bot_daily", "flt_search_operators", "flt_exclude", "flt_path_rules", "q_group", "dim_exprs",
    "q_timeseries_stacked", "q_histogram60_errors", "rows_page", "trend_pct", "summary_kpis", "strategic_by_class",
    "preset_googlebot_depth", "insight_locale_error_rates", "sink_csv_gsc_top_clicks", "src_incremental_files",
    "rules_diff",
)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("HITLOOM_ALL") else SAMPLE)
def test_matches_sql(spark, name):
    result = compare(spark, database(SF), name, QUERIES[name], SQL[name], SF)
    assert result.startswith("ok") or result == "EMPTY"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_search_operators():
    text, inc, exc, mode = filters.parse_search("status:4xx status:500 -is:bot -path:/a /x|y/ foo:bar free utm:News")
    assert (text, mode) == ("x|y foo:bar free", "regex")
    assert inc == {"status_class": ["4"], "status": ["500"], "utm_source": ["News"]}
    assert exc == {"is_bot": [True], "path": ["/a"]}


def test_explicit_filters_win():
    assert presets.preset("top-404", status=(500,)).filters.include == {"status": (404,)}
    assert presets.preset("top-urls", status=(500,)).filters.include == {"status": (500,)}
    merged = presets.with_view("ai-bots", FilterSpec(is_bot=False))
    assert merged.is_bot is False and merged.include == {"bot_category": ("AI Crawler",)}


def test_not_contains_drops_missing_referers(spark):
    df = spark.createDataFrame([("/a", "1", "u", None), ("/a", "1", "u", "r")],
                               "path string, edge_ip string, user_agent string, referer string")
    assert filters.apply(df, FilterSpec(search="zzz", search_mode="not_contains")).count() == 1
    assert filters.apply(df, FilterSpec(exclude={"referer_type": ("x",)})).count() == 2


def test_periods():
    assert periods.compare("2024-01-08", "2024-01-10", "x") == ("2024-01-08", "2024-01-10", "2024-01-05", "2024-01-07")
    assert periods.default_last_7(None, None, "2024-01-03", "2024-01-05") == ("2024-01-03", "2024-01-05")
    assert periods.last_n(30, "2024-01-30") == ("2024-01-01", "2024-01-30")
    assert periods.date_list("2024-02-28", "2024-03-01") == ["2024-02-28", "2024-02-29", "2024-03-01"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    from hitloom import schema
    from hitloom.plans import catalog
    from hitloom.sources import storage

    storage.replace_partitions(catalog.parsed(spark, SF), str(tmp_path))
    table = storage.read_table(spark, str(tmp_path), schema.PARSED)
    spec = QuerySpec(mode="group", group_by="url_group", date_from="2024-01-05", date_to="2024-01-06",
                     filters=FilterSpec(search="status:404 path:/fr", is_bot=True))
    query.run(table, spec).explain("formatted")
    scan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(date" in scan and "2024-01-05" in scan
    for pushed in ("EqualTo(status,404)", "EqualTo(is_bot,true)", "StringStartsWith(path,/fr)"):
        assert pushed in scan
    read = scan[scan.index("ReadSchema"):]
    assert "user_agent" not in read and "referer" not in read  # columns the query does not need


def test_top_urls_are_limited_before_the_shuffle(spark):
    from hitloom.operators import aggregates

    assert "WindowGroupLimit" in plan(aggregates.bot_top_urls_daily(catalog.parsed(spark, SF)))


def test_nothing_is_cut_in_silence(spark):
    rows = [(f"l{i}", g, 1, 0, 1, 0, 0) for i in range(300) for g in ("About", "Home")]
    cells = spark.createDataFrame(rows, "locale string, url_group string, hits long, hits_bot long, hits_human long, s4xx long, s5xx long")
    matrix = reports.locale_group_matrix(cells, ("About", "Home")).collect()
    assert len(matrix) == 300 and all(r["About"] == r["Home"] == 1 for r in matrix)
    assert reports.csv_report("locale-groups", lambda name: cells.withColumn("date", F.lit("2024-01-01"))).count() == 600
    crawl = spark.createDataFrame([(f"bot{i}", 100) for i in range(40)] + [("rare", 1)], "bot_family string, crawl_hits long")
    assert reports.choose_bot(crawl, "rare") == "rare" and reports.choose_bot(crawl, "none") == "bot0"


@pytest.mark.parametrize("rule", ["regex:(", "contains:", "bad:x", "regex:" + "a" * 201])
def test_unusable_path_rules_are_errors(rule):
    with pytest.raises(ValueError):
        filters.parse_path_rules(["contains:ok", rule])
