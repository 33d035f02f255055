"""One named query per operator, over tables derived from ``events`` and ``pages``.

Every entry takes a session and a data folder. Averages are rounded to six digits so that results do not
depend on the order of summation.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom import schema, session
from hitloom.config import SiteRules
from hitloom.functions import agents, lines, referers, urls, utm
from hitloom.operators import aggregates, enrich, filters, query, search_join, sketches, suggestions, tables
from hitloom.operators.filters import FilterSpec
from hitloom.operators.query import QuerySpec
from hitloom.plans import periods, presets, reports
from hitloom.plans.dictionaries import Dictionaries
from hitloom.plans.refresh import Warehouse
from hitloom.sources import derived, storage
from hitloom.sources.versions import Files, Store

Query = Callable[[SparkSession, str], DataFrame]

RULES = SiteRules.default(derived.SITE_DOMAIN)
# A second rule set, stored as a profile row, for the rule queries.
PROFILE = {
    "domain": "example.com",
    "locale_whitelist": json.dumps(["en", "fr"]),
    "url_group_rules": json.dumps([
        {"group": "Home", "match": "exact", "value": "/"},
        {"group": "Files", "match": "prefix", "value": "/static/"},
    ]),
    "section_mappings": json.dumps({"about": "Company"}),
    "settings": json.dumps({"fallback_group": "Misc"}),
}
# Fixed dates of the range queries.
RANGE = ("2024-01-05", "2024-01-20")
MIDDLE = "2024-01-15"
LAST_DAY = "2024-01-30"
CURRENT, PREVIOUS = ("2024-01-16", LAST_DAY), ("2024-01-01", MIDDLE)


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    return derived.log_lines(derived.access_log(spark, sf))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.parse_log(raw_lines(session.tune(spark), sf), RULES)


def lines_by_date(spark: SparkSession, sf: str) -> DataFrame:
    """The raw lines gathered by date before they are parsed: even tasks whatever the row groups, few files per date."""
    return storage.by_date(raw_lines(session.tune(spark), sf))


def request_fields(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.parse_lines(raw_lines(session.tune(spark), sf))


def search_perf(spark: SparkSession, sf: str) -> DataFrame:
    return derived.search_perf(session.tune(spark), sf)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """An aggregate table of the derived requests."""
    if name in ("gsc_daily", "gsc_bot_daily"):
        return getattr(search_join, name)(parsed(spark, sf), search_perf(spark, sf))
    return aggregates.TABLES[name](parsed(spark, sf))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return session.tune(spark).read.parquet(f"{sf}/pages.parquet").select(
        "page_id", "url", urls.page_path(F.col("url")).alias("path"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


# Files and tables on shared storage ---------------------------------------------------------------------------

_written: dict[tuple, str] = {}


def fresh_dir(spark: SparkSession) -> str:
    return f"{session.work_dir(spark)}/hitloom/{uuid.uuid4().hex}"


def raw_folder(spark: SparkSession, sf: str) -> str:
    """The raw lines as text files in one folder per date; written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _written:
        path = fresh_dir(spark)
        named = raw_lines(session.tune(spark), sf).select(
            F.concat(F.lit("site_access_"), "date", F.lit("_000000")).alias("log"), "value")
        named.write.partitionBy("log").text(path)
        _written[key] = path
    return _written[key]


def old_manifest(files: DataFrame) -> DataFrame:
    """A manifest in which early dates are ingested, middle ones have another size and late ones are missing."""
    size = F.when(F.col("log_date") < "2024-01-11", F.col("size_bytes")).otherwise(F.col("size_bytes") + 1)
    return schema.conform(files.where(F.col("log_date") < "2024-01-21").withColumn("size_bytes", size), schema.MANIFEST)


def src_raw_log(spark, sf):
    return count_by(storage.read_raw(spark, raw_folder(spark, sf)), "date")


def src_date_from_filename(spark, sf):
    return storage.list_raw(spark, raw_folder(spark, sf)).select(F.col("log_date").alias("date")).distinct()


def src_incremental_files(spark, sf):
    folder = raw_folder(spark, sf)
    files = storage.list_raw(spark, folder)
    dates = storage.affected_dates(files, old_manifest(files)).withColumnRenamed("log_date", "date")
    return count_by(storage.read_raw(spark, folder).join(F.broadcast(dates), "date", "left_semi"), "date")


def src_file_status(spark, sf):
    files = storage.list_raw(spark, raw_folder(spark, sf))
    return storage.file_status(files, old_manifest(files)).select(F.col("log_date").alias("date"), "status").distinct()


def src_date_range_rebuild(spark, sf):
    wanted = periods.date_list(*RANGE)
    again = storage.read_raw(spark, raw_folder(spark, sf)).where(F.col("date").isin(wanted))
    return aggregates.daily(enrich.parse_log(again.select("date", "value"), RULES)).select("date", "hits", "bytes_sent")


def sink_parsed(spark, sf):
    path, requests = fresh_dir(spark), loaded(spark, sf).parsed()
    storage.replace_partitions(requests, path)
    late = requests.where((F.col("date") >= MIDDLE) & ~F.col("is_bot"))
    storage.replace_partitions(late, path)  # replaces the later dates only
    stored = storage.read_table(spark, path, schema.PARSED)
    return stored.groupBy("date").agg(F.count("*").alias("hits"), F.sum("bytes_sent").alias("bytes_sent"))


def sink_aggregate(spark, sf):
    path = fresh_dir(spark)
    storage.replace_partitions(table(spark, sf, "group_daily"), path)
    return storage.read_table(spark, path).select("date", "url_group", "hits", "bytes_sent")


def sink_empty_typed(spark, sf):
    path = fresh_dir(spark)
    storage.replace_partitions(parsed(spark, sf).where(F.col("date") < "1970-01-01"), path)
    empty = storage.read_table(spark, path, schema.PARSED)
    return empty.unionByName(parsed(spark, sf)).groupBy("date").agg(F.count("*").alias("hits"))


def fix_country_type(spark, sf):
    """Files with whole-number countries among text ones, repaired in place."""
    w = Warehouse(spark, fresh_dir(spark), RULES)
    with w.change() as change:
        w.load_parsed(lines_by_date(spark, sf))
        early = w.parsed([d for d in w.dates() if d < MIDDLE])
        change.write("parsed", early.withColumn("country", F.length("country")))
    w.fix_country_type()
    return count_by(w.parsed(), "country")


def src_emptied_files(spark, sf):
    """The state of the raw files after one of them was cut to nothing."""
    folder, day = fresh_dir(spark), RANGE[0]
    named = raw_lines(session.tune(spark), sf).select(F.concat(F.lit("site_access_"), "date", F.lit("_000000")).alias("log"), "value")
    named.write.partitionBy("log").text(folder)
    known = tables.kept(storage.ingested_files(storage.list_raw(spark, folder)), "manifest")
    files = Files(spark, folder)
    inside = f"{folder}/log=site_access_{day}_000000"
    for name in files.names(inside):
        files.fs.create(files.path(f"{inside}/{name}"), True).close()
    status = storage.file_status(storage.list_raw(spark, folder), known)
    return status.select(F.col("log_date").alias("date"), "status").distinct()


def loaded(spark, sf) -> Warehouse:
    """A warehouse of the derived requests; written once per session."""
    key = (spark.sparkContext.applicationId, sf, "loaded")
    if key not in _written:
        path = fresh_dir(spark)
        Warehouse(spark, path, RULES).load_parsed(lines_by_date(spark, sf))
        _written[key] = path
    return Warehouse(spark, _written[key], RULES)


def partly_filled(spark, sf) -> Warehouse:
    """A warehouse of the derived tables whose search tables end early; written once per session.

    The search tables are built from the stored requests and search data, so no line is parsed for them again.
    """
    key = (spark.sparkContext.applicationId, sf, "warehouse")
    if key not in _written:
        w = loaded(spark, sf)
        with w.change() as change:
            change.write("search_perf", schema.conform(search_perf(spark, sf), schema.SEARCH_PERF))
            change.write("files", storage.ingested_files(storage.list_raw(spark, raw_folder(spark, sf)).where(F.col("log_date") < "2024-01-21")))
            for name, end in (("gsc_daily", MIDDLE), ("gsc_bot_daily", "2024-01-18")):
                rows = getattr(search_join, name)(w.parsed(), w.search_perf())
                change.write(f"aggregates/{name}", rows.where(F.col("date") < end))
        _written[key] = w.root
    return Warehouse(spark, _written[key], RULES)


def listed(spark, values, column: str = "date") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def labelled_by_dictionary(spark, sf):
    """Labels of all requests where the values of the first half of the month are in the dictionaries."""
    requests, store = request_fields(spark, sf), Store(spark, fresh_dir(spark))
    change = store.begin()
    known = Dictionaries(change, RULES)
    known.extend(requests.where(F.col("date") < MIDDLE))
    change.commit()
    labels = enrich.enrich(requests, RULES, Dictionaries(store.begin(), RULES))
    return count_by(labels, "is_bot", "bot_family", "bot_category", "url_group", "locale", "section", "is_resource", "referer_type",
                    "has_utm", "utm_source_norm", "utm_medium", "utm_campaign")


def scan_union_by_name(spark, sf):
    p = parsed(spark, sf)
    old, new = p.where(F.col("date") < MIDDLE).drop("country"), p.where(F.col("date") >= MIDDLE)
    return count_by(tables.union_by_name(new, old), "country")


def scan_schema_probe(spark, sf):
    p = parsed(spark, sf).drop("country")
    return count_by(p, *tables.known_columns(p, ("method", "no_such_column", "country", "status")))


def cov_available_dates(spark, sf):
    w = partly_filled(spark, sf)
    return listed(spark, sorted({*w.dates("parsed"), *w.dates("search_perf")}))


def cov_freshness(spark, sf):
    return listed(spark, [partly_filled(spark, sf).latest_ingested()], "latest")


def cov_backfill_missing(spark, sf):
    return listed(spark, partly_filled(spark, sf).missing_search_dates())


def csv_round_trip(spark, df, limited):
    path = fresh_dir(spark)
    storage.write_csv(df, path, single_file=limited)
    return spark.read.option("header", "true").csv(path)


def csv_report(name: str) -> Query:
    def run(spark, sf):
        return csv_round_trip(spark, reports.csv_report(name, lambda t: table(spark, sf, t)), True)

    return run


def csv_logs(spec: QuerySpec) -> Query:
    """An export read back as text."""

    def run(spark, sf):
        path = fresh_dir(spark)
        query.export_csv(parsed(spark, sf), spec, path)
        return spark.read.option("header", "true").csv(path)

    return run


# Parsing and labels -------------------------------------------------------------------------------------------


def broken_lines(spark, sf):
    """The raw lines, those of failed requests damaged in one of four ways by their status."""
    v = F.col("value")
    damaged = (
        F.when(F.contains(v, F.lit('" 404 ')), F.regexp_replace(v, r"/[A-Z][a-z]{2}/", "/Xyz/"))
        .when(F.contains(v, F.lit('" 403 ')), F.regexp_replace(v, '"', ""))
        .when(F.contains(v, F.lit('" 410 ')), F.regexp_replace(v, '" 410 ', '" 410 99999999999999999999'))
        .when(F.contains(v, F.lit('" 500 ')), F.lit("� garbage"))
        .otherwise(v)
    )
    return raw_lines(session.tune(spark), sf).withColumn("value", damaged)


def parse_line(spark, sf):
    return request_fields(spark, sf).select(
        "date", "ts_utc", "edge_ip", "country", "status", "bytes_sent", "referer", "user_agent")


def parse_time(spark, sf):
    t = request_fields(spark, sf).select("ts_utc", F.unix_seconds("ts_local").alias("epoch"))
    hour = F.date_format("ts_utc", "HH").alias("hour")
    return t.groupBy(hour).agg(F.count("*").alias("n"), F.sum("epoch").alias("epochs"))


def parse_request(spark, sf):
    return count_by(request_fields(spark, sf), "method", "path", "http_version", "request_target", "query_string",
                    "has_query")


def lookup_dim_ua(spark, sf):
    """Bot labels with the frequent agents looked up in a broadcast table and the others matched by rule."""
    requests = request_fields(spark, sf)
    cache = agents.frequent_agents(requests, RULES, n=4)
    return count_by(agents.classify_bot(requests, RULES, cache), "user_agent", "is_bot", "bot_family", "bot_category")


def lookup_dim_path(spark, sf):
    """Group labels of the distinct paths only, with their hits."""
    paths = request_fields(spark, sf).groupBy("path").agg(F.count("*").alias("n"))
    return urls.classify_path(paths, RULES)


def url_labels(*columns: str) -> Query:
    def run(spark, sf):
        requests = urls.classify_path(request_fields(spark, sf), RULES)
        return count_by(requests, *columns)

    return run


def page_labels(spark, sf):
    return urls.classify_path(pages(spark, sf), RULES).select("page_id", "url_group", "locale", "section")


def cfg_rules(spark, sf):
    requests = urls.classify_path(request_fields(spark, sf), SiteRules.from_profile(PROFILE))
    return count_by(requests, "url_group", "locale")


def qs_decode(spark, sf):
    return count_by(request_fields(spark, sf).select(utm.decode_twice(F.col("query_string")).alias("decoded")), "decoded")


def classify_page_referer(spark, sf):
    df = referers.classify_referer(pages(spark, sf), derived.SITE_DOMAIN, referer="url")
    return df.select("page_id", "referer_type", "referer_path")


# Reports ------------------------------------------------------------------------------------------------------


def report(name: str, source: str, *args, round_columns=(), dates=None, **kwargs) -> Query:
    def run(spark, sf):
        rows = {"parsed": parsed, "search_perf": search_perf}.get(source, lambda s, d: table(s, d, source))(spark, sf)
        if dates:
            rows = tables.between_dates(rows, *dates)
        return rounded(getattr(reports, name)(rows, *args, **kwargs), *round_columns)

    return run


def period_ranges(spark, sf):
    """The default, last-14 and comparison ranges of the requests, with their hits.

    The ranges come from the commit, and only their dates are read.
    """
    w = partly_filled(spark, sf)
    cur_from, cur_to, prev_from, prev_to = w.comparison()
    ranges = {"default7": w.default_range(), "last14": w.last_days(14), "current": (cur_from, cur_to), "previous": (prev_from, prev_to)}
    labels = F.filter(F.array(*[
        F.when(F.col("date").between(*r), F.struct(F.lit(n).alias("period"), F.lit(r[0]).cast("string").alias("date_from"),
                                                   F.lit(r[1]).cast("string").alias("date_to"))) for n, r in ranges.items()
    ]), lambda x: x.isNotNull())
    dates = {d for r in ranges.values() if r[0] for d in periods.date_list(*r)}
    days = w.parsed(sorted(dates)).groupBy("date").agg(F.count("*").alias("n"))
    return days.select(F.inline(labels), "n").groupBy("period", "date_from", "date_to").agg(F.sum("n").alias("hits"))


def trend_pct(spark, sf):
    return reports.with_trend(table(spark, sf, "locale_daily"), "locale", ["hits", "hits_human"], CURRENT, PREVIOUS)


def issue_bot_anomaly(spark, sf):
    """Bots whose last day stands out against the two days before."""
    return reports.issue_bot_anomaly(table(spark, sf, "bot_daily"), ("2024-01-04", LAST_DAY), ("2024-01-01", "2024-01-03"))


def filtered(spec: FilterSpec) -> Query:
    """Kept requests by path and status under a filter."""

    def run(spark, sf):
        kept = filters.apply(parsed(spark, sf), spec)
        return kept.groupBy("path", "status").agg(F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes_sent"))

    return run


def shaped(shape: Callable, spec: QuerySpec, *args) -> Query:
    def run(spark, sf):
        return shape(parsed(spark, sf), spec, *args)

    return run


def rows_nth(spark, sf):
    return query.rows_nth(parsed(spark, sf), 100).select("ts_utc", "path", "edge_ip", "status", "bytes_sent")


def q_detail(spark, sf):
    """The last request, found again by its time, path and address."""
    p = parsed(spark, sf)
    key = p.orderBy(F.desc("ts_utc"), "path", "edge_ip").select(
        "date", F.col("ts_utc").cast("string").alias("ts"), "path", "edge_ip").first()
    found = tables.detail(p, key.date, key.ts, key.path, key.edge_ip)
    return found.select("ts_utc", "path", "edge_ip", "method", "url_group", "locale", "referer_type")


def suggest_values_index(spark, sf):
    values = suggestions.field_values(parsed(spark, sf))
    return suggestions.suggest(values, suggestions.field_grams(values), "bot_family", "BOT", 5)


def unique_visitors_sketch(spark, sf):
    """Distinct addresses of a range by group, exact and whether the merged daily sketches keep their bound."""
    requests = tables.between_dates(parsed(spark, sf), *RANGE)
    estimated = sketches.unique_visitors(sketches.visitor_sketches(requests), "url_group").withColumnRenamed("unique_ips", "estimate")
    exact = requests.groupBy("url_group").agg(F.count_distinct("edge_ip").alias("unique_ips"))
    close = F.abs(F.col("estimate") - F.col("unique_ips")) <= F.ceil(F.col("unique_ips") * sketches.ERROR_BOUND)
    return exact.join(estimated, "url_group").select("url_group", "unique_ips", close.alias("within_bound"))


def q_histogram_totals(spark, sf):
    spec = QuerySpec()
    return rounded(query.histogram_totals(query.histogram(parsed(spark, sf), spec, "errors")), "error_pct")


def histogram(metric: str) -> Query:
    def run(spark, sf):
        out = query.histogram(parsed(spark, sf), QuerySpec(), metric)
        return rounded(out, "error_pct") if metric == "errors" else out

    return run


def preset(name: str) -> Query:
    return lambda spark, sf: query.run(parsed(spark, sf), presets.preset(name))


def view(name: str) -> Query:
    spec = QuerySpec(mode="group", group_by="url_group", filters=presets.with_view(name))
    return lambda spark, sf: query.run(parsed(spark, sf), spec)


def insight(name: str) -> Query:
    return lambda spark, sf: reports.insight(name, lambda t: table(spark, sf, t))


FILTERS = {
    "flt_status": FilterSpec(include={"status": (404, "500", "not a number")}),
    "flt_status_class": FilterSpec(include={"status_class": (1, 4, 5)}),
    "flt_in_list": FilterSpec(include={"method": ("GET",), "url_group": ("About", "Trading", "API"),
                                       "locale": ("fr", "en-gb", "no-locale"), "referer_type": ("Direct", "Social")}),
    "flt_is_bot": FilterSpec(is_bot=False),
    "flt_country": FilterSpec(include={"country": ("US", "JP")}),
    "flt_no_assets": FilterSpec(include_assets=False),
    "flt_content_only": FilterSpec(content_only=True),
    "flt_search": FilterSpec(search="GOOGLE", search_field="any"),
    "flt_search_not_contains": FilterSpec(search="google", search_mode="not_contains"),
    "flt_search_equals": FilterSpec(search="/en-GB/trading/", search_mode="equals", search_field="path"),
    "flt_search_starts_with": FilterSpec(search="10.0.3.", search_mode="starts_with", search_field="ip"),
    "flt_search_ends_with": FilterSpec(search=".png", search_mode="ends_with", search_field="path"),
    "flt_search_regex": FilterSpec(search=r"^/(FR|en)(/|$)", search_mode="regex", search_field="path"),
    "flt_search_family": FilterSpec(search="bot", search_field="user_agent_family"),
    "flt_search_host": FilterSpec(search="t.co", search_mode="equals", search_field="referer_host"),
    "flt_search_wildcard": FilterSpec(search="t_am-%", search_field="path"),
    "flt_path_prefix": FilterSpec(path_prefixes=("/un",), not_path_prefixes=("/unknown/page-1",)),
    "flt_path_rules": FilterSpec(path_rules=filters.parse_path_rules(
        ["contains:_nuxt", r"regex:^/fr/.*-[0-3]$"]), path_rules_join="or"),
    "flt_path_rules_and": FilterSpec(path_rules=(("contains", "/PAGE-"), ("not_contains", "-1"))),
    "flt_exclude": FilterSpec(exclude={"country": ("US",), "bot_family": ("Googlebot", "GPTBot"),
                                       "utm_source": ("news",), "status": (200,)}),
    "flt_time_brush": FilterSpec(time_brush=(1706054400000, 1704844800000)),
    "flt_search_operators": FilterSpec(search="status:4xx -bot_family:Googlebot is:bot utm:chatgpt.com /unknown|fr/"),
    "flt_like_escape": FilterSpec(path_rules=(("contains", "_"),)),
}

_SEARCH = "gsc_daily"
_STRATEGIC = "gsc_bot_daily"


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "src_raw_log": src_raw_log,
        "src_date_from_filename": src_date_from_filename,
        "src_incremental_files": src_incremental_files,
        "src_file_status": src_file_status,
        "src_date_range_rebuild": src_date_range_rebuild,
        "sink_parsed": sink_parsed,
        "sink_aggregate": sink_aggregate,
        "sink_empty_typed": sink_empty_typed,
        "scan_parsed_range": lambda s, d: count_by(tables.between_dates(parsed(s, d), *RANGE), "date", "url_group"),
        "scan_agg_range": lambda s, d: tables.between_dates(table(s, d, "daily"), None, RANGE[1]).select("date", "hits"),
        "scan_union_by_name": scan_union_by_name,
        "scan_schema_probe": scan_schema_probe,
        "src_search_perf": lambda s, d: rounded(search_perf(s, d), "ctr", "position"),
        "src_emptied_files": src_emptied_files,
        "cov_available_dates": cov_available_dates,
        "cov_freshness": cov_freshness,
        "cov_backfill_missing": cov_backfill_missing,
        "sink_csv_logs": csv_logs(QuerySpec(mode="timeseries")),
        "sink_csv_log_rows": csv_logs(QuerySpec(filters=FilterSpec(include={"status_class": (4, 5)}))),
        "sink_csv_log_groups": csv_logs(QuerySpec(mode="group", group_by="bot_family", group_by_2="status", filters=FilterSpec(is_bot=True))),
        "fix_country_type": fix_country_type,
        "cfg_rules": cfg_rules,
        # Row parsing and labels.
        "parse_line": parse_line,
        "parse_bad_lines": lambda s, d: enrich.bad_line_counts(broken_lines(s, d)),
        "parse_time": parse_time,
        "parse_request": parse_request,
        "status_class": lambda s, d: count_by(request_fields(s, d).select(
            "status", lines.status_class(F.col("status")).alias("status_class")), "status", "status_class"),
        "classify_bot": lambda s, d: count_by(agents.classify_bot(
            request_fields(s, d).withColumn("referer", F.lit(None).cast("string")), RULES),
            "user_agent", "is_bot", "bot_family", "bot_category"),
        "classify_bot_referer": lambda s, d: count_by(agents.classify_bot(request_fields(s, d), RULES),
                                                      "referer", "user_agent", "bot_family"),
        "path_normalise": lambda s, d: pages(s, d).select("page_id", urls.normalise_path(F.col("path")).alias("p")),
        "path_ext": lambda s, d: pages(s, d).select(
            "page_id", urls.path_extension(urls.normalise_path(F.col("path"))).alias("ext")),
        "url_group_rules": url_labels("path", "url_group"),
        "url_locale": url_labels("path", "locale", "url_group"),
        "url_section": url_labels("path", "section", "url_group"),
        "url_labels_pages": page_labels,
        "rules_diff": lambda s, d: reports.rules_diff(parsed(s, d), RULES, SiteRules.from_profile(PROFILE)),
        "is_resource": lambda s, d: count_by(parsed(s, d), "url_group", "is_resource"),
        "qs_decode": qs_decode,
        "parse_utm": lambda s, d: count_by(utm.parse_utm(request_fields(s, d)), "query_string", "has_utm",
                                           "utm_source", "utm_source_norm", "utm_medium", "utm_campaign"),
        "utm_clean": lambda s, d: count_by(utm.parse_utm(request_fields(s, d)).select("utm_source"), "utm_source"),
        "utm_chatgpt_flag": lambda s, d: count_by(parsed(s, d), "is_utm_chatgpt"),
        "referer_host": lambda s, d: pages(s, d).select("page_id", referers.referer_host(F.col("url")).alias("host")),
        "classify_referer": lambda s, d: count_by(parsed(s, d), "referer", "referer_type", "referer_path"),
        "classify_referer_pages": classify_page_referer,
    }
    q.update({name: (lambda s, d, n=name: table(s, d, n)) for name in aggregates.TABLES})
    q["bot_daily"] = lambda s, d: rounded(table(s, d, "bot_daily"), "resource_hits_pct")
    q["ai_crawler_daily"] = lambda s, d: rounded(table(s, d, "ai_crawler_daily"), "overlap_with_googlebot")
    q["gsc_daily"] = lambda s, d: rounded(table(s, d, "gsc_daily"), "ctr", "position")
    q["gsc_bot_daily"] = lambda s, d: rounded(table(s, d, "gsc_bot_daily"), "ctr", "position")
    q["gsc_bot_daily_spread"] = lambda s, d: rounded(
        search_join.gsc_bot_daily(parsed(s, d), search_perf(s, d), hot_rows=0), "ctr", "position")
    q["gsc_daily_deduped"] = lambda s, d: rounded(
        search_join.gsc_daily(parsed(s, d), search_perf(s, d), dedupe_pages=True), "ctr", "position")
    q.update({
        # Joins and windows.
        "join_key_norm": lambda s, d: pages(s, d).select("page_id", urls.page_join_key(F.col("path")).alias("norm_path")),
        "join_ref_update": lambda s, d: referers.classify_referer(parsed(s, d).drop("referer_type", "referer_path"),
                                                                  derived.SITE_DOMAIN)
        .groupBy("date", "referer_type").agg(F.count("*").alias("n")),
        "prev_period_join": trend_pct,
        "ai_overlap": lambda s, d: rounded(aggregates.crawler_pages(parsed(s, d)).groupBy("bot_family").agg(
            F.count("*").alias("pages"), F.count_if("by_googlebot").alias("shared_pages"),
            F.avg(F.when(F.col("by_googlebot"), 1.0).otherwise(0.0)).alias("overlap")), "overlap"),
        "topk_membership": lambda s, d: query.top_keys(query.stack_counts(parsed(s, d), QuerySpec(stack_by="path_segment_1"))),
        "lookup_dim_ua": lookup_dim_ua,
        "lookup_dim_path": lookup_dim_path,
        "lookup_dictionaries": labelled_by_dictionary,
        "top5_per_group": lambda s, d: aggregates.top_values(
            aggregates.facts(parsed(s, d)).where("is_bot"), "url_group", 5, "top_url_groups"),
        "error_spike_vs_mean": report("error_rate_vs_mean", "daily"),
        # Sorting and paging.
        "topk_desc": lambda s, d: table(s, d, "top_urls_daily").groupBy("path").agg(
            F.sum("hits_total").alias("hits")).orderBy(F.desc("hits"), "path").limit(20),
        "multi_key_sort": shaped(query.group, QuerySpec(mode="group", group_by="url_group", group_by_2="bot_family",
                                                        sort_by="waste_score", limit=40)),
        "rows_page": shaped(query.rows, QuerySpec(page=3, per_page=50, sort="bytes_sent", order="asc",
                                                  columns=("bytes_sent", "status", "method"))),
        "rows_count": shaped(query.rows_count, QuerySpec(filters=FilterSpec(search="status:404"))),
        "rows_nth": rows_nth,
        "rows_page_deep": lambda s, d: query.rows(loaded(s, d).parsed(), QuerySpec(
            page=14, per_page=50, sort="bytes_sent", columns=("bytes_sent", "status", "method")), shallow_rows=0),
    })
    q.update({name: filtered(spec) for name, spec in FILTERS.items()})
    q.update({
        # Query modes.
        "q_rows": shaped(query.rows, QuerySpec(date_from=RANGE[0], date_to=RANGE[1], per_page=200,
                                               filters=FilterSpec(include={"status_class": (5,)}))),
        "q_rows_export": shaped(query.rows_export, QuerySpec()),
        "q_group": shaped(query.group, QuerySpec(mode="group", group_by="country", group_by_2="status_class",
                                                 sort_by="unique_ips")),
        "dim_exprs": shaped(query.group, QuerySpec(mode="group", group_by="path_segment_2", group_by_2="path_depth")),
        "q_waste_score": shaped(query.group, QuerySpec(mode="group", group_by="bot_family", sort_by="waste_score")),
        "q_timeseries_status": shaped(query.timeseries, QuerySpec(mode="timeseries", date_from=MIDDLE, date_to=MIDDLE)),
        "q_timeseries_stacked": shaped(query.timeseries, QuerySpec(mode="timeseries", stack_by="path_segment_1")),
        "q_timeseries_wide": shaped(query.timeseries_wide, QuerySpec(mode="timeseries", stack_by="is_bot")),
        "q_histogram60": histogram("requests"),
        "q_histogram60_bytes": histogram("bytes"),
        "q_histogram60_status": histogram("status"),
        "q_histogram60_bots": histogram("bots"),
        "q_histogram60_errors": histogram("errors"),
        "q_histogram_totals": q_histogram_totals,
        "q_detail": q_detail,
        "unique_visitors_sketch": unique_visitors_sketch,
        # Values and suggestions.
        "distinct_agg_values": lambda s, d: tables.distinct_values(table(s, d, "locale_daily"), "locale"),
        "distinct_parsed_values": lambda s, d: tables.distinct_values(parsed(s, d), "country", keep_empty=False),
        "suggest_values": lambda s, d: tables.suggest_values(parsed(s, d), "bot_family", "BOT", 5),
        "suggest_values_index": suggest_values_index,
        # Reports.
        "period_default7": period_ranges,
        "period_last_n": period_ranges,
        "period_compare": period_ranges,
        "trend_pct": trend_pct,
        "summary_kpis": report("summary_kpis", "daily", CURRENT, PREVIOUS),
        "issue_404": report("issue_404", "top_4xx_daily"),
        "issue_5xx": report("issue_5xx", "top_5xx_daily"),
        "issue_wasteful_bot": report("issue_wasteful_bot", "wasted_crawl_daily"),
        "issue_bot_anomaly": issue_bot_anomaly,
        "issue_error_spike": lambda s, d: reports.issue_error_spike(table(s, d, "daily").where(F.col("hits") > 0)),
        "locale_totals": report("locale_totals", "locale_daily"),
        "locale_non_resource": report("locale_non_resource", "locale_daily"),
        "locale_group_matrix": report("locale_group_matrix", "locale_group_daily", ("About", "Trading", "Home")),
        "locale_groups": report("locale_groups", "locale_group_daily", locales=("fr", "en", "no-locale"), limit=5),
        "search_kpis": report("search_kpis", _SEARCH, CURRENT, PREVIOUS, round_columns=("avg_ctr", "avg_position")),
        "search_trend": report("search_trend", _SEARCH, round_columns=("avg_position",)),
        "search_top_pages": report("search_top_pages", _SEARCH, 10, round_columns=("avg_ctr", "avg_position")),
        "search_top_queries": report("search_top_queries", "search_perf", round_columns=("avg_ctr", "avg_position")),
        "crawl_no_impressions": report("crawl_no_impressions", _SEARCH),
        "impressions_no_crawl": report("impressions_no_crawl", _SEARCH, round_columns=("avg_position",)),
        "crawl_vs_position": report("crawl_vs_position", _SEARCH, round_columns=("avg_position",)),
        "strategic_bots": report("strategic_bots", _STRATEGIC),
        "strategic_kpis": report("strategic_kpis", _STRATEGIC),
        "strategic_by_class": report("strategic_by_class", _STRATEGIC),
        "strategic_top_wasted": report("strategic_top_wasted", _STRATEGIC),
        "strategic_top_good": report("strategic_top_good", _STRATEGIC, round_columns=("avg_position",)),
        "strategic_by_segment": report("strategic_by_segment", _STRATEGIC),
        "qa_no_locale": report("qa_no_locale_paths", "parsed"),
        "qa_no_locale_share": report("qa_no_locale_share", "parsed"),
        "qa_no_locale_groups": report("qa_no_locale_groups", "parsed"),
    })
    q.update({f"sink_csv_{n.replace('-', '_')}": csv_report(n) for n in reports.CSV_REPORTS})
    q.update({f"preset_{n.replace('-', '_')}": preset(n) for n in presets.PRESETS})
    q.update({f"view_{n.replace('-', '_')}": view(n) for n in presets.VIEWS})
    q.update({f"insight_{n.replace('-', '_')}": insight(n) for n in reports.INSIGHTS})
    return q
