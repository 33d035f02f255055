"""Reports over the daily aggregate tables.

Each function takes the aggregate tables it needs, already limited to the wanted dates unless it compares
periods, and returns a DataFrame. ``Period`` pairs are ``(from, to)`` date strings, both included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.defaults import INFRASTRUCTURE_GROUPS, NO_LOCALE
from hitloom.operators.search_join import STRATEGIC_CLASSES
from hitloom.operators.tables import between_dates
from hitloom.plans import periods

Period = tuple[str, str]
ISSUES_PER_KIND = 5


def sums(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double")), digits)


def in_period(period: Period) -> Column:
    return F.col("date").between(*period)


def by_period(table: DataFrame, current: Period, previous: Period) -> DataFrame:
    """Rows of both periods in one scan, labelled ``current`` or ``previous``."""
    label = F.when(in_period(current), F.lit("current")).otherwise(F.lit("previous"))
    return table.where(in_period(current) | in_period(previous)).withColumn("period", label)


def with_trend(table: DataFrame, key: str, metrics, current: Period, previous: Period) -> DataFrame:
    """Sums per key in the current period, the previous sums, and the change of each metric.

    Keys seen only in the previous period are left out. Both periods come from one scan and one shuffle.
    """
    cur, prev = (F.col("period") == "current"), (F.col("period") == "previous")
    rows = by_period(table, current, previous).groupBy(key).agg(
        F.count_if(cur).alias("_n"),
        *[F.coalesce(F.sum(F.when(cur, F.col(m))), F.lit(0)).alias(m) for m in metrics],
        *[F.coalesce(F.sum(F.when(prev, F.col(m))), F.lit(0)).alias(f"{m}_prev") for m in metrics],
    ).where(F.col("_n") > 0)
    changes = []
    for m in metrics:
        change, direction = periods.trend(F.col(m), F.col(f"{m}_prev"))
        changes += [F.round(change, 4).alias(f"{m}_chg_pct"), direction.alias(f"{m}_trend")]
    return rows.select(key, *metrics, *[f"{m}_prev" for m in metrics], *changes)


# Summary --------------------------------------------------------------------------------------------------


def summary_kpis(daily: DataFrame, current: Period, previous: Period) -> DataFrame:
    return by_period(daily, current, previous).groupBy("period").agg(
        F.sum("hits").alias("hits"), F.sum("hits_human").alias("human"), F.sum("hits_bot").alias("bot"),
        F.sum(F.col("s4xx") + F.col("s5xx")).alias("errors"),
        pct(F.sum(F.col("s4xx") + F.col("s5xx")), F.sum("hits")).alias("error_pct"),
        F.sum("bytes_sent").alias("bytes"),
    )


def issue_404(top_4xx_daily: DataFrame, limit: int = ISSUES_PER_KIND) -> DataFrame:
    """Of the ``limit`` paths with most human client errors, those with more than ten."""
    top = (
        top_4xx_daily.groupBy("path")
        .agg(F.sum("s404").alias("errors"), F.sum(F.col("hits_4xx") - F.col("hits_4xx_bot")).alias("human_errors"))
        .where(F.col("errors") > 0).orderBy(F.desc("human_errors"), "path").limit(limit)
    )
    human = F.col("human_errors")
    return top.where(human > 10).withColumn("severity", F.when(human > 100, "high").otherwise("medium"))


def issue_5xx(top_5xx_daily: DataFrame, limit: int = ISSUES_PER_KIND) -> DataFrame:
    errors, days = F.col("errors"), F.col("days_affected")
    top = (
        top_5xx_daily.groupBy("path")
        .agg(F.sum("hits_5xx").alias("errors"), F.count_distinct("date").alias("days_affected"))
        .where(errors > 0).orderBy(F.desc("errors"), "path").limit(limit)
    )
    return top.where(errors > 5).withColumn(
        "severity", F.when((errors > 50) | (days > 3), "high").otherwise("medium"))


def issue_wasteful_bot(wasted_crawl_daily: DataFrame, limit: int = ISSUES_PER_KIND) -> DataFrame:
    top = (
        wasted_crawl_daily.groupBy("bot_family")
        .agg(F.sum("bot_hits").alias("hits"), F.sum("error_bot_hits").alias("errors"),
             F.sum("waste_score").alias("waste"))
        .orderBy(F.desc("waste"), "bot_family").limit(limit)
    )
    return (top.where(F.col("waste") > 50)
            .withColumn("error_pct", pct(F.col("errors"), F.col("hits")))
            .withColumn("severity", F.when(F.col("waste") > 200, "medium").otherwise("low")))


def issue_bot_anomaly(bot_daily: DataFrame, current: Period, previous: Period) -> DataFrame:
    """Bots that are new, or more than three times as active as in the previous period."""
    hits, before = F.col("hits"), F.col("prev_hits")
    cur, prev = (F.col("period") == "current"), (F.col("period") == "previous")
    bots = by_period(bot_daily, current, previous).groupBy("bot_family").agg(
        F.coalesce(F.sum(F.when(cur, F.col("hits"))), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(prev, F.col("hits"))), F.lit(0)).alias("prev_hits"),
    )
    kind = F.when((before == 0) & (hits > 50), F.lit("new")).when(
        (before > 0) & (hits > before * 3) & (hits > 100), F.lit("spike"))
    return (bots.withColumn("kind", kind).where(F.col("kind").isNotNull())
            .withColumn("change_pct", pct(hits - before, before, 0)))


def issue_error_spike(daily: DataFrame) -> DataFrame:
    """Days whose error rate is above 5 % and above twice the mean of the period."""
    days = daily.where(F.col("hits") > 0).select(
        "date", "hits", pct(F.col("s4xx") + F.col("s5xx"), F.col("hits")).alias("error_pct"))
    mean = days.agg(F.avg("error_pct").alias("m")).scalar()
    return (days.withColumn("avg_pct", F.round(mean, 6))
            .where((F.col("avg_pct") > 0) & (F.col("error_pct") > mean * 2) & (F.col("error_pct") > 5)))


def error_rate_vs_mean(daily: DataFrame) -> DataFrame:
    """Error rate of each day next to the mean of all days."""
    days = daily.where(F.col("hits") > 0).select(
        "date", pct(F.col("s4xx") + F.col("s5xx"), F.col("hits")).alias("error_pct"))
    mean = days.agg(F.avg("error_pct").alias("m")).scalar()
    return days.withColumn("avg_pct", F.round(mean, 6)).withColumn(
        "ratio", F.round(F.try_divide(F.col("error_pct"), mean), 6))


# Locales --------------------------------------------------------------------------------------------------


def _folded() -> Column:
    unknown = F.col("locale").isNull() | (F.col("locale") == "Unknown")
    return F.when(unknown, F.lit(NO_LOCALE)).otherwise(F.col("locale")).alias("locale")


def locale_totals(locale_daily: DataFrame) -> DataFrame:
    return locale_daily.groupBy(_folded()).agg(*sums(
        "hits", "hits_bot", "hits_human", "s4xx", "s5xx", "resource_hits", "resource_hits_bot",
    )).orderBy(F.desc("hits"), "locale")


def locale_non_resource(locale_daily: DataFrame) -> DataFrame:
    t = locale_daily.groupBy(_folded()).agg(*sums(
        "hits", "hits_bot", "hits_human", "resource_hits", "resource_hits_bot"))
    return t.select(
        "locale",
        (F.col("hits") - F.col("resource_hits")).alias("hits_non_resource"),
        (F.col("hits_bot") - F.col("resource_hits_bot")).alias("hits_bot_non_resource"),
        (F.col("hits_human") - (F.col("resource_hits") - F.col("resource_hits_bot"))).alias("hits_human_non_resource"),
    ).orderBy(F.desc("hits_non_resource"), "locale")


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def locale_groups(locale_group_daily: DataFrame, locales=(), url_groups=(), limit: int | None = 200) -> DataFrame:
    """Locales and URL groups with most hits; all of them without a limit."""
    df = locale_group_daily
    if locales:
        df = df.where(F.col("locale").isin(list(locales)))
    if url_groups:
        df = df.where(F.col("url_group").isin(list(url_groups)))
    return df.groupBy("locale", "url_group").agg(*sums("hits", "hits_bot", "hits_human", "s4xx", "s5xx")).orderBy(
        F.desc("hits"), "locale", "url_group").transform(first_rows, limit)


def locale_group_matrix(locale_group_daily: DataFrame, url_groups, locales=()) -> DataFrame:
    """Hits by locale, of every locale, with one column per listed URL group."""
    cells = locale_groups(locale_group_daily, locales, url_groups, limit=None)
    return cells.groupBy("locale").pivot("url_group", list(url_groups)).agg(F.sum("hits")).na.fill(0).orderBy("locale")


# Search ---------------------------------------------------------------------------------------------------


def _shown(metric: str) -> Column:
    return F.avg(F.when(F.col("impressions") > 0, F.col(metric)))


def search_kpis(gsc_daily: DataFrame, current: Period, previous: Period) -> DataFrame:
    return by_period(gsc_daily, current, previous).where("has_impressions").groupBy("period").agg(
        F.sum("clicks").alias("total_clicks"), F.sum("impressions").alias("total_impressions"),
        _shown("ctr").alias("avg_ctr"), _shown("position").alias("avg_position"))


def search_trend(gsc_daily: DataFrame) -> DataFrame:
    return gsc_daily.where("has_impressions").groupBy("date").agg(
        *sums("clicks", "impressions"), _shown("position").alias("avg_position")).orderBy("date")


def _averages() -> list[Column]:
    return [F.avg("ctr").alias("avg_ctr"), F.avg("position").alias("avg_position")]


def search_top_pages(gsc_daily: DataFrame, limit: int | None = 200) -> DataFrame:
    return gsc_daily.where("has_impressions").groupBy("page").agg(
        *sums("clicks", "impressions"), *_averages(), *sums("crawl_hits")).orderBy(
        F.desc("clicks"), "page").transform(first_rows, limit)


def search_top_queries(search_perf: DataFrame, limit: int = 200) -> DataFrame:
    return search_perf.where(F.col("query").isNotNull()).groupBy("query").agg(
        *sums("clicks", "impressions"), *_averages()).orderBy(F.desc("impressions"), "query").limit(limit)


def crawl_no_impressions(gsc_daily: DataFrame, limit: int | None = 200) -> DataFrame:
    return gsc_daily.where(F.col("crawl_hits") > 0).groupBy("page").agg(
        *sums("crawl_hits", "bot_hits", "impressions")).where(F.col("impressions") == 0).orderBy(
        F.desc("crawl_hits"), "page").transform(first_rows, limit)


def impressions_no_crawl(gsc_daily: DataFrame, limit: int | None = 200) -> DataFrame:
    return gsc_daily.where(F.col("impressions") > 0).groupBy("page").agg(
        *sums("impressions", "clicks"), F.avg("position").alias("avg_position"), *sums("crawl_hits"),
    ).where(F.col("crawl_hits") == 0).orderBy(F.desc("impressions"), "page").transform(first_rows, limit)


def crawl_vs_position(gsc_daily: DataFrame, limit: int = 200) -> DataFrame:
    both = (F.col("crawl_hits") > 0) & (F.col("impressions") > 0)
    return gsc_daily.where(both).groupBy("page").agg(
        *sums("crawl_hits"), F.avg("position").alias("avg_position"), *sums("impressions", "clicks"),
    ).orderBy(F.desc("crawl_hits"), "page").limit(limit)


# Strategic crawl ------------------------------------------------------------------------------------------

GOOD_CLASSES, WASTED_CLASS = STRATEGIC_CLASSES[:3], STRATEGIC_CLASSES[3]


def strategic_bots(gsc_bot_daily: DataFrame, limit: int = 30) -> DataFrame:
    return gsc_bot_daily.groupBy("bot_family").agg(F.sum("crawl_hits").alias("hits")).orderBy(
        F.desc("hits"), "bot_family").limit(limit)


def choose_bot(gsc_bot_daily: DataFrame, wanted: str = "Googlebot") -> str:
    """The wanted bot if the table has it, else Googlebot, else the most active one."""
    for bot in dict.fromkeys((wanted, "Googlebot")):
        if not _of_bot(gsc_bot_daily, bot).limit(1).isEmpty():
            return bot
    first = strategic_bots(gsc_bot_daily, 1).first()
    return first.bot_family if first else wanted


def _of_bot(gsc_bot_daily: DataFrame, bot: str) -> DataFrame:
    return gsc_bot_daily.where(F.col("bot_family") == bot)


def strategic_kpis(gsc_bot_daily: DataFrame, bot: str = "Googlebot") -> DataFrame:
    klass = F.col("strategic_class")

    def crawls(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("crawl_hits")).otherwise(F.lit(0).cast("long")))

    return _of_bot(gsc_bot_daily, bot).agg(
        F.sum("crawl_hits").alias("total_crawl"),
        crawls(klass.isin(*GOOD_CLASSES)).alias("strategic_crawl"),
        crawls(klass == STRATEGIC_CLASSES[0]).alias("top10_crawl"),
        crawls(klass == WASTED_CLASS).alias("non_strategic_crawl"),
        F.count_distinct("page").alias("unique_pages"),
        crawls(F.col("is_indexed")).alias("indexed_crawl"),
    )


def strategic_by_class(gsc_bot_daily: DataFrame, bot: str = "Googlebot") -> DataFrame:
    """Crawl hits and distinct pages per class, best class first."""
    rows = _of_bot(gsc_bot_daily, bot)
    whole = rows.agg(F.sum("crawl_hits").alias("n")).scalar()
    rank = F.array_position(F.array(*[F.lit(c) for c in STRATEGIC_CLASSES]), F.col("strategic_class"))
    return (
        rows.groupBy("strategic_class").agg(F.sum("crawl_hits").alias("hits"), F.count_distinct("page").alias("pages"))
        .withColumn("pct_of_total", pct(F.col("hits"), whole)).orderBy(rank)
    )


def strategic_top_wasted(gsc_bot_daily: DataFrame, bot: str = "Googlebot", limit: int = 100) -> DataFrame:
    return _of_bot(gsc_bot_daily, bot).where(F.col("strategic_class") == WASTED_CLASS).groupBy("page").agg(
        *sums("crawl_hits", "err_hits", "param_hits")).orderBy(F.desc("crawl_hits"), "page").limit(limit)


def strategic_top_good(gsc_bot_daily: DataFrame, bot: str = "Googlebot", limit: int = 100) -> DataFrame:
    good = F.col("strategic_class").isin(*STRATEGIC_CLASSES[:2])
    return _of_bot(gsc_bot_daily, bot).where(good).groupBy("page").agg(
        *sums("crawl_hits", "impressions", "clicks"), F.avg("position").alias("avg_position"),
    ).orderBy(F.desc("crawl_hits"), "page").limit(limit)


def strategic_by_segment(gsc_bot_daily: DataFrame, bot: str = "Googlebot", limit: int = 30) -> DataFrame:
    first = F.get(F.filter(F.split("page", "/"), lambda s: s != ""), F.lit(0))
    return (
        _of_bot(gsc_bot_daily, bot).where(F.col("strategic_class") == WASTED_CLASS)
        .groupBy(F.coalesce(first, F.lit("(root)")).alias("path_segment_1"))
        .agg(F.sum("crawl_hits").alias("crawl_hits"), F.count_distinct("page").alias("unique_pages"))
        .orderBy(F.desc("crawl_hits"), "path_segment_1").limit(limit)
    )


# Quality of locale detection --------------------------------------------------------------------------------


def qa_no_locale_share(parsed: DataFrame) -> DataFrame:
    none = F.count_if(F.col("locale") == NO_LOCALE)
    return parsed.agg(F.count("*").alias("total_rows"), none.alias("no_locale_rows"),
                      pct(none, F.count("*")).alias("pct"))


def qa_no_locale_groups(parsed: DataFrame) -> DataFrame:
    return (parsed.where(F.col("locale") == NO_LOCALE).groupBy("url_group").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "url_group"))


def qa_no_locale_paths(parsed: DataFrame, top: int = 30) -> DataFrame:
    """Most requested paths without locale; ``unexpected`` marks those outside the infrastructure groups."""
    return (
        parsed.where(F.col("locale") == NO_LOCALE).groupBy("path", "url_group").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "path", "url_group").limit(top)
        .withColumn("unexpected", ~F.col("url_group").isin(*INFRASTRUCTURE_GROUPS))
    )


def rules_diff(parsed: DataFrame, current, candidate) -> DataFrame:
    """Hits whose group or locale would change under another rule set.

    Both rule sets run once per distinct path, not per request.
    """
    from hitloom.functions.urls import classify_path

    paths = parsed.groupBy("path").agg(F.count("*").alias("hits"))
    old = classify_path(paths, current).withColumnsRenamed({"url_group": "old_group", "locale": "old_locale"})
    both = classify_path(old.drop("section"), candidate).withColumnsRenamed(
        {"url_group": "new_group", "locale": "new_locale"})
    changed = (F.col("old_group") != F.col("new_group")) | (F.col("old_locale") != F.col("new_locale"))
    return (both.where(changed).groupBy("old_group", "new_group", "old_locale", "new_locale")
            .agg(F.count("*").alias("paths"), F.sum("hits").alias("hits")))


# Saved questions --------------------------------------------------------------------------------------------

TOP = 20


def _top(table: DataFrame, key: str, limit: int = TOP, order: str | None = None, **metrics: Column) -> DataFrame:
    rows = table.groupBy(key).agg(*[c.alias(n) for n, c in metrics.items()])
    return rows.orderBy(F.desc(order or next(iter(metrics))), key).limit(limit)


def _errors() -> Column:
    return F.col("s4xx") + F.col("s5xx")


# Question id to (table, function of that table).
INSIGHTS = {
    "busiest-days": ("daily", lambda t: t.select("date", "hits", "hits_human", "hits_bot").orderBy(
        F.desc("hits"), "date").limit(TOP)),
    "bot-vs-human": ("daily", lambda t: t.select("date", "hits_human", "hits_bot").orderBy("date")),
    "traffic-trend": ("daily", lambda t: t.select("date", "hits").orderBy("date")),
    "error-rate-trend": ("daily", lambda t: t.where(F.col("hits") > 0).select(
        "date", pct(_errors(), F.col("hits")).alias("error_pct")).orderBy("date")),
    "top-pages": ("human_urls_daily", lambda t: _top(t, "path", hits=F.sum("hits"))),
    "top-url-groups": ("group_daily", lambda t: _top(t, "url_group", human_hits=F.sum("hits_human"))),
    "heaviest-pages": ("top_urls_daily", lambda t: _top(
        t.where(F.col("hits_total") > 0), "path",
        avg_bytes=F.round(F.try_divide(F.sum("bytes_sent").cast("double"), F.sum("hits_total").cast("double")), 0))),
    "top-404": ("top_4xx_daily", lambda t: _top(t, "path", errors=F.sum("s404"))),
    "top-5xx": ("top_5xx_daily", lambda t: _top(t, "path", errors=F.sum("hits_5xx"))),
    "top-redirects": ("top_urls_daily", lambda t: _top(t, "path", redirects=F.sum("s3xx"))),
    "top-bots": ("bot_daily", lambda t: _top(t, "bot_family", hits=F.sum("hits"))),
    "wasted-bot-crawl": ("wasted_crawl_daily", lambda t: _top(
        t, "bot_family", order="avg_waste", hits=F.sum("bot_hits"), errors=F.sum("error_bot_hits"),
        avg_waste=F.round(F.avg("waste_score"), 2))),
    "bot-trend": ("daily", lambda t: t.select("date", "hits_bot").orderBy("date")),
    "bot-error-rates": ("bot_daily", lambda t: t.groupBy("bot_family").agg(*sums("s4xx", "s5xx", "hits")).orderBy(
        F.desc(_errors()), "bot_family").limit(TOP)),
    "top-locales": ("locale_daily", lambda t: _top(t, "locale", human_hits=F.sum("hits_human"))),
    "locale-error-rates": ("locale_daily", lambda t: _top(
        t.where(F.col("hits") > 0), "locale", order="error_pct", errors=F.sum(_errors()), hits=F.sum("hits"),
        error_pct=pct(F.sum(_errors()), F.sum("hits")))),
    "utm-sources": ("utm_sources_daily", lambda t: _top(t, "utm_source", hits=F.sum("hits_human"))),
    "utm-top-pages": ("utm_source_urls_daily", lambda t: _top(t, "path", hits=F.sum("hits_human"))),
}


def insight(name: str, tables, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Answer of a saved question; ``tables`` gives a DataFrame for a table name."""
    table, answer = INSIGHTS[name]
    return answer(between_dates(tables(table), date_from, date_to))


# CSV reports ------------------------------------------------------------------------------------------------


def csv_columns(df: DataFrame) -> DataFrame:
    """Text forms of the CSV files: click rate as a percentage, position with one decimal."""

    def decimals(c: Column, form: str) -> Column:
        return F.call_function("format_number", c, F.lit(form))  # rounds the exact value, unlike format_string

    forms = {"avg_ctr": lambda c: F.concat(decimals(c * 100.0, "0.00"), F.lit("%")),
             "avg_position": lambda c: decimals(c, "0.0")}
    return df.select(*[forms[c](F.col(c)).alias(c) if c in forms else F.col(c) for c in df.columns])


CSV_REPORTS = {
    "locales": ("locale_daily", lambda t, n: t.groupBy("locale").agg(*sums(
        "hits", "hits_bot", "hits_human", "s4xx", "s5xx", "resource_hits", "resource_hits_bot",
    )).orderBy(F.desc("hits"), "locale")),
    "locale-groups": ("locale_group_daily", lambda t, n: locale_groups(t, limit=n)),
    "gsc-top-clicks": ("gsc_daily", lambda t, n: csv_columns(search_top_pages(t, n))),
    "gsc-high-crawl-no-impressions": ("gsc_daily", lambda t, n: crawl_no_impressions(t, n)),
    "gsc-impressions-no-crawl": ("gsc_daily", lambda t, n: csv_columns(impressions_no_crawl(t, n))),
}


def csv_report(name: str, tables, date_from=None, date_to=None, limit: int | None = None) -> DataFrame:
    """The rows of a report file: all of them without a limit."""
    table, build = CSV_REPORTS[name]
    return build(between_dates(tables(table), date_from, date_to), limit)
