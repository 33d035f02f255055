"""Daily aggregate tables of the parsed requests.

Every table is a sum over requests, so each function also accepts a pre-counted rollup: rows with a ``hits``
column (requests per row) and ``bytes_sent`` summed. ``plans.refresh`` uses that to read the requests once
for all tables of a kind; on the plain parsed table every row counts one.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitloom import defaults
from hitloom.functions import lines

# Single status codes counted in each table.
DAILY_CODES = (200, 301, 302, 304, 307, 308, 400, 403, 404, 410, 500, 502, 503)
REDIRECT_CODES = (301, 302, 303, 307, 308)
CLIENT_ERROR_CODES = (400, 401, 403, 404, 405, 410, 422, 429)
SERVER_ERROR_CODES = (500, 502, 503, 504)
TOP_URLS_PER_BOT = 50
TOP_VALUES_PER_CRAWLER = 5

FAILED = "status_class IN (4, 5)"
NOT_OK = "status_class IN (3, 4, 5)"


def facts(df: DataFrame) -> DataFrame:
    """Requests with a weight: the parsed table counts one per row, a rollup brings its own counts."""
    return df if "hits" in df.columns else df.withColumn("hits", F.lit(1).cast("long"))


def total(cond: str | None = None, measure: str = "hits") -> Column:
    """Sum of a measure over the rows that meet a condition."""
    value = F.col(measure)
    return F.sum(value if cond is None else F.when(F.expr(cond), value).otherwise(F.lit(0).cast("long")))


def named(**metrics: Column) -> list[Column]:
    return [c.alias(n) for n, c in metrics.items()]


def traffic() -> list[Column]:
    return named(hits=total(), hits_bot=total("is_bot"), hits_human=total("NOT is_bot"))


def classes() -> list[Column]:
    return [total(f"status_class = {c}").alias(f"s{c}xx") for c in (2, 3, 4, 5)]


def codes(values) -> list[Column]:
    return [total(f"status = {c}").alias(f"s{c}") for c in values]


def size() -> list[Column]:
    return named(bytes_sent=total(measure="bytes_sent"))


def resources() -> list[Column]:
    return named(
        resource_hits=total("is_resource"),
        resource_bytes_sent=total("is_resource", "bytes_sent"),
        resource_4xx=total("is_resource AND status_class = 4"),
        resource_5xx=total("is_resource AND status_class = 5"),
        resource_hits_bot=total("is_resource AND is_bot"),
        resource_4xx_bot=total("is_resource AND is_bot AND status_class = 4"),
        resource_5xx_bot=total("is_resource AND is_bot AND status_class = 5"),
    )


def resource_pair() -> list[Column]:
    return named(resource_hits=total("is_resource"), resource_hits_bot=total("is_resource AND is_bot"))


def waste() -> Column:
    """Crawl-waste score: parameterised, redirected and failed hits, the latter two again for assets."""
    return (total("is_parameterized") + total("status_class = 3") + total(FAILED)
            + total("is_resource AND is_parameterized") + total(f"is_resource AND {NOT_OK}"))


def family() -> Column:
    return F.coalesce("bot_family", F.lit(defaults.UNKNOWN_BOT)).alias("bot_family")


def locale() -> Column:
    return F.coalesce("locale", F.lit(defaults.NO_LOCALE)).alias("locale")


def daily(df: DataFrame) -> DataFrame:
    return facts(df).groupBy("date").agg(*traffic(), *classes(), *codes(DAILY_CODES), *size(), *resources())


def hour_of(df: DataFrame, time_zone: str = "UTC") -> DataFrame:
    """Add ``hour_local``, the hour in a time zone (a region name or an offset such as ``+08:00``)."""
    if "hour_local" in df.columns:
        return df
    local = F.col("ts_utc")
    if time_zone != "UTC":
        local = F.convert_timezone(F.lit("UTC"), F.lit(time_zone), local)
    return df.withColumn("hour_local", lines.truncate("hour", local))


def hourly(df: DataFrame, time_zone: str = "UTC") -> DataFrame:
    return facts(hour_of(df, time_zone)).groupBy("date", "hour_local").agg(
        *traffic(), *classes(), *size(), *resources())


def bot_daily(df: DataFrame) -> DataFrame:
    category = F.coalesce("bot_category", F.lit("Other")).alias("bot_category")
    return (
        facts(df).where("is_bot").groupBy("date", family(), category)
        .agg(total().alias("hits"), *classes(), *size(),
             *named(resource_hits=total("is_resource"), resource_errors=total(f"is_resource AND {NOT_OK}")))
        .withColumn("resource_hits_pct",
                    F.try_divide(F.col("resource_hits").cast("double"), F.col("hits").cast("double")))
    )


def locale_daily(df: DataFrame) -> DataFrame:
    return facts(df).groupBy("date", locale()).agg(*traffic(), *classes(), *size(), *resource_pair())


def group_daily(df: DataFrame) -> DataFrame:
    return facts(df).groupBy("date", "url_group").agg(*traffic(), *classes(), *size(), *resource_pair())


def locale_group_daily(df: DataFrame) -> DataFrame:
    return facts(df).groupBy("date", locale(), "url_group").agg(*traffic(), *classes(), *size())


def top_urls_daily(df: DataFrame) -> DataFrame:
    return facts(df).groupBy("date", "path", "url_group").agg(
        *named(hits_total=total(), hits_bot=total("is_bot"), hits_human=total("NOT is_bot"), s3xx=total("status_class = 3")),
        *codes(REDIRECT_CODES),
        *named(s4xx=total("status_class = 4"), s5xx=total("status_class = 5"), parameterized_hits=total("is_parameterized")),
        *size(),
    )


def top_4xx_daily(df: DataFrame) -> DataFrame:
    return facts(df).where("status_class = 4").groupBy("date", "path", "url_group").agg(
        *named(hits_4xx=total(), hits_4xx_bot=total("is_bot"), bytes_sent_4xx=total(measure="bytes_sent")),
        *codes(CLIENT_ERROR_CODES),
    )


def top_5xx_daily(df: DataFrame) -> DataFrame:
    return facts(df).where("status_class = 5").groupBy("date", "path", "url_group").agg(
        *named(hits_5xx=total(), hits_5xx_bot=total("is_bot")), *codes(SERVER_ERROR_CODES))


def wasted_crawl_daily(df: DataFrame) -> DataFrame:
    return facts(df).where("is_bot").groupBy("date", "path", "url_group", family()).agg(*named(
        bot_hits=total(),
        parameterized_bot_hits=total("is_parameterized"),
        redirect_bot_hits=total("status_class = 3"),
        error_bot_hits=total(FAILED),
        resource_bot_hits=total("is_resource"),
        resource_parameterized_bot_hits=total("is_resource AND is_parameterized"),
        resource_error_bot_hits=total(f"is_resource AND {NOT_OK}"),
        waste_score=waste(),
        waste_score_strict=waste() + total("is_resource"),
    ))


def top_resource_waste_daily(df: DataFrame) -> DataFrame:
    return facts(df).where("is_bot AND is_resource").groupBy("date", "path").agg(*named(
        bot_hits=total(),
        resource_error_bot_hits=total(NOT_OK),
        status_404_bot_hits=total("status = 404"),
        waste_score_strict=total(NOT_OK) + total(),
    ))


def human_urls_daily(df: DataFrame) -> DataFrame:
    return facts(df).where("NOT is_bot").groupBy("date", "path", "url_group").agg(total().alias("hits"))


def bot_urls_daily(df: DataFrame) -> DataFrame:
    return facts(df).where("is_bot").groupBy("date", family(), "path", "url_group").agg(total().alias("hits"))


def bot_top_urls_daily(df: DataFrame, n: int = TOP_URLS_PER_BOT) -> DataFrame:
    """The ``n`` most requested URLs per date and bot family.

    Spark keeps ``n`` rows per group before the shuffle, so a dominant bot does not overload a task.
    """
    order = W.partitionBy("date", "bot_family").orderBy(F.desc("hits"), "path", "url_group")
    return bot_urls_daily(df).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).drop("rn")


def utm_source_urls_daily(df: DataFrame) -> DataFrame:
    source = F.coalesce("utm_source_norm", F.lit(defaults.NO_UTM_SOURCE)).alias("utm_source")
    return facts(df).where("has_utm").groupBy("date", source, "path", "url_group").agg(*traffic())



def utm_sources_daily(df: DataFrame) -> DataFrame:
    source = F.coalesce("utm_source_norm", F.lit(defaults.NO_UTM_SOURCE)).alias("utm_source")
    return facts(df).where("has_utm").groupBy("date", source).agg(*traffic())


def utm_chatgpt_daily(df: DataFrame) -> DataFrame:
    return facts(df).where(F.col("utm_source_norm") == defaults.CHATGPT_SOURCE).groupBy("date").agg(*traffic())


def utm_chatgpt_urls_daily(df: DataFrame) -> DataFrame:
    return (facts(df).where(F.col("utm_source_norm") == defaults.CHATGPT_SOURCE)
            .groupBy("date", "path", "url_group").agg(total().alias("hits")))


def referer_flow_daily(df: DataFrame) -> DataFrame:
    """Page-to-page edges inside the site."""
    internal = (F.col("referer_type") == "Internal") & F.col("referer_path").isNotNull()
    return (
        facts(df).where(internal)
        .groupBy("date", F.col("referer_path").alias("from_path"), F.col("path").alias("to_path"), "referer_type")
        .agg(total().alias("hit_count"))
    )


def top_values(df: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """JSON list of the ``n`` most requested values per date and family; ties by value.

    Ranked before collecting, so a list never holds more than ``n`` values.
    """
    counts = df.groupBy("date", "bot_family", value).agg(total().alias("cnt"))
    order = W.partitionBy("date", "bot_family").orderBy(F.desc("cnt"), value)
    ranked = counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rn", value))), lambda s: s[value])
    return ranked.groupBy("date", "bot_family").agg(F.to_json(listed).alias(name))


def crawler_pages(df: DataFrame) -> DataFrame:
    """Distinct pages per date and AI crawler with hits, bytes and whether Googlebot read the page that day.

    One pass and one shuffle by page: a page holds at most one row per bot family.
    """
    google = F.col("bot_family") == "Googlebot"
    ai = F.col("bot_category") == "AI Crawler"
    pages = (
        facts(df).where(F.col("is_bot") & (ai | google)).groupBy("date", "path", "bot_family", ai.alias("is_ai"))
        .agg(total().alias("hits"), *size())
    )
    per_page = pages.groupBy("date", "path").agg(
        F.bool_or(google).alias("by_googlebot"),
        F.collect_list(F.when(F.col("is_ai"), F.struct("bot_family", "hits", "bytes_sent"))).alias("crawlers"),
    )
    return per_page.select("date", "path", "by_googlebot", F.inline("crawlers"))


def ai_crawler_daily(df: DataFrame) -> DataFrame:
    crawls = facts(df).where(F.col("is_bot") & (F.col("bot_category") == "AI Crawler"))
    base = crawler_pages(df).groupBy("date", "bot_family").agg(
        F.sum("hits").alias("total_hits"),
        F.count("*").alias("unique_urls"),
        F.sum("bytes_sent").alias("bytes_sent"),
        F.avg(F.when(F.col("by_googlebot"), 1.0).otherwise(0.0)).alias("overlap_with_googlebot"),
    )
    keys = ["date", "bot_family"]
    return (
        base.join(top_values(crawls, "url_group", TOP_VALUES_PER_CRAWLER, "top_url_groups"), keys, "left")
        .join(top_values(crawls, "locale", TOP_VALUES_PER_CRAWLER, "top_locales"), keys, "left")
        .select(*keys, "total_hits", "unique_urls", "bytes_sent",
                F.coalesce("top_url_groups", F.lit("[]")).alias("top_url_groups"),
                F.coalesce("top_locales", F.lit("[]")).alias("top_locales"),
                "overlap_with_googlebot")
    )


# Name to function, in the order the tables are written.
TABLES = {
    f.__name__: f
    for f in (
        daily, hourly, bot_daily, locale_daily, group_daily, locale_group_daily, top_urls_daily, top_4xx_daily,
        top_5xx_daily, wasted_crawl_daily, top_resource_waste_daily, bot_urls_daily, bot_top_urls_daily,
        human_urls_daily, utm_chatgpt_daily, utm_chatgpt_urls_daily, utm_sources_daily, utm_source_urls_daily,
        referer_flow_daily, ai_crawler_daily,
    )
}


def traffic_rollup(df: DataFrame, time_zone: str = "UTC") -> DataFrame:
    """Counts by everything but the page: enough for the tables without a path."""
    return facts(hour_of(df, time_zone)).groupBy(
        "date", "hour_local", "locale", "url_group", "is_resource", "is_bot", "bot_family", "bot_category",
        "status", "status_class",
    ).agg(total().alias("hits"), *size())


def page_rollup(df: DataFrame) -> DataFrame:
    """Counts by page and bot: enough for the tables with a path and for the search join."""
    return facts(df).groupBy(
        "date", "path", "locale", "url_group", "is_resource", "is_bot", "bot_family", "bot_category", "status",
        "status_class", "is_parameterized",
    ).agg(total().alias("hits"), *size())


def utm_rollup(df: DataFrame) -> DataFrame:
    return facts(df).where("has_utm").groupBy("date", "utm_source_norm", "has_utm", "path", "url_group", "is_bot").agg(
        total().alias("hits"))


# Which rollup each table is summed from; the remaining one reads the requests themselves.
FROM_TRAFFIC = ("daily", "hourly", "bot_daily", "locale_daily", "group_daily", "locale_group_daily")
FROM_PAGES = ("top_urls_daily", "top_4xx_daily", "top_5xx_daily", "wasted_crawl_daily", "top_resource_waste_daily",
              "bot_urls_daily", "bot_top_urls_daily", "human_urls_daily", "ai_crawler_daily")
FROM_UTM = ("utm_chatgpt_daily", "utm_chatgpt_urls_daily", "utm_sources_daily", "utm_source_urls_daily")
