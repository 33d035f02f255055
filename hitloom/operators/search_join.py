"""Crawl activity joined with search performance."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.defaults import UNKNOWN_BOT
from hitloom.functions import urls
from hitloom.operators import skew
from hitloom.operators.aggregates import FAILED, facts, named, total

# Fixed values, best first.
STRATEGIC_CLASSES = ("strategic_top10", "strategic_indexed", "strategic_ranked_low", "non_strategic_unindexed")
KEYS = ["date", "norm_path"]


def search_pages(perf: DataFrame, dedupe_pages: bool = False) -> DataFrame:
    """Page totals of the search table with the join key.

    Pages that differ only in query or trailing slash stay separate rows unless ``dedupe_pages`` is set;
    separate rows each meet the same crawl row.
    """
    pages = perf.where(F.col("query").isNull()).withColumn("page", urls.page_path(F.col("page")))
    if dedupe_pages:
        pages = pages.withColumn("page", urls.page_join_key(F.col("page")))
    return (
        pages.groupBy("date", "page")
        .agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.avg("ctr").alias("ctr"),
             F.avg("position").alias("position"))
        .withColumn("norm_path", urls.page_join_key(F.col("page")))
    )


def search_dates(perf: DataFrame) -> DataFrame:
    """Dates with page totals: one row per day, so broadcasting it is safe at any table size."""
    return F.broadcast(perf.where(F.col("query").isNull()).select("date").distinct())


def crawl_counts(parsed: DataFrame) -> DataFrame:
    return facts(parsed).groupBy("date", urls.join_key(F.col("path")).alias("norm_path")).agg(*named(
        crawl_hits=total(), bot_hits=total("is_bot"), human_hits=total("NOT is_bot")))


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def gsc_daily(parsed: DataFrame, perf: DataFrame, dedupe_pages: bool = False) -> DataFrame:
    """Search pages and crawled paths of a date, matched where both exist (a full outer join).

    Written as a left join plus the crawled paths without a search page: a left join can be split when one
    path has very many page variants, a full outer join cannot. Dates without search data are left out.
    """
    pages = search_pages(perf, dedupe_pages)
    crawls = crawl_counts(parsed).join(search_dates(perf), "date", "left_semi")
    matched = pages.join(crawls, KEYS, "left")
    unmatched = crawls.join(pages.select(*KEYS).distinct(), KEYS, "left_anti").withColumn("page", F.col("norm_path"))
    rows = matched.unionByName(unmatched, allowMissingColumns=True)
    zero = F.lit(0).cast("long")
    return rows.select(
        "date", "page",
        *[F.coalesce(c, zero).alias(c) for c in ("clicks", "impressions")],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ctr", "position")],
        *[F.coalesce(c, zero).alias(c) for c in ("crawl_hits", "bot_hits", "human_hits")],
        _flag(F.col("crawl_hits") > 0).alias("has_crawl_activity"),
        _flag(F.col("impressions") > 0).alias("has_impressions"),
        (_flag(F.col("impressions") > 0) | _flag(F.col("position") > 0)).alias("is_indexed"),
    )


def strategic_class(impressions: Column, position: Column) -> Column:
    seen, ranked = _flag(impressions > 0), _flag(position > 0)
    names = [F.lit(c) for c in STRATEGIC_CLASSES]
    return (F.when(seen & ranked & (position <= 10), names[0]).when(seen, names[1]).when(ranked, names[2])
            .otherwise(names[3]))


def gsc_bot_daily(parsed: DataFrame, perf: DataFrame, dedupe_pages: bool = False, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Crawled paths per bot with their search signals and the class of crawl they are."""
    pages = search_pages(perf, dedupe_pages)
    crawls = (
        facts(parsed).where("is_bot")
        .groupBy("date", urls.join_key(F.col("path")).alias("norm_path"),
                 F.coalesce("bot_family", F.lit(UNKNOWN_BOT)).alias("bot_family"))
        .agg(*named(crawl_hits=total(), ok_hits=total("status_class = 2"), redirect_hits=total("status_class = 3"),
                    err_hits=total(FAILED), param_hits=total("is_parameterized"), resource_hits=total("is_resource")))
        .join(search_dates(perf), "date", "left_semi")
    )
    zero = F.lit(0).cast("long")
    # A page may have very many variants in the search data, few bots crawl it: the side that a left join cannot split.
    return skew.left_join(crawls, pages.drop("page"), KEYS, hot_rows).select(
        "date", "bot_family", F.col("norm_path").alias("page"),
        "crawl_hits", "ok_hits", "redirect_hits", "err_hits", "param_hits", "resource_hits",
        F.coalesce("clicks", zero).alias("clicks"),
        F.coalesce("impressions", zero).alias("impressions"),
        F.coalesce("ctr", F.lit(0.0)).alias("ctr"),
        "position",
        _flag(F.col("impressions") > 0).alias("has_impressions"),
        (_flag(F.col("impressions") > 0) | _flag(F.col("position") > 0)).alias("is_indexed"),
        strategic_class(F.col("impressions"), F.col("position")).alias("strategic_class"),
    )
