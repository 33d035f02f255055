"""Ad-hoc queries on the parsed requests: rows, groups, time series and the 60-bucket histogram."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.functions import lines, urls
from hitloom.operators import filters, ranks, tables
from hitloom.operators.aggregates import waste
from hitloom.operators.filters import FilterSpec

# Columns that requests can be grouped, stacked and sorted by, and those shown and exported.
GROUP_COLUMNS = (
    "path", "path_segment_1", "path_segment_2", "path_depth", "url_group", "bot_family", "bot_category", "status",
    "status_class", "locale", "country", "referer_type", "referer_path", "utm_source_norm", "method", "is_bot",
)
STACK_COLUMNS = ("is_bot", "status_class", "bot_family", "url_group", "path_segment_1", "method", "referer_type",
                 "country")
SORT_METRICS = {"hits": "hits", "bytes": "bytes_total", "unique_ips": "unique_ips", "waste_score": "waste_score"}
DEFAULT_COLUMNS = (
    "ts_utc", "method", "path", "status", "bytes_sent", "edge_ip", "country", "locale", "is_bot", "bot_family",
    "user_agent", "url_group", "referer", "referer_type", "utm_source_norm",
)
EXPORT_COLUMNS = (
    "ts_utc", "edge_ip", "method", "path", "status", "bytes_sent", "is_bot", "bot_family", "bot_category",
    "user_agent", "url_group", "locale", "referer", "referer_type", "utm_source_norm", "country",
)
ROW_KEY = ("ts_utc", "path", "edge_ip")
# Breaks ties between requests of the same second, so that pages do not overlap.
TIE_BREAK = (*ROW_KEY, "method", "status", "bytes_sent", "user_agent", "request_target", "referer")
# Largest page that ``rows`` gives; exports give all rows.
MAX_PER_PAGE = 1_000
STACK_LIMIT = 8
OTHER = "Other"
BUCKETS = 60


@dataclass(frozen=True)
class QuerySpec:
    """A whole query: what to keep, how to shape it."""

    mode: str = "rows"  # rows | group | timeseries
    filters: FilterSpec = field(default_factory=FilterSpec)
    date_from: str | None = None
    date_to: str | None = None
    columns: tuple[str, ...] = DEFAULT_COLUMNS
    sort: str = "ts_utc"
    order: str = "desc"
    page: int = 1
    per_page: int = 100
    group_by: str = "path"
    group_by_2: str | None = None
    sort_by: str = "hits"
    limit: int = 500
    bucket: str | None = None
    stack_by: str = ""


def run(parsed: DataFrame, spec: QuerySpec) -> DataFrame:
    modes = {"group": group, "timeseries": timeseries}
    return modes.get(spec.mode, rows)(parsed, spec)


def selected(parsed: DataFrame, spec: QuerySpec) -> DataFrame:
    return filters.apply(tables.between_dates(parsed, spec.date_from, spec.date_to), spec.filters)


# Rows -----------------------------------------------------------------------------------------------------


def _ties(df: DataFrame) -> list[str]:
    return tables.known_columns(df, TIE_BREAK)


def _order(df: DataFrame, sort: str, ascending: bool) -> ranks.Order:
    return [(sort, ascending), *[(c, True) for c in _ties(df) if c != sort]]


def rows(parsed: DataFrame, spec: QuerySpec, shallow_rows: int = ranks.SHALLOW_ROWS) -> DataFrame:
    """One page of requests; the key columns are always included. Deep pages are found by counting, not by sorting."""
    if spec.page < 1 or not 1 <= spec.per_page <= MAX_PER_PAGE:
        raise ValueError(f"page must be 1 or more and per_page 1 to {MAX_PER_PAGE}")
    sort = spec.sort if spec.sort in parsed.columns else "ts_utc"
    columns = tables.known_columns(parsed, (*ROW_KEY, *spec.columns))
    df = selected(parsed, spec)
    order = _order(df, sort, spec.order.lower() == "asc")
    return ranks.page(df, order, (spec.page - 1) * spec.per_page, spec.per_page, shallow_rows).select(*columns)


def rows_count(parsed: DataFrame, spec: QuerySpec) -> DataFrame:
    return selected(parsed, spec).agg(F.count("*").alias("total"))


def rows_nth(parsed: DataFrame, n: int, shallow_rows: int = ranks.SHALLOW_ROWS) -> DataFrame:
    """The ``n``-th request (from 0) in time order."""
    if n < 0:
        raise ValueError("n must not be negative")
    return ranks.page(parsed, [(c, True) for c in _ties(parsed)], n, 1, shallow_rows)


def rows_export(parsed: DataFrame, spec: QuerySpec) -> DataFrame:
    """All requests, newest first, fixed columns."""
    df = selected(parsed, spec)
    if "country" not in df.columns:
        df = df.withColumn("country", F.lit(None).cast("string"))
    return df.orderBy(F.desc("ts_utc"), *[c for c in _ties(df) if c != "ts_utc"]).select(*EXPORT_COLUMNS)


def export_csv(parsed: DataFrame, spec: QuerySpec, path: str) -> None:
    """Write the result of a query as CSV with a header, times as text: all rows, the groups, or the time series.

    Rows come in one file per sorted range; groups and series, which have a limit or one row per hour, in one file.
    """
    out = {"group": group, "timeseries": timeseries}.get(spec.mode, rows_export)(parsed, spec)
    times = [f.name for f in out.schema if f.dataType.typeName().startswith("timestamp")]
    out = out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times})
    if spec.mode in ("group", "timeseries"):
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", "true").csv(path)


# Groups ---------------------------------------------------------------------------------------------------


def dimension(name: str, columns) -> Column:
    """Grouping expression of a dimension; missing values get a label."""
    if name == "country" and "country" not in columns:
        return F.lit(None).cast("string")
    if name == "is_bot":
        return F.when(F.col("is_bot"), F.lit("Bot")).otherwise(F.lit("Human"))
    if name == "status_class":
        return F.coalesce(F.col("status_class").cast("string"), F.lit(""))
    if name == "status":
        return F.col("status").cast("string")
    segs = urls.request_segments(F.col("path"))
    if name == "path_segment_1":
        return F.coalesce(F.get(segs, F.lit(0)), F.lit("(root)"))
    if name == "path_segment_2":
        return F.coalesce(F.get(segs, F.lit(1)), F.lit("(none)"))
    if name == "path_depth":
        return F.size(segs).cast("string")
    return F.coalesce(F.col(name), F.lit("(none)"))


def group_keys(parsed: DataFrame, spec: QuerySpec) -> list[str]:
    usable = [c for c in GROUP_COLUMNS if c != "country" or "country" in parsed.columns]
    if spec.group_by not in usable:
        raise ValueError(f"cannot group by {spec.group_by!r}")
    second = spec.group_by_2
    return [spec.group_by] + ([second] if second in usable and second != spec.group_by else [])


def group(parsed: DataFrame, spec: QuerySpec) -> DataFrame:
    """Counts by one or two dimensions, largest first; the waste score looks at bots only."""
    keys = group_keys(parsed, spec)
    by_waste = spec.sort_by == "waste_score"
    df = selected(parsed, spec)
    if by_waste:
        df = df.where(F.col("is_bot"))
    one = F.lit(1).cast("long")
    metrics = [
        F.count("*").alias("hits"),
        F.count_if("is_bot").alias("hits_bot"),
        F.count_if(~F.col("is_bot")).alias("hits_human"),
        F.sum("bytes_sent").alias("bytes_total"),
        F.count_distinct("edge_ip").alias("unique_ips"),
        F.count_if(F.col("status_class") == 4).alias("s4xx"),
        F.count_if(F.col("status_class") == 5).alias("s5xx"),
    ]
    out = df.select("*", *[dimension(k, df.columns).alias(f"_k{i}") for i, k in enumerate(keys)])
    if by_waste:
        out = out.withColumn("hits", one)
        metrics.append(waste().alias("waste_score"))
    out = out.groupBy(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]).agg(*metrics)
    sort = SORT_METRICS.get(spec.sort_by, "hits")
    order = [F.desc(sort)] + ([F.desc("hits")] if by_waste else [])
    return out.orderBy(*order, *keys).limit(spec.limit)


# Time series ----------------------------------------------------------------------------------------------


def time_bucket(spec: QuerySpec) -> Column:
    single_day = spec.date_from and spec.date_from == spec.date_to
    unit = spec.bucket if spec.bucket in ("hour", "day") else ("hour" if single_day else "day")
    return lines.truncate(unit, F.col("ts_utc")).alias("time_bucket")


def status_counts() -> list[Column]:
    return [F.count_if(F.col("status").between(c * 100, c * 100 + 99)).alias(f"s{c}xx") for c in (2, 3, 4, 5)]


def timeseries(parsed: DataFrame, spec: QuerySpec) -> DataFrame:
    if spec.stack_by in STACK_COLUMNS:
        return timeseries_stacked(parsed, spec)
    return timeseries_status(parsed, spec)


def timeseries_status(parsed: DataFrame, spec: QuerySpec) -> DataFrame:
    return (selected(parsed, spec).groupBy(time_bucket(spec))
            .agg(*status_counts(), F.count("*").alias("hits")).orderBy("time_bucket"))


def stack_counts(parsed: DataFrame, spec: QuerySpec) -> DataFrame:
    """Hits per time bucket and value of the stack dimension."""
    df = selected(parsed, spec)
    return df.groupBy(time_bucket(spec), dimension(spec.stack_by, df.columns).alias("k")).agg(
        F.count("*").alias("hits"))


def top_keys(counts: DataFrame, n: int = STACK_LIMIT) -> DataFrame:
    """The ``n`` keys with most hits; ties by key."""
    return counts.groupBy("k").agg(F.sum("hits").alias("n")).orderBy(F.desc("n"), "k").limit(n).select("k")


def timeseries_stacked(parsed: DataFrame, spec: QuerySpec) -> DataFrame:
    """Hits per time bucket and stack key: the eight largest keys, the rest as ``Other``."""
    counts = stack_counts(parsed, spec)
    top = F.broadcast(top_keys(counts).withColumn("in_top", F.lit(True)))  # at most STACK_LIMIT rows
    label = F.when(F.col("in_top"), F.col("k")).otherwise(F.lit(OTHER))
    return (
        counts.join(top, "k", "left").groupBy("time_bucket", label.alias("stack_k"))
        .agg(F.sum("hits").alias("hits")).orderBy("time_bucket", "stack_k")
    )


def timeseries_wide(parsed: DataFrame, spec: QuerySpec) -> DataFrame:
    """``timeseries_stacked`` with one column per stack key and 0 where a bucket has none."""
    stacked = timeseries_stacked(parsed, spec)
    keys = [r.stack_k for r in stacked.select("stack_k").distinct().orderBy("stack_k").take(STACK_LIMIT + 1)]
    return stacked.groupBy("time_bucket").pivot("stack_k", keys).agg(F.sum("hits")).na.fill(0).orderBy("time_bucket")


# Histogram ------------------------------------------------------------------------------------------------

HISTOGRAM_METRICS = {
    "requests": lambda: [F.count("*").alias("v")],
    "bytes": lambda: [F.sum(F.coalesce("bytes_sent", F.lit(0))).alias("v")],
    "status": status_counts,
    "bots": lambda: [F.count_if("is_bot").alias("v_bot"), F.count_if(~F.col("is_bot")).alias("v_human")],
    "errors": lambda: [F.count_if(F.col("status").between(400, 599)).alias("err"), F.count("*").alias("tot")],
}


def per_instant(parsed: DataFrame, spec: QuerySpec, metric: str = "requests") -> DataFrame:
    """A metric by time in milliseconds (log times are whole seconds): sums of it give any range and any buckets."""
    values = HISTOGRAM_METRICS.get(metric, HISTOGRAM_METRICS["requests"])()
    return selected(parsed, spec).groupBy(lines.epoch_millis(F.col("ts_utc")).alias("ms")).agg(*values)


def histogram(parsed: DataFrame, spec: QuerySpec, metric: str = "requests") -> DataFrame:
    """A metric in 60 equal time buckets over the filtered range, or over the brushed range when one is set.

    The requests are read once: their sums per instant are kept in the shared work folder, and range and buckets come
    from those. Empty buckets count 0 and the last instant belongs to the last bucket.
    """
    instants = per_instant(parsed, spec, metric)
    if spec.filters.time_brush is not None:
        t0, t1 = sorted(int(t) for t in spec.filters.time_brush)
    else:
        instants = tables.kept(instants, "instants")
        t0, t1 = instants.agg(F.min("ms"), F.max("ms")).first()
    return buckets(instants, t0, t1, metric)


def buckets(instants: DataFrame, t0: int | None, t1: int | None, metric: str) -> DataFrame:
    """The sums of a metric per instant, added up in 60 buckets from ``t0`` to ``t1``."""
    width = max((t1 - t0 if t0 is not None and t1 > t0 else 60_000) / BUCKETS, 1.0)
    bucket = F.least(F.floor((F.col("ms") - F.lit(t0).cast("long")).cast("double") / F.lit(width)), F.lit(BUCKETS - 1)).cast("long")
    names = [c for c in instants.columns if c != "ms"]
    counted = instants.groupBy(bucket.alias("bucket")).agg(*[F.sum(c).alias(c) for c in names]).where(F.col("bucket").between(0, BUCKETS - 1))
    every = instants.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    out = every.join(counted, "bucket", "left").na.fill(0, names)
    if metric == "errors":
        pct = F.coalesce(F.try_divide(F.col("err") * F.lit(100.0), F.col("tot").cast("double")), F.lit(0.0))
        out = out.withColumn("error_pct", pct)
    return out.orderBy("bucket")


def histogram_totals(counted: DataFrame) -> DataFrame:
    """Totals of the shown series; the error rate is weighted by requests."""
    series = [c for c in counted.columns if c not in ("bucket", "error_pct")]
    out = counted.agg(*[F.sum(c).alias(c) for c in series])
    if "err" in series:
        pct = F.coalesce(F.try_divide(F.col("err") * F.lit(100.0), F.col("tot").cast("double")), F.lit(0.0))
        out = out.withColumn("error_pct", pct)
    return out
