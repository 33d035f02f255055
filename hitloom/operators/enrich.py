"""Raw log lines to labelled requests: one narrow projection chain, no shuffle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom import schema
from hitloom.config import SiteRules
from hitloom.defaults import ASSET_GROUPS
from hitloom.functions import agents, lines, referers, urls, utm


def split_lines(raw: DataFrame) -> DataFrame:
    """Add ``_f``, the array of raw fields, ``_time``, ``_bytes`` and ``is_bad`` to ``(date, value)`` rows."""
    f = F.col("_f")
    return (
        raw.withColumn("_f", lines.split_line(F.col("value")))
        .withColumn("_time", lines.parse_time(F.get(f, F.lit(2))))
        .withColumn("_bytes", F.get(f, F.lit(5)).try_cast("long"))
        .withColumn("is_bad", (F.size(f) != len(lines.LINE_FIELDS)) | F.col("_time").isNull()
                    | F.col("_bytes").isNull())
    )


def parse_lines(raw: DataFrame) -> DataFrame:
    """Request fields of the good lines of ``(date, value)`` rows; bad lines are left out.

    Good lines come out of ``explode`` rather than a filter: a filter would be pushed below the split and
    evaluate the line pattern and the time a second time for every row.
    """
    f, parts, target = F.col("_f"), F.col("_parts"), F.col("request_target")
    good = F.struct(
        F.col("_time").alias("ts_local"),
        F.get(f, F.lit(0)).alias("edge_ip"),
        F.nullif(F.get(f, F.lit(1)), F.lit("")).alias("country"),
        lines.request_parts(F.get(f, F.lit(3))).alias("_parts"),
        F.get(f, F.lit(4)).try_cast("int").alias("status"),
        F.col("_bytes").alias("bytes_sent"),
        lines.header_value(F.get(f, F.lit(6))).alias("referer"),
        F.get(f, F.lit(7)).alias("user_agent"),
    )
    return (
        split_lines(raw)
        .select("date", F.inline(F.when(~F.col("is_bad"), F.array(good))))
        .withColumn("request_target", lines.request_target(parts))
        .select(
            "date",
            "ts_local",
            lines.utc_wall_clock(F.col("ts_local")).alias("ts_utc"),
            "edge_ip",
            "country",
            lines.request_method(parts).alias("method"),
            lines.target_path(target).alias("path"),
            lines.http_version(parts).alias("http_version"),
            "status",
            "bytes_sent",
            "referer",
            "user_agent",
            "request_target",
            lines.query_string(target).alias("query_string"),
            lines.has_query(target).alias("has_query"),
        )
    )


def enrich(requests: DataFrame, rules: SiteRules, dictionaries=None) -> DataFrame:
    """All columns of the parsed table from the request fields.

    With ``dictionaries`` (``plans.dictionaries.Dictionaries``) labels of known values are looked up.
    """
    df = requests.withColumns({
        "status_code": F.col("status"),
        "status_class": lines.status_class(F.col("status")),
        "is_parameterized": F.col("has_query"),
    })
    if dictionaries is not None:
        for kind in ("agents", "referers", "paths", "queries"):
            df = dictionaries.labelled(df, kind)
        df = agents.classify_bot(df, rules)
    else:
        df = agents.classify_bot(df, rules)
        df = urls.classify_path(df, rules)
        df = utm.parse_utm(df)
        df = referers.classify_referer(df, rules.site_domain)
    df = df.withColumn("is_resource", F.col("url_group").isin(*ASSET_GROUPS))
    return schema.conform(df, schema.PARSED)


def parse_log(raw: DataFrame, rules: SiteRules) -> DataFrame:
    """Parsed table of raw ``(date, value)`` rows."""
    return enrich(parse_lines(raw), rules)


def bad_line_counts(raw: DataFrame) -> DataFrame:
    """Lines, good lines and bad lines per date."""
    return split_lines(raw).groupBy("date").agg(
        F.count("*").alias("lines"),
        F.count_if(~F.col("is_bad")).alias("parsed_lines"),
        F.count_if("is_bad").alias("bad_lines"),
    )
