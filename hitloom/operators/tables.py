"""Date-partitioned tables: scans, coverage, distinct values."""

import uuid
from datetime import date as day_type
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.session import work_dir


def kept(df: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared work folder and read back, so that what follows does not compute them again."""
    path = f"{work_dir(df.sparkSession)}/hitloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def between_dates(df: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Rows whose partition date lies in a range; either end may be open."""
    if date_from:
        df = df.where(F.col("date") >= date_from)
    if date_to:
        df = df.where(F.col("date") <= date_to)
    return df


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Rows of tables with differing columns; missing columns are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def known_columns(df: DataFrame, wanted) -> list[str]:
    """The requested columns that exist, in the requested order."""
    return [c for c in dict.fromkeys(wanted) if c in df.columns]


def distinct_values(df: DataFrame, column: str, keep_empty: bool = True) -> DataFrame:
    values = df.select(F.col(column).cast("string").alias("value")).where(F.col("value").isNotNull())
    if not keep_empty:
        values = values.where(F.col("value") != "")
    return values.distinct().orderBy("value")


# Fields with suggestions, and short names of one of them.
SUGGEST_FIELDS = ("status", "method", "bot_family", "bot_category", "url_group", "locale", "country",
                  "referer_type", "utm_source_norm")
SUGGEST_ALIASES = {"utm": "utm_source_norm", "utm_source": "utm_source_norm"}


MAX_SUGGESTIONS = 50


def suggest_values(parsed: DataFrame, field: str, text: str = "", limit: int = 10) -> DataFrame:
    """Values of a field that contain a text, in order; the limit is 1 to ``MAX_SUGGESTIONS``."""
    if not 1 <= limit <= MAX_SUGGESTIONS:
        raise ValueError(f"limit must be 1 to {MAX_SUGGESTIONS}")
    column = SUGGEST_ALIASES.get(field, field)
    if column not in SUGGEST_FIELDS or column not in parsed.columns:
        return parsed.select(F.lit(None).cast("string").alias("value")).where(F.lit(False))
    values = distinct_values(parsed, column, keep_empty=False)
    needle = (text or "").strip().lower()
    if needle:
        values = values.where(F.contains(F.lower("value"), F.lit(needle)))
    return values.orderBy("value").limit(limit)


def time_span(prefix: str) -> tuple[datetime, datetime] | None:
    """The first and last time that agree with the whole fields (day, hour, minute, second) a text such as
    ``2024-01-05 10:3`` begins with; none if it has no whole day."""
    whole = max((n for n in (10, 13, 16, 19) if n <= len(prefix)), default=0)
    try:
        low = datetime.fromisoformat(prefix[:whole] + "0001-01-01 00:00:00"[whole:])
    except ValueError:
        return None
    length = {10: timedelta(days=1), 13: timedelta(hours=1), 16: timedelta(minutes=1), 19: timedelta(seconds=1)}
    return (low, low + length[whole] - timedelta(microseconds=1)) if whole else None


def detail(parsed: DataFrame, date: str, ts: str, path: str | None = None, ip: str | None = None) -> DataFrame:
    """The first request whose UTC time starts with a text, optionally of one path and address.

    The partition date comes from the file name, so the neighbouring dates are read as well. The text also gives a
    range of times, which reaches the scan.
    """
    day = day_type.fromisoformat(date)
    df = between_dates(parsed, (day - timedelta(days=1)).isoformat(), (day + timedelta(days=1)).isoformat())
    if span := time_span(ts):
        df = df.where(F.col("ts_utc").between(*(F.lit(t).cast("timestamp_ntz") for t in span)))
    df = df.where(F.startswith(F.col("ts_utc").cast("string"), F.lit(ts)))
    if path is not None:
        df = df.where(F.col("path") == path)
    if ip is not None:
        df = df.where(F.col("edge_ip") == ip)
    return df.orderBy("ts_utc", "path", "edge_ip").limit(1)
