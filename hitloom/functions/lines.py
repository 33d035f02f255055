"""Log-line fields: one regular-expression pass, then plain column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: address, optional two-letter country, time, request, status, bytes, referer, user agent.
LINE_PATTERN = (
    r'^(\S+)\s+\S+\s+(?:([A-Z]{2})\s+)?\S+\s+\[([^\]]+)\]\s+(?:-\s+)?"([^"]*)"\s+(\d{3})\s+(\d+)\s+'
    r'"([^"]*)"\s+"([^"]*)"\s*$'
)
LINE_FIELDS = ("edge_ip", "country", "time", "request", "status", "bytes_sent", "referer", "user_agent")
TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def split_line(line: Column) -> Column:
    """Array of the eight raw fields, or an array of another size for a line that does not match.

    The fields are joined by a line feed, which no text line can contain, so a single match per line
    is enough and no field value can be mistaken for a separator.
    """
    return F.split(F.regexp_replace(line, LINE_PATTERN, "$1\n$2\n$3\n$4\n$5\n$6\n$7\n$8"), "\n")


def parse_time(text: Column) -> Column:
    """Instant of a log time such as ``07/Mar/2026:00:00:00 +0800``; NULL when malformed."""
    return F.try_to_timestamp(text, F.lit(TIME_FORMAT))


def utc_wall_clock(instant: Column) -> Column:
    """UTC wall-clock time of an instant, whatever the session time zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(EPOCH_NTZ))


def epoch_millis(ts_utc: Column) -> Column:
    """Milliseconds since the epoch of a UTC wall-clock time, whatever the session time zone."""
    return F.timestamp_diff("MILLISECOND", F.expr(EPOCH_NTZ), ts_utc)


def truncate(unit: str, ts: Column) -> Column:
    """``date_trunc`` that keeps the wall-clock type."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def request_parts(request: Column) -> Column:
    return F.split(request, " ", 3)


def request_method(parts: Column) -> Column:
    return F.when(F.size(parts) >= 2, F.get(parts, F.lit(0)))


def request_target(parts: Column) -> Column:
    """Second token of the request line, ``/`` when absent or empty."""
    target = F.get(parts, F.lit(1))
    return F.when(target.isNull() | (target == ""), F.lit("/")).otherwise(target)


def http_version(parts: Column) -> Column:
    return F.get(parts, F.lit(2))


def has_query(target: Column) -> Column:
    return F.contains(target, F.lit("?"))


def target_path(target: Column) -> Column:
    path = F.substring_index(target, "?", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def query_string(target: Column) -> Column:
    """Text after the first ``?``; NULL when there is none or it is empty."""
    return F.nullif(F.get(F.split(target, r"\?", 2), F.lit(1)), F.lit(""))


def status_class(status: Column) -> Column:
    """2 to 5 for 200 to 599, otherwise 0."""
    return F.when(status.between(200, 599), F.floor(status / 100).cast("int")).otherwise(F.lit(0))


def header_value(raw: Column) -> Column:
    """NULL for an absent header (``-`` or empty)."""
    return F.when((raw != "-") & (raw != ""), raw)
