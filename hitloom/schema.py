"""Explicit table schemas."""

from pyspark.sql import types as T

_STR, _INT, _LONG, _DBL, _BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(*pairs) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


PARSED = _struct(
    ("date", _STR), ("ts_local", T.TimestampType()), ("ts_utc", T.TimestampNTZType()), ("edge_ip", _STR),
    ("country", _STR), ("method", _STR), ("path", _STR), ("http_version", _STR), ("status", _INT),
    ("status_code", _INT), ("status_class", _INT), ("bytes_sent", _LONG), ("referer", _STR),
    ("referer_type", _STR), ("referer_path", _STR), ("user_agent", _STR), ("has_query", _BOOL),
    ("is_parameterized", _BOOL), ("locale", _STR), ("section", _STR), ("url_group", _STR),
    ("is_resource", _BOOL), ("is_bot", _BOOL), ("bot_family", _STR), ("bot_category", _STR),
    ("request_target", _STR), ("query_string", _STR), ("is_utm_chatgpt", _BOOL), ("has_utm", _BOOL),
    ("utm_source", _STR), ("utm_source_norm", _STR), ("utm_medium", _STR), ("utm_campaign", _STR),
    ("utm_term", _STR), ("utm_content", _STR),
)

SEARCH_PERF = _struct(
    ("date", _STR), ("page", _STR), ("query", _STR), ("clicks", _LONG), ("impressions", _LONG), ("ctr", _DBL),
    ("position", _DBL),
)

MANIFEST = _struct(
    ("date", _STR), ("path", _STR), ("size_bytes", _LONG), ("mtime_epoch", _LONG), ("log_date", _STR), ("ingested_at_epoch", _LONG),
)


def conform(df, schema: T.StructType):
    """Columns of ``schema`` in order and type; missing ones become typed NULLs."""
    from pyspark.sql import functions as F

    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])
