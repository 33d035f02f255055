"""Campaign tags of a query string."""

from pyspark.sql import Column
from pyspark.sql import functions as F

UTM_FIELDS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
# Fixed value: characters stripped from both ends of a tag value.
WRAPPING = " '\"\t\r\n`"
BLANKS = " \t\r\n\x0b\x0c"


def decode_once(text: Column) -> Column:
    """Plus signs to blanks and percent escapes to characters; a broken escape stays as it is."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def decode_twice(text: Column) -> Column:
    return decode_once(decode_once(text))


def is_escaped(text: Column) -> Column:
    return F.contains(text, F.lit("%")) | F.contains(text, F.lit("+"))


def may_have_utm(query: Column) -> Column:
    """Cheap exact pre-test: without it no key of the decoded query can start with ``utm_``."""
    return F.contains(query, F.lit("%")) | F.contains(F.lower(query), F.lit("utm_"))


def query_pairs(decoded: Column) -> Column:
    """``(k, v)`` pairs of a decoded query in order; a key without ``=`` has an empty value."""

    def pair(part: Column) -> Column:
        k = F.substring_index(part, "=", 1)
        v = F.coalesce(F.get(F.split(part, "=", 2), F.lit(1)), F.lit(""))
        plain = F.struct(k.alias("k"), v.alias("v"))
        return F.when(is_escaped(part), F.struct(decode_once(k).alias("k"), decode_once(v).alias("v"))).otherwise(plain)

    return F.transform(F.filter(F.split(decoded, "&"), lambda part: part != ""), pair)


def utm_pairs(pairs: Column) -> Column:
    """Pairs whose key starts with ``utm_``, values cleaned: NULL when blank, empty when only quotes."""
    tagged = F.filter(pairs, lambda kv: F.startswith(F.lower(kv["k"]), F.lit("utm_")))
    return F.transform(tagged, lambda kv: F.struct(
        kv["k"].alias("k"),
        F.when(F.btrim(kv["v"], F.lit(BLANKS)) != "", clean_value(kv["v"])).alias("v"),
    ))


def clean_value(value: Column) -> Column:
    """Decoded value without wrapping blanks and quotes."""
    return F.btrim(decode_twice(value), F.lit(WRAPPING))


def first_value(pairs: Column, key: str) -> Column:
    """First value of ``key``, or of its upper-case spelling when that one is missing or blank."""

    def value_of(name: str) -> Column:
        return F.get(F.filter(pairs, lambda kv: kv["k"] == name), F.lit(0))["v"]

    return F.coalesce(value_of(key), value_of(key.upper()))


def parse_utm(df, query: str = "query_string"):
    """Add ``has_utm``, the five tag columns, ``utm_source_norm`` and ``is_utm_chatgpt``.

    The steps are separate columns so that none is evaluated more than once per row.
    """
    from hitloom.defaults import CHATGPT_SOURCE

    q = F.col("_q")
    decode = F.when(is_escaped(q), decode_once(q)).otherwise(q)
    return (
        df.withColumn("_q", F.when(may_have_utm(F.col(query)), F.col(query)))
        .withColumn("_q", decode)
        .withColumn("_q", decode)
        .withColumn("_utm", utm_pairs(query_pairs(q)))
        .withColumn("has_utm", F.coalesce(F.size("_utm") > 0, F.lit(False)))
        .withColumns({f: F.when(F.col("has_utm"), first_value(F.col("_utm"), f)) for f in UTM_FIELDS})
        .withColumns({f: F.nullif(F.col(f), F.lit("")) for f in UTM_FIELDS})
        .withColumn("utm_source_norm", F.lower("utm_source"))
        .withColumn("is_utm_chatgpt", F.coalesce(F.col("utm_source_norm") == CHATGPT_SOURCE, F.lit(False)))
        .drop("_q", "_utm")
    )
