"""Suggestions from kept values instead of the requests.

Per date the distinct values of the suggested fields are kept, and for each value the trigrams of its lower-case form.
A needle of three characters or more is looked up by its own trigrams: only values that have all of them are checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.operators import tables

GRAM = 3


def field_values(parsed: DataFrame) -> DataFrame:
    """date, field and value: the distinct values that may be suggested, one pass over the requests."""
    fields = tables.known_columns(parsed, tables.SUGGEST_FIELDS)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return parsed.select("date", F.inline(pairs)).where("value <> ''").distinct()


def grams_of(text):
    """The distinct trigrams of a text's lower-case form; none if it is shorter."""
    low = F.lower(text)
    places = F.when(F.char_length(low) >= GRAM, F.sequence(F.lit(1), F.char_length(low) - (GRAM - 1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM))))


def field_grams(values: DataFrame) -> DataFrame:
    """date, field, gram and value: where each trigram occurs."""
    return values.select("date", "field", F.explode(grams_of(F.col("value"))).alias("gram"), "value")


def suggest(values: DataFrame, grams: DataFrame, field: str, text: str = "", limit: int = 10) -> DataFrame:
    """What ``tables.suggest_values`` gives, from the kept tables of the dates in question."""
    if not 1 <= limit <= tables.MAX_SUGGESTIONS:
        raise ValueError(f"limit must be 1 to {tables.MAX_SUGGESTIONS}")
    field, needle = tables.SUGGEST_ALIASES.get(field, field), (text or "").strip().lower()
    wanted = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
    if wanted:
        found = grams.where((F.col("field") == field) & F.col("gram").isin(wanted))
        found = found.groupBy("value").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
    else:
        found = values.where(F.col("field") == field)
    found = found.select("value").distinct()
    if needle:
        found = found.where(F.contains(F.lower("value"), F.lit(needle)))
    return found.orderBy("value").limit(limit)
