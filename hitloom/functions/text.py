"""SQL text for expressions built from rule tables.

A rule table becomes one parsed expression; building it from hundreds of Column calls would take seconds
on the driver for every query.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quote(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(values) -> str:
    return ", ".join(quote(v) for v in values)


def case_insensitive(pattern: str) -> str:
    """Pattern to use on lower-case text; the slower flag is needed only when it has capitals."""
    return "(?i)" + pattern if any(c.isupper() for c in pattern) else pattern


def once(df: DataFrame, **columns) -> DataFrame:
    """Add costly columns so that each is evaluated once per row.

    A filter on a plain computed column is pushed below it and evaluates its expression again, as often as
    the filter mentions it. Columns that come out of a generator are never pushed through.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
