"""Distinct visitors of any range from sketches kept per day.

Exact distinct counts cannot be added up: the visitors of a month are not the sum of its days'. A HyperLogLog sketch
per day and group can be merged over any range in a few kilobytes. The exact count stays the default everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base-two logarithm of a sketch's registers.
LOG_REGISTERS = 12
#: Relative standard error of merged sketches, and the bound of three of them that an estimate keeps but for 3 in 1000.
STANDARD_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)
ERROR_BOUND = 3 * STANDARD_ERROR
VISITOR_KEYS = ("url_group", "bot_family")


def visitor_sketches(parsed: DataFrame, *keys: str) -> DataFrame:
    """One sketch of the addresses per date and key values: a few kilobytes a row, combined before the shuffle."""
    keys = keys or VISITOR_KEYS
    return parsed.groupBy("date", *keys).agg(F.hll_sketch_agg("edge_ip", F.lit(LOG_REGISTERS)).alias("visitors"))


def unique_visitors(sketches: DataFrame, *keys: str) -> DataFrame:
    """Estimated distinct addresses by some of the keys (or in all), over the dates that are given."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("unique_ips"))
