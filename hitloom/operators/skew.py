"""A left join whose right side has keys with very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the right side from which a key is joined apart, and the parts that its rows are dealt into.
HOT_ROWS, SALTS = 20_000, 64
#: Hot keys that are broadcast to tell the rows apart; there cannot be more than the right side's rows over HOT_ROWS.
MAX_HOT_KEYS = 100_000


def left_join(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """``left.join(right, keys, "left")`` in which no task gets a hot key alone.

    Spark splits a hot key of the left side by itself, but not one of the right side of a left join. Keys with more
    than ``hot_rows`` right rows are found by count. Their right rows are dealt by salt and their left rows repeated
    for every salt; since such keys have matches, an inner join does for them. Rows of ``left`` should be few per key.
    """
    counts = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys)
    hot = counts.limit(MAX_HOT_KEYS + 1).collect()
    if not hot:
        return left.join(right, keys, "left")
    if len(hot) > MAX_HOT_KEYS:
        hot_keys = counts
    else:
        hot_keys = F.broadcast(left.sparkSession.createDataFrame(hot, counts.schema))
    plain = left.join(hot_keys, keys, "left_anti").join(right.join(hot_keys, keys, "left_anti"), keys, "left")
    value_columns = [c for c in right.columns if c not in keys] or keys
    dealt = right.join(hot_keys, keys, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*value_columns), F.lit(salts)).cast("int"))
    repeated = left.join(hot_keys, keys, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # The repeated side has the same rows per salt; written as a shuffle join so that no side is broadcast unchecked.
    spread = repeated.join(dealt, [*keys, "_salt"]).drop("_salt")
    return plain.unionByName(spread)
