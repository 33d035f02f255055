"""Rows by their rank in a total order, without sorting or shuffling the table.

A page deep in a sorted result is found by counting: values of the first sort column cut the rows into ranges, one
pass counts them, and the range that holds the rank is cut again, or, where a single value fills it, by the next sort
column. Only the rows of the last range, a few thousand, are ordered. Every pass reads the sort columns only, and the
bounds reach the scan as filters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rank below this is found by Spark's own top-n.
SHALLOW_ROWS = 10_000
#: Ranges of one counting pass, values that are looked at to choose them, and rows of a range that is ordered.
RANGES, SAMPLE, RANGE_ROWS = 128, 8_000, 4_096

Order = list[tuple[str, bool]]  # column, ascending


@dataclass(frozen=True)
class Range:
    """Rows that meet a condition, how many they are, and whether the column has one value in them."""

    rows: Column
    n: int
    single: bool


def ordering(order: Order) -> list[Column]:
    return [F.asc(c) if up else F.desc(c) for c, up in order]


def ranges(df: DataFrame, column: str, ascending: bool, n: int) -> list[Range]:
    """The rows of ``df`` (``n`` of them) cut by values of a column, in order: single values and what lies between.

    The values come from a sample, so one that fills a good part of the rows is among them. NULL is a value of its
    own, first if ascending.
    """
    some = df.select(column).where(F.col(column).isNotNull()).sample(min(1.0, SAMPLE / max(n, 1)), 17)
    values = [r[0] for r in some.distinct().orderBy(column).collect()]  # SAMPLE rows on average
    step = max(1, -(-len(values) // (RANGES // 2)))
    cuts = values[step // 2 :: step]
    c = F.col(column)

    def place(lo: int, hi: int) -> Column:
        """2i + 1 for the value i of ``cuts``, 2i for what lies before it, found by halving."""
        if lo == hi:
            return F.lit(2 * lo)
        mid = (lo + hi) // 2
        return F.when(c == F.lit(cuts[mid]), F.lit(2 * mid + 1)).when(c < F.lit(cuts[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))

    counted = df.select(F.when(c.isNull(), F.lit(-1)).otherwise(place(0, len(cuts))).alias("place"))
    counts = {r.place: r.n for r in counted.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}  # RANGES rows
    out = []
    for p in sorted(counts):
        i = p // 2
        if p == -1:
            rows = c.isNull()
        elif p % 2:
            rows = c == F.lit(cuts[i])
        else:
            bounds = ([c > F.lit(cuts[i - 1])] if i else []) + ([c < F.lit(cuts[i])] if i < len(cuts) else [])
            rows = reduce(lambda a, b: a & b, bounds, c.isNotNull())
        out.append(Range(rows, counts[p], p == -1 or p % 2 == 1))
    return out if ascending else out[::-1]


def page(df: DataFrame, order: Order, offset: int, limit: int, shallow_rows: int = SHALLOW_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of ``df`` in an order; beyond the last row there are none."""
    if offset + limit <= shallow_rows:
        return df.orderBy(*ordering(order)).offset(offset).limit(limit)
    total = df.count()
    if offset >= total or limit <= 0:
        return df.limit(0)
    # Ranges still to come, nearest last; each with the sort columns that may cut it further.
    todo: list[tuple[Column, int, int]] = [(F.lit(True), total, 0)]
    parts, left = [], limit
    while todo and left:
        rows, n, at = todo.pop()
        if offset >= n:
            offset -= n
        elif offset == 0 or n <= range_rows or at == len(order):
            take = min(left, n - offset)
            parts.append(df.where(rows).orderBy(*ordering(order)).offset(offset).limit(take))
            left, offset = left - take, 0
        else:
            column, ascending = order[at]
            found = ranges(df.where(rows), column, ascending, n)
            todo.extend((rows & r.rows, r.n, at + 1 if r.single else at) for r in reversed(found))
    return reduce(DataFrame.unionAll, parts).orderBy(*ordering(order)) if len(parts) > 1 else parts[0]
