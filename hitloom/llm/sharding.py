"""Sharding by a Feistel permutation with cycle walking over global row numbers.

A row's number (its place in the order of id, size and checksum) is permuted within 0..n-1; the result gives the
shard (modulo) and the slot (quotient), so counts differ by one at most, and both can be computed either way.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.common import let, stored, unsigned_crc32

ROUNDS = 6
#: Rows numbered by one task.
ROWS_PER_BUCKET = 200_000
#: A repeated row with more copies is split before its copies are written out.
COPIES_PER_TASK = 100_000


def halves(n: int) -> tuple[int, int]:
    """The smallest a * b >= n with a = ceil(sqrt(n)): the two halves of a number are x // b and x % b."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def walk_limit(n: int) -> int:
    """Steps that a cycle walk may take.

    At most sqrt(n) numbers lie beyond n. If they are up to 32, no cycle among them is longer, so the limit is exact.
    Else n is above 1000, a step fails to return below n with a chance under 1/32, and 33 steps in a row with one below
    n * 32^-33; ``permute`` raises an error then instead of giving a wrong place.
    """
    a, b = halves(n)
    return min(a * b - n, 32) + 1


def _round(half: Column, seed: int, r: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(half, F.lit(seed), F.lit(r)), F.lit(modulus))


def feistel(x: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """One pass of the permutation of 0..a*b-1; even rounds add to the first half, odd ones to the second."""
    a, b = halves(n)
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def step(pair: Column, r: int) -> Column:
        def mixed(p: Column) -> Column:
            if r % 2 == 0:
                f = _round(p["r"], seed, r, a)
                return F.struct(F.pmod(p["l"] - f if inverse else p["l"] + f, F.lit(a)).alias("l"), p["r"].alias("r"))
            f = _round(p["l"], seed, r, b)
            return F.struct(p["l"].alias("l"), F.pmod(p["r"] - f if inverse else p["r"] + f, F.lit(b)).alias("r"))

        return let(pair, mixed)

    start = let(x, lambda v: F.struct(F.call_function("div", v, F.lit(b)).alias("l"), F.pmod(v, F.lit(b)).alias("r")))
    return let(reduce(step, order, start), lambda p: p["l"] * F.lit(b) + p["r"])


def permute(x: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """The place of number ``x`` among 0..n-1, or with ``inverse`` the number at place ``x``."""
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(walk_limit(n))), feistel(x.cast("long"), n, seed, inverse),
        lambda at, _: F.when(at < F.lit(n), at).otherwise(feistel(at, n, seed, inverse)),
    )
    return let(walked, lambda at: F.when(at < F.lit(n), at).otherwise(F.raise_error(F.lit("walk too long")).cast("long")))


def numbered(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, int]:
    """The rows with a column ``name``, 0 to n-1 without gaps, and n. Equal rows get any order among themselves.

    Equal rows are first counted, so that even a row that makes up a third of the table is one row while numbering.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__copies"))
    counted = stored(counted.withColumn("__hash", F.xxhash64(*keys)), "numbered")
    total, distinct = counted.agg(F.coalesce(F.sum("__copies"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, -(-distinct // ROWS_PER_BUCKET))
    counted = counted.withColumn("__bucket", F.pmod(F.col("__hash"), F.lit(buckets)))
    sizes = counted.groupBy("__bucket").agg(F.sum("__copies").alias("__size"))
    # One row per bucket of 200 000 rows goes to this window.
    starts = sizes.select("__bucket", (F.sum("__size").over(Window.orderBy("__bucket")) - F.col("__size")).alias("__start"))
    order = Window.partitionBy("__bucket").orderBy(*keys)
    placed = counted.withColumn("__first", F.sum("__copies").over(order) - F.col("__copies")).join(starts, "__bucket")
    placed = placed.withColumn("__first", F.col("__first") + F.col("__start")).select(*keys, "__first", "__copies")

    def expand(df: DataFrame, first: Column, count: Column) -> DataFrame:
        return df.select(*keys, F.explode(F.sequence(first, first + count - 1)).alias(name))

    few = expand(placed.filter(F.col("__copies") <= COPIES_PER_TASK), F.col("__first"), F.col("__copies"))
    many = placed.filter(F.col("__copies") > COPIES_PER_TASK)
    parts = many.select("*", F.posexplode(F.sequence(F.lit(0), F.col("__copies") - 1, F.lit(COPIES_PER_TASK))).alias("__i", "__at"))
    parts = parts.repartition("__first", "__i")
    many = expand(parts, F.col("__first") + F.col("__at"), F.least(F.lit(COPIES_PER_TASK), F.col("__copies") - F.col("__at")))
    return few.unionByName(many), int(total)


def shard(docs: DataFrame, shards: int = 16, seed: int = 20240601) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, and its row number and place.

    A null text has no bytes: size 1, checksum 0. Null ids come first in the order. Repeated rows are numbered one
    after the other. An empty table gives no rows. Columns besides doc_id and text play no part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), unsigned_crc32(text).alias("text_crc32")
    )
    keys = ["doc_id", "size", "text_crc32"]
    numbers, n = numbered(rows, keys, "row_number")
    placed = numbers.withColumn("place", permute(F.col("row_number"), max(n, 1), seed))
    return placed.select(
        *keys, F.lit("rows").alias("law"), F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"place div {int(shards)}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "row_number", "place",
    )


def row_numbers_of(places: DataFrame, n: int, seed: int = 20240601, shards: int = 16) -> DataFrame:
    """``places`` (shard, slot) with the row number that lies there: the inverse of ``shard``."""
    place = F.col("slot").cast("long") * shards + F.col("shard")
    return places.withColumn("row_number", permute(place, n, seed, inverse=True))
