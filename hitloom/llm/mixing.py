"""Mixing sources to target weights.

Tokens are summed per source; every source's target is its weight's share of all tokens, but at most ``LIMIT`` times
what it has, the excess going to the others by weight. Target over tokens is the source's repetition rate: a document
is taken floor(rate) times, and once more if a number in [0, 1) hashed from the seed, its id and its text falls below
the fraction. Documents only meet their source's few numbers, so no source, however large, gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.common import SPACES, fresh, stored

#: Weights by the place of a source in code-point order, repeating; a null source comes last.
WEIGHTS = (1, 2, 3)
#: A target, and the copies of a document, stop at so many times the size.
LIMIT = 3
WORD = SPACES.replace("[", "[^", 1)
#: Sources numbered by one task.
SOURCES_PER_TASK = 100_000
#: Sources joined by broadcast; more of them are joined by shuffle, which splits a source's documents by salt.
MAX_BROADCAST = 50_000
SALTS = 64


def size_of(text: Column) -> Column:
    """Words of the text; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def digest_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def ranked(sources: DataFrame) -> DataFrame:
    """The sources with ``place``, 0 to n-1 in code-point order, null last: numbered range by range."""
    spark = sources.sparkSession
    ranges = -(-sources.count() // SOURCES_PER_TASK) or 1
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sources.repartitionByRange(ranges, *order) if ranges > 1 else sources.coalesce(1)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()), "sources")
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    first = spark.createDataFrame(starts, "part int, start long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    placed = dealt.withColumn("within", within).join(F.broadcast(first), "part")
    return placed.select("source", "source_size", (F.col("start") + F.col("within")).alias("place"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight and target of every source.

    The shares of the sources below their limit rise together until what the limits cut off is dealt out. Each step
    is one sum over the sources; a source once at its limit stays there, so the steps end.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod("place", F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = stored(ranked(sizes).select("source", "source_size", weight.cast("long").alias("weight")), "weights")
    limit = F.col("source_size") * LIMIT
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    rest, rest_weight, before = total, None, None
    while True:
        if rest_weight is None:
            at_limit = F.lit(False)
        else:
            at_limit = limit <= _share(rest, rest_weight)
        capped, open_weight, n = weighed.agg(
            F.coalesce(F.sum(F.when(at_limit, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0)),
            F.count(F.when(at_limit, 1))).first()
        rest, rest_weight = total - capped, open_weight
        if n == before or not rest_weight:
            break
        before = n
    target = limit.cast("double") if not rest_weight else F.when(at_limit, limit.cast("double")).otherwise(_share(rest, rest_weight))
    return weighed.withColumn("target", target)


def _share(rest: int, rest_weight: int) -> Column:
    return F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(rest_weight))


def chance(seed: int, doc_id: Column, digest: Column) -> Column:
    """A number in [0, 1) from the seed, the id and the text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), digest)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_source(rows: DataFrame, aimed: DataFrame) -> DataFrame:
    """The rows with their source's numbers: by broadcast if the sources are few, else by a join with salted sources."""
    of, salt, grain = fresh("of", "salt", "grain")
    aimed = aimed.withColumnRenamed("source", of)
    same = F.col("source").eqNullSafe(F.col(of))
    if aimed.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(aimed), same).drop(of)
    salted = rows.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    spread = aimed.withColumn(grain, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, same & (F.col(salt) == F.col(grain))).drop(of, salt, grain)


def rates(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target and rate (target over size, 0 for a source without words)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return stored(targets(sizes).withColumn("rate", F.least(rate, F.lit(float(LIMIT)))), "rates")


def copies(rate: Column, number: Column) -> Column:
    """floor(rate) copies, and one more if the number in [0, 1) is below the fraction."""
    return (F.floor(rate) + F.when(number < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, seed: int = 20240601) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and copies of every row.

    A null or empty text has size 0 and is taken 0 words (its copies are counted all the same, by its source's rate).
    A null source is a source of its own, last in order. A source whose texts are all empty has target 0 and rate 0.
    Rows that agree in id and text draw the same number; a null id hashes as an empty one. An empty table gives no
    rows. Columns besides doc_id, text and source play no part.
    """
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), digest_of(F.col("text")).alias("digest"))
    rows = stored(rows, "sized")
    aimed = rates(rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    taken = with_source(rows, aimed).withColumn("copies", copies(F.col("rate"), chance(seed, F.col("doc_id"), F.col("digest"))))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def emit(docs: DataFrame, seed: int = 20240601) -> DataFrame:
    """The mixed table: every row of ``docs``, with its columns, as often as the mix takes it."""
    rate, n, i = fresh("rate", "copies", "copy")
    sizes = docs.groupBy("source").agg(F.sum(size_of(F.col("text"))).cast("long").alias("source_size"))
    aimed = rates(sizes).select("source", F.col("rate").alias(rate))
    drawn = with_source(docs, aimed)
    drawn = drawn.withColumn(n, copies(F.col(rate), chance(seed, F.col("doc_id"), digest_of(F.col("text")))))
    drawn = drawn.filter(F.col(n) > 0).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n))))
    return drawn.select(*[docs[c] for c in docs.columns])
