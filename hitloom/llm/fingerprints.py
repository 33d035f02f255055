"""Document fingerprints by winnowing, in DataFrame expressions alone.

A text is cut into tokens (runs of up to TOKEN_CHARS characters between white space); every K tokens in a row have a
rolling hash, and of every WINDOW hashes the least is kept, the rightmost one of equals, with its position. Two texts
that share a run of K + WINDOW - 1 tokens therefore share a fingerprint; nothing shorter than K tokens matches.

The hash of K tokens is taken from the K token hashes anew at each place. A hash that truly rolls from place to place
needs the running value of the one before, which Spark's expressions give only by a fold that copies the array at
every step; with K = 3 the direct form costs two more lookups per place.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.common import let, stored

TOKEN_CHARS = 6
K = 3
WINDOW = 8
#: Rows ordered by one task.
ROWS_PER_RANGE = 200_000
_LAST = (1 << 31) - 1


def winnow(text: Column) -> Column:
    """The kept hashes in text order, each as hash * 2^31 + (2^31 - 1 - position): the least is the rightmost of equals."""

    def grams(hashed: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            rolled = F.xxhash64(h, *[F.get(hashed, i + j) for j in range(1, K)])
            return F.shiftrightunsigned(rolled, 33) * F.lit(1 << 31) + (F.lit(_LAST).cast("long") - i)

        return F.slice(F.transform(hashed, one), F.lit(1), F.greatest(F.size(hashed) - (K - 1), F.lit(1)))

    def least_of(reach: int, values: Column) -> Column:
        return F.transform(values, lambda x, i: F.least(x, F.get(values, i + reach)))

    def minima(values: Column) -> Column:
        body = values
        for reach in (1, 2, 4):  # least of 2, 4, 8 values in a row
            body = let(body, partial(least_of, reach))
        return F.array_distinct(F.slice(body, F.lit(1), F.greatest(F.size(values) - (WINDOW - 1), F.lit(1))))

    tokens = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % TOKEN_CHARS), F.lit(0))
    hashed = F.transform(tokens, lambda t: F.xxhash64(t))
    return let(let(hashed, grams), minima)


def printed(marks: Column) -> Column:
    """hash:position of every mark, the hash in hex and the position in tokens, separated by spaces."""
    return F.array_join(
        F.transform(marks, lambda m: F.concat(F.lower(F.hex(F.shiftright(m, 31))), F.lit(":"), (F.lit(_LAST) - m.bitwiseAND(F.lit(_LAST))).cast("string"))), " "
    )


def hashes(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, 31).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes as a part of all hashes of two sets; two empty sets are alike."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every).cast("double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and marks (hash and position) of every text; a null text is empty and has none."""
    split = F.transform(F.col("marks"), lambda m: F.struct(F.shiftright(m, 31).cast("int").alias("hash"), (F.lit(_LAST) - m.bitwiseAND(F.lit(_LAST))).alias("position")))
    return docs.select("doc_id", winnow(F.coalesce(F.col("text"), F.lit(""))).alias("marks")).select("doc_id", split.alias("marks"))


def neighbours(keys: DataFrame) -> DataFrame:
    """Every distinct key (doc_id, h) with its size, copies and the key that follows it in descending order of doc_id.

    Nulls come last, equal ids are ordered by h, and after the last key comes the first. Only narrow rows are sorted:
    ranges of about ROWS_PER_RANGE keys, whose ends are then tied to the next range.
    """
    distinct = stored(keys.groupBy("doc_id", "h").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")), "keys")
    ranges = max(1, -(-distinct.count() // ROWS_PER_RANGE))
    ordered = distinct.repartitionByRange(ranges, F.desc_nulls_last("doc_id")).withColumn("range", F.spark_partition_id())
    ordered = stored(ordered, "ranges")
    order = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), "h")
    key = F.struct("doc_id", "h").alias("key")
    ordered = ordered.select("range", "n", "copies", key, F.lead(F.struct("doc_id", "h")).over(order).alias("next"), F.row_number().over(order).alias("row"))
    heads = ordered.filter("row = 1").select("range", F.col("key").alias("head"))
    # One row per range of 200 000 keys goes to this window.
    across = Window.orderBy("range")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("range", F.coalesce(F.lead("head").over(across), F.first("head").over(whole)).alias("after"))
    return ordered.join(heads, "range").select("key", "n", "copies", F.coalesce("next", "after").alias("next"))


def flat_id(doc_id: Column) -> Column:
    """An id as text that is never null: empty for a null id."""
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text and of its edited text, and how alike they and the next document are.

    The edited text has the last floor(n / 2) characters replaced by the first as many of the next document. A null
    text is empty; an empty text has an empty fingerprint. Of repeated rows (same id and text) each but the last is
    followed by its own copy. A table of one row is followed by itself; an empty one gives no rows. Columns besides
    doc_id and text play no part.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    after = stored(neighbours(texts.select("doc_id", "h", F.char_length("text").alias("n"))), "neighbours")
    # The texts are shuffled once, by a flat key (a struct's nullability would force a cast and a second shuffle).
    key = ["id", "h"]
    keyed = texts.select(flat_id(F.col("doc_id")).alias("id"), "h", "text")
    one_each = keyed.withColumn("__row", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))).filter("__row = 1").drop("__row")

    def key_of(struct: str, *names: str) -> list[Column]:
        return [flat_id(F.col(struct)["doc_id"]).alias(names[0]), F.col(struct)["h"].alias(names[1])]

    # What each text gives to the document before it: its beginning and its hashes.
    given = after.select(*key_of("next", *key), *key_of("key", "before_id", "before_h"), F.expr("n div 2").cast("int").alias("need"))
    given = one_each.join(given, key).withColumn("marks", winnow(F.col("text")))
    given = given.select(F.col("before_id").alias("id"), F.col("before_h").alias("h"), F.substring("text", F.lit(1), F.col("need")).alias("part"),
                         hashes(F.col("marks")).alias("next_hashes"))
    own = one_each.join(after.select(*key_of("key", *key), F.col("key")["doc_id"].alias("doc_id"), "n", "copies"), key).join(given, key)
    half = F.expr("n div 2").cast("int")

    def edited(part: Column) -> Column:
        return F.concat(F.substring("text", F.lit(1), F.col("n") - half), part)

    # Copies of one row: the last is followed by the next document, all others by themselves.
    self_part = F.struct(F.substring("text", F.lit(1), half).alias("part"), F.lit(True).alias("is_copy"), (F.col("copies") - 1).alias("times"))
    next_part = F.struct(F.col("part"), F.lit(False).alias("is_copy"), F.lit(1).cast("long").alias("times"))
    cases = F.when(F.col("copies") > 1, F.array(next_part, self_part)).otherwise(F.array(next_part))
    own = own.withColumn("marks", winnow(F.col("text"))).withColumn("case", F.explode(cases))
    own = own.withColumn("edited", edited(F.col("case")["part"])).withColumn("edited_marks", winnow(F.col("edited")))
    own = own.withColumn("own_hashes", hashes(F.col("marks")))
    result = own.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("marks")).alias("fingerprint"), printed(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), hashes(F.col("edited_marks"))).alias("near_edited"),
        F.when(F.col("case")["is_copy"], F.lit(1.0)).otherwise(likeness(F.col("own_hashes"), F.col("next_hashes"))).alias("near_next"),
        F.col("case")["times"].alias("times"),
    )
    return result.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "__copy")
