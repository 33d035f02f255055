"""Filter interaction audit by min-plus removal ranks.

Every document has a mask of the filters it fails. Documents are counted by part, mask and labels, so what follows
grows with the parts only. With M the matrix of masks (0 where a filter fails a mask's documents, infinite elsewhere)
and P the matrix that gives, for every order of the filters, the place of each (the inverse permutation), the min-plus
product of M and P is the step at which each order removes each mask. The counts, weighted into those steps, give what
every step of every order keeps and removes, and which of its failures were gone already.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import Words, slices, stored

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"
NEVER = 99
DUPLICATE = 1 << FILTERS.index("E")


def text_masks(texts: pa.Array) -> np.ndarray:
    """The mask of the filters A to D for every text; a null text counts as empty."""
    words = Words(texts)
    n = words.counts()
    row = np.repeat(np.arange(len(n)), n)
    used = np.unique(row * max(1, len(words.distinct)) + words.codes)
    distinct = np.bincount(used // max(1, len(words.distinct)), minlength=len(n))
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]

    def count(table: np.ndarray) -> np.ndarray:
        places = np.flatnonzero(table[data])
        return np.diff(np.searchsorted(places, offsets))

    code = np.arange(256)
    points = count((code & 0xC0) != 0x80)  # all bytes but those that continue a character
    capitals = count((code >= ord("A")) & (code <= ord("Z")))
    symbols = count(np.isin(code, np.frombuffer(SYMBOLS, np.uint8)))
    fails = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * capitals > MAX_CAPITAL_PERCENT * points, symbols > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (of the text) and mask of A to D, with the number of equal rows."""
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = [batch.column(c) for c in ("doc_id", "part", "digest")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(text_masks(batch.column("text")), pa.int32())], ["doc_id", "part", "digest", "mask"])

    schema = rows.select("doc_id", "part", "digest").schema.add("mask", "integer")
    return rows.mapInArrow(run, schema).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n: documents by the filters they fail and their labels.

    Whether a smaller id has the same text is asked by a join on text *and* id, which no text, however common, skews.
    """
    rows = stored(measured(docs), "measured")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    rows = rows.withColumn("mask", F.col("mask") + F.when(copy, DUPLICATE).otherwise(0))
    rows = rows.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    known = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                                         F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(known, "doc_id", "left").na.fill(False, ["good", "toxic"])
    return rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product in which sums are minima and products are sums."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def audit_part(mask: np.ndarray, good: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """All orders and steps of one part, from its counts by mask and labels."""
    size, m = len(FILTERS), 1 << len(FILTERS)
    counts = np.stack([np.bincount(mask, weights=w, minlength=m).astype(np.int64) for w in (n, n * good, n * toxic)])
    fails = (np.arange(m)[:, None] >> np.arange(size)) & 1 == 1  # mask x filter
    orders = np.array(list(permutations(range(size))))  # order x step: the filter
    place = np.argsort(orders, axis=1)  # order x filter: the step
    step = min_plus(np.where(fails, 0, NEVER), place.T)  # mask x order
    at = step[:, :, None] == np.arange(size)  # mask x order x step
    removed, good_lost, toxic_lost = np.einsum("cm,mos->cos", counts, at.astype(np.int64))
    kept = counts[0].sum() - np.cumsum(removed, axis=1)
    failing = fails[:, orders]  # mask x order x step: does the step's filter fail the mask
    gone = step[:, :, None] < np.arange(size)
    redundant = np.einsum("m,mos->os", counts[0], (failing & gone).astype(np.int64))
    alone = counts[0][1 << orders]
    shapley = np.zeros(size, np.int64)
    np.add.at(shapley, orders, removed)
    names = np.array(list(FILTERS))
    return pd.DataFrame({
        "filter_order": np.repeat(["".join(names[o]) for o in orders], size), "step": np.tile(np.arange(1, size + 1), len(orders)),
        "kept": kept.ravel(), "removed": removed.ravel(), "redundant": redundant.ravel(), "unique_fails": alone.ravel(),
        "good_lost": good_lost.ravel(), "toxic_lost": toxic_lost.ravel(), "shapley": shapley[orders].ravel(),
    })


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts, zeros included: 600 rows per part.

    A null text is empty (it fails A only); a null lang is the part of the empty string. Equal rows each count. A
    document with a null id is no copy and nobody's original, and has no labels. An id labelled more than once is good
    (toxic) if any of its labels says so. An empty table gives no rows. Other columns play no part.
    """
    counts = masks(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:  # 128 rows at most
        out = audit_part(pdf["mask"].to_numpy(), pdf["good"].to_numpy().astype(np.int64), pdf["toxic"].to_numpy().astype(np.int64), pdf["n"].to_numpy())
        out.insert(0, "part", pdf["part"].iloc[0])
        return out

    schema = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
              "good_lost long, toxic_lost long, shapley long")
    return counts.groupBy("part").applyInPandas(run, schema)
