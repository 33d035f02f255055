"""Kept dictionaries of labelled values.

Labels depend on one field each: the bot rule on the user agent, the group on the path, the tags on the query, the
kind on the referer. A dictionary holds the labels of values seen before. Each load adds the values it brings more
than once (an anti join against what is known), so the rules run per value, not per line; values seen only once are
labelled in their line, so no label ever depends on a dictionary. A dictionary belongs to the rules it was made with:
its name holds their fingerprint, and those of other rules are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.config import SiteRules
from hitloom.functions import agents, referers, urls, utm
from hitloom.sources.versions import Transaction

FOLDER = "_dictionaries"
#: Part of the fingerprint: raise it when a label function changes.
LABELS_VERSION = 1
#: A dictionary up to this size is broadcast whole; of a larger one the most frequent values up to it are.
MAX_BROADCAST_BYTES = 48 << 20
#: What a broadcast row takes besides its texts.
ROW_BYTES = 100
#: Additions after which a dictionary is written anew as one.
MAX_ADDITIONS = 24


@dataclass(frozen=True)
class Kind:
    """A field, the columns that depend on it alone, and how they are made."""

    field: str
    labels: tuple[str, ...]
    classify: Callable[[DataFrame, SiteRules], DataFrame]


def _agent(df: DataFrame, rules: SiteRules) -> DataFrame:
    lowered = df.withColumn("_agent", F.lower("user_agent"))
    return lowered.withColumn("_agent_rule", F.coalesce(agents.first_rule("_agent", rules.bots), F.lit(-1))).drop("_agent")


def _referer(df: DataFrame, rules: SiteRules) -> DataFrame:
    lowered = df.withColumn("_lowered", F.lower("referer"))
    lowered = lowered.withColumn("_referer_rule", F.coalesce(agents.first_rule("_lowered", rules.referer_bots), F.lit(-1)))
    return referers.classify_referer(lowered.drop("_lowered"), rules.site_domain)


KINDS = {
    "agents": Kind("user_agent", ("_agent_rule",), _agent),
    "referers": Kind("referer", ("_referer_rule", "referer_type", "referer_path"), _referer),
    "paths": Kind("path", ("url_group", "locale", "section"), urls.classify_path),
    "queries": Kind("query_string", ("has_utm", *utm.UTM_FIELDS, "utm_source_norm", "is_utm_chatgpt"), lambda df, rules: utm.parse_utm(df)),
}


class Dictionaries:
    def __init__(self, change: Transaction, rules: SiteRules):
        self.change, self.rules = change, rules
        self.spark = change.store.spark
        self.mark = hashlib.sha256(f"{LABELS_VERSION} {rules!r}".encode()).hexdigest()[:16]

    def name(self, kind: str) -> str:
        return f"{FOLDER}/{kind}-{self.mark}"

    def _empty(self, kind: str) -> DataFrame:
        k = KINDS[kind]
        none = self.spark.createDataFrame([], f"date string, hits long, {k.field} string")
        return k.classify(none, self.rules).select("date", "hits", k.field, *k.labels)

    def read(self, kind: str) -> DataFrame:
        return self.change.read(self.name(kind), self._empty(kind).schema)

    def extend(self, requests: DataFrame) -> None:
        """Add the values that occur at least twice in the requests and are not known yet."""
        for table in list(self.change.now.tables):
            if table.startswith(f"{FOLDER}/") and not table.endswith(self.mark):
                self.change.forget(table, keep_files=True)
        for kind, k in KINDS.items():
            values = requests.where(F.col(k.field).isNotNull()).groupBy(k.field).agg(F.count(F.lit(1)).alias("hits")).where("hits > 1")
            known = self.change.now.dates(self.name(kind))
            if known:
                values = values.join(self.read(kind).select(k.field), k.field, "left_anti")
            # Few long texts meet costly rules: by count they would end in too few tasks.
            values = values.repartition(self.spark.sparkContext.defaultParallelism)
            label = f"{self.change.id}-{len(known)}"
            added = k.classify(values, self.rules).select(F.lit(label).alias("date"), "hits", k.field, *k.labels)
            if len(known) >= MAX_ADDITIONS:
                added = added.unionByName(self.read(kind).withColumn("date", F.lit(label)))
                self.change.write(self.name(kind), added, known)
            else:
                self.change.write(self.name(kind), added)

    def joined(self, df: DataFrame, kind: str) -> DataFrame:
        """The rows with ``_known_<kind>``: the labels of their value, or NULL if the dictionary lacks it.

        A dictionary within the size bound is broadcast. Of a larger one the frequent values are, and the others are
        joined by a shuffle to which the rows already answered go by a salt: no value there is frequent.
        """
        k, known = KINDS[kind], f"_known_{kind}"
        if not self.change.now.dates(self.name(kind)):
            return df.withColumn(known, F.lit(None).cast(self._empty(kind).select(F.struct(*k.labels)).schema[0].dataType))
        rows = self.read(kind)
        size = F.coalesce(F.octet_length(k.field), F.lit(0)) + ROW_BYTES
        for c in k.labels:
            size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
        n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        entries = rows.select(F.col(k.field).alias("_value"), F.struct(*k.labels).alias(known), "hits")
        if total <= MAX_BROADCAST_BYTES:
            return df.join(F.broadcast(entries.drop("hits")), F.col(k.field) == F.col("_value"), "left").drop("_value")
        frequent = self._frequent(rows, size)
        hot, cold = entries.where(frequent), entries.where(~frequent)
        df = df.join(F.broadcast(hot.drop("hits")), F.col(k.field) == F.col("_value"), "left").drop("_value")
        done = F.col(known).isNotNull() | F.col(k.field).isNull()
        spread = F.concat(F.lit("\0"), F.xxhash64(*[F.col(c) for c in df.columns if c in ("edge_ip", "ts_utc", "request_target")]).cast("string"))
        df = df.withColumn("_seek", F.when(done, spread).otherwise(F.col(k.field))).withColumnRenamed(known, "_hot")
        df = df.join(cold.drop("hits"), F.col("_seek") == F.col("_value"), "left")
        return df.withColumn(known, F.coalesce("_hot", known)).drop("_hot", "_seek", "_value")

    def _frequent(self, rows: DataFrame, size: Column) -> Column:
        """Test for the most frequent values that fit the bound together: a threshold found by halving."""
        low, high = 0, rows.agg(F.max("hits")).first()[0]  # too many above low, few enough above high
        while high - low > 1:
            middle = (low + high) // 2
            fits = (rows.where(F.col("hits") > middle).agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) <= MAX_BROADCAST_BYTES
            low, high = (low, middle) if fits else (middle, high)
        return F.col("hits") > high

    def labelled(self, df: DataFrame, kind: str) -> DataFrame:
        """The rows with the labels of a kind, looked up or, for values not kept, made in place."""
        k, known = KINDS[kind], f"_known_{kind}"
        df = self.joined(df, kind)
        hit = F.col(known).isNotNull()
        # The rules see NULL where the answer is known already.
        df = df.withColumnRenamed(k.field, "_field").withColumn(k.field, F.when(~hit, F.col("_field")))
        df = k.classify(df, self.rules)
        df = df.withColumns({c: F.when(hit, F.col(known)[c]).otherwise(F.col(c)) for c in k.labels})
        return df.withColumn(k.field, F.col("_field")).drop("_field", known)
