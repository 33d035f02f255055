"""Deep pages by counting, joins with hot keys, histograms from one scan."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hitloom.operators import query, ranks, skew, tables
from hitloom.operators.query import QuerySpec
from hitloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df, mode="extended"):
    return df._jdf.queryExecution().toString() if mode == "extended" else df._jdf.queryExecution().executedPlan().toString()


def sort_key(order):
    def key(row):
        out = []
        for (_, up), v in zip(order, row):
            null = v is None
            if isinstance(v, str):
                v = v.encode()
            out.append((not null if up else null, Reverse(v) if not up and not null else (v if not null else 0)))
        return out

    return key


class Reverse:
    def __init__(self, v):
        self.v = v

    def __lt__(self, other):
        return other.v < self.v

    def __eq__(self, other):
        return self.v == other.v


def test_any_page_of_any_order(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SAMPLE", 40)
    monkeypatch.setattr(ranks, "RANGES", 6)
    rng = random.Random(3)
    rows = [(rng.choice([None, 0, 0, 0, 0, rng.randrange(40)]), rng.choice([None, "", "é", "z", f"k{rng.randrange(30)}"]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(4).cache()
    for order in ([("a", True), ("b", True), ("c", True)], [("a", False), ("b", True), ("c", False)], [("b", False), ("c", True)]):
        at = ["abc".index(c) for c, _ in order]
        want = sorted([tuple(r[i] for i in at) for r in rows], key=sort_key(order))
        for offset, limit in ((0, 7), (133, 40), (390, 30), (399, 1), (400, 5)):
            got = ranks.page(df, order, offset, limit, shallow_rows=0, range_rows=9).select(*[c for c, _ in order]).collect()
            assert [tuple(r) for r in got] == want[offset : offset + limit], (order, offset, limit)
    df.unpersist()


def test_a_deep_page_orders_few_rows(spark):
    df = spark.range(400_000).select(F.timestamp_seconds(F.col("id") % 1000).alias("ts"), F.col("id").cast("string").alias("path"), (F.col("id") % 7).alias("status"))
    found = ranks.page(df, [("ts", False), ("path", True)], 200_000, 50)
    assert [r.ts.timestamp() for r in found.collect()] == [499.0] * 50
    ordered = found._jdf.queryExecution().optimizedPlan().toString()
    offset = int(ordered.split("LocalLimit ")[1].split()[0]) if "LocalLimit" in ordered else 0
    assert offset <= ranks.RANGE_ROWS + 50  # what any task hands on
    assert "Exchange rangepartitioning" not in plan(found, "physical")


def test_pages_out_of_bounds_are_errors(spark):
    df = catalog.parsed(spark, SF)
    for spec in (QuerySpec(page=0), QuerySpec(per_page=0), QuerySpec(per_page=query.MAX_PER_PAGE + 1)):
        with pytest.raises(ValueError):
            query.rows(df, spec)
    with pytest.raises(ValueError):
        tables.suggest_values(df, "bot_family", limit=tables.MAX_SUGGESTIONS + 1)
    with pytest.raises(ValueError):
        query.rows_nth(df, -1)


def test_hot_keys_of_the_right_side_are_spread(spark):
    right = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    left = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (2, "a"), (None, "x")], "k long, bot string")
    got = skew.left_join(left, right, ["k"], hot_rows=1_000, salts=16)
    want = left.join(right, ["k"], "left")
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        spread = skew.left_join(left, right, ["k"], hot_rows=1_000, salts=64).where("k = 0").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = sorted(r["count"] for r in spread)
    assert sum(sizes) == 20_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_the_histogram_reads_the_requests_once(spark):
    parsed = catalog.parsed(spark, SF)
    text = plan(query.per_instant(parsed, QuerySpec(), "errors"), "physical")
    assert text.count("events.parquet") == 1
    after = plan(query.histogram(parsed, QuerySpec(), "errors"))
    assert "events.parquet" not in after and "instants-" in after
    none = query.histogram(parsed.where(F.col("date") < "1970"), QuerySpec(), "errors").collect()
    assert len(none) == 60 and all(r.tot == 0 for r in none)


def test_one_instant_falls_into_the_first_bucket(spark):
    one = catalog.parsed(spark, SF).limit(1).withColumn("ts_utc", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"))
    assert [r.v for r in query.histogram(one, QuerySpec()).collect()] == [1] + [0] * 59
