"""Single requests from clustered files, and suggestions from kept trigrams."""

import random

from pyspark.sql import functions as F

from hitloom.operators import suggestions, tables
from hitloom.plans import catalog
from hitloom.plans.refresh import Warehouse

SF = "/root/testdata/sf0.001"


def scanned_rows(df):
    """Rows that the file scans of an executed query gave on."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan()
    leaves = leaves.finalPhysicalPlan() if "AdaptiveSparkPlan" in leaves.nodeName() else leaves
    found, todo = 0, [leaves]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            found += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return found


def test_one_request_opens_one_row_group(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "wh"), catalog.RULES, clustered=True)
    lines = catalog.raw_lines(spark, SF).withColumn("date", F.lit("2024-01-10"))
    more = lines.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(59)))).select("date", F.regexp_replace("value", r'(GET|POST) (\S*)', F.concat(F.lit("$1 $2-"), "copy")).alias("value"))
    before = spark._jsc.hadoopConfiguration().get("parquet.block.size")
    spark._jsc.hadoopConfiguration().set("parquet.block.size", str(64 << 10))
    try:
        w.load_parsed(more.coalesce(1))
    finally:
        spark._jsc.hadoopConfiguration().set("parquet.block.size", before or str(128 << 20))
    total = w.parsed().count()
    one = w.parsed().where("path like '%-31'").orderBy("path", "ts_utc").select(F.col("ts_utc").cast("string").alias("ts"), "path", "edge_ip").first()
    found = tables.detail(w.parsed(), "2024-01-10", one.ts, one.path, one.edge_ip)
    assert total == 60_000 and 0 < scanned_rows(found) < total / 4
    assert [(r.path, r.edge_ip) for r in found.collect()] == [(one.path, one.edge_ip)]


def test_suggestions_equal_a_scan(spark):
    parsed = catalog.parsed(spark, SF).withColumn("utm_source_norm", F.concat(F.lit("Ünï_%src"), F.col("bytes_sent") % 90)).cache()
    values = suggestions.field_values(parsed).cache()
    grams = suggestions.field_grams(values).cache()
    rng, fields = random.Random(2), ["utm", "bot_family", "status", "locale", "url_group", "no such field"]
    known = [r.value for r in values.select("value").distinct().collect()]
    for _ in range(14):
        word = rng.choice(known)
        a = rng.randrange(len(word))
        needle = word[a : a + rng.randrange(1, 7)]
        for field in rng.sample(fields, 2):
            want = [r.value for r in tables.suggest_values(parsed, field, needle, 7).collect()]
            assert [r.value for r in suggestions.suggest(values, grams, field, needle, 7).collect()] == want, (field, needle)
    for df in (parsed, values, grams):
        df.unpersist()
