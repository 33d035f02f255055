"""Kept dictionaries change no label; expressions are analysed soundly; counters and sketches keep their bounds."""

import random

import pytest
from pyspark.sql import functions as F

from hitloom.config import BotRule, SiteRules
from hitloom.functions import agents, expressions
from hitloom.operators import enrich, filters, sketches, tables
from hitloom.plans import catalog, dictionaries
from hitloom.plans.dictionaries import Dictionaries
from hitloom.sources.versions import Store

SF = "/root/testdata/sf0.001"
RULES = catalog.RULES


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def load(store, requests, rules=RULES):
    change = store.begin()
    Dictionaries(change, rules).extend(requests)
    change.commit()


def test_labels_are_the_same_with_dictionaries(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/s")
    requests = catalog.request_fields(spark, SF)
    odd = requests.withColumns({"path": F.lit(None).cast("string"), "user_agent": F.lit(None).cast("string"), "referer": F.lit("")}).limit(3)
    requests = requests.unionByName(odd).unionByName(odd)
    want = rows(enrich.enrich(requests, RULES))
    load(store, requests.where(F.col("date") < "2024-01-10"))
    load(store, requests.where(F.col("date") < "2024-01-20"))
    known = Dictionaries(store.begin(), RULES)
    for kind, k in dictionaries.KINDS.items():
        kept = known.read(kind)
        assert kept.count() == kept.select(k.field).distinct().count() > 0
    assert rows(enrich.enrich(requests, RULES, known)) == want
    # A dictionary beyond the broadcast bound: frequent values are broadcast, the others joined by a shuffle.
    monkeypatch.setattr(dictionaries, "MAX_BROADCAST_BYTES", 1_000)
    assert rows(enrich.enrich(requests, RULES, Dictionaries(store.begin(), RULES))) == want
    monkeypatch.undo()
    # Other rules make other dictionaries; the old ones are dropped.
    other = SiteRules.from_profile(catalog.PROFILE)
    load(store, requests, other)
    assert not any(t.endswith(known.mark) for t in store.snapshot().tables)
    assert rows(enrich.enrich(requests, other, Dictionaries(store.begin(), other))) == rows(enrich.enrich(requests, other))


def test_many_additions_are_written_as_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dictionaries, "MAX_ADDITIONS", 1)
    store = Store(spark, f"{tmp_path}/s")
    requests = catalog.request_fields(spark, SF)
    for last in ("2024-01-08", "2024-01-16"):
        load(store, requests.where(F.col("date") < last))
    known = Dictionaries(store.begin(), RULES)
    assert len(store.snapshot().dates(known.name("paths"))) == 1
    want = requests.where(F.col("date") < "2024-01-08").groupBy("path").count().where("count > 1").select("path")
    assert want.subtract(known.read("paths").select("path")).count() == 0


ATOMS = ["a", "b", "oo", r"\x67", r"g", "g", r"\.", ".", "[ab]", "[^g]", "(a|b)", "(?:go)", r"\d", r"\w", r"\Qa.\E", "x", "/", r"\b", "é", r"\p{L}"]


def test_required_texts_are_sound(spark):
    rng = random.Random(7)
    patterns = []
    for _ in range(60):
        branches = ["".join(rng.choice(ATOMS) + rng.choice(["", "", "", "?", "*", "+", "{1,2}", "{0}"]) for _ in range(rng.randrange(1, 5)))
                    for _ in range(rng.randrange(1, 3))]
        patterns.append("|".join(branches))
    patterns += [r"\x67oogb+ot", "^curl$", "bot|crawl(er)?", r"(?i)GOO", "[a|b]x"]
    texts = ["", "a", "ab", "google", "goo.gl/x", "a.b", "googbot", "googbbot", "curl", "crawl", "é", "xg", "b/ooa", "1g", "ggoox", "a.", "agob"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    usable = [p for p in patterns if not re_error(p)]
    assert len(usable) > 40
    checks = [F.count_if(F.expr(f"({agents.matches('t', p)}) <> rlike(t, {agents.quote(agents.case_insensitive(p))})")).alias(f"c{i}") for i, p in enumerate(usable)]
    got = df.agg(*checks).first()
    assert {p: n for p, n in zip(usable, got) if n} == {}
    assert expressions.alternatives(r"\x67oogb+ot") == [(r"\x67oogb+ot", "goog")]


def re_error(pattern):
    try:
        expressions.check(pattern)
    except ValueError:
        return True
    return False


def test_expressions_are_checked_where_they_run(spark):
    df = catalog.parsed(spark, SF)
    expressions.check(r"\p{javaLowerCase}+")  # Java's, unknown to Python
    for bad in ("(", r"(?P<x>a)", "a{2"):
        with pytest.raises(ValueError):
            filters.apply(df, filters.FilterSpec(search=bad, search_mode="regex"))
    with pytest.raises(ValueError):
        filters.parse_path_rules([r"regex:(?P<x>a)"])


def test_frequent_agents_are_found_by_bounded_counters(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 4 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit("warm"))
                                    .otherwise(F.concat(F.lit("a"), F.col("id"))).alias("user_agent"))
    rules = SiteRules(bots=(BotRule("hot", "Hot", "x"),), referer_bots=(), locales=(), url_rules=())
    got = {r.user_agent: r._cached_rule for r in agents.frequent_agents(df.repartition(8), rules, n=64).collect()}
    assert len(got) <= 64 and got["hot"] == 0 and got["warm"] == -1


def test_sketches_merge_over_any_range(spark):
    df = spark.range(60_000).select(F.concat(F.lit("d"), F.col("id") % 3).alias("date"), F.concat("id", F.lit(".x")).alias("edge_ip"),
                                    F.lit("g").alias("url_group"), (F.col("id") % 2).cast("string").alias("bot_family"))
    kept = sketches.visitor_sketches(df.unionByName(df))
    for range_, keys, want in ((["d0"], [], 20_000), (["d0", "d1", "d2"], ["bot_family"], 30_000)):
        for r in sketches.unique_visitors(kept.where(F.col("date").isin(range_)), *keys).collect():
            assert abs(r.unique_ips - want) <= sketches.ERROR_BOUND * want


@pytest.mark.parametrize("text, low, high", [
    ("2024-01-05", "2024-01-05 00:00:00", "2024-01-05 23:59:59.999999"), ("2024-01-05 1", "2024-01-05 00:00:00", "2024-01-05 23:59:59.999999"),
    ("2024-01-05 10:30:0", "2024-01-05 10:30:00", "2024-01-05 10:30:59.999999"), ("2024-01-05 10:30:01.5", "2024-01-05 10:30:01", "2024-01-05 10:30:01.999999"),
])
def test_time_texts_as_ranges(text, low, high):
    assert [str(t) for t in tables.time_span(text)] == [low, high]


def test_texts_without_a_day_have_no_range():
    assert [tables.time_span(t) for t in ("", "2024-0", "2024-01-3", "x" * 30)] == [None] * 4
