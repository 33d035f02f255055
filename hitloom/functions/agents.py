"""Bot detection from the user agent, then from the referer."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.config import BotRule, SiteRules
from hitloom.defaults import HUMAN_FAMILY
from hitloom.functions.expressions import alternatives
from hitloom.functions.text import case_insensitive, once, quote, quoted

_PLAIN = re.compile(r"(?:[a-z0-9 _/-]|\\\.)+", re.IGNORECASE)
_WHOLE = re.compile(r"\^([a-z0-9 _/-]+)\$", re.IGNORECASE)

# Upper bound of the broadcast table of frequent user agents.
MAX_CACHED_AGENTS = 20_000
COUNTERS_PER_AGENT, MAX_COUNTERS = 8, 1_000_000


def matches(lowered: str, pattern: str) -> str:
    """SQL test whether a lower-case text contains a match of a case-insensitive pattern.

    Alternatives that are plain text become substring tests; a real expression runs only on texts that
    contain the fixed part of it. Both are far cheaper per row than running every expression.
    """
    tests = []
    for alt, fixed in alternatives(pattern):
        if _PLAIN.fullmatch(alt):
            tests.append(f"contains({lowered}, {quote(alt.replace(chr(92) + '.', '.').lower())})")
        elif _WHOLE.fullmatch(alt):
            tests.append(f"{lowered} = {quote(_WHOLE.fullmatch(alt).group(1).lower())}")
        else:
            test = f"rlike({lowered}, {quote(case_insensitive(alt))})"
            tests.append(f"(contains({lowered}, {quote(fixed.lower())}) AND {test})" if len(fixed) > 1 else test)
    return " OR ".join(tests)


def first_rule(lowered: str, rules: tuple[BotRule, ...]) -> Column:
    """Position of the first rule that matches a lower-case column; NULL when none matches."""
    if not rules:
        return F.lit(None).cast("int")
    branches = " ".join(f"WHEN {matches(lowered, r.pattern)} THEN {i}" for i, r in enumerate(rules))
    return F.expr(f"CASE {branches} END")


def frequent_agents(requests: DataFrame, rules: SiteRules, n: int = MAX_CACHED_AGENTS) -> DataFrame:
    """Up to ``n`` frequent user agents with their rule position (-1 for none), from mergeable bounded counters.

    Each task keeps at most ``COUNTERS_PER_AGENT * n`` counters, and these merge; an agent with more than 2 of every
    ``COUNTERS_PER_AGENT * n`` requests is surely among them. Only a shortcut for ``classify_bot``: agents that are
    not in it are classified by the rules, so it may come from an older date without changing any result.
    """
    counters = min(COUNTERS_PER_AGENT * n, MAX_COUNTERS)
    top = requests.where(F.col("user_agent").isNotNull()).agg(F.expr(f"approx_top_k(user_agent, {int(n)}, {counters})").alias("top"))
    top = top.select(F.inline("top")).select(F.col("item").alias("user_agent"))
    rule = F.coalesce(first_rule("_agent", rules.bots), F.lit(-1))
    return top.select("user_agent", F.lower("user_agent").alias("_agent")).select(
        "user_agent", rule.alias("_cached_rule"))


def classify_bot(df: DataFrame, rules: SiteRules, cache: DataFrame | None = None) -> DataFrame:
    """Add ``is_bot``, ``bot_family`` and ``bot_category`` (both NULL for humans).

    The referer rules are tried only for requests that look human and have a referer. Rule positions that are
    already known (``_agent_rule``, ``_referer_rule``; -1 for none) are taken instead of matching.
    """
    by_agent = first_rule("_agent", rules.bots)
    if "_agent_rule" in df.columns:
        by_agent = F.nullif(F.col("_agent_rule"), F.lit(-1))
    if cache is not None:
        df = df.join(F.broadcast(cache.limit(MAX_CACHED_AGENTS)), "user_agent", "left")
        cached = F.col("_cached_rule")
        by_agent = F.when(cached.isNull(), by_agent).otherwise(F.nullif(cached, F.lit(-1)))
    df = once(df.withColumns({"_agent": F.lower("user_agent"), "_referer": F.lower("referer")}), _rule=by_agent)
    human = ", ".join(str(i) for i, r in enumerate(rules.bots) if r.family == HUMAN_FAMILY)
    bot_by_agent = f"(_rule IS NOT NULL{f' AND _rule NOT IN ({human})' if human else ''})"

    def label(field: str) -> str:
        agent = quoted(getattr(r, field) for r in rules.bots)
        referer = quoted(getattr(r, field) for r in rules.referer_bots)
        return (f"CASE WHEN {bot_by_agent} THEN get(array({agent}), _rule)"
                f" ELSE {f'get(array({referer}), _by_referer)' if referer else 'CAST(NULL AS STRING)'} END")

    by_referer = F.nullif(F.col("_referer_rule"), F.lit(-1)) if "_referer_rule" in df.columns else first_rule("_referer", rules.referer_bots)
    return (
        df.withColumn("_by_referer", F.when(F.expr(f"NOT {bot_by_agent}"), by_referer))
        .withColumns({
            "is_bot": F.expr(f"{bot_by_agent} OR _by_referer IS NOT NULL"),
            "bot_family": F.expr(label("family")),
            "bot_category": F.expr(label("category")),
        })
        .drop("_rule", "_by_referer", "_agent", "_referer", "_cached_rule", "_agent_rule", "_referer_rule")
    )
