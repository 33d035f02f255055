"""Path normalisation and URL grouping as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitloom.config import SiteRules
from hitloom.defaults import NO_LOCALE
from hitloom.functions.text import case_insensitive, quote, quoted


def normalise_path(path: Column) -> Column:
    """Path without query, with a leading slash, in lower case."""
    p = F.substring_index(F.coalesce(path, F.lit("")), "?", 1)
    return F.lower(F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p)))


def path_extension(path: Column) -> Column:
    """Lower-case extension of the last segment; NULL when it has none."""
    return F.nullif(F.lower(F.regexp_extract(path, r"[^/]*\.([^./]*)$", 1)), F.lit(""))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def request_segments(path: Column) -> Column:
    """Non-empty lower-case segments of a path, without query and fragment."""
    return segments(F.lower(F.regexp_replace(F.coalesce(path, F.lit("")), "[?#].*$", "")))


def join_key(path: Column) -> Column:
    """Path form shared by crawl and search data: no trailing slashes, lower case (the root is empty)."""
    return F.lower(F.rtrim(path, F.lit("/")))


def page_path(page: Column) -> Column:
    """Page address without scheme and host."""
    return F.regexp_replace(page, "^https?://[^/]+", "")


def page_join_key(page: Column) -> Column:
    return join_key(F.regexp_replace(page, r"\?.*$", ""))


def rule_group(p: str, ext: str, rules: SiteRules) -> str:
    """SQL for the group of the first matching rule of a normalised path; NULL when no rule matches."""
    branches = []
    for rule in rules.url_rules:
        if rule.match == "exact":
            hit = f"{p} = {quote(rule.value.lower())}"
        elif rule.match == "prefix":
            hit = f"startswith({p}, {quote(rule.value.lower())})"
        elif rule.match == "regex":
            hit = f"rlike({p}, {quote(case_insensitive(rule.value))})"
        elif rule.match == "ext":
            hit = f"{ext} IN ({quoted(e.lower() for e in rule.value)})"
        else:
            continue
        branches.append(f"WHEN {hit} THEN {quote(rule.group)}")
    return f"CASE {' '.join(branches)} END" if branches else "CAST(NULL AS STRING)"


def is_locale(segment: str, rules: SiteRules) -> str:
    """SQL test whether a segment is a known locale or looks like one."""
    tests = [f"{segment} IN ({quoted(rules.locales)})"] if rules.locales else []
    if rules.locale_pattern:
        tests.append(f"rlike({segment}, {quote(case_insensitive(f'^(?:{rules.locale_pattern})$'))})")
    return f"COALESCE({' OR '.join(tests)}, FALSE)" if tests else "FALSE"


def section_group(section: str, subsection: str, rules: SiteRules) -> str:
    """SQL for the mapped group of ``section/subsection``, else of ``section``, else the fallback."""
    fallback = quote(rules.fallback_group)
    if not rules.section_map:
        return fallback
    mapping = f"map({quoted(x for kv in rules.section_map.items() for x in kv)})"
    return f"COALESCE({mapping}[concat({section}, '/', {subsection})], {mapping}[{section}], {fallback})"


def classify_path(df, rules: SiteRules, path: str = "path"):
    """Add ``url_group``, ``locale`` and ``section``."""
    home = quote(rules.locale_homepage_group)
    return (
        df.withColumn("_p", normalise_path(F.col(path)))
        .withColumns({"_segs": segments(F.col("_p")), "_ext": path_extension(F.col("_p"))})
        .withColumn("_ruled", F.expr(rule_group("_p", "_ext", rules)))
        .withColumn("_local", F.expr(f"_ruled IS NULL AND {is_locale('get(_segs, 0)', rules)}"))
        .withColumns({
            "_section": F.expr("get(_segs, IF(_local, 1, 0))"),
            "_subsection": F.expr("get(_segs, IF(_local, 2, 1))"),
            "locale": F.expr(f"IF(_local, get(_segs, 0), {quote(NO_LOCALE)})"),
        })
        .withColumns({
            "url_group": F.expr(f"""CASE WHEN _ruled IS NOT NULL THEN _ruled WHEN size(_segs) = 0 THEN 'Home'
                WHEN _local AND size(_segs) = 1 THEN {home}
                ELSE {section_group('_section', '_subsection', rules)} END"""),
            "section": F.expr("IF(_ruled IS NULL, _section, NULL)"),
        })
        .drop("_p", "_segs", "_ext", "_ruled", "_local", "_section", "_subsection")
    )
