"""The SQL that each named query is checked against, runnable over the same Parquet tables.

Labels come from the literal values of the derived access log, not from the rule tables, so that the rules
are checked as well. Tables are common table expressions; each statement names only those it needs.
"""

from __future__ import annotations

import re

from hitloom.sources.derived import ACCESS_LOG_SQL, SEARCH_PERF_SQL

AI = "bot_category = 'AI Crawler'"
ERR = "status_class IN (4, 5)"
NOT_OK = "status_class IN (3, 4, 5)"
CURRENT, PREVIOUS = ("2024-01-16", "2024-01-30"), ("2024-01-01", "2024-01-15")


def n(cond: str | None = None) -> str:
    return "COUNT(*)" if cond is None else f"COUNT(*) FILTER (WHERE {cond})"


def s(expr: str, cond: str | None = None) -> str:
    return f"CAST(COALESCE(SUM({expr}){f' FILTER (WHERE {cond})' if cond else ''}, 0) AS BIGINT)"


def cols(**metrics: str) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in metrics.items())


def pct(part: str, whole: str, digits: int = 1) -> str:
    return f"ROUND(100.0 * ({part}) / NULLIF({whole}, 0), {digits})"


PARSED = """
SELECT date, ts_utc, edge_ip, country, method, path, 'HTTP/1.1' AS http_version,
  path || COALESCE('?' || query_string, '') AS request_target, query_string, status,
  CASE WHEN status < 300 THEN 2 WHEN status < 400 THEN 3 WHEN status < 500 THEN 4 ELSE 5 END AS status_class,
  bytes_sent, referer, user_agent, query_string IS NOT NULL AS is_parameterized,
  CASE WHEN referer IS NULL THEN 'Direct' WHEN referer LIKE 'https://www.example.com/%' THEN 'Internal'
    WHEN referer LIKE '%google%' THEN 'Search Engine' WHEN referer LIKE '%//t.co/%' THEN 'Social'
    WHEN referer LIKE '%chatgpt%' THEN 'AI Platform' ELSE 'Other' END AS referer_type,
  CASE WHEN referer LIKE 'https://www.example.com/%' THEN '/en/about' END AS referer_path,
  CASE WHEN path = '/' THEN 'Home' WHEN path = '/robots.txt' THEN 'Robots' WHEN path = '/sitemap-en.xml' THEN 'Sitemaps'
    WHEN starts_with(path, '/_nuxt/') THEN 'Nuxt Assets' WHEN path = '/api/v1/prices' THEN 'API'
    WHEN path = '/en' THEN 'Locale Homepage' WHEN starts_with(path, '/fr/') THEN 'About'
    WHEN starts_with(path, '/zh-hant/') THEN 'Analysis - Market News' WHEN path = '/EN-gb/Trading/' THEN 'Trading'
    WHEN path = '/wp-login.php' THEN 'Vulnerability Probe' WHEN starts_with(path, '/static/') THEN 'Static Assets'
    ELSE 'Other Content' END AS url_group,
  CASE WHEN path = '/en' THEN 'en' WHEN starts_with(path, '/fr/') THEN 'fr' WHEN starts_with(path, '/zh-hant/') THEN 'zh-hant'
    WHEN path = '/EN-gb/Trading/' THEN 'en-gb' ELSE 'no-locale' END AS locale,
  CASE WHEN starts_with(path, '/fr/') THEN 'about' WHEN starts_with(path, '/zh-hant/') THEN 'analysis'
    WHEN path = '/EN-gb/Trading/' THEN 'trading' WHEN starts_with(path, '/unknown/') THEN 'unknown' END AS section,
  starts_with(path, '/_nuxt/') OR starts_with(path, '/static/') AS is_resource,
  bot_family IS NOT NULL AS is_bot, bot_family,
  CASE WHEN bot_family IN ('Googlebot', 'Bingbot') THEN 'Search Engine'
    WHEN bot_family IN ('GPTBot', 'ClaudeBot') THEN 'AI Crawler' WHEN bot_family = 'HTTP Library' THEN 'HTTP Library'
    WHEN bot_family IS NOT NULL THEN 'Other' END AS bot_category,
  COALESCE(query_string LIKE 'utm%' OR query_string LIKE 'UTM%', FALSE) AS has_utm,
  CASE WHEN query_string LIKE '%ChatGPT%' THEN 'ChatGPT.com' WHEN query_string LIKE '%news%' THEN 'news' END AS utm_source,
  CASE WHEN query_string LIKE '%ChatGPT%' THEN 'chatgpt.com' WHEN query_string LIKE '%news%' THEN 'news' END AS utm_source_norm,
  CASE WHEN query_string LIKE '%medium=ref' THEN 'ref' WHEN query_string LIKE '%zz' THEN '%zz' END AS utm_medium,
  CASE WHEN query_string LIKE '%campaign%' THEN 'a b' END AS utm_campaign
FROM (SELECT *, CASE WHEN user_agent LIKE '%Googlebot%' THEN 'Googlebot' WHEN user_agent LIKE '%bingbot%' THEN 'Bingbot'
    WHEN user_agent LIKE '%GPTBot%' THEN 'GPTBot' WHEN user_agent LIKE 'ClaudeBot%' THEN 'ClaudeBot'
    WHEN user_agent LIKE 'curl%' THEN 'HTTP Library' WHEN user_agent = '-' THEN 'Unknown Bot'
    WHEN user_agent LIKE '%Chrome/57 %' THEN 'Fake Browser UA' WHEN referer LIKE '%ventrofx.com%' THEN 'Hotlink Bot'
    END AS bot_family FROM access_log) a
"""

TRAFFIC = cols(hits=n(), hits_bot=n("is_bot"), hits_human=n("NOT is_bot"))
CLASSES = ", ".join(f"{n(f'status_class = {c}')} AS s{c}xx" for c in (2, 3, 4, 5))
SIZE = f"{s('bytes_sent')} AS bytes_sent"
RESOURCES = cols(
    resource_hits=n("is_resource"), resource_bytes_sent=s("bytes_sent", "is_resource"),
    resource_4xx=n("is_resource AND status_class = 4"), resource_5xx=n("is_resource AND status_class = 5"),
    resource_hits_bot=n("is_resource AND is_bot"), resource_4xx_bot=n("is_resource AND is_bot AND status_class = 4"),
    resource_5xx_bot=n("is_resource AND is_bot AND status_class = 5"))
RESOURCE_PAIR = cols(resource_hits=n("is_resource"), resource_hits_bot=n("is_resource AND is_bot"))
WASTE = " + ".join(n(c) for c in ("is_parameterized", "status_class = 3", ERR, "is_resource AND is_parameterized",
                                  f"is_resource AND {NOT_OK}"))


def codes(*values: int) -> str:
    return ", ".join(f"{n(f'status = {v}')} AS s{v}" for v in values)


def agg(metrics: str, *keys: str, where: str | None = None, source: str = "parsed") -> str:
    """Grouped counts; a key may be written ``expression AS name``."""
    pairs = [k.rpartition(" AS ") for k in keys]
    names = [name for _, _, name in pairs]
    inner = f"SELECT *{''.join(f', {expr} AS k_{name}' for expr, _, name in pairs if expr)} FROM {source}"
    inner += f" WHERE {where}" if where else ""
    out = [f"k_{m} AS {m}" if " AS " in k else m for k, m in zip(keys, names)]
    by = [f"k_{m}" if " AS " in k else m for k, m in zip(keys, names)]
    group = f" GROUP BY {', '.join(by)}" if keys else ""
    return f"SELECT {', '.join([*out, metrics])} FROM ({inner}) x{group}"


AGGREGATES = {
    "daily": agg(", ".join([TRAFFIC, CLASSES, codes(200, 301, 302, 304, 307, 308, 400, 403, 404, 410, 500, 502, 503),
                            SIZE, RESOURCES]), "date"),
    "hourly": agg(", ".join([TRAFFIC, CLASSES, SIZE, RESOURCES]), "date",
                  "CAST(date_trunc('hour', ts_utc) AS TIMESTAMP) AS hour_local"),
    "bot_daily": agg(", ".join([f"{n()} AS hits", CLASSES, SIZE, cols(
        resource_hits=n("is_resource"), resource_errors=n(f"is_resource AND {NOT_OK}"),
        resource_hits_pct=f"ROUND(1.0 * {n('is_resource')} / COUNT(*), 6)")]),
        "date", "bot_family", "bot_category", where="is_bot"),
    "locale_daily": agg(", ".join([TRAFFIC, CLASSES, SIZE, RESOURCE_PAIR]), "date", "locale"),
    "group_daily": agg(", ".join([TRAFFIC, CLASSES, SIZE, RESOURCE_PAIR]), "date", "url_group"),
    "locale_group_daily": agg(", ".join([TRAFFIC, CLASSES, SIZE]), "date", "locale", "url_group"),
    "top_urls_daily": agg(", ".join([
        cols(hits_total=n(), hits_bot=n("is_bot"), hits_human=n("NOT is_bot"), s3xx=n("status_class = 3")),
        codes(301, 302, 303, 307, 308),
        cols(s4xx=n("status_class = 4"), s5xx=n("status_class = 5"), parameterized_hits=n("is_parameterized")), SIZE]),
        "date", "path", "url_group"),
    "top_4xx_daily": agg(", ".join([cols(hits_4xx=n(), hits_4xx_bot=n("is_bot"), bytes_sent_4xx=s("bytes_sent")),
                                    codes(400, 401, 403, 404, 405, 410, 422, 429)]),
                         "date", "path", "url_group", where="status_class = 4"),
    "top_5xx_daily": agg(", ".join([cols(hits_5xx=n(), hits_5xx_bot=n("is_bot")), codes(500, 502, 503, 504)]),
                         "date", "path", "url_group", where="status_class = 5"),
    "wasted_crawl_daily": agg(cols(
        bot_hits=n(), parameterized_bot_hits=n("is_parameterized"), redirect_bot_hits=n("status_class = 3"),
        error_bot_hits=n(ERR), resource_bot_hits=n("is_resource"),
        resource_parameterized_bot_hits=n("is_resource AND is_parameterized"),
        resource_error_bot_hits=n(f"is_resource AND {NOT_OK}"), waste_score=WASTE,
        waste_score_strict=f"{WASTE} + {n('is_resource')}"), "date", "path", "url_group", "bot_family", where="is_bot"),
    "top_resource_waste_daily": agg(cols(
        bot_hits=n(), resource_error_bot_hits=n(NOT_OK), status_404_bot_hits=n("status = 404"),
        waste_score_strict=f"{n(NOT_OK)} + COUNT(*)"), "date", "path", where="is_bot AND is_resource"),
    "human_urls_daily": agg(f"{n()} AS hits", "date", "path", "url_group", where="NOT is_bot"),
    "bot_urls_daily": agg(f"{n()} AS hits", "date", "bot_family", "path", "url_group", where="is_bot"),
    "bot_top_urls_daily": """SELECT date, bot_family, path, url_group, hits FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY date, bot_family ORDER BY hits DESC, path, url_group) AS rn
        FROM bot_urls_daily) r WHERE rn <= 50""",
    "utm_chatgpt_daily": agg(TRAFFIC, "date", where="utm_source_norm = 'chatgpt.com'"),
    "utm_chatgpt_urls_daily": agg(f"{n()} AS hits", "date", "path", "url_group", where="utm_source_norm = 'chatgpt.com'"),
    "utm_sources_daily": agg(TRAFFIC, "date", "COALESCE(utm_source_norm, '(none)') AS utm_source", where="has_utm"),
    "utm_source_urls_daily": agg(TRAFFIC, "date", "COALESCE(utm_source_norm, '(none)') AS utm_source", "path",
                                 "url_group", where="has_utm"),
    "referer_flow_daily": agg(f"{n()} AS hit_count", "date", "referer_path AS from_path", "path AS to_path",
                              "referer_type", where="referer_type = 'Internal' AND referer_path IS NOT NULL"),
}


def top_json(value: str, where: str, name: str) -> str:
    """JSON list of the five most requested values per date and family."""
    return f"""SELECT date, bot_family, to_json(list(v ORDER BY rn)) AS {name} FROM (
      SELECT date, bot_family, {value} AS v,
        ROW_NUMBER() OVER (PARTITION BY date, bot_family ORDER BY COUNT(*) DESC, {value}) AS rn
      FROM parsed WHERE {where} GROUP BY date, bot_family, {value}) q WHERE rn <= 5 GROUP BY date, bot_family"""


AI_PAGES = f"""SELECT DISTINCT p.date, p.bot_family, p.path, g.path IS NOT NULL AS shared
  FROM parsed p LEFT JOIN (SELECT DISTINCT date, path FROM parsed WHERE bot_family = 'Googlebot') g
    ON g.date = p.date AND g.path = p.path WHERE {AI}"""
AGGREGATES["ai_crawler_daily"] = f"""
SELECT b.date, b.bot_family, b.total_hits, b.unique_urls, b.bytes_sent, CAST(g.top_url_groups AS VARCHAR) AS top_url_groups,
  CAST(l.top_locales AS VARCHAR) AS top_locales, o.overlap AS overlap_with_googlebot
FROM (SELECT date, bot_family, COUNT(*) AS total_hits, COUNT(DISTINCT path) AS unique_urls, {SIZE}
      FROM parsed WHERE {AI} GROUP BY date, bot_family) b
JOIN ({top_json('url_group', AI, 'top_url_groups')}) g ON g.date = b.date AND g.bot_family = b.bot_family
JOIN ({top_json('locale', AI, 'top_locales')}) l ON l.date = b.date AND l.bot_family = b.bot_family
JOIN (SELECT date, bot_family, ROUND(AVG(CASE WHEN shared THEN 1.0 ELSE 0.0 END), 6) AS overlap
      FROM ({AI_PAGES}) p GROUP BY date, bot_family) o ON o.date = b.date AND o.bot_family = b.bot_family"""

NORM = "lower(rtrim(regexp_replace({}, '\\?.*$', ''), '/'))"


def search_agg(page: str) -> str:
    return f"""SELECT date, page, {cols(clicks=s('clicks'), impressions=s('impressions'))}, AVG(ctr) AS ctr,
      AVG(position) AS position FROM (SELECT * REPLACE ({page} AS page) FROM search_perf WHERE query IS NULL) r
      GROUP BY date, page"""


def gsc(source: str) -> str:
    return f"""
SELECT COALESCE(g.date, l.date) AS date, COALESCE(g.page, l.norm_path) AS page, COALESCE(g.clicks, 0) AS clicks,
  COALESCE(g.impressions, 0) AS impressions, ROUND(COALESCE(g.ctr, 0.0), 6) AS ctr,
  ROUND(COALESCE(g.position, 0.0), 6) AS position, COALESCE(l.crawl_hits, 0) AS crawl_hits,
  COALESCE(l.bot_hits, 0) AS bot_hits, COALESCE(l.human_hits, 0) AS human_hits,
  COALESCE(l.crawl_hits > 0, FALSE) AS has_crawl_activity, COALESCE(g.impressions > 0, FALSE) AS has_impressions,
  COALESCE(g.impressions > 0, FALSE) OR COALESCE(g.position > 0, FALSE) AS is_indexed
FROM ({source}) g FULL OUTER JOIN (
  SELECT date, {NORM.format('path')} AS norm_path, {cols(crawl_hits=n(), bot_hits=n('is_bot'), human_hits=n('NOT is_bot'))}
  FROM parsed GROUP BY 1, 2) l ON {NORM.format('g.page')} = l.norm_path AND g.date = l.date"""


STRIPPED = "regexp_replace(page, '^https?://[^/]+', '')"
AGGREGATES["gsc_daily"] = gsc(search_agg(STRIPPED))
AGGREGATES["gsc_bot_daily"] = f"""
SELECT b.*, COALESCE(g.clicks, 0) AS clicks, COALESCE(g.impressions, 0) AS impressions,
  ROUND(COALESCE(g.ctr, 0.0), 6) AS ctr, ROUND(g.position, 6) AS position,
  COALESCE(g.impressions, 0) > 0 AS has_impressions,
  COALESCE(g.impressions, 0) > 0 OR COALESCE(g.position, 0) > 0 AS is_indexed,
  CASE WHEN g.impressions > 0 AND g.position > 0 AND g.position <= 10 THEN 'strategic_top10'
    WHEN g.impressions > 0 THEN 'strategic_indexed' WHEN g.position > 0 THEN 'strategic_ranked_low'
    ELSE 'non_strategic_unindexed' END AS strategic_class
FROM (SELECT date, bot_family, {NORM.format('path')} AS page, {cols(
    crawl_hits=n(), ok_hits=n('status_class = 2'), redirect_hits=n('status_class = 3'), err_hits=n(ERR),
    param_hits=n('is_parameterized'), resource_hits=n('is_resource'))}
  FROM parsed WHERE is_bot GROUP BY 1, 2, 3) b
LEFT JOIN ({search_agg(STRIPPED)}) g ON {NORM.format('g.page')} = b.page AND g.date = b.date"""

PAGES = "SELECT page_id, url, regexp_replace(url, '^https?://[^/]+', '') AS path FROM pages"
TABLES = {
    "access_log": ACCESS_LOG_SQL.format(events="events", ts_type="TIMESTAMP"),
    "parsed": PARSED,
    "search_perf": SEARCH_PERF_SQL.format(access_log="access_log"),
    "web_pages": PAGES,
    **AGGREGATES,
}


def needed(sql: str) -> list[str]:
    """Tables that a statement refers to, directly or not, in the order of ``TABLES``."""
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(TABLES[name])

    visit(sql)
    order = ["access_log", "parsed", "search_perf", "web_pages", "bot_urls_daily"]
    rest = [t for t in TABLES if t not in order]
    return [t for t in [*order, *rest] if t in seen]


def statement(sql: str) -> str:
    ctes = ", ".join(f"{t} AS ({TABLES[t]})" for t in needed(sql))
    return f"WITH {ctes} {sql}" if ctes else sql


def count_by(*keys: str, source: str = "parsed", where: str | None = None) -> str:
    return agg(f"{n()} AS n", *keys, source=source, where=where)


# Ad-hoc groups and series ---------------------------------------------------------------------------------------

SEGS = "list_filter(string_split(lower(regexp_replace(path, '[?#].*$', '')), '/'), lambda x: x <> '')"
DIMS = {
    "path_segment_1": f"COALESCE({SEGS}[1], '(root)')", "path_segment_2": f"COALESCE({SEGS}[2], '(none)')",
    "path_depth": f"CAST(len({SEGS}) AS VARCHAR)", "status": "CAST(status AS VARCHAR)",
    "status_class": "CAST(status_class AS VARCHAR)", "is_bot": "CASE WHEN is_bot THEN 'Bot' ELSE 'Human' END",
}


def dim(name: str) -> str:
    return DIMS.get(name, f"COALESCE({name}, '(none)')")


def grouped(first: str, second: str | None = None, sort: str = "hits", where: str = "TRUE", limit: int = 500) -> str:
    keys = [first] + ([second] if second else [])
    waste = f", {WASTE} AS waste_score" if sort == "waste_score" else ""
    if waste:
        where += " AND is_bot"
    metrics = cols(hits=n(), hits_bot=n("is_bot"), hits_human=n("NOT is_bot"), bytes_total=s("bytes_sent"),
                   unique_ips="COUNT(DISTINCT edge_ip)", s4xx=n("status_class = 4"), s5xx=n("status_class = 5")) + waste
    body = agg(metrics, *[f"{dim(k)} AS {k}" for k in keys], where=where)
    order = [f"{sort} DESC"] + (["hits DESC"] if waste else []) + keys
    return f"SELECT * FROM ({body}) g ORDER BY {', '.join(order)} LIMIT {limit}"


def stacked(by: str, unit: str = "day", where: str = "TRUE") -> str:
    base = f"SELECT CAST(date_trunc('{unit}', ts_utc) AS TIMESTAMP) AS time_bucket, {dim(by)} AS k FROM parsed WHERE {where}"
    return f"""SELECT time_bucket, stack_k, COUNT(*) AS hits FROM (
      SELECT time_bucket, CASE WHEN k IN (SELECT k FROM ({base}) a GROUP BY k ORDER BY COUNT(*) DESC, k LIMIT 8)
        THEN k ELSE 'Other' END AS stack_k FROM ({base}) b) c GROUP BY time_bucket, stack_k"""


STATUS_COUNTS = ", ".join(f"{n(f'status BETWEEN {c}00 AND {c}99')} AS s{c}xx" for c in (2, 3, 4, 5))
PAGES_ONLY = "NOT is_resource"
GOOGLE = "is_bot AND bot_family = 'Googlebot' AND NOT is_resource"
PRESETS = {
    "top-4xx": grouped("path", where=f"status_class = 4 AND {PAGES_ONLY}"),
    "top-5xx": grouped("path", where=f"status_class = 5 AND {PAGES_ONLY}"),
    "top-3xx": grouped("path", where=f"status_class = 3 AND {PAGES_ONLY}"),
    "top-404": grouped("path", where=f"status = 404 AND {PAGES_ONLY}"),
    "top-urls": grouped("path", where=f"NOT is_bot AND {PAGES_ONLY}"),
    "url-groups": grouped("url_group"),
    "bot-families": grouped("bot_family", where="is_bot"),
    "bot-categories": grouped("bot_category", where="is_bot"),
    "crawl-waste": grouped("path", sort="waste_score", where="is_bot"),
    "googlebot-segments": grouped("path_segment_1", where=GOOGLE),
    "googlebot-subsegments": grouped("path_segment_1", "path_segment_2", where=GOOGLE),
    "googlebot-depth": grouped("path_depth", where=GOOGLE),
    "bot-segments": grouped("path_segment_1", where=f"is_bot AND {PAGES_ONLY}"),
    "heavy-urls": grouped("path", sort="bytes_total", where=PAGES_ONLY),
    "top-countries": grouped("country"),
    "top-locales": grouped("locale"),
    "utm-sources": grouped("utm_source_norm"),
    "internal-nav": grouped("referer_path", "path", where="referer_type = 'Internal'"),
    "referer-types": grouped("referer_type"),
    "traffic": stacked("is_bot"),
    "hourly-traffic": stacked("is_bot", "hour"),
    "status-over-time": stacked("status_class"),
    "errors-over-time": stacked("status_class", where=ERR),
    "methods-over-time": stacked("method"),
    "url-groups-over-time": stacked("url_group"),
    "bot-families-over-time": stacked("bot_family", where="is_bot"),
    "countries-over-time": stacked("country"),
    "referers-over-time": stacked("referer_type"),
}
VIEWS = {
    "all": "TRUE", "errors": ERR, "top-404": "status = 404", "ai-bots": AI, "humans": "NOT is_bot",
    "paid": "utm_source_norm IN ('google_ads', 'newsletter', 'chatgpt')",
}

ANY = ("path", "edge_ip", "user_agent", "referer")
FILTERS = {
    "flt_status": "status IN (404, 500)",
    "flt_status_class": "status_class IN (1, 4, 5)",
    "flt_in_list": "method = 'GET' AND url_group IN ('About', 'Trading', 'API') AND locale IN ('fr', 'en-gb', 'no-locale')"
                   " AND referer_type IN ('Direct', 'Social')",
    "flt_is_bot": "is_bot = FALSE",
    "flt_country": "country IN ('US', 'JP')",
    "flt_no_assets": "NOT is_resource",
    "flt_content_only": "url_group NOT IN ('Static Assets', 'Nuxt Assets', 'API', 'Feeds', 'Robots', 'Sitemaps', 'Well-Known')",
    "flt_search": "(" + " OR ".join(f"{c} ILIKE '%GOOGLE%'" for c in ANY) + ")",
    "flt_search_not_contains": " AND ".join(f"{c} NOT ILIKE '%google%'" for c in ANY),
    "flt_search_equals": "lower(path) = '/en-gb/trading/'",
    "flt_search_starts_with": "edge_ip ILIKE '10.0.3.%'",
    "flt_search_ends_with": "path ILIKE '%.png'",
    "flt_search_regex": "regexp_matches(path, '(?i)^/(FR|en)(/|$)')",
    "flt_search_family": "COALESCE(bot_family, '') ILIKE '%bot%'",
    "flt_search_host": "lower(COALESCE(regexp_extract(referer, '^https?://([^/]+)', 1), '')) = 't.co'",
    "flt_search_wildcard": "path ILIKE '%t_am-%%'",
    "flt_path_prefix": "path LIKE '/un%' AND path NOT LIKE '/unknown/page-1%'",
    "flt_path_rules": r"(path ILIKE '%\_nuxt%' ESCAPE '\' OR regexp_matches(path, '(?i)^/fr/.*-[0-3]$'))",
    "flt_path_rules_and": "path ILIKE '%/page-%' AND path NOT ILIKE '%-1%'",
    "flt_exclude": "(country IS NULL OR country NOT IN ('US')) AND (bot_family IS NULL OR bot_family NOT IN ('Googlebot', 'GPTBot'))"
                   " AND (utm_source_norm IS NULL OR utm_source_norm <> 'news') AND status <> 200",
    "flt_time_brush": "epoch_ms(ts_utc) BETWEEN 1704844800000 AND 1706054400000",
    "flt_search_operators": "status_class = 4 AND bot_family <> 'Googlebot' AND is_bot AND utm_source_norm = 'chatgpt.com'"
                            " AND (" + " OR ".join(f"regexp_matches({c}, '(?i)unknown|fr')" for c in ANY) + ")",
    "flt_like_escape": "contains(path, '_')",
}

HIST = """SELECT *, CAST(LEAST(FLOOR((ms - t0) / ((t1 - t0) / 60.0)), 59) AS BIGINT) AS bucket
  FROM (SELECT *, epoch_ms(ts_utc) AS ms, MIN(epoch_ms(ts_utc)) OVER () AS t0, MAX(epoch_ms(ts_utc)) OVER () AS t1
        FROM parsed) p"""


def histogram(**metrics: str) -> str:
    filled = ", ".join(f"COALESCE({m}, 0) AS {m}" for m in metrics)
    return (f"SELECT r.bucket, {filled} FROM (SELECT unnest(range(60)) AS bucket) r LEFT JOIN ("
            f"SELECT bucket, {cols(**metrics)} FROM ({HIST}) h GROUP BY bucket) c ON c.bucket = r.bucket")


# Reports --------------------------------------------------------------------------------------------------------

PERIOD = (f"CASE WHEN date BETWEEN '{CURRENT[0]}' AND '{CURRENT[1]}' THEN 'current'"
          f" WHEN date BETWEEN '{PREVIOUS[0]}' AND '{PREVIOUS[1]}' THEN 'previous' END")


def top(body: str, order: str, limit: int) -> str:
    return f"SELECT * FROM ({body}) t ORDER BY {order} LIMIT {limit}"


def trend(m: str) -> str:
    p, change = f"{m}_prev", f"100.0 * ({m} - {m}_prev) / {m}_prev"
    return (f"CASE WHEN {p} <> 0 THEN ROUND({change}, 4) END AS {m}_chg_pct,"
            f" CASE WHEN {p} = 0 THEN CASE WHEN {m} = 0 THEN 'flat' ELSE 'new' END WHEN ABS({change}) < 0.5 THEN 'flat'"
            f" WHEN {m} > {p} THEN 'up' ELSE 'down' END AS {m}_trend")


TREND = f"""SELECT locale, hits, hits_human, hits_prev, hits_human_prev, {trend('hits')}, {trend('hits_human')} FROM (
  SELECT c.locale, c.hits, c.hits_human, COALESCE(p.hits, 0) AS hits_prev, COALESCE(p.hits_human, 0) AS hits_human_prev
  FROM (SELECT locale, {cols(hits=s('hits'), hits_human=s('hits_human'))} FROM locale_daily
        WHERE date BETWEEN '{CURRENT[0]}' AND '{CURRENT[1]}' GROUP BY locale) c
  LEFT JOIN (SELECT locale, {cols(hits=s('hits'), hits_human=s('hits_human'))} FROM locale_daily
        WHERE date BETWEEN '{PREVIOUS[0]}' AND '{PREVIOUS[1]}' GROUP BY locale) p ON p.locale = c.locale) j"""

PERIODS = """SELECT period, date_from, date_to, COUNT(*) AS hits FROM (
  SELECT 'default7' AS period, GREATEST(CAST(hi - 6 AS VARCHAR), lo) AS date_from, CAST(hi AS VARCHAR) AS date_to FROM b
  UNION ALL SELECT 'last14', CAST(hi - 13 AS VARCHAR), CAST(hi AS VARCHAR) FROM b
  UNION ALL SELECT 'current', CAST(hi - 6 AS VARCHAR), CAST(hi AS VARCHAR) FROM b
  UNION ALL SELECT 'previous', CAST(hi - 13 AS VARCHAR), CAST(hi - 7 AS VARCHAR) FROM b) r
JOIN parsed p ON p.date BETWEEN r.date_from AND r.date_to GROUP BY period, date_from, date_to""".replace(
    "FROM b", "FROM (SELECT CAST(MAX(date) AS DATE) AS hi, MIN(date) AS lo FROM parsed) b")

ERR_PCT = pct("s4xx + s5xx", "hits")
DAYS = f"SELECT date, hits, {ERR_PCT} AS error_pct, AVG({ERR_PCT}) OVER () AS mean FROM daily WHERE hits > 0"
EARLY, EARLY_AFTER = "date <= '2024-01-03'", "date >= '2024-01-04'"
NO_LOCALE = "locale = 'no-locale'"
GOOGLE_ONLY = "bot_family = 'Googlebot'"
WASTED = f"{GOOGLE_ONLY} AND strategic_class = 'non_strategic_unindexed'"


def reports() -> dict[str, str]:
    bots = (f"SELECT bot_family, {s('hits', EARLY_AFTER)} AS hits,"
            f" {s('hits', EARLY)} AS prev_hits FROM bot_daily GROUP BY bot_family")
    shown = "AVG({0}) FILTER (WHERE impressions > 0)"
    pages_q = agg(cols(clicks=s("clicks"), impressions=s("impressions"), avg_ctr="ROUND(AVG(ctr), 6)",
                       avg_position="ROUND(AVG(position), 6)", crawl_hits=s("crawl_hits")), "page",
                  where="has_impressions", source="gsc_daily")
    no_impressions = agg(cols(crawl_hits=s("crawl_hits"), bot_hits=s("bot_hits"), impressions=s("impressions")), "page",
                         where="crawl_hits > 0", source="gsc_daily") + " HAVING SUM(impressions) = 0"
    no_crawl = agg(cols(impressions=s("impressions"), clicks=s("clicks"), avg_position="ROUND(AVG(position), 6)",
                        crawl_hits=s("crawl_hits")), "page", where="impressions > 0",
                   source="gsc_daily") + " HAVING SUM(crawl_hits) = 0"
    locale_sums = {m: s(m) for m in ("hits", "hits_bot", "hits_human", "s4xx", "s5xx", "resource_hits", "resource_hits_bot")}
    locale_totals = agg(cols(**locale_sums), "locale", source="locale_daily")
    lg = {m: s(m) for m in ("hits", "hits_bot", "hits_human", "s4xx", "s5xx")}
    locale_groups = agg(cols(**lg), "locale", "url_group", source="locale_group_daily")

    def cell(g: str) -> str:
        cond = f"url_group = '{g}'"
        return f'{s("hits", cond)} AS "{g}"'

    return {
        "summary_kpis": f"SELECT period, {cols(hits=s('hits'), human=s('hits_human'), bot=s('hits_bot'), errors=s('s4xx + s5xx'), error_pct=pct('SUM(s4xx + s5xx)', 'SUM(hits)'), bytes=s('bytes_sent'))} FROM (SELECT *, {PERIOD} AS period FROM daily) d WHERE period IS NOT NULL GROUP BY period",
        "issue_404": f"SELECT *, CASE WHEN human_errors > 100 THEN 'high' ELSE 'medium' END AS severity FROM ({top(agg(cols(errors=s('s404'), human_errors=s('hits_4xx - hits_4xx_bot')), 'path', source='top_4xx_daily') + ' HAVING SUM(s404) > 0', 'human_errors DESC, path', 5)}) i WHERE human_errors > 10",
        "issue_5xx": f"SELECT *, CASE WHEN errors > 50 OR days_affected > 3 THEN 'high' ELSE 'medium' END AS severity FROM ({top(agg(cols(errors=s('hits_5xx'), days_affected='COUNT(DISTINCT date)'), 'path', source='top_5xx_daily'), 'errors DESC, path', 5)}) i WHERE errors > 5",
        "issue_wasteful_bot": f"SELECT *, {pct('errors', 'hits')} AS error_pct, CASE WHEN waste > 200 THEN 'medium' ELSE 'low' END AS severity FROM ({top(agg(cols(hits=s('bot_hits'), errors=s('error_bot_hits'), waste=s('waste_score')), 'bot_family', source='wasted_crawl_daily'), 'waste DESC, bot_family', 5)}) i WHERE waste > 50",
        "issue_bot_anomaly": f"SELECT *, {pct('hits - prev_hits', 'prev_hits', 0)} AS change_pct FROM (SELECT *, CASE WHEN prev_hits = 0 AND hits > 50 THEN 'new' WHEN prev_hits > 0 AND hits > prev_hits * 3 AND hits > 100 THEN 'spike' END AS kind FROM ({bots}) b) k WHERE kind IS NOT NULL",
        "issue_error_spike": f"SELECT date, hits, error_pct, ROUND(mean, 6) AS avg_pct FROM ({DAYS}) d WHERE mean > 0 AND error_pct > mean * 2 AND error_pct > 5",
        "error_spike_vs_mean": f"SELECT date, error_pct, ROUND(mean, 6) AS avg_pct, ROUND(error_pct / NULLIF(mean, 0), 6) AS ratio FROM ({DAYS}) d",
        "locale_totals": locale_totals,
        "locale_non_resource": f"SELECT locale, hits - resource_hits AS hits_non_resource, hits_bot - resource_hits_bot AS hits_bot_non_resource, hits_human - (resource_hits - resource_hits_bot) AS hits_human_non_resource FROM ({locale_totals}) l",
        "locale_group_matrix": f"SELECT locale, {cell('About')}, {cell('Trading')}, {cell('Home')} FROM locale_group_daily WHERE url_group IN ('About', 'Trading', 'Home') GROUP BY locale",
        "locale_groups": top(f"SELECT * FROM ({locale_groups}) g WHERE locale IN ('fr', 'en', 'no-locale')", "hits DESC, locale, url_group", 5),
        "search_kpis": f"SELECT period, {cols(total_clicks=s('clicks'), total_impressions=s('impressions'))}, ROUND({shown.format('ctr')}, 6) AS avg_ctr, ROUND({shown.format('position')}, 6) AS avg_position FROM (SELECT *, {PERIOD} AS period FROM gsc_daily WHERE has_impressions) g WHERE period IS NOT NULL GROUP BY period",
        "search_trend": agg(cols(clicks=s("clicks"), impressions=s("impressions"), avg_position=f"ROUND({shown.format('position')}, 6)"), "date", where="has_impressions", source="gsc_daily"),
        "search_top_pages": top(pages_q, "clicks DESC, page", 10),
        "search_top_queries": top(agg(cols(clicks=s("clicks"), impressions=s("impressions"), avg_ctr="ROUND(AVG(ctr), 6)", avg_position="ROUND(AVG(position), 6)"), "query", where="query IS NOT NULL", source="search_perf"), "impressions DESC, query", 200),
        "crawl_no_impressions": top(no_impressions, "crawl_hits DESC, page", 200),
        "impressions_no_crawl": top(no_crawl, "impressions DESC, page", 200),
        "crawl_vs_position": top(agg(cols(crawl_hits=s("crawl_hits"), avg_position="ROUND(AVG(position), 6)", impressions=s("impressions"), clicks=s("clicks")), "page", where="crawl_hits > 0 AND impressions > 0", source="gsc_daily"), "crawl_hits DESC, page", 200),
        "strategic_bots": top(agg(f"{s('crawl_hits')} AS hits", "bot_family", source="gsc_bot_daily"), "hits DESC, bot_family", 30),
        "strategic_kpis": agg(cols(total_crawl=s("crawl_hits"), strategic_crawl=s("crawl_hits", "strategic_class <> 'non_strategic_unindexed'"), top10_crawl=s("crawl_hits", "strategic_class = 'strategic_top10'"), non_strategic_crawl=s("crawl_hits", "strategic_class = 'non_strategic_unindexed'"), unique_pages="COUNT(DISTINCT page)", indexed_crawl=s("crawl_hits", "is_indexed")), where=GOOGLE_ONLY, source="gsc_bot_daily"),
        "strategic_by_class": f"SELECT strategic_class, hits, pages, ROUND(100.0 * hits / SUM(hits) OVER (), 1) AS pct_of_total FROM ({agg(cols(hits=s('crawl_hits'), pages='COUNT(DISTINCT page)'), 'strategic_class', where=GOOGLE_ONLY, source='gsc_bot_daily')}) c",
        "strategic_top_wasted": top(agg(cols(crawl_hits=s("crawl_hits"), err_hits=s("err_hits"), param_hits=s("param_hits")), "page", where=WASTED, source="gsc_bot_daily"), "crawl_hits DESC, page", 100),
        "strategic_top_good": top(agg(cols(crawl_hits=s("crawl_hits"), impressions=s("impressions"), clicks=s("clicks"), avg_position="ROUND(AVG(position), 6)"), "page", where=f"{GOOGLE_ONLY} AND strategic_class IN ('strategic_top10', 'strategic_indexed')", source="gsc_bot_daily"), "crawl_hits DESC, page", 100),
        "strategic_by_segment": top(agg(cols(crawl_hits=s("crawl_hits"), unique_pages="COUNT(DISTINCT page)"), "COALESCE(list_filter(string_split(page, '/'), lambda x: x <> '')[1], '(root)') AS path_segment_1", where=WASTED, source="gsc_bot_daily"), "crawl_hits DESC, path_segment_1", 30),
        "qa_no_locale": f"SELECT *, url_group NOT IN ('Home', 'Robots', 'Sitemaps', 'Nuxt Assets', 'API', 'Static Assets') AS unexpected FROM ({top(count_by('path', 'url_group', where=NO_LOCALE), 'n DESC, path, url_group', 30)}) q",
        "qa_no_locale_share": f"SELECT {cols(total_rows=n(), no_locale_rows=n(NO_LOCALE))}, ROUND(100.0 * COUNT(*) FILTER (WHERE locale = 'no-locale') / COUNT(*), 1) AS pct FROM parsed",
        "qa_no_locale_groups": count_by("url_group", where="locale = 'no-locale'"),
        "sink_csv_locales": f"SELECT locale, {', '.join(f'CAST({m} AS VARCHAR) AS {m}' for m in locale_sums)} FROM ({locale_totals}) l",
        "sink_csv_locale_groups": f"SELECT locale, url_group, {', '.join(f'CAST({m} AS VARCHAR) AS {m}' for m in lg)} FROM ({locale_groups}) l",
        "sink_csv_gsc_high_crawl_no_impressions": f"SELECT NULLIF(page, '') AS page, {', '.join(f'CAST({m} AS VARCHAR) AS {m}' for m in ('crawl_hits', 'bot_hits', 'impressions'))} FROM ({no_impressions}) l",
        "sink_csv_gsc_top_clicks": f"SELECT page, CAST(clicks AS VARCHAR) AS clicks, CAST(impressions AS VARCHAR) AS impressions, printf('%.2f%%', avg_ctr * 100) AS avg_ctr, printf('%.1f', avg_position) AS avg_position, CAST(crawl_hits AS VARCHAR) AS crawl_hits FROM ({pages_q}) l",
        "sink_csv_gsc_impressions_no_crawl": f"SELECT page, CAST(impressions AS VARCHAR) AS impressions, CAST(clicks AS VARCHAR) AS clicks, printf('%.1f', avg_position) AS avg_position, CAST(crawl_hits AS VARCHAR) AS crawl_hits FROM ({no_crawl}) l",
    }


INSIGHTS = {
    "busiest-days": top("SELECT date, hits, hits_human, hits_bot FROM daily", "hits DESC, date", 20),
    "bot-vs-human": "SELECT date, hits_human, hits_bot FROM daily",
    "traffic-trend": "SELECT date, hits FROM daily",
    "error-rate-trend": f"SELECT date, {ERR_PCT} AS error_pct FROM daily WHERE hits > 0",
    "top-pages": top(agg(f"{s('hits')} AS hits", "path", source="human_urls_daily"), "hits DESC, path", 20),
    "top-url-groups": top(agg(f"{s('hits_human')} AS human_hits", "url_group", source="group_daily"), "human_hits DESC, url_group", 20),
    "heaviest-pages": top(agg("ROUND(SUM(bytes_sent) * 1.0 / SUM(hits_total), 0) AS avg_bytes", "path", source="top_urls_daily"), "avg_bytes DESC, path", 20),
    "top-404": top(agg(f"{s('s404')} AS errors", "path", source="top_4xx_daily"), "errors DESC, path", 20),
    "top-5xx": top(agg(f"{s('hits_5xx')} AS errors", "path", source="top_5xx_daily"), "errors DESC, path", 20),
    "top-redirects": top(agg(f"{s('s3xx')} AS redirects", "path", source="top_urls_daily"), "redirects DESC, path", 20),
    "top-bots": top(agg(f"{s('hits')} AS hits", "bot_family", source="bot_daily"), "hits DESC, bot_family", 20),
    "wasted-bot-crawl": top(agg(cols(hits=s("bot_hits"), errors=s("error_bot_hits"), avg_waste="ROUND(AVG(waste_score), 2)"), "bot_family", source="wasted_crawl_daily"), "avg_waste DESC, bot_family", 20),
    "bot-trend": "SELECT date, hits_bot FROM daily",
    "bot-error-rates": top(agg(cols(s4xx=s("s4xx"), s5xx=s("s5xx"), hits=s("hits")), "bot_family", source="bot_daily"), "s4xx + s5xx DESC, bot_family", 20),
    "top-locales": top(agg(f"{s('hits_human')} AS human_hits", "locale", source="locale_daily"), "human_hits DESC, locale", 20),
    "locale-error-rates": top(agg(cols(errors=s("s4xx + s5xx"), hits=s("hits"), error_pct=pct("SUM(s4xx + s5xx)", "SUM(hits)")), "locale", source="locale_daily"), "error_pct DESC, locale", 20),
    "utm-sources": top(agg(f"{s('hits_human')} AS hits", "utm_source", source="utm_sources_daily"), "hits DESC, utm_source", 20),
    "utm-top-pages": top(agg(f"{s('hits_human')} AS hits", "path", source="utm_source_urls_daily"), "hits DESC, path", 20),
}

# Rule set of the rule queries.
PROFILE_GROUP = ("CASE WHEN path = '/' THEN 'Home' WHEN starts_with(path, '/static/') THEN 'Files'"
                 " WHEN path = '/en' THEN 'Locale Homepage' WHEN starts_with(path, '/fr/') THEN 'Company' ELSE 'Misc' END")
PROFILE_LOCALE = "CASE WHEN path = '/en' THEN 'en' WHEN starts_with(path, '/fr/') THEN 'fr' ELSE 'no-locale' END"
PAGE_KEY = "lower(split_part(path, '?', 1))"
HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
BAD = "status IN (404, 403, 410, 500)"


EXPORTED = ("edge_ip", "method", "path", "status", "bytes_sent", "is_bot", "bot_family", "bot_category", "user_agent", "url_group",
            "locale", "referer", "referer_type", "utm_source_norm", "country")
GROUP_METRICS = ("hits", "hits_bot", "hits_human", "bytes_total", "unique_ips", "s4xx", "s5xx")


def oracle_sql() -> dict[str, str]:
    late_humans = "date < '2024-01-15' OR NOT is_bot"
    affected = "date >= '2024-01-11'"
    detail_key = "SELECT * FROM parsed ORDER BY ts_utc DESC, path, edge_ip LIMIT 1"
    q = {
        "src_raw_log": count_by("date"),
        "src_date_from_filename": "SELECT DISTINCT date FROM parsed",
        "src_incremental_files": count_by("date", where=affected),
        "src_file_status": "SELECT DISTINCT date, CASE WHEN date < '2024-01-11' THEN 'ingested' WHEN date < '2024-01-21' THEN 'changed' ELSE 'pending' END AS status FROM parsed",
        "src_date_range_rebuild": agg(f"{n()} AS hits, {SIZE}", "date", where="date BETWEEN '2024-01-05' AND '2024-01-20'"),
        "sink_parsed": agg(f"{n()} AS hits, {SIZE}", "date", where=late_humans),
        "sink_aggregate": "SELECT date, url_group, hits, bytes_sent FROM group_daily",
        "sink_empty_typed": agg(f"{n()} AS hits", "date"),
        "scan_parsed_range": count_by("date", "url_group", where="date BETWEEN '2024-01-05' AND '2024-01-20'"),
        "scan_agg_range": "SELECT date, hits FROM daily WHERE date <= '2024-01-20'",
        "scan_union_by_name": count_by("CASE WHEN date >= '2024-01-15' THEN country END AS country"),
        "scan_schema_probe": count_by("method", "status"),
        "src_search_perf": "SELECT date, page, query, clicks, impressions, ROUND(ctr, 6) AS ctr, ROUND(position, 6) AS position FROM search_perf",
        "cov_available_dates": "SELECT DISTINCT date FROM parsed",
        "cov_freshness": "SELECT MAX(date) AS latest FROM parsed WHERE date < '2024-01-21'",
        "cov_backfill_missing": "SELECT DISTINCT date FROM parsed WHERE date >= '2024-01-15'",
        "src_emptied_files": "SELECT DISTINCT date, CASE WHEN date = '2024-01-05' THEN 'changed' ELSE 'ingested' END AS status FROM parsed",
        "sink_csv_logs": f"SELECT strftime(date_trunc('day', ts_utc), '%Y-%m-%d %H:%M:%S') AS time_bucket, {', '.join(f'CAST({m} AS VARCHAR) AS {m}' for m in ('s2xx', 's3xx', 's4xx', 's5xx', 'hits'))} FROM (SELECT date_trunc('day', ts_utc) AS ts_utc, {STATUS_COUNTS}, COUNT(*) AS hits FROM parsed GROUP BY 1) d",
        "sink_csv_log_rows": f"SELECT strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in EXPORTED)} FROM parsed WHERE status_class IN (4, 5)",
        "sink_csv_log_groups": f"SELECT bot_family, status, {', '.join(f'CAST({m} AS VARCHAR) AS {m}' for m in GROUP_METRICS)} FROM ({grouped('bot_family', 'status', where='is_bot')}) g",
        "fix_country_type": count_by("CASE WHEN date >= '2024-01-15' THEN country ELSE CAST(length(country) AS VARCHAR) END AS country"),
        "cfg_rules": count_by(f"{PROFILE_GROUP} AS url_group", f"{PROFILE_LOCALE} AS locale"),
        "parse_line": "SELECT date, ts_utc, edge_ip, country, status, bytes_sent, referer, user_agent FROM access_log",
        "parse_bad_lines": agg(cols(lines=n(), parsed_lines=n(f"NOT ({BAD})"), bad_lines=n(BAD)), "date", source="access_log"),
        "parse_time": "SELECT strftime(ts_utc, '%H') AS hour, COUNT(*) AS n, CAST(SUM(epoch_ms(ts_utc) // 1000) AS BIGINT) AS epochs FROM access_log GROUP BY 1",
        "parse_request": count_by("method", "path", "http_version", "request_target", "query_string", "is_parameterized AS has_query"),
        "status_class": count_by("status", "status_class"),
        "classify_bot": count_by("user_agent", "CASE WHEN bot_family = 'Hotlink Bot' THEN FALSE ELSE is_bot END AS is_bot", "NULLIF(bot_family, 'Hotlink Bot') AS bot_family", "CASE WHEN bot_family = 'Hotlink Bot' THEN NULL ELSE bot_category END AS bot_category"),
        "classify_bot_referer": count_by("referer", "user_agent", "bot_family"),
        "path_normalise": f"SELECT page_id, {PAGE_KEY} AS p FROM web_pages",
        "path_ext": f"SELECT page_id, NULLIF(regexp_extract({PAGE_KEY}, '\\.([^./]*)$', 1), '') AS ext FROM web_pages",
        "url_group_rules": count_by("path", "url_group"),
        "url_locale": count_by("path", "locale", "url_group"),
        "url_section": count_by("path", "section", "url_group"),
        "url_labels_pages": f"SELECT page_id, 'Other Content' AS url_group, split_part({PAGE_KEY}, '/', 2) AS locale, split_part({PAGE_KEY}, '/', 3) AS section FROM web_pages",
        "rules_diff": f"SELECT old_group, new_group, old_locale, new_locale, COUNT(DISTINCT path) AS paths, COUNT(*) AS hits FROM (SELECT path, url_group AS old_group, locale AS old_locale, {PROFILE_GROUP} AS new_group, {PROFILE_LOCALE} AS new_locale FROM parsed) d WHERE old_group <> new_group OR old_locale <> new_locale GROUP BY 1, 2, 3, 4",
        "is_resource": count_by("url_group", "is_resource"),
        "qs_decode": count_by("CASE WHEN query_string LIKE '%2527%' THEN 'UTM_SOURCE=''news''&utm_campaign=a b' ELSE query_string END AS decoded"),
        "parse_utm": count_by("query_string", "has_utm", "utm_source", "utm_source_norm", "utm_medium", "utm_campaign"),
        "utm_clean": count_by("utm_source"),
        "utm_chatgpt_flag": count_by("COALESCE(utm_source_norm = 'chatgpt.com', FALSE) AS is_utm_chatgpt"),
        "referer_host": f"SELECT page_id, {HOST} AS host FROM web_pages",
        "classify_referer": count_by("referer", "referer_type", "referer_path"),
        "classify_referer_pages": f"SELECT page_id, CASE WHEN internal THEN 'Internal' ELSE 'Other' END AS referer_type, CASE WHEN internal THEN regexp_extract(path, '^[^?#]*') END AS referer_path FROM (SELECT *, {HOST} = 'example.com' OR {HOST} LIKE '%.example.com' AS internal FROM web_pages) w",
        **{name: f"SELECT * FROM {name}" for name in AGGREGATES},
        "gsc_bot_daily_spread": "SELECT * FROM gsc_bot_daily",
        "gsc_daily_deduped": gsc(search_agg(NORM.format(STRIPPED))),
        "join_key_norm": f"SELECT page_id, {NORM.format('path')} AS norm_path FROM web_pages",
        "join_ref_update": count_by("date", "referer_type"),
        "prev_period_join": TREND,
        "trend_pct": TREND,
        "ai_overlap": f"SELECT bot_family, COUNT(*) AS pages, COUNT(*) FILTER (WHERE shared) AS shared_pages, ROUND(AVG(CASE WHEN shared THEN 1.0 ELSE 0.0 END), 6) AS overlap FROM ({AI_PAGES}) p GROUP BY bot_family",
        "topk_membership": f"SELECT k FROM (SELECT {dim('path_segment_1')} AS k FROM parsed) p GROUP BY k ORDER BY COUNT(*) DESC, k LIMIT 8",
        "lookup_dim_ua": count_by("user_agent", "is_bot", "bot_family", "bot_category"),
        "lookup_dictionaries": count_by("is_bot", "bot_family", "bot_category", "url_group", "locale", "section", "is_resource", "referer_type", "has_utm", "utm_source_norm", "utm_medium", "utm_campaign"),
        "lookup_dim_path": count_by("path", "url_group", "locale", "section"),
        "top5_per_group": f"SELECT date, bot_family, CAST(top_url_groups AS VARCHAR) AS top_url_groups FROM ({top_json('url_group', 'is_bot', 'top_url_groups')}) t",
        "topk_desc": top(agg(f"{s('hits_total')} AS hits", "path", source="top_urls_daily"), "hits DESC, path", 20),
        "multi_key_sort": grouped("url_group", "bot_family", "waste_score", limit=40),
        "rows_page": "SELECT ts_utc, path, edge_ip, bytes_sent, status, method FROM parsed ORDER BY bytes_sent, ts_utc, path, edge_ip, method, status, user_agent, request_target, referer NULLS FIRST LIMIT 50 OFFSET 100",
        "rows_count": "SELECT COUNT(*) AS total FROM parsed WHERE status = 404",
        "rows_page_deep": "SELECT ts_utc, path, edge_ip, bytes_sent, status, method FROM parsed ORDER BY bytes_sent DESC, ts_utc, path, edge_ip, method, status, user_agent, request_target, referer NULLS FIRST LIMIT 50 OFFSET 650",
        "rows_nth": "SELECT ts_utc, path, edge_ip, status, bytes_sent FROM parsed ORDER BY ts_utc, path, edge_ip, method, status, bytes_sent, user_agent, request_target, referer NULLS FIRST LIMIT 1 OFFSET 100",
        **{name: agg(f"{n()} AS n, {SIZE}", "path", "status", where=where) for name, where in FILTERS.items()},
        "q_rows": "SELECT ts_utc, path, edge_ip, method, status, bytes_sent, country, locale, is_bot, bot_family, user_agent, url_group, referer, referer_type, utm_source_norm FROM parsed WHERE status_class = 5 AND date BETWEEN '2024-01-05' AND '2024-01-20' ORDER BY ts_utc DESC, path, edge_ip, method, status, bytes_sent, user_agent, request_target, referer NULLS FIRST LIMIT 200",
        "q_rows_export": "SELECT ts_utc, edge_ip, method, path, status, bytes_sent, is_bot, bot_family, bot_category, user_agent, url_group, locale, referer, referer_type, utm_source_norm, country FROM parsed ORDER BY ts_utc DESC, path, edge_ip, method, status, bytes_sent, user_agent, request_target, referer NULLS FIRST",
        "q_group": grouped("country", "status_class", "unique_ips"),
        "dim_exprs": grouped("path_segment_2", "path_depth"),
        "q_waste_score": grouped("bot_family", sort="waste_score"),
        "q_timeseries_status": f"SELECT CAST(date_trunc('hour', ts_utc) AS TIMESTAMP) AS time_bucket, {STATUS_COUNTS}, COUNT(*) AS hits FROM parsed WHERE date = '2024-01-15' GROUP BY 1",
        "q_timeseries_stacked": stacked("path_segment_1"),
        "q_timeseries_wide": f"SELECT CAST(date_trunc('day', ts_utc) AS TIMESTAMP) AS time_bucket, {n('is_bot')} AS \"Bot\", {n('NOT is_bot')} AS \"Human\" FROM parsed GROUP BY 1",
        "q_histogram60": histogram(v=n()),
        "q_histogram60_bytes": histogram(v=s("bytes_sent")),
        "q_histogram60_status": histogram(**{f"s{c}xx": n(f"status_class = {c}") for c in (2, 3, 4, 5)}),
        "q_histogram60_bots": histogram(v_bot=n("is_bot"), v_human=n("NOT is_bot")),
        "q_histogram60_errors": f"SELECT *, ROUND(CASE WHEN tot > 0 THEN 100.0 * err / tot ELSE 0 END, 6) AS error_pct FROM ({histogram(err=n(ERR), tot=n())}) e",
        "q_histogram_totals": f"SELECT {cols(err=n(ERR), tot=n())}, ROUND(100.0 * COUNT(*) FILTER (WHERE {ERR}) / COUNT(*), 6) AS error_pct FROM parsed",
        "q_detail": f"SELECT ts_utc, path, edge_ip, method, url_group, locale, referer_type FROM ({detail_key}) d",
        "distinct_agg_values": "SELECT DISTINCT locale AS value FROM locale_daily",
        "distinct_parsed_values": "SELECT DISTINCT country AS value FROM parsed WHERE country IS NOT NULL",
        "suggest_values": "SELECT DISTINCT bot_family AS value FROM parsed WHERE lower(bot_family) LIKE '%bot%' ORDER BY value LIMIT 5",
        "suggest_values_index": "SELECT DISTINCT bot_family AS value FROM parsed WHERE lower(bot_family) LIKE '%bot%' ORDER BY value LIMIT 5",
        "unique_visitors_sketch": "SELECT url_group, COUNT(DISTINCT edge_ip) AS unique_ips, TRUE AS within_bound FROM parsed WHERE date BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY url_group",
        "period_default7": PERIODS,
        "period_last_n": PERIODS,
        "period_compare": PERIODS,
        **reports(),
        **{f"preset_{k.replace('-', '_')}": v for k, v in PRESETS.items()},
        **{f"view_{k.replace('-', '_')}": grouped("url_group", where=v) for k, v in VIEWS.items()},
        **{f"insight_{k.replace('-', '_')}": v for k, v in INSIGHTS.items()},
    }
    return {name: statement(sql) for name, sql in q.items()}
