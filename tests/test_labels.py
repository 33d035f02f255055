"""Parsing and labelling of single values, all values of a kind in one job."""

from pyspark.sql import functions as F

from hitloom.config import SiteRules
from hitloom.functions import agents, lines, referers, urls, utm
from hitloom.operators import enrich

RULES = SiteRules.default("example.com")


def labelled(spark, schema, cases, label, *columns):
    rows = [(i, *c) for i, c in enumerate(cases)]
    df = label(spark.createDataFrame(rows, f"i int, {schema}"))
    return [tuple(r) for r in df.orderBy("i").select(*columns).collect()]


def test_paths(spark):
    none = "no-locale"
    cases = {
        "/": ("Home", none), "": ("Home", none), "/?utm_source=google": ("Home", none),
        "/robots.txt": ("Robots", none), "/sitemap-en.xml": ("Sitemaps", none),
        "/_nuxt/chunk.abc123.js": ("Nuxt Assets", none), "/api/v1/prices": ("API", none),
        "/getMenuStructure/foo": ("API", none), "/feed": ("Feeds", none),
        "/.well-known/assetlinks.json": ("Well-Known", none), "/some/path/file.css": ("Static Assets", none),
        "/style.css?v=3": ("Static Assets", none), "/wp-login.php": ("Vulnerability Probe", none),
        "/.git/HEAD": ("Vulnerability Probe", none), "/administrators": ("Vulnerability Probe", none),
        "/en": ("Locale Homepage", "en"), "/en/": ("Locale Homepage", "en"),
        "/zh-hans-cn": ("Locale Homepage", "zh-hans-cn"), "/en-gb": ("Locale Homepage", "en-gb"),
        "/ja": ("Locale Homepage", "ja"), "/es-419": ("Locale Homepage", "es-419"),
        "/about": ("About", none), "/mcp": ("Other Content", none), "/our-team": ("Other Content", none),
        "/en/about": ("About", "en"), "/zh-hant/analysis/market-insight": ("Analysis - Market Insight", "zh-hant"),
        "/en/analysis/other": ("Analysis", "en"), "/en/checkout": ("Other Content", "en"), "/EN/about": ("About", "en"),
        "//en/about": ("About", "en"), "/en/v1.0/release-notes": ("Other Content", "en"),
        "/ja/trading": ("Trading", "ja"),
    }
    got = labelled(spark, "path string", [(p,) for p in cases], lambda d: urls.classify_path(d, RULES),
                   "url_group", "locale")
    assert dict(zip(cases, got)) == cases


def test_sections(spark):
    cases = {"/en/about/team": "about", "/unknown/page": "unknown", "/en": None, "/robots.txt": None, "/": None}
    got = labelled(spark, "path string", [(p,) for p in cases], lambda d: urls.classify_path(d, RULES), "section")
    assert dict(zip(cases, (s for s, in got))) == cases


AGENTS = {
    "-": "Unknown Bot", "Mozilla/5.0 (compatible; Googlebot/2.1)": "Googlebot",
    "AdsBot-Google (+http://www.google.com/adsbot.html)": "AdsBot-Google",
    "GoogleAssociationService/1.0": "Google Special Crawlers", "python-requests/2.31.0": "HTTP Library",
    "curl/7.88.1": "HTTP Library", "Go-http-client/2.0": "HTTP Library", "zgrab/0.x": "Security Scanner",
    "Adobe Application Manager 2.0": "Security Scanner", "AHC/2.1": "Feed Crawler", "PTST/3.0": "Synthetic Monitor",
    "7Siters/1.1 (+https://7ooo.ru/siters/)": "7Siters", "Mozilla/5.0 Chrome/57 Safari/537": "Fake Browser UA",
    "Mozilla/5.0 Chrome/124.0.0": "Fake Browser UA", "Mozilla/5.0 Firefox/119.0 x": "Fake Browser UA",
    "SomeCrawler/1": "Other bot", "Mozilla/5.0 Chrome/124.0.6367.155 Safari/537.36": None, "curl/x": None, "": None,
}


def test_agents(spark):
    got = labelled(spark, "user_agent string, referer string", [(a, None) for a in AGENTS],
                   lambda d: agents.classify_bot(d, RULES), "bot_family", "is_bot")
    assert dict(zip(AGENTS, (f for f, _ in got))) == AGENTS
    assert all(b == (f is not None) for f, b in got)


def test_cached_agents_do_not_change_labels(spark):
    df = spark.createDataFrame([(a, None) for a in AGENTS] * 3, "user_agent string, referer string")
    cache = agents.frequent_agents(df, RULES, n=6)
    plain, cached = agents.classify_bot(df, RULES), agents.classify_bot(df, RULES, cache)
    columns = ["user_agent", "is_bot", "bot_family", "bot_category"]
    assert sorted(map(str, plain.select(columns).collect())) == sorted(map(str, cached.select(columns).collect()))


def test_referer_rule_only_for_humans(spark):
    human = "Mozilla/5.0 Chrome/124.0.6367.155 Safari/537.36"
    cases = [(human, "https://VENTROFX.com/q"), ("curl/7.1", "https://ventrofx.com/q"), (human, None)]
    got = labelled(spark, "user_agent string, referer string", cases, lambda d: agents.classify_bot(d, RULES),
                   "is_bot", "bot_family", "bot_category")
    assert got == [(True, "Hotlink Bot", "Other"), (True, "HTTP Library", "HTTP Library"), (False, None, None)]


def test_referers(spark):
    cases = {
        None: ("Direct", None), "": ("Direct", None), "-": ("Direct", None),
        "http://example.com/en/platform?ref=nav": ("Internal", "/en/platform"),
        "https://sub.example.com/page": ("Internal", "/page"), "https://EXAMPLE.com:8443": ("Internal", "/"),
        "https://u:p@example.com/a;v=1?x#y": ("Internal", "/a"), "//example.com/Rel": ("Internal", "/Rel"),
        "https://notexample.com/": ("Other", None), "https://WWW.GOOGLE.COM/search": ("Search Engine", None),
        "https://news.google.com/x": ("Search Engine", None), "https://t.co/a": ("Social", None),
        "https://not.co/a": ("Other", None), "https://claude.ai/chat/a": ("AI Platform", None),
        "https://bard.google.com/": ("AI Platform", None), "https://x.bard.google.com/": ("AI Platform", None),
        "https://blog.example.org/a": ("Other", None), "google.com/search": ("Other", None),
        "android-app://com.example": ("Other", None),
    }
    got = labelled(spark, "referer string", [(r,) for r in cases],
                   lambda d: referers.classify_referer(d, "example.com"), "referer_type", "referer_path")
    assert dict(zip(cases, got)) == cases
    assert labelled(spark, "referer string", [("https://example.com/page",)],
                    lambda d: referers.classify_referer(d, ""), "referer_type") == [("Other",)]


def test_utm(spark):
    cases = {
        None: (False, None, None), "page=2": (False, None, None), "x=utm_source": (False, None, None),
        "utm_source=ChatGPT.com&utm_medium=ref": (True, "ChatGPT.com", "ref"),
        "UTM_SOURCE=%2527news%2527": (True, "news", None), "utm_medium=%zz": (True, None, "%zz"),
        "utm_source=a&utm_source=b": (True, "a", None), "utm_source=+&UTM_SOURCE=up": (True, "up", None),
        "utm_source='`'&UTM_SOURCE=up": (True, None, None), "%75tm_source=enc": (True, "enc", None),
        "utm_source": (True, None, None), "utm_source=a%26b": (True, "a", None), "utm_term=%C3%A9+x": (True, None, None),
        "utm_source=it%27s": (True, "it's", None), "&&utm_source=a=b": (True, "a=b", None),
    }
    got = labelled(spark, "query_string string", [(q,) for q in cases], utm.parse_utm, "has_utm", "utm_source",
                   "utm_medium")
    assert dict(zip(cases, got)) == cases


def test_status_class(spark):
    cases = {200: 2, 204: 2, 308: 3, 429: 4, 504: 5, 100: 0, 0: 0, 600: 0}
    got = labelled(spark, "s int", [(c,) for c in cases],
                   lambda d: d.withColumn("k", lines.status_class(F.col("s"))), "k")
    assert dict(zip(cases, (k for k, in got))) == cases


LINE = '1.2.3.4 - {c}- [{t}] "{r}" {s} {b} "{ref}" "UA x"'


def line(c="", t="07/Mar/2026:01:30:00 +0800", r="GET /a?b=1 HTTP/1.1", s="200", b="5", ref="-"):
    return LINE.format(c=c, t=t, r=r, s=s, b=b, ref=ref)


def test_lines(spark):
    good = [line(), line(c="JP "), line(r="GET /a?"), line(r="GET"), line(r="GET ?x=1 HTTP/1.1"), line(r=""),
            line(r=r"GET /$1\1 HTTP/1.1"), line(t="07/Mar/2026:01:30:00 -0000")]
    bad = ["", "garbage", line(t="07/Mrz/2026:01:30:00 +0800"), line(s="20"), line(b="-"), line(b="9" * 20),
           line(ref='a"b')]
    raw = spark.createDataFrame([("2026-03-06", v) for v in good + bad], "date string, value string")
    got = enrich.parse_lines(raw.coalesce(1)).collect()
    assert len(got) == len(good)
    fields = [(r.country, r.method, r.path, r.query_string, r.has_query, r.http_version) for r in got]
    assert fields == [
        (None, "GET", "/a", "b=1", True, "HTTP/1.1"), ("JP", "GET", "/a", "b=1", True, "HTTP/1.1"),
        (None, "GET", "/a", None, True, None), (None, None, "/", None, False, None),
        (None, "GET", "/", "x=1", True, "HTTP/1.1"), (None, None, "/", None, False, None),
        (None, "GET", r"/$1\1", None, False, "HTTP/1.1"), (None, "GET", "/a", "b=1", True, "HTTP/1.1"),
    ]
    assert str(got[0].ts_utc) == "2026-03-06 17:30:00"
    counts = enrich.bad_line_counts(raw).first()
    assert (counts.lines, counts.parsed_lines, counts.bad_lines) == (len(good + bad), len(good), len(bad))


def test_utc_time_does_not_depend_on_the_session(spark):
    raw = spark.createDataFrame([("d", line())], "date string, value string")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert str(enrich.parse_lines(raw).first().ts_utc) == "2026-03-06 17:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_required_text_of_patterns():
    assert agents.alternatives(r"\bahc/\d|rss") == [(r"\bahc/\d", "ahc/"), ("rss", "rss")]
    assert agents.alternatives(r"a\.b?c(x|y)|[|]q{2}")[0] == (r"a\.b?c(x|y)", "a.")
    assert agents.alternatives(r"chrome/\d+([\s;/)]|$)|x") == [(r"chrome/\d+([\s;/)]|$)", "chrome/"), ("x", "x")]
