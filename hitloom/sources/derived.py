"""Access log and search-performance rows derived from an ``events`` table.

Every event becomes one request, so the derived tables grow with ``events``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Portable SQL: both queries also run unchanged in other ANSI engines, over views of the same name.
ACCESS_LOG_SQL = """
SELECT CAST(CAST(ts_utc AS DATE) AS STRING) AS date, event_id, ts_utc,
  concat('10.0.', CAST(user_id % 8 AS STRING), '.', CAST(user_id % 250 AS STRING)) AS edge_ip,
  CASE user_id % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'JP' WHEN 2 THEN 'DE' WHEN 3 THEN 'FR' ELSE NULL END AS country,
  CASE WHEN event_type IN ('purchase','signup') THEN 'POST' ELSE 'GET' END AS method,
  CASE k % 12 WHEN 0 THEN '/' WHEN 1 THEN '/robots.txt' WHEN 2 THEN '/sitemap-en.xml'
    WHEN 3 THEN concat('/_nuxt/chunk.', CAST(k AS STRING), '.js') WHEN 4 THEN '/api/v1/prices' WHEN 5 THEN '/en'
    WHEN 6 THEN concat('/fr/about/team-', CAST(user_id % 7 AS STRING)) WHEN 7 THEN '/zh-hant/analysis/market-news'
    WHEN 8 THEN '/EN-gb/Trading/' WHEN 9 THEN '/wp-login.php'
    WHEN 10 THEN concat('/static/img-', CAST(k AS STRING), '.PNG')
    ELSE concat('/unknown/page-', CAST(user_id % 20 AS STRING)) END AS path,
  CASE event_id % 8 WHEN 0 THEN 'utm_source=ChatGPT.com&utm_medium=ref'
    WHEN 1 THEN 'UTM_SOURCE=%2527news%2527&utm_campaign=a+b'
    WHEN 2 THEN 'page=2' WHEN 3 THEN 'utm_medium=%zz' ELSE NULL END AS query_string,
  CASE WHEN event_type = 'error' THEN CASE k % 6 WHEN 0 THEN 404 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 410
      WHEN 4 THEN 500 ELSE 503 END
    WHEN k % 10 = 0 THEN 301 WHEN k % 10 = 1 THEN 304 ELSE 200 END AS status,
  CAST(floor(value * 100) AS BIGINT) AS bytes_sent,
  CASE event_id % 9 WHEN 0 THEN 'https://www.example.com/en/about?x=1' WHEN 1 THEN 'https://news.google.com/a'
    WHEN 2 THEN 'https://t.co/z' WHEN 3 THEN 'https://chatgpt.com/' WHEN 4 THEN 'https://ventrofx.com/q'
    WHEN 5 THEN 'https://blog.example.org/p' ELSE NULL END AS referer,
  CASE user_id % 10 WHEN 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)'
    WHEN 1 THEN 'Mozilla/5.0 (compatible; bingbot/2.0)' WHEN 2 THEN 'Mozilla/5.0 (compatible; GPTBot/1.1)'
    WHEN 3 THEN 'ClaudeBot/1.0' WHEN 4 THEN 'curl/7.88.1' WHEN 5 THEN '-' WHEN 6 THEN 'Mozilla/5.0 Chrome/57 Safari'
    ELSE 'Mozilla/5.0 (Windows NT 10.0) Chrome/146.0.7680.177 Safari/537.36' END AS user_agent
FROM (SELECT event_id, user_id, event_type, value, CAST(date_trunc('second', ts) AS {ts_type}) AS ts_utc,
             CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
"""

SEARCH_PERF_SQL = """
SELECT date, page, query, clicks, impressions,
  CASE WHEN impressions > 0 THEN CAST(clicks AS DOUBLE) / CAST(impressions AS DOUBLE)
    ELSE CAST(0 AS DOUBLE) END AS ctr,
  CASE WHEN h % 8 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 + h % 30 AS DOUBLE) END AS position
FROM (
  SELECT date, concat('https://www.example.com', path, v.sfx) AS page, v.q AS query, h,
    CASE WHEN h % 4 = 0 THEN CAST(0 AS BIGINT) ELSE h * 10 END AS impressions,
    CASE WHEN h % 4 = 0 THEN CAST(0 AS BIGINT) ELSE h END AS clicks
  FROM (
    SELECT date, path, CAST(sum(event_id) % 97 AS BIGINT) AS h FROM {access_log}
    WHERE path IN ('/en', '/zh-hant/analysis/market-news', '/EN-gb/Trading/') OR path LIKE '/fr/%'
    GROUP BY date, path
    UNION ALL
    SELECT date, '/never-crawled' AS path, CAST(count(*) % 97 AS BIGINT) AS h FROM {access_log} GROUP BY date) b
  CROSS JOIN (VALUES ('', CAST(NULL AS STRING)), ('?x=1', CAST(NULL AS STRING)), ('', 'open account'),
    ('', 'market news')) AS v(sfx, q)) s
"""

SITE_DOMAIN = "example.com"


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event, as columns."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(ACCESS_LOG_SQL.format(events="{events}", ts_type="TIMESTAMP_NTZ"), events=events)


def log_lines(log: DataFrame) -> DataFrame:
    """The requests of ``access_log`` as raw ``(date, value)`` log lines."""
    opt = lambda c, pre, post: F.coalesce(F.concat(F.lit(pre), F.col(c), F.lit(post)), F.lit(""))
    line = F.concat(
        "edge_ip", F.lit(" - "), opt("country", "", " "), F.lit("- ["),
        F.date_format("ts_utc", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'),
        "method", F.lit(" "), "path", opt("query_string", "?", ""), F.lit(' HTTP/1.1" '),
        F.col("status").cast("string"), F.lit(" "), F.col("bytes_sent").cast("string"), F.lit(' "'),
        F.coalesce("referer", F.lit("-")), F.lit('" "'), "user_agent", F.lit('"'),
    )
    return log.select("date", line.alias("value"))


def search_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search-performance rows of the pages of ``access_log``."""
    sql = SEARCH_PERF_SQL.format(access_log="{access_log}")
    return spark.sql(sql, access_log=access_log(spark, sf_dir))
