"""DuckDB SQL that gives the rows of the queries which SQL can express."""

from __future__ import annotations


def _assign(i: int) -> str:
    """The assignment to the centroids c{i}: every vector meets all of them, and the nearest one stays."""
    return f"""a{i} AS MATERIALIZED (
  SELECT rid, min(d * 64 + k) % 64 AS k, min(d * 64 + k) // 64 AS d
  FROM (SELECT v.rid, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
        FROM v, c{i} c)
  GROUP BY rid)"""


def _update(i: int) -> str:
    """The centroids c{i+1}: exact floors of the means, by position; clusters without vectors keep theirs."""
    return f"""m{i} AS MATERIALIZED (
  SELECT k, list(f ORDER BY pos) AS x FROM (
    SELECT k, pos, ((s - ((s % n) + n) % n) // n)::BIGINT AS f FROM (
      SELECT a.k, u.pos, sum(u.y)::BIGINT AS s, count(*)::BIGINT AS n
      FROM a{i} a JOIN (SELECT rid, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM v) u USING (rid) GROUP BY 1, 2))
  GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (k))"""


def clustering(rounds: int = 5) -> str:
    steps = ",\n".join(f"{_assign(i)},\n{_update(i)}" for i in range(rounds))
    return f"""WITH w AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, x FROM w),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (
    SELECT x, sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h, x LIMIT 40)),
{steps},
{_assign(rounds)}
SELECT v.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON c.k = a.k"""


MIXING = r"""WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS digest
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source),
r AS (
  SELECT 0 AS turn, sum(source_size)::DOUBLE AS rest, sum(weight)::DOUBLE AS open FROM s
  UNION ALL
  SELECT r.turn + 1, (SELECT sum(source_size)::DOUBLE FROM s) - x.capped, x.open FROM r, LATERAL (
    SELECT coalesce(sum(CASE WHEN s.source_size * 3 <= s.weight::DOUBLE * r.rest / r.open THEN s.source_size * 3 END), 0)::DOUBLE AS capped,
           coalesce(sum(CASE WHEN s.source_size * 3 <= s.weight::DOUBLE * r.rest / r.open THEN 0 ELSE s.weight END), 0)::DOUBLE AS open FROM s) x
  WHERE r.turn < (SELECT count(*) FROM s) AND r.open > 0 AND x.open > 0),
l AS (SELECT arg_max(rest, turn) AS rest, arg_max(open, turn) AS open FROM r),
t AS (SELECT source, source_size, least(source_size * 3, weight::DOUBLE * l.rest / l.open)::DOUBLE AS target FROM s, l),
m AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0 END::DOUBLE AS rate,
    ('0x' || substr(md5('20240601:' || coalesce(d.doc_id::VARCHAR, '') || ':' || digest), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken,
  source, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies
FROM m"""

FILTER_AUDIT = r"""WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
k AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
f AS MATERIALIZED (
  SELECT part, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
      'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t),
      'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > firsts.first, false)} AS x,
    coalesce(k.good, false) AS good, coalesce(k.bad, false) AS bad
  FROM d JOIN firsts USING (t) LEFT JOIN k ON k.doc_id = d.doc_id),
g AS MATERIALIZED (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda n: CASE n WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END) AS fails,
    good, bad, count(*) AS n
  FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS n),
o AS (
  SELECT a.n || b.n || c.n || d.n || e.n AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.n, b.n, c.n, d.n, e.n])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
e AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, fails, good, bad, n,
    coalesce(list_min(list_transform(fails, lambda y: strpos(filter_order, y))), 99) AS gone FROM g, s),
r AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN list_contains(fails, letter) AND gone < step THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = [letter] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = step AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN gone = step AND bad THEN n ELSE 0 END) AS toxic_lost
  FROM e GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r"""

ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clustering": clustering(),
    "op12_source_mixing": MIXING,
    "op13_filter_audit": FILTER_AUDIT,
}
