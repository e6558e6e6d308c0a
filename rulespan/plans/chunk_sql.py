"""The SQL that must give the chunks of the recursive splitter."""

from __future__ import annotations

from rulespan.operators.chunks import Profile


def chunks_sql(profile: Profile) -> str:
    """The recursive splitter in SQL: parts of a text cut at ever finer separators, then pieces packed into chunks."""
    size, overlap, last = profile.size, profile.overlap, len(profile.separators)
    names = ", ".join("'" + s.replace("\n", "' || chr(10) || '") + "'" for s in profile.separators)
    return f"""
    WITH RECURSIVE s AS (SELECT [{names}] AS seps),
    part AS (
      SELECT doc_id, 0 AS a, text AS body, (SELECT min(l) FROM generate_series(1, {last}) g(l), s WHERE l = {last} OR contains(text, seps[l])) AS level
      FROM documents WHERE text <> ''
      UNION ALL
      SELECT doc_id, a, body, (SELECT min(l) FROM generate_series(deeper, {last}) g(l), s WHERE l = {last} OR contains(body, seps[l])) FROM (
        SELECT doc_id, a + sum(length(piece)) OVER (PARTITION BY doc_id, a ORDER BY i ROWS UNBOUNDED PRECEDING) - length(piece) AS a, piece AS body, level + 1 AS deeper
        FROM (SELECT doc_id, a, level, i, CASE WHEN i = 1 THEN x ELSE seps[level] || x END AS piece
          FROM (SELECT doc_id, a, level, unnest(string_split(body, seps[level])) AS x, generate_subscripts(string_split(body, seps[level]), 1) AS i, seps
            FROM part, s WHERE level < {last}))
      ) WHERE length(body) >= {size}),
    piece AS (
      SELECT doc_id, part_a, level, i, length(x) + CASE WHEN i = 1 THEN 0 ELSE length(sep) END AS n FROM (
        SELECT doc_id, a AS part_a, level, seps[level] AS sep, unnest(string_split(body, seps[level])) AS x, generate_subscripts(string_split(body, seps[level]), 1) AS i
        FROM part, s WHERE level < {last})),
    placed AS (
      SELECT doc_id, part_a, level, i, n, part_a + sum(n) OVER w - n AS a, count(*) FILTER (WHERE n >= {size}) OVER w AS run
      FROM piece WHERE n > 0 WINDOW w AS (PARTITION BY doc_id, part_a, level ORDER BY i ROWS UNBOUNDED PRECEDING)),
    groups AS (
      SELECT doc_id, part_a, level, run, list_append(list(a ORDER BY a), max(a + n))::BIGINT[] AS bounds FROM placed WHERE n < {size} GROUP BY ALL),
    packed AS (
      SELECT doc_id, bounds, 1::BIGINT AS low, (SELECT max(j) FROM generate_series(2, len(bounds)) g(j) WHERE bounds[j] - bounds[1] <= {size}) AS high FROM groups
      UNION ALL
      SELECT doc_id, bounds, low, (SELECT max(j) FROM generate_series(low + 1, len(bounds)) g(j) WHERE bounds[j] - bounds[low] <= {size}) FROM (
        SELECT doc_id, bounds, (SELECT min(k) FROM generate_series(low, high) g(k)
          WHERE bounds[high] - bounds[k] <= {overlap} AND bounds[high + 1] - bounds[k] <= {size}) AS low
        FROM packed WHERE high < len(bounds))),
    chars AS (
      SELECT doc_id, a + k * {size - overlap} AS a, least(a + k * {size - overlap} + {size}, a + length(body)) AS b
      FROM part, generate_series(0, 1000000) g(k) WHERE level = {last} AND k <= greatest(0, ceil((length(body) - {size}) / {size - overlap}.0))),
    spans AS (SELECT doc_id, bounds[low] AS a, bounds[high] AS b FROM packed UNION ALL SELECT doc_id, a, b FROM chars),
    cut AS (SELECT doc_id, a, regexp_replace(regexp_replace(substring(text, (a + 1)::BIGINT, (b - a)::BIGINT), '^\\s+', ''), '\\s+$', '') AS chunk FROM spans JOIN documents USING (doc_id))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INTEGER AS chunk_no, chunk FROM cut WHERE chunk <> ''"""
