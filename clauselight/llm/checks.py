"""Checks in SQL for the queries that SQL can express."""

from clauselight.llm import chat_format as chat
from clauselight.llm.secret_scan import BASE_RULES

_PART = f"coalesce(CAST(floor(turn / {chat.TURNS_PER_PART}) AS BIGINT), -1)"

OP1 = f"""WITH m AS (SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn,
    coalesce(role, '{chat.UNNAMED}') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> '{chat.SYSTEM}'),
r AS (SELECT m.conv_id, speaker, {_PART} AS part, turn, role, text,
    '<|' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
      ELSE 'user ' || replace(replace(role, '<|', '< |'), '|>', '| >') END || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part
    ORDER BY turn NULLS FIRST, role, text) AS e FROM r)
SELECT conv_id, speaker, part, count(*) AS n_messages,
  CAST(coalesce(sum(length(body)) FILTER (role = speaker), 0) AS BIGINT) AS n_target,
  string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
  coalesce(string_agg((e - length(body)) || ':' || e, ',' ORDER BY turn NULLS FIRST, role, text)
    FILTER (role = speaker), '') AS mask
FROM o GROUP BY conv_id, speaker, part"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _kind(rank: int, rule) -> str:
    """(row number, span, rank) of one rule, from the lengths of matches and of what lies between."""
    p = _quoted(rule.pattern)
    return f"""SELECT n, {rank} AS rank, '{rule.kind}' AS kind, s AS start, s + length(m[i]) AS stop
  FROM (SELECT n, m, g, i, CAST(list_sum(list_transform(b[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT n, m, g, b, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT n, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {rule.group}) AS g,
        regexp_split_to_array(t, {p}) AS b FROM d WHERE regexp_matches(t, {p}))))
  WHERE length(g[i]) >= {rule.least}"""


def _count(kind: str) -> str:
    return f"count(*) FILTER (kind = '{kind}') AS n_{kind}"


def secrets(rules=BASE_RULES) -> str:
    found = " UNION ALL ".join(_kind(i, r) for i, r in enumerate(rules))
    spans = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found})
SELECT doc_id, {', '.join(_count(r.kind) for r in rules)}, sha256({spans}) AS base_sha256, {spans} AS spans
FROM d LEFT JOIN f USING (n) GROUP BY n, doc_id"""


_VECTORS = """v AS (SELECT DISTINCT vec_id, label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

OP11 = f"""WITH {_VECTORS},
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0) q
  JOIN (SELECT DISTINCT vec_id, e FROM v) c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5"""

OP13 = f"""WITH {_VECTORS},
r AS (SELECT vec_id, e, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM v WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same)
  WHERE n <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score
FROM (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
WHERE rank <= 5"""
