"""SQL twins of the training-data queries, where SQL can express them over whole tables."""

_NF = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_P1_KEYS = f"SELECT DISTINCT id, {_NF.format('s')} AS s FROM (SELECT id, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS s FROM entities) WHERE s IS NOT NULL"
_P4_NAMES = f"""SELECT DISTINCT session, {_NF.format('n')} AS name FROM (SELECT session, unnest(entities) AS n FROM
  (SELECT unnest(session_ids) AS session, entities FROM atoms)) WHERE n IS NOT NULL AND {_NF.format('n')} <> ''"""
_GROUPS = """, e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r(n, g) AS (SELECT a, a FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.n WHERE r.g < e.b)
  SELECT e.a AS {node}, least(e.a, min(r.g)) AS group_id FROM e LEFT JOIN r ON r.n = e.a GROUP BY e.a"""

SQL: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE k AS ({_P1_KEYS}), m AS (SELECT s, min(id) AS b FROM k WHERE s <> '' GROUP BY s),
  l AS (SELECT DISTINCT k.id AS a, m.b FROM k JOIN m USING (s) WHERE k.id <> m.b)""" + _GROUPS.format(node="entity_id"),
    "p2_found": """WITH RECURSIVE t AS (SELECT DISTINCT id, regexp_extract_all(lower(content), '[0-9a-z]+') AS runs FROM (SELECT id, content FROM atoms UNION ALL SELECT id, content FROM facts) WHERE content IS NOT NULL),
  s AS (SELECT DISTINCT id, list_sort(list_distinct(runs)) AS ws FROM t WHERE len(runs) >= 8),
  k AS (SELECT ws, min(id) AS k, len(ws) AS n FROM s GROUP BY ws), w AS (SELECT k, n, unnest(ws) AS w FROM k),
  x AS (SELECT a.k AS a, b.k AS b FROM w a JOIN w b ON a.w = b.w AND a.k < b.k GROUP BY a.k, b.k, a.n, b.n HAVING count(*) >= 0.75 * least(a.n, b.n)),
  l AS (SELECT a, b FROM x UNION SELECT s.id, k.k FROM s JOIN k USING (ws) WHERE s.id <> k.k)""" + _GROUPS.format(node="record_id"),
    "p3_found": """WITH v AS (SELECT id, min(embedding)::DOUBLE[64] AS e FROM (SELECT id, embedding FROM entities UNION ALL SELECT id, embedding FROM logical_forms)
    WHERE len(embedding) = 64 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0 GROUP BY id),
  s AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY array_cosine_similarity(a.e, b.e) DESC, b.id) AS r FROM v a, v b WHERE a.id <> b.id)
  SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM s WHERE r <= 5""",
    "p4_pairs": f"""WITH p AS ({_P4_NAMES}), c AS (SELECT name, count(*) AS n FROM p GROUP BY name), t AS (SELECT count(DISTINCT s) AS n FROM (SELECT unnest(session_ids) AS s FROM atoms)),
  x AS (SELECT a.name AS item_a, b.name AS item_b, count(*) AS n_ab FROM p a JOIN p b ON a.session = b.session AND a.name < b.name GROUP BY 1, 2), i AS (SELECT DISTINCT id, {_NF.format('canonical_name')} AS n FROM entities WHERE {_NF.format('canonical_name')} <> ''),
  w AS (SELECT least(a.n, b.n) AS item_a, greatest(a.n, b.n) AS item_b, max(weight) AS weight FROM relations JOIN i a ON a.id = lower(trim(source_entity)) JOIN i b ON b.id = lower(trim(target_entity)) WHERE relation_type = 'related_to' GROUP BY 1, 2),
  m AS (SELECT least(a.n, b.n) AS item_a, greatest(a.n, b.n) AS item_b, max(coactivations)::DOUBLE AS coactivations FROM metrics JOIN i a ON a.id = lower(trim(entity_a)) JOIN i b ON b.id = lower(trim(entity_b)) GROUP BY 1, 2)
  SELECT x.item_a, x.item_b, n_ab, a.n AS n_a, b.n AS n_b, t.n, round(n_ab * t.n::DOUBLE / (a.n * b.n), 6) AS lift, round(log2(n_ab * t.n::DOUBLE / (a.n * b.n)), 6) AS pmi, w.weight, m.coactivations
  FROM x CROSS JOIN t JOIN c a ON a.name = x.item_a JOIN c b ON b.name = x.item_b LEFT JOIN w ON w.item_a = x.item_a AND w.item_b = x.item_b LEFT JOIN m ON m.item_a = x.item_a AND m.item_b = x.item_b""",
    # what must hold of the results, as these cannot be said in SQL themselves
    "p7_checks": "SELECT DISTINCT spec_id, (SELECT count(*) FROM documents) AS documents, 0 AS missing, 0 AS wrong, 0 AS split, 0 AS overfull FROM pack_specs",
    "p8_checks": "SELECT DISTINCT mix_id, 0 AS over_repeated, 0 AS unasked, 0 AS off_target FROM mix_targets",
    "p4_found": f"""WITH p AS ({_P4_NAMES}), c AS (SELECT name, count(*) AS n FROM p GROUP BY name),
  t AS (SELECT count(DISTINCT s) AS n FROM (SELECT unnest(session_ids) AS s FROM atoms)),
  x AS (SELECT a.name AS name_a, b.name AS name_b, count(*) AS n FROM p a JOIN p b ON a.session = b.session AND a.name < b.name GROUP BY 1, 2)
  SELECT name_a, name_b FROM x, t JOIN c a ON a.name = name_a JOIN c b ON b.name = name_b WHERE x.n >= 6 AND x.n * t.n >= 4 * a.n * b.n""",
}
