"""Queries of graph upkeep, recall, dialogue, probes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.functions.vectors import cosine, usable
from tracewell.operators import beliefs as B
from tracewell.operators import evaluation as V
from tracewell.operators import graph as G
from tracewell.operators import models as M
from tracewell.operators import rows as R
from tracewell.operators import sessions as S
from tracewell.operators import upkeep as U
from tracewell.plans.common import Register, cur, cur_sql, name_sql
from tracewell.plans.memory import _ED, _INDEX, _RES, _edges, _resolved
from tracewell.plans.memory import SQL as MEMORY_SQL
from tracewell.runtime import table

query = Register()
A, E, L, FS, RL, BT, FA = (cur_sql(t) for t in ("atoms", "entities", "logical_forms", "form_status", "relations", "belief_tests", "facts"))
_K = "lower(trim({}))"
#: Atoms stored from here on are the new batch of the update queries.
SINCE = "2026-05-01 00:00:00"
_NEW = f"(SELECT * FROM {A} WHERE created_at >= TIMESTAMP '{SINCE}')"
_HIT = f"(SELECT r.id, r.entity_id, n.time_last FROM {_RES} r JOIN {_NEW} n USING (id))"


def _update(spark: SparkSession, d: str) -> U.GraphUpdate:
    atoms = cur(spark, d, "atoms").filter(F.col("created_at") >= F.lit(SINCE).cast("timestamp_ntz")).select("id", "entities", F.array("topic").alias("tags"), "time_last", "created_at")
    entities = cur(spark, d, "entities")
    counted = cur(spark, d, "relations").filter("relation_type = 'related_to'").select(X.ref_key(F.col("source_entity")).alias("src"), X.ref_key(F.col("target_entity")).alias("dst"), "weight", "atom_ids")
    known = G.undirected(counted.filter("src != dst"), "src", "dst").groupBy("a", "b").agg(F.max("weight").alias("weight"), F.array_distinct(F.flatten(F.collect_list("atom_ids"))).alias("atom_ids"))
    areas = cur(spark, d, "facts").filter("topic is not null").select(X.name_form(F.col("topic")).alias("area"), F.array("topic").alias("tags"), F.array(F.lit(None).cast("string")).alias("atom_ids")).dropDuplicates(["area"])
    return U.incremental_update(atoms, entities, known, entities.select("id", F.col("entity_type").alias("community")), areas)


@query(f"""WITH r AS (SELECT DISTINCT id, entity_id FROM {_HIT}), p AS (SELECT x.entity_id AS a, y.entity_id AS b, x.id AS atom FROM r x JOIN r y ON x.id = y.id AND x.entity_id < y.entity_id),
  k AS (SELECT least({_K.format('source_entity')}, {_K.format('target_entity')}) AS a, greatest({_K.format('source_entity')}, {_K.format('target_entity')}) AS b, weight, atom_ids FROM {RL} WHERE relation_type = 'related_to' AND trim(source_entity) <> '' AND trim(target_entity) <> ''),
  e AS (SELECT a, b, max(weight) AS w FROM k WHERE a <> b GROUP BY 1, 2), l AS (SELECT DISTINCT a, b, unnest(atom_ids) AS atom FROM k)
  SELECT p.a, p.b, round(coalesce(max(e.w), 0) + count(*) FILTER (l.atom IS NULL), 6) AS weight, count(*) FILTER (l.atom IS NULL) AS added, max(e.w) IS NOT NULL AS existed FROM p LEFT JOIN e ON e.a = p.a AND e.b = p.b LEFT JOIN l ON l.a = p.a AND l.b = p.b AND l.atom = p.atom GROUP BY 1, 2""")
def graph_update_relations(spark: SparkSession, d: str) -> DataFrame:
    return _update(spark, d).relations.select("a", "b", F.round("weight", 6).alias("weight"), F.col("added").cast("long").alias("added"), "existed")


@query(f"""WITH h AS {_HIT}, u AS (SELECT id AS entity_id, unnest(atom_ids) AS atom FROM {E} UNION SELECT entity_id, id FROM h), n AS (SELECT entity_id, count(DISTINCT atom) AS n FROM u GROUP BY 1), s AS (SELECT entity_id, max(time_last) AS seen FROM h GROUP BY 1)
  SELECT s.entity_id, n.n AS atom_count, greatest(e.last_seen, s.seen) AS last_seen FROM s JOIN n USING (entity_id) JOIN {E} e ON e.id = s.entity_id""")
def graph_update_entities(spark: SparkSession, d: str) -> DataFrame:
    return _update(spark, d).entities.select("entity_id", F.col("atom_count").cast("long").alias("atom_count"), "last_seen")


@query(f"""WITH t AS (SELECT DISTINCT id, {name_sql('n')} AS name FROM (SELECT id, unnest(entities) AS n FROM {_NEW}) WHERE n IS NOT NULL AND {name_sql('n')} <> '')
  SELECT (SELECT max(created_at) FROM {_NEW}) AS cursor, (SELECT count(*) FROM {_NEW}) AS atoms, (SELECT count(*) FROM {_NEW}) AS since_rebuild, (SELECT count(*) >= 30 FROM {_NEW}) AS should_rebuild, (SELECT count(DISTINCT name) FROM t WHERE name NOT IN (SELECT name FROM {_INDEX})) AS unresolved,
  (SELECT count(DISTINCT e.entity_type) FROM {_HIT} h JOIN {E} e ON e.id = h.entity_id) AS stale""")
def graph_update_state(spark: SparkSession, d: str) -> DataFrame:
    u = _update(spark, d)
    return u.state.join(u.unresolved.agg(F.count("*").alias("unresolved"))).join(u.stale.agg(F.count("*").alias("stale")))  # one row each


@query(f"""SELECT f.area, count(DISTINCT n.id) AS atoms FROM {_NEW} n JOIN (SELECT DISTINCT {name_sql('topic')} AS area FROM {FA} WHERE topic IS NOT NULL) f ON f.area = {name_sql('n.topic')} WHERE f.area <> '' GROUP BY 1""")
def graph_update_areas(spark: SparkSession, d: str) -> DataFrame:
    return _update(spark, d).areas.select("area", F.size(F.filter("atom_ids", lambda x: x.isNotNull())).cast("long").alias("atoms"))


@query(f"SELECT entity_type AS label, count(*) AS size, (row_number() OVER (ORDER BY count(*) DESC, entity_type) - 1)::INT AS community_no FROM {E} GROUP BY 1")
def community_groups(spark: SparkSession, d: str) -> DataFrame:
    return U.label_groups(cur(spark, d, "entities").select("id", F.col("entity_type").alias("label")))


@query(f"SELECT community, count(*) AS edges FROM (SELECT DISTINCT r.id, e.entity_type AS community FROM {_ED} r JOIN {E} e ON e.id = r.src OR e.id = r.dst) GROUP BY 1")
def touching_edges(spark: SparkSession, d: str) -> DataFrame:
    member = cur(spark, d, "entities").select("id", F.col("entity_type").alias("community"))
    return U.touching_edges(_edges(spark, d).select("src", "dst"), member, "src", "dst")


@query(f"SELECT DISTINCT e.entity_type AS community, a.topic AS area FROM {_RES} r JOIN {E} e ON e.id = r.entity_id JOIN {A} a ON a.id = r.id WHERE a.topic IS NOT NULL")
def community_areas(spark: SparkSession, d: str) -> DataFrame:
    member = _resolved(spark, d).join(cur(spark, d, "entities").select(F.col("id").alias("entity_id"), F.col("entity_type").alias("community")), "entity_id").select("community", F.col("id").alias("atom"))
    return U.community_areas(member, cur(spark, d, "atoms").filter("topic is not null").select(F.col("topic").alias("area"), F.col("id").alias("atom")))


_SESS = f"(SELECT DISTINCT s, entity_id FROM (SELECT id, unnest(session_ids) AS s FROM {A}) JOIN {_RES} USING (id) WHERE s IS NOT NULL)"


@query(f"""WITH g AS {_SESS}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {_ED} WHERE src <> dst AND relation_type = 'related_to'), n AS (SELECT entity_id, count(*) AS n FROM g GROUP BY 1),
  s AS (SELECT p.a, p.b, count(*) AS shared FROM p JOIN g x ON x.entity_id = p.a JOIN g y ON y.entity_id = p.b AND y.s = x.s GROUP BY 1, 2)
  SELECT p.a, p.b, coalesce(x.n, 0) AS groups_a, coalesce(y.n, 0) AS groups_b, coalesce(s.shared, 0) AS shared, round(100.0 * coalesce(s.shared, 0) / greatest(coalesce(x.n, 0), coalesce(y.n, 0), 1), 1) AS overlap_pct FROM p LEFT JOIN n x ON x.entity_id = p.a LEFT JOIN n y ON y.entity_id = p.b LEFT JOIN s ON s.a = p.a AND s.b = p.b""")
def shared_sessions(spark: SparkSession, d: str) -> DataFrame:
    pairs = G.undirected(_edges(spark, d).filter("relation_type = 'related_to' and src != dst"), "src", "dst").select("a", "b").distinct()
    rows = cur(spark, d, "atoms").select("id", F.explode("session_ids").alias("group")).filter("group is not null").join(_resolved(spark, d), "id").select("group", F.col("entity_id").alias("item")).distinct()
    return U.shared_groups(pairs, rows)


def probe_atoms_sql(a: str, b: str) -> str:
    return f"""WITH t AS (SELECT id, lower(coalesce(content, '')) AS t, lower(array_to_string(coalesce(entities, []), chr(10))) AS s FROM {A} WHERE invalidated_by IS NULL), f AS (SELECT bool_or(contains(s, '{a}')) AS fa, bool_or(contains(s, '{b}')) AS fb FROM t),
  h AS (SELECT id, CASE WHEN fa THEN contains(s, '{a}') ELSE contains(t, '{a}') END AS ha, CASE WHEN fb THEN contains(s, '{b}') ELSE contains(t, '{b}') END AS hb FROM t, f), g AS (SELECT bool_or(ha AND hb) AS every FROM h WHERE ha OR hb)
  SELECT id FROM h, g WHERE (ha OR hb) AND (ha AND hb OR NOT every) ORDER BY id LIMIT 5"""


@query(probe_atoms_sql("harrowgate index", "brindle notebook"))
def probe_atoms(spark: SparkSession, d: str, a: str = "harrowgate index", b: str = "brindle notebook") -> DataFrame:
    """The first five atoms that speak of both names, or else of either."""
    rows = cur(spark, d, "atoms").filter("invalidated_by is null").select("id", "content", F.col("entities").alias("names"))
    return U.probe_records(rows, a, b).select("id")


@query(f"""WITH RECURSIVE f AS (SELECT id, superseded_by AS p FROM {L}), k AS (SELECT f.id, f.p FROM f JOIN {L} t ON t.id = f.p WHERE f.id <> f.p), r(id, root, depth) AS (SELECT id, p, 1 FROM k UNION ALL SELECT r.id, k.p, depth + 1 FROM r JOIN k ON k.id = r.root WHERE depth < 100)
  SELECT f.id, coalesce(m.root, f.id) AS root FROM f LEFT JOIN (SELECT id, arg_max(root, depth) AS root FROM r GROUP BY 1) m USING (id)""")
def superseded_roots(spark: SparkSession, d: str) -> DataFrame:
    """The form that each form has been merged into in the end."""
    return U.merge_by_pointer(cur(spark, d, "logical_forms").select("id", "superseded_by"), "id", "superseded_by")


@query("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS seq, user_id || ':' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_key FROM events")
def sequence_numbers(spark: SparkSession, d: str) -> DataFrame:
    return S.sequence_numbers(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "seq", F.concat_ws(":", F.col("user_id").cast("string"), F.col("seq").cast("string")).alias("event_key"))


_GAPS = """(SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) > 1800000000 THEN 1 ELSE 0 END AS new FROM events))"""


@query(f"SELECT user_id, min(ts) AS first, count(*) AS turns FROM {_GAPS} GROUP BY user_id, s HAVING count(*) >= 2 OR bool_or(event_type IN ('error', 'purchase'))")
def significant_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = S.gap_sessions(table(spark, d, "events"), "user_id", "ts", ["event_id"])
    one = rows.groupBy("user_id", "session_no").agg(F.min("ts").alias("first"), F.count("*").alias("turns"), F.bool_or(F.col("event_type") == "error").alias("had_error"), F.bool_or(F.col("event_type") == "purchase").alias("acted"))
    return one.filter(S.significant(F.col("turns"), F.col("had_error"), F.col("acted"))).select("user_id", "first", "turns")


@query()
def chunk_job(spark: SparkSession, d: str) -> DataFrame:
    """Turns to clusters to units with provenance: what a chunking run over all events gives out."""
    turns = table(spark, d, "events").select("user_id", "ts", "event_id", "value", F.col("event_type").alias("intent"), F.array("event_type").alias("things"))
    rows = S.turn_clusters(turns, "user_id", "ts", ["event_id"], "intent", "things").withColumn("kind", F.col("intent"))
    units = S.provenance(rows, ["user_id", "cluster_no"], "ts", ["event_id"], ["kind"], F.col("kind") == "error", F.col("intent"))
    return units.filter(S.significant(F.col("source_count"), F.col("had_errors"), F.array_contains("kind", "purchase"))).select("user_id", "cluster_no", "source_count", "time_first", "time_last", "duration_s", F.array_join("kind", ",").alias("kinds"), "had_errors", "retry_count", "trigger")


@query("""WITH k AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, min(struct_pack(t := ts, e := event_id)) AS f FROM events GROUP BY 1, 2, 3), l AS (SELECT user_id, day, string_agg(event_type, ',' ORDER BY f) AS kinds FROM k GROUP BY 1, 2)
  SELECT e.user_id, strftime(e.ts, '%Y-%m-%d') AS day, count(*) AS source_count, min(ts) AS time_first, max(ts) AS time_last, round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 1) AS duration_s, any_value(l.kinds) AS kinds, bool_or(event_type = 'error') AS had_errors, count(*) FILTER (event_type = 'error') AS retry_count
  FROM events e JOIN l ON l.user_id = e.user_id AND l.day = strftime(e.ts, '%Y-%m-%d') GROUP BY 1, 2""")
def daily_provenance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = S.provenance(rows, ["user_id", "day"], "ts", ["event_id"], ["event_type"], F.col("event_type") == "error", F.col("event_type"))
    return out.select("user_id", "day", "source_count", "time_first", "time_last", "duration_s", F.array_join("event_type", ",").alias("kinds"), "had_errors", "retry_count")


_LINES = """(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS seq, CASE WHEN starts_with(line, 'User: ') THEN 'user' ELSE 'assistant' END AS role, regexp_replace(line, '^(User|Assistant): ', '') AS text FROM
  (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE starts_with(line, 'User: ') OR starts_with(line, 'Assistant: '))"""
_ASKS = "regexp_matches(text, '" + X.QUESTION.removeprefix("(?i)").replace("'", "''") + "', 'i')"


def _dialogue(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).filter(F.col("line").startswith("User: ") | F.col("line").startswith("Assistant: "))
    rows = S.sequence_numbers(lines, "doc_id", ["n"])
    return rows.select("doc_id", "seq", F.when(F.col("line").startswith("User: "), "user").otherwise("assistant").alias("role"), F.regexp_replace("line", "^(User|Assistant): ", "").alias("text"))


@query(f"""SELECT doc_id, seq - 1 AS window_no FROM (SELECT doc_id, seq, bool_or(role = 'user' AND {_ASKS}) OVER w AS asked, count(*) OVER w AS n FROM {_LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE n = 4 AND asked""")
def question_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of four lines of talk in which a user asks something."""
    return S.question_windows(_dialogue(spark, d), "doc_id", "seq", "role", "text", 4).withColumn("window_no", F.col("window_no").cast("long"))


@query(f"""SELECT doc_id, seq, length(trim(text)) AS asked, length(trim(next)) AS answered FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS next FROM {_LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) WHERE role = 'user' AND r = 'assistant' AND length(trim(text)) >= 10 AND length(trim(next)) >= 5""")
def qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = S.exchanges(_dialogue(spark, d), "doc_id", "seq", "role", "text")
    kept = pairs.filter(X.valid_pair(F.col("user_text"), F.col("assistant_text"), F.col("doc_id").cast("string")))
    return kept.select("doc_id", F.col("seq").cast("long").alias("seq"), F.length(F.trim("user_text")).alias("asked"), F.length(F.trim("assistant_text")).alias("answered"))


_FLAT = "regexp_replace(content, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT id FROM {FA} WHERE lower({_FLAT}) NOT IN ('', 'none', 'unknown', 'n/a', '[haiku unavailable]', '[no transcript available]', '(not present this session)', '[haiku unavailable — session cleared]') AND length({_FLAT}) > 10")
def meaningful_facts(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "facts").filter(X.meaningful(F.col("content"))).select("id")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS e, label AS l FROM embeddings WHERE vec_id = 0), b AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 30)
  SELECT vec_id, label, round(s, 6) AS score FROM b WHERE label <> (SELECT l FROM q) ORDER BY s DESC, vec_id LIMIT 10""")
def over_fetch_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best thirty vectors, and of those the first ten of another label."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"), F.col("label").alias("ql"))
    return U.over_fetch(e.join(F.broadcast(q)), cosine(F.col("embedding"), F.col("q")), F.col("label") != F.col("ql"), 10, "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


_MEANS = "(SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY label)"


def _means(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vec"))


@query(f"""SELECT vec_id, label, round(s, 6) AS score FROM (SELECT v.vec_id, m.label, list_cosine_similarity(v.embedding::DOUBLE[], m.c) AS s, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], m.c) DESC, m.label) AS r FROM embeddings v, {_MEANS} m) WHERE r <= 2 AND s > 0.15""")
def recall_communities(spark: SparkSession, d: str) -> DataFrame:
    """The best two label means for each vector, of those only what is near enough; the means are few, one a label."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    near = e.join(F.broadcast(_means(spark, d))).select("vec_id", "label", cosine(F.col("embedding"), F.col("vec")).alias("s"))
    best = R.top_per_group(near, ["vec_id"], [F.desc("s"), F.col("label")], 2).filter("s > 0.15")
    return best.select("vec_id", "label", F.round("s", 6).alias("score"))


@query(f"""SELECT s.id, CASE WHEN s.valid_until IS NULL AND f.superseded_by IS NOT NULL THEN TIMESTAMP '2026-06-30 00:00:00' ELSE s.valid_until END AS valid_until FROM {FS} s LEFT JOIN {L} f ON f.id = {_K.format('s.form_id')}""")
def expire_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Statuses of superseded forms end where they have no end yet."""
    gone = cur(spark, d, "logical_forms").filter("superseded_by is not null").select(F.col("id").alias("key"), F.lit("2026-06-30 00:00:00").cast("timestamp_ntz").alias("at"))
    s = cur(spark, d, "form_status").select("id", X.ref_key(F.col("form_id")).alias("key"), "valid_until")
    return R.expire(s, gone, ["key"], "valid_until").select("id", "valid_until")


@query(f"""WITH t AS (SELECT id, {_K.format('source_entity')} AS src, {_K.format('target_entity')} AS dst, relation_type, description, last_seen, atom_ids FROM {RL} WHERE relation_type <> 'related_to' AND trim(source_entity) <> '' AND trim(target_entity) <> ''),
  a AS (SELECT src, dst, relation_type, count(DISTINCT x) AS n FROM (SELECT *, unnest(atom_ids) AS x FROM t) GROUP BY 1, 2, 3)
  SELECT t.src, t.dst, t.relation_type, 1.0::DOUBLE AS weight, arg_max(t.description, struct_pack(s := t.last_seen, i := t.id)) FILTER (t.description IS NOT NULL) AS description, any_value(a.n) AS atoms FROM t JOIN a ON a.src = t.src AND a.dst = t.dst AND a.relation_type = t.relation_type GROUP BY 1, 2, 3""")
def typed_relation_upsert(spark: SparkSession, d: str) -> DataFrame:
    r = cur(spark, d, "relations").filter("relation_type != 'related_to'").select(X.ref_key(F.col("source_entity")).alias("src"), X.ref_key(F.col("target_entity")).alias("dst"), "relation_type", "description", F.struct("last_seen", "id").alias("seq"), F.explode("atom_ids").alias("atom_id"))
    return U.upsert_typed_relations(r).select("src", "dst", "relation_type", "weight", "description", F.size("atom_ids").cast("long").alias("atoms"))


@query(f"SELECT * FROM ({MEMORY_SQL['conflict_pairs']}) c WHERE NOT EXISTS (SELECT 1 FROM {L} f WHERE f.id IN (c.form_a, c.form_b) AND f.superseded_by IS NOT NULL)")
def new_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts that are not known yet: pairs with a superseded form have been dealt with."""
    f = cur(spark, d, "logical_forms")
    found = B.conflict_pairs(f)
    gone = f.filter("superseded_by is not null").select("id")
    known = found.join(gone.withColumnRenamed("id", "form_a"), "form_a", "left_semi").select("form_a", "form_b").unionByName(found.join(gone.withColumnRenamed("id", "form_b"), "form_b", "left_semi").select("form_a", "form_b"))
    return B.new_pairs(found, known).select("subject", "predicate", "form_a", "form_b")


@query(f"""WITH f AS (SELECT lower(trim(subject)) AS s, project, embedding FROM {L} WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND trim(subject) <> '' AND project IS NOT NULL), v AS (SELECT s, list(x ORDER BY i) AS vec FROM (SELECT s, i, avg(embedding[i]::DOUBLE) AS x FROM f, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
  a AS (SELECT s, list(DISTINCT project) AS areas FROM f GROUP BY 1), c AS (SELECT v.s AS id, v.vec, a.areas FROM v JOIN a USING (s))
  SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.vec, y.vec), 5) AS score FROM c x JOIN c y ON x.id < y.id AND NOT list_has_any(x.areas, y.areas) WHERE list_cosine_similarity(x.vec, y.vec) >= 0.45""")
def subject_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Subjects whose forms are alike though they share no project."""
    f = cur(spark, d, "logical_forms").filter(usable(F.col("embedding"), 64)).select(F.lower(F.trim("subject")).alias("id"), "project", "embedding").filter("id != '' and project is not null")
    c = f.select("id", F.posexplode("embedding").alias("i", "x")).groupBy("id", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vec"))
    areas = f.groupBy("id").agg(F.collect_set("project").alias("areas"))
    return G.bridges(c.join(areas, "id"), 0.45).withColumn("score", F.round("score", 5))


_HEAD = "text, '\\A---\\nsession: \"[^\"\\n]*\"\\nproject: \"([^\"\\n]*)\"\\ndate: ([^\\n]*)\\n---\\n"


@query(f"""WITH e AS (SELECT doc_id, regexp_extract({_HEAD}', 1) AS project, regexp_extract({_HEAD}', 2) AS date, trim(regexp_extract(text, '\\n---\\n+([^\\n]*)', 1)) AS line FROM documents WHERE regexp_matches({_HEAD}'))
  SELECT project, doc_id, date, CASE WHEN line <> '' THEN line ELSE '(no summary)' END AS summary, rank FROM (SELECT *, (row_number() OVER (PARTITION BY project ORDER BY date DESC, doc_id))::INT AS rank FROM e) WHERE rank <= 5""")
def recap(spark: SparkSession, d: str) -> DataFrame:
    """The five newest episodes of each project with their first line."""
    head = r'\A---\nsession: "[^"\n]*"\nproject: "([^"\n]*)"\ndate: ([^\n]*)\n---\n'
    docs = table(spark, d, "documents").filter(F.col("text").rlike(head)).select("doc_id", F.regexp_extract("text", head, 1).alias("project"), F.regexp_extract("text", head, 2).alias("date"), F.trim(F.regexp_extract("text", r"\n---\n+([^\n]*)", 1)).alias("line"))
    best = R.top_per_group(docs, ["project"], [F.desc("date"), F.col("doc_id")], 5)
    return best.select("project", "doc_id", "date", F.when(F.col("line") != "", F.col("line")).otherwise("(no summary)").alias("summary"), "rank")


@query(f"""WITH t AS (SELECT project, topic, count(*) AS n FROM {A} WHERE topic IS NOT NULL AND invalidated_by IS NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, topic) AS k FROM t),
  l AS (SELECT project, string_agg('  [' || n || '] ' || topic, chr(10) ORDER BY k) AS lines FROM r WHERE k <= 5 GROUP BY 1), p AS (SELECT project, count(DISTINCT s) AS sessions FROM (SELECT project, unnest(session_ids) AS s FROM {A} WHERE invalidated_by IS NULL) GROUP BY 1)
  SELECT l.project, '# Project: ' || l.project || chr(10) || '## Sessions (' || coalesce(p.sessions, 0) || ')' || chr(10) || '## Topics' || chr(10) || l.lines AS digest FROM l LEFT JOIN p USING (project)""")
def digest(spark: SparkSession, d: str) -> DataFrame:
    """A short text on the state of each project: its sessions and its five leading topics."""
    a = cur(spark, d, "atoms").filter("invalidated_by is null")
    top = R.top_per_group(a.filter("topic is not null").groupBy("project", "topic").agg(F.count("*").alias("n")), ["project"], [F.desc("n"), F.col("topic")], 5)
    line = F.concat(F.lit("  ["), F.col("n").cast("string"), F.lit("] "), "topic")
    lines = top.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda s: s["l"]), "\n").alias("lines"))
    sessions = a.select("project", F.explode("session_ids").alias("s")).groupBy("project").agg(F.countDistinct("s").alias("sessions"))
    both = lines.join(sessions, "project", "left").na.fill(0, ["sessions"])
    return both.select("project", F.concat(F.lit("# Project: "), "project", F.lit("\n## Sessions ("), F.col("sessions").cast("string"), F.lit(")\n## Topics\n"), "lines").alias("digest"))


_GL = f"""(SELECT f.form_type, f.content, f.confidence, f.extracted_at, f.id, f.scope_type, f.scope_id, s.status, s.world_id FROM {L} f JOIN {FS} s ON {_K.format('s.form_id')} = f.id WHERE s.valid_until IS NULL)"""


@query(f"""WITH b AS (SELECT * FROM {_GL}), g AS (SELECT row_number() OVER (ORDER BY confidence DESC, extracted_at DESC, id) AS k, '- [' || form_type || '] ' || left(content, 120) || CASE WHEN status = 'stable' THEN ' [STABLE]' ELSE '' END AS l FROM b WHERE scope_type = 'global' AND world_id = 'current' AND status IN ('active', 'stable')),
  c AS (SELECT row_number() OVER (ORDER BY extracted_at DESC, id, world_id) AS k, '- [!] ' || left(content, 100) || ' (status: ' || status || ')' AS l FROM b WHERE world_id IN ('contested', 'rejected')),
  t AS (SELECT array_to_string(list_filter([(SELECT '### Known Beliefs (global stable)' || chr(10) || string_agg(l, chr(10) ORDER BY k) FROM g WHERE k <= 8), (SELECT chr(10) || '### Caution (contested/rejected)' || chr(10) || string_agg(l, chr(10) ORDER BY k) FROM c WHERE k <= 3)], lambda x: x IS NOT NULL), chr(10)) AS t)
  SELECT CASE WHEN length(t) > 2000 THEN left(t, 1980) || chr(10) || '... (truncated)' ELSE t END AS block FROM t""")
def belief_block(spark: SparkSession, d: str) -> DataFrame:
    """The block of beliefs that goes before a talk: what is held for sure everywhere, and what to be careful with."""
    s = cur(spark, d, "form_status").filter("valid_until is null").select(X.ref_key(F.col("form_id")).alias("form_id"), "status", "world_id")
    return B.belief_block(cur(spark, d, "logical_forms"), s)


@query(f"""WITH w AS ({MEMORY_SQL['lesson_overlap']}), s AS (SELECT warning_id AS id FROM w UNION SELECT decision_id FROM w) SELECT f.id, CASE WHEN s.id IS NOT NULL AND f.scope_type = 'project' THEN 'global' ELSE f.scope_type END AS scope_type, CASE WHEN s.id IS NOT NULL AND f.scope_type = 'project' THEN NULL ELSE f.scope_id END AS scope_id FROM {L} f LEFT JOIN s USING (id)""")
def promote_sources(spark: SparkSession, d: str) -> DataFrame:
    """Forms of a project from which a lesson was derived hold everywhere."""
    f = cur(spark, d, "logical_forms")
    derived = B.lessons(f, ["fail", "block"]).select(F.lit("lesson").alias("type"), F.array("warning_id", "decision_id").alias("source_form_ids"), F.lit(None).cast("timestamp").alias("invalidated_at"))
    return B.promote_sources(f, derived).select("id", "scope_type", "scope_id")


@query(f"SELECT floor, least, f1 FROM ({MEMORY_SQL['param_sweep']}) ORDER BY f1 DESC, floor, least LIMIT 1")
def best_parameters(spark: SparkSession, d: str) -> DataFrame:
    score = F.struct("confidence", "source_count")
    out = V.sweep(cur(spark, d, "atoms"), F.col("invalidated_by").isNotNull(), score, {"floor": [0.5, 0.7, 0.9], "least": [1, 2, 3]}, lambda s, p: (s["confidence"] < p("floor")) & (s["source_count"] >= p("least")))
    return V.best_point(out, ["floor", "least"]).select("floor", "least", "f1")


@query("""WITH s AS (SELECT DISTINCT * FROM metrics), g AS (SELECT experiment, false AS every, count(*) AS pairs, sum(coactivations) AS total, max(coactivations) AS top FROM s WHERE edge_existed GROUP BY 1 UNION ALL SELECT experiment, true, count(*), sum(coactivations), max(coactivations) FROM s GROUP BY 1),
  l AS (SELECT experiment, every, unnest(['pairs', 'sums.total', 'sums.top']) AS name, unnest([pairs, total, top])::DOUBLE AS v FROM g) SELECT b.experiment, b.name, b.v AS before, a.v AS after, a.v - b.v AS delta FROM l b JOIN l a ON a.experiment = b.experiment AND a.name = b.name AND a.every AND NOT b.every WHERE a.v <> b.v""")
def metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    """What changes in the figures of each experiment between the pairs that had an edge before and all pairs."""
    m = table(spark, d, "metrics").distinct()
    sums = F.struct(F.sum("coactivations").alias("total"), F.max("coactivations").alias("top"))
    told = lambda rows: U.flatten_metrics(rows.groupBy("experiment").agg(F.to_json(F.struct(F.count("*").alias("pairs"), sums.alias("sums"))).alias("j")), "experiment", "j")
    return U.metric_deltas(told(m.filter("edge_existed")), told(m), "experiment")


@query(f"SELECT id, project FROM {A} WHERE id NOT IN (SELECT source_unit_id FROM {L} WHERE source_unit_id IS NOT NULL)")
def late_repair(spark: SparkSession, d: str) -> DataFrame:
    """Nothing is new since the last atom, so atoms that no form was taken from are taken up again."""
    a = cur(spark, d, "atoms").select("id", "project", "created_at")
    done = cur(spark, d, "logical_forms").select(F.col("source_unit_id").alias("id")).filter("id is not null")
    return S.fresh_or_missed(a, a.agg(F.max("created_at").alias("cursor")), "created_at", done, "id").select("id", "project")


@query(f"""SELECT entity_type, 'Community ' || entity_type || chr(10) || string_agg('- ' || canonical_name, chr(10) ORDER BY r) AS prompt FROM (SELECT entity_type, canonical_name, row_number() OVER (PARTITION BY entity_type ORDER BY atom_count DESC, id) AS r FROM {E}) WHERE r <= 10 GROUP BY 1""")
def community_prompts(spark: SparkSession, d: str) -> DataFrame:
    top = R.top_per_group(cur(spark, d, "entities").select("entity_type", "canonical_name", "atom_count", "id"), ["entity_type"], [F.desc("atom_count"), F.col("id")], 10)
    return M.list_prompts(top, "entity_type", "rank", F.concat(F.lit("- "), "canonical_name"), "Community ")


@query(f"SELECT id, ((row_number() OVER (PARTITION BY session_id ORDER BY id) - 1) // 8)::INT AS batch_no, upper(coalesce(content, '')) AS answer FROM {FA}")
def batched_calls(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for a model called with eight texts of a session at a time."""
    rows = cur(spark, d, "facts").select("id", "session_id", F.coalesce("content", F.lit("")).alias("content"))
    return M.call_in_batches(rows, ["session_id"], ["id"], "content", 8, lambda texts: [t.upper() for t in texts]).select("id", "batch_no", "answer")


@query(f"""SELECT world_id, label, status, count(*) AS n FROM {FS} LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in B.WORLDS.items())}) w(w, label) ON w = world_id GROUP BY 1, 2, 3""")
def world_statuses(spark: SparkSession, d: str) -> DataFrame:
    return B.world_counts(cur(spark, d, "form_status"))


@query(f"""SELECT vec_id AS id, label AS target, round(s, 6) AS score FROM (SELECT v.vec_id, m.label, list_cosine_similarity(v.embedding::DOUBLE[], m.c) AS s, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], m.c) DESC, m.label) AS r FROM embeddings v, {_MEANS} m) WHERE r = 1 AND s >= 0.25""")
def nearest_above(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the nearest mean of a label, where that is near enough."""
    near = U.nearest_above(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), _means(spark, d).select(F.col("label").alias("target"), "vec"), 0.25)
    return near.select("id", "target", F.round("score", 6).alias("score"))


@query(f"""WITH p AS ({MEMORY_SQL['coactivation_pairs']}) SELECT a, b, round(least(0.3 * n, 3.0), 6) AS delta FROM p""")
def batch_deltas(spark: SparkSession, d: str) -> DataFrame:
    """What each pair gains in a batch, capped at 3 however often it was active."""
    rows = cur(spark, d, "atoms").select("id", F.explode("session_ids").alias("s")).join(_resolved(spark, d), "id").select("s", "entity_id").filter("s is not null").distinct()
    return G.batch_deltas(G.pair_counts(rows, "s", "entity_id").filter("n >= 2"), 3.0).withColumn("delta", F.round("delta", 6))


@query(f"""WITH c AS (SELECT id, string_split(id, '-')[1] AS chunk, session_ids, time_first FROM {A}), u AS (SELECT e.entity_type AS community, unnest(e.atom_ids) AS atom FROM {E} e), h AS (SELECT DISTINCT u.community, c.chunk FROM u JOIN c ON c.id = u.atom),
  m AS (SELECT chunk, min(time_first) AS t FROM c GROUP BY 1), s AS (SELECT h.community, count(DISTINCT x.s) AS sessions FROM h JOIN (SELECT chunk, unnest(session_ids) AS s FROM c) x USING (chunk) GROUP BY 1),
  t AS (SELECT h.community, count(*) AS chunks, min(m.t) AS first, max(m.t) AS last FROM h JOIN m USING (chunk) GROUP BY 1)
  SELECT e.community, coalesce(chunks, 0) AS chunks, coalesce(sessions, 0) AS sessions, first, last, CASE WHEN first IS NULL THEN 0 ELSE greatest(1, (date_diff('microsecond', first, last) // 86400000000) // 7 + 1) END::INT AS week_span FROM (SELECT DISTINCT entity_type AS community FROM {E}) e LEFT JOIN t USING (community) LEFT JOIN s USING (community)""")
def trace_hops(spark: SparkSession, d: str) -> DataFrame:
    """From types of entities over their atoms as text units, and documents named after chunks, to chunks and sessions."""
    a = cur(spark, d, "atoms").select("id", F.split_part("id", F.lit("-"), F.lit(1)).alias("chunk_id"), "session_ids", "time_first")
    chunks = a.groupBy("chunk_id").agg(F.array_distinct(F.flatten(F.collect_list("session_ids"))).alias("session_ids"), F.min("time_first").alias("first_timestamp"))
    units = a.select("id", F.concat(F.lit("d-"), "id").alias("document_id"))
    docs = a.select(F.concat(F.lit("d-"), "id").alias("id"), F.concat(F.lit("chunk-"), "chunk_id", F.lit(".txt")).alias("title"))
    return U.trace_hops(cur(spark, d, "entities").select(F.col("entity_type").alias("community"), F.col("atom_ids").alias("text_unit_ids")), units, docs, chunks)


QUERIES, SQL = query.queries, query.sql
