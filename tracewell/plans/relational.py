"""Queries of the relational operators: filters, joins, aggregations, set operations, top-k, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import (
    estimate_tokens, infer_entity_type, initial_world, memory_class, name_form, normalized_block_hash, preview, ref_key, stable_id, title_case, truncate,
)
from tracewell.functions.times import local_time, week_span
from tracewell.functions.vectors import cosine
from tracewell.operators import rows as R
from tracewell.operators import sessions as S
from tracewell.plans.common import Register, cur, cur_sql, name_sql
from tracewell.runtime import table

query = Register()
A, E, L, FS, RL, BT, FA = (cur_sql(t) for t in ("atoms", "entities", "logical_forms", "form_status", "relations", "belief_tests", "facts"))


@query(f"SELECT project, count(*) AS atoms, min(time_first) AS first_seen, max(time_last) AS last_seen FROM {A} GROUP BY project")
def projects_summary(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "atoms").groupBy("project").agg(F.count("*").alias("atoms"), F.min("time_first").alias("first_seen"), F.max("time_last").alias("last_seen"))


@query(f"""SELECT 'atom_type' AS what, atom_type AS value, count(*) AS n FROM {A} GROUP BY 2 UNION ALL SELECT 'form_type', form_type, count(*) FROM {L} GROUP BY 2
  UNION ALL SELECT 'world', world_id, count(*) FROM {FS} GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM {FS} GROUP BY 2
  UNION ALL SELECT 'relation_type', relation_type, count(*) FROM {RL} GROUP BY 2 UNION ALL SELECT 'entity_type', entity_type, count(*) FROM {E} GROUP BY 2""")
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [("atoms", "atom_type", "atom_type"), ("logical_forms", "form_type", "form_type"), ("form_status", "world_id", "world"), ("form_status", "status", "status"), ("relations", "relation_type", "relation_type"), ("entities", "entity_type", "entity_type")]
    out = None
    for t, c, what in parts:
        df = cur(spark, d, t).groupBy(F.lit(what).alias("what"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
        out = df if out is None else out.unionByName(df)
    return out


@query(f"""SELECT count(*) AS total, count(*) FILTER (invalidated_by IS NULL) AS active, count(*) FILTER (len(entities) > 0) AS with_entities,
  count(*) FILTER (memory_class IS NULL) AS unclassified, count(DISTINCT project) AS projects FROM {A}""")
def scalar_counts(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "atoms").agg(
        F.count("*").alias("total"), F.count_if(F.col("invalidated_by").isNull()).alias("active"), F.count_if(F.size("entities") > 0).alias("with_entities"),
        F.count_if(F.col("memory_class").isNull()).alias("unclassified"), F.countDistinct("project").alias("projects"),
    )


@query(f"SELECT relation_type, count(*) AS n, round(avg(weight), 6) AS mean_weight, max(weight) AS max_weight, count(*) FILTER (weight > 5) AS over_5 FROM {RL} GROUP BY 1")
def weight_stats(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "relations").groupBy("relation_type").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight"), F.max("weight").alias("max_weight"), F.count_if(F.col("weight") > 5).alias("over_5"))


@query(f"""SELECT e.id AS entity_id, count(*) AS atoms, min(a.time_first) AS first_time, max(a.time_last) AS last_time
  FROM (SELECT id, unnest(list_distinct(atom_ids)) AS atom FROM {E}) e JOIN {A} a ON a.id = e.atom GROUP BY 1""")
def entity_time_range(spark: SparkSession, d: str) -> DataFrame:
    e = cur(spark, d, "entities").select(F.col("id").alias("entity_id"), F.explode(F.array_distinct("atom_ids")).alias("atom"))
    a = cur(spark, d, "atoms").select(F.col("id").alias("atom"), "time_first", "time_last")
    return e.join(a, "atom").groupBy("entity_id").agg(F.count("*").alias("atoms"), F.min("time_first").alias("first_time"), F.max("time_last").alias("last_time"))


_NAMES = f"(SELECT DISTINCT id, {name_sql('n')} AS name FROM (SELECT id, unnest(entities) AS n FROM {A}) WHERE n IS NOT NULL AND {name_sql('n')} <> '')"


def _atom_names(spark: SparkSession, d: str) -> DataFrame:
    rows = cur(spark, d, "atoms").select("id", F.explode("entities").alias("n"))
    return rows.select("id", name_form(F.col("n")).alias("name")).filter("name != ''").distinct()


@query(f"SELECT name, id AS atom_id, freq FROM {_NAMES} JOIN (SELECT name, count(*) AS freq FROM {_NAMES} GROUP BY name) USING (name)")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Postings as rows, so that a name in very many atoms stays spread over tasks."""
    names = _atom_names(spark, d)
    return names.join(names.groupBy("name").agg(F.count("*").alias("freq")), "name").select("name", F.col("id").alias("atom_id"), "freq")


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS last_ts FROM events GROUP BY 1, 2")
def usage_sums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last_ts"))


@query(f"SELECT least(source_entity, target_entity) AS a, greatest(source_entity, target_entity) AS b, relation_type, count(*) AS n, round(sum(weight), 6) AS weight FROM {RL} GROUP BY 1, 2, 3")
def relation_totals(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "relations").groupBy(F.least("source_entity", "target_entity").alias("a"), F.greatest("source_entity", "target_entity").alias("b"), "relation_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query(f"""SELECT topic, count(DISTINCT s) AS sessions, min(time_first) AS first_time, max(time_last) AS last_time, greatest(1, (date_diff('microsecond', min(time_first), max(time_last)) // 86400000000) // 7 + 1)::INT AS weeks
  FROM (SELECT coalesce(topic, '') AS topic, unnest(session_ids) AS s, time_first, time_last FROM {A}) GROUP BY topic""")
def topic_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = cur(spark, d, "atoms").select(F.coalesce("topic", F.lit("")).alias("topic"), F.explode("session_ids").alias("s"), "time_first", "time_last")
    out = rows.groupBy("topic").agg(F.countDistinct("s").alias("sessions"), F.min("time_first").alias("first_time"), F.max("time_last").alias("last_time"))
    return out.withColumn("weeks", week_span(F.col("first_time"), F.col("last_time")))


_M = "(SELECT DISTINCT * FROM metrics)"


@query(f"SELECT experiment, count(*) AS n, sum(coactivations) AS coactivations, round(avg(delta), 6) AS mean_delta, round(max(new_weight), 6) AS max_weight, count(*) FILTER (new_weight > 5) AS over_5, count(*) FILTER (new_weight > 10) AS over_10, count(*) FILTER (NOT edge_existed) AS created FROM {_M} GROUP BY 1")
def experiment_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "metrics").distinct()
    return m.groupBy("experiment").agg(
        F.count("*").alias("n"), F.sum("coactivations").alias("coactivations"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.round(F.max("new_weight"), 6).alias("max_weight"),
        F.count_if(F.col("new_weight") > 5).alias("over_5"), F.count_if(F.col("new_weight") > 10).alias("over_10"), F.count_if(~F.col("edge_existed")).alias("created"),
    )


@query(f"""WITH s AS (SELECT DISTINCT unnest(session_ids) AS s FROM {A}), f AS (SELECT DISTINCT session_id AS s FROM {FA})
  SELECT (SELECT count(*) FROM s) AS sessions, (SELECT count(*) FROM s SEMI JOIN f USING (s)) AS done, greatest(0, (SELECT count(*) FROM s) - (SELECT count(*) FROM s SEMI JOIN f USING (s))) AS backlog""")
def backlog(spark: SparkSession, d: str) -> DataFrame:
    s = cur(spark, d, "atoms").select(F.explode("session_ids").alias("s")).filter("s is not null").distinct()
    f = cur(spark, d, "facts").select(F.col("session_id").alias("s")).distinct().withColumn("has", F.lit(True))
    return s.join(f, "s", "left").agg(F.count("*").alias("sessions"), F.count_if("has").alias("done")).withColumn("backlog", F.greatest(F.lit(0), F.col("sessions") - F.col("done")))


@query(f"SELECT DISTINCT project, topic FROM {A} WHERE topic IS NOT NULL")
def distinct_topics(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "atoms").filter("topic is not null").select("project", "topic").distinct()


@query(f"SELECT count(*) AS stale, round(sum(weight), 6) AS weight FROM {RL} WHERE relation_type = 'related_to' AND description = 'hebbian' AND last_seen < TIMESTAMP '2026-05-01 00:00:00'")
def stale_edges(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "relations").filter("relation_type = 'related_to' and description = 'hebbian' and last_seen < timestamp_ntz'2026-05-01 00:00:00'").agg(F.count("*").alias("stale"), F.round(F.sum("weight"), 6).alias("weight"))


@query(f"SELECT id, form_type, subject, confidence FROM {L} WHERE superseded_by IS NULL AND form_type IN ('rule', 'decision') AND extracted_at > TIMESTAMP '2025-06-01' AND confidence >= 0.5 AND subject IS NOT NULL AND subject <> ''")
def active_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = cur(spark, d, "logical_forms").filter(F.col("superseded_by").isNull() & F.col("form_type").isin("rule", "decision"))
    return rows.filter("extracted_at > timestamp_ntz'2025-06-01 00:00:00' and confidence >= 0.5 and subject != ''").select("id", "form_type", "subject", "confidence")


@query(f"SELECT a.id, a.project, a.atom_type FROM {A} a WHERE a.id IN (SELECT source_unit_id FROM {L})")
def atoms_in_forms(spark: SparkSession, d: str) -> DataFrame:
    used = cur(spark, d, "logical_forms").select(F.col("source_unit_id").alias("id")).filter("id is not null")
    return cur(spark, d, "atoms").join(used, "id", "left_semi").select("id", "project", "atom_type")


@query(f"SELECT id, form_type FROM {L} WHERE lower(content) LIKE '%snapshot%' OR lower(coalesce(subject, '')) LIKE '%snapshot%' OR lower(coalesce(object, '')) LIKE '%snapshot%'")
def like_search(spark: SparkSession, d: str) -> DataFrame:
    hit = F.lit(False)
    for c in ("content", "subject", "object"):
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains("snapshot")
    return cur(spark, d, "logical_forms").filter(hit).select("id", "form_type")


@query(f"""SELECT r.id, e.id AS entity_id FROM {RL} r JOIN {E} e ON starts_with(e.id, left(lower(trim(r.source_entity)), 8)) WHERE length(trim(r.source_entity)) >= 8""")
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Records found by the first eight characters of an id, joined on that prefix."""
    r = cur(spark, d, "relations").select("id", F.substring(ref_key(F.col("source_entity")), 1, 8).alias("p")).filter("length(p) = 8")
    return r.join(cur(spark, d, "entities").select(F.col("id").alias("entity_id"), F.substring("id", 1, 8).alias("p")), "p").select("id", "entity_id")


@query(f"SELECT a.id AS a, b.id AS b FROM {E} a JOIN {E} b ON {name_sql('a.canonical_name')} = {name_sql('b.canonical_name')} AND a.id < b.id")
def same_name_records(spark: SparkSession, d: str) -> DataFrame:
    e = cur(spark, d, "entities").select("id", name_form(F.col("canonical_name")).alias("n"))
    return e.select(F.col("id").alias("a"), "n").join(e.select(F.col("id").alias("b"), "n"), "n").filter("a < b").select("a", "b")


_K = "lower(trim({}))"


@query(f"""SELECT r.id, s.canonical_name AS source_name, t.canonical_name AS target_name, r.relation_type, r.weight FROM {RL} r
  JOIN {E} s ON s.id = {_K.format('r.source_entity')} JOIN {E} t ON t.id = {_K.format('r.target_entity')} WHERE r.weight >= 1""")
def edge_names(spark: SparkSession, d: str) -> DataFrame:
    r = cur(spark, d, "relations").filter("weight >= 1").select("id", ref_key(F.col("source_entity")).alias("s"), ref_key(F.col("target_entity")).alias("t"), "relation_type", "weight")
    e = cur(spark, d, "entities")
    return r.join(e.select(F.col("id").alias("s"), F.col("canonical_name").alias("source_name")), "s").join(e.select(F.col("id").alias("t"), F.col("canonical_name").alias("target_name")), "t").select("id", "source_name", "target_name", "relation_type", "weight")


@query(f"""SELECT f.id, count(s.id) AS current_rows, max(s.confidence) AS best FROM {L} f LEFT JOIN {FS} s ON {_K.format('s.form_id')} = f.id AND s.world_id = 'current' GROUP BY f.id""")
def status_left_join(spark: SparkSession, d: str) -> DataFrame:
    s = cur(spark, d, "form_status").filter("world_id = 'current'").select(ref_key(F.col("form_id")).alias("id"), F.col("id").alias("sid"), F.col("confidence").alias("c"))
    return cur(spark, d, "logical_forms").select("id").join(s, "id", "left").groupBy("id").agg(F.count("sid").alias("current_rows"), F.max("c").alias("best"))


@query(f"""SELECT f.id, f.form_type, s.status FROM {L} f LEFT JOIN {FS} s ON {_K.format('s.form_id')} = f.id AND s.world_id = 'current' AND s.valid_until IS NULL
  WHERE s.status IN ('active', 'stable') OR s.status IS NULL""")
def world_status_filter(spark: SparkSession, d: str) -> DataFrame:
    s = cur(spark, d, "form_status").filter("world_id = 'current' and valid_until is null").select(ref_key(F.col("form_id")).alias("id"), "status")
    return cur(spark, d, "logical_forms").select("id", "form_type").join(s, "id", "left").filter("status in ('active', 'stable') or status is null")


@query(f"""SELECT t.id, f.form_type, a.atom_type, t.outcome FROM {BT} t JOIN {L} f ON f.id = {_K.format('t.form_id')} JOIN {A} a ON a.id = {_K.format('t.atom_id')}""")
def review_double_join(spark: SparkSession, d: str) -> DataFrame:
    t = cur(spark, d, "belief_tests").select("id", ref_key(F.col("form_id")).alias("f"), ref_key(F.col("atom_id")).alias("a"), "outcome")
    return t.join(cur(spark, d, "logical_forms").select(F.col("id").alias("f"), "form_type"), "f").join(cur(spark, d, "atoms").select(F.col("id").alias("a"), "atom_type"), "a").select("id", "form_type", "atom_type", "outcome")


@query(f"""WITH s AS (SELECT project, unnest(session_ids) AS s, time_last FROM {A}), x AS (SELECT project, s, max(time_last) AS t FROM s WHERE EXISTS (SELECT 1 FROM {FA} f WHERE f.session_id = s.s) GROUP BY 1, 2)
  SELECT project, arg_max(s, struct_pack(t := t, s := s)) AS latest_session, max(t) AS ended FROM x GROUP BY project""")
def latest_session(spark: SparkSession, d: str) -> DataFrame:
    s = cur(spark, d, "atoms").select("project", F.explode("session_ids").alias("s"), "time_last")
    has = cur(spark, d, "facts").select(F.col("session_id").alias("s"))
    x = s.join(has, "s", "left_semi").groupBy("project", "s").agg(F.max("time_last").alias("t"))
    return x.groupBy("project").agg(F.max_by("s", F.struct("t", "s")).alias("latest_session"), F.max("t").alias("ended"))


_PS = f"(SELECT DISTINCT project AS p, s FROM (SELECT project, unnest(session_ids) AS s FROM {A} UNION ALL SELECT project_scope, session_id FROM {FA}) WHERE s IS NOT NULL)"


@query(f"SELECT DISTINCT a.p AS project, b.p AS alias FROM {_PS} a JOIN {_PS} b ON a.s = b.s WHERE a.p <> b.p")
def alias_family(spark: SparkSession, d: str) -> DataFrame:
    ps = cur(spark, d, "atoms").select(F.col("project").alias("p"), F.explode("session_ids").alias("s")).unionByName(cur(spark, d, "facts").select(F.col("project_scope").alias("p"), F.col("session_id").alias("s")))
    ps = ps.filter("s is not null").distinct()
    return ps.select(F.col("p").alias("project"), "s").join(ps.select(F.col("p").alias("alias"), "s"), "s").filter("project != alias").select("project", "alias").distinct()


@query(f"SELECT id, project FROM {A} WHERE id NOT IN (SELECT u FROM (SELECT unnest(source_unit_ids) AS u FROM {L}) WHERE u IS NOT NULL)")
def unreferenced_atoms(spark: SparkSession, d: str) -> DataFrame:
    used = cur(spark, d, "logical_forms").select(F.explode("source_unit_ids").alias("id")).filter("id is not null")
    return cur(spark, d, "atoms").join(used, "id", "left_anti").select("id", "project")


@query(f"""SELECT entity_type, id AS entity_id, atom_count, rank FROM (SELECT entity_type, id, atom_count, row_number() OVER (PARTITION BY entity_type ORDER BY atom_count DESC, id) AS rank FROM {E}) WHERE rank <= 3""")
def top_members(spark: SparkSession, d: str) -> DataFrame:
    return R.top_per_group(cur(spark, d, "entities").select("entity_type", F.col("id").alias("entity_id"), "atom_count"), ["entity_type"], [F.desc("atom_count"), F.col("entity_id")], 3)


@query(f"SELECT id, project, importance, confidence, created_at FROM {A} WHERE invalidated_by IS NULL ORDER BY importance DESC, confidence DESC, created_at DESC, id LIMIT 50")
def top_atoms(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "atoms").filter("invalidated_by is null").select("id", "project", "importance", "confidence", "created_at").orderBy(F.desc("importance"), F.desc("confidence"), F.desc("created_at"), "id").limit(50)


@query("SELECT event_id, user_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
  SELECT vec_id, label, round(s, 6) AS score FROM (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]) AS s FROM embeddings WHERE vec_id <> 0) ORDER BY s DESC, vec_id LIMIT 10""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.filter("vec_id != 0").join(F.broadcast(q)).select("vec_id", "label", cosine(F.col("embedding"), F.col("q")).alias("s")).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", "label", F.round("s", 6).alias("score"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id IN (0, 1, 2))
  SELECT vec_id, round(max(s), 6) AS score FROM (SELECT v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.e::DOUBLE[]) AS s FROM embeddings v, q WHERE v.vec_id > 2) GROUP BY vec_id ORDER BY max(s) DESC, vec_id LIMIT 10""")
def multi_query_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.filter(F.col("vec_id").isin(0, 1, 2)).select(F.col("embedding").alias("q"))
    s = e.filter("vec_id > 2").join(F.broadcast(q)).select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("s"))
    return s.groupBy("vec_id").agg(F.max("s").alias("s")).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("score"))


@query("""WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2), m AS (SELECT label, list(x ORDER BY i) AS c FROM c GROUP BY label)
  SELECT vec_id, area, round(s, 6) AS score FROM (SELECT v.vec_id, m.label AS area, list_cosine_similarity(v.embedding::DOUBLE[], m.c) AS s, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], m.c) DESC, m.label) AS r FROM embeddings v, m) WHERE r = 1""")
def nearest_area(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the nearest mean of a label; the means are few (one a label), so they are broadcast."""
    e = table(spark, d, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    m = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    s = e.join(F.broadcast(m.select(F.col("label").alias("area"), "c"))).select("vec_id", "area", cosine(F.col("embedding"), F.col("c")).alias("s"))
    best = s.groupBy("vec_id").agg(F.max(F.struct("s", (-F.col("area")).alias("a"))).alias("b"))
    return best.select("vec_id", (-F.col("b.a")).alias("area"), F.round("b.s", 6).alias("score"))


@query(f"""SELECT project, id AS atom_id, rank FROM (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY importance DESC, id) AS rank FROM {A}) WHERE rank <= 20""")
def per_group_cap(spark: SparkSession, d: str) -> DataFrame:
    return R.top_per_group(cur(spark, d, "atoms").select("project", F.col("id").alias("atom_id"), "importance"), ["project"], [F.desc("importance"), F.col("atom_id")], 20).drop("importance")


@query(f"""SELECT f.id, len(list_intersect(list_distinct(f.source_unit_ids), list_distinct(coalesce(a.source_events, [])))) AS shared,
  len(list_distinct(list_concat(f.source_unit_ids, [f.source_unit_id]))) AS all_sources, len(list_filter(list_distinct(f.source_unit_ids), lambda x: x <> coalesce(f.source_unit_id, ''))) AS others FROM {L} f LEFT JOIN {A} a ON a.id = f.source_unit_id""")
def array_sets(spark: SparkSession, d: str) -> DataFrame:
    f = cur(spark, d, "logical_forms").select("id", "source_unit_id", "source_unit_ids")
    a = cur(spark, d, "atoms").select(F.col("id").alias("source_unit_id"), "source_events")
    both = f.join(a, "source_unit_id", "left")
    every = F.array_distinct(F.filter(F.concat("source_unit_ids", F.array("source_unit_id")), lambda x: x.isNotNull()))
    return both.select("id", F.size(F.array_intersect("source_unit_ids", F.coalesce("source_events", F.array()))).alias("shared"), F.size(every).alias("all_sources"), F.size(F.array_except("source_unit_ids", F.array(F.coalesce("source_unit_id", F.lit(""))))).alias("others"))


@query(f"SELECT DISTINCT {_K.format('form_id')} AS form_id, world_id FROM {FS} WHERE world_id IN ('current', 'planned', 'user_belief') AND trim(form_id) <> ''")
def world_union(spark: SparkSession, d: str) -> DataFrame:
    s = cur(spark, d, "form_status").select(ref_key(F.col("form_id")).alias("form_id"), "world_id").filter("form_id is not null")
    return s.filter("world_id = 'current'").unionByName(s.filter("world_id = 'planned'")).unionByName(s.filter("world_id = 'user_belief'")).distinct()


_B = "(SELECT doc_id, generate_subscripts(b, 1) - 1 AS pos, unnest(b) AS block FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t]*\\n') AS b FROM documents))"


@query(f"""SELECT doc_id, pos, h FROM (SELECT doc_id, pos, md5(lower(trim(regexp_replace(block, '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g')))) AS h, row_number() OVER (PARTITION BY md5(lower(trim(regexp_replace(block, '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g')))) ORDER BY doc_id, pos) AS r
  FROM {_B} WHERE length(trim(regexp_replace(block, '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g'))) >= 20) WHERE r = 1""")
def paragraph_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first place of each text block, compared without case and spacing; blocks under 20 characters are dropped."""
    b = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\\n[ \\t]*\\n", -1)).alias("pos", "block"))
    flat = F.trim(F.regexp_replace("block", r"[ \t\n\r\x0b\f]+", " "))
    return b.filter(F.length(flat) >= 20).groupBy(normalized_block_hash(F.col("block")).alias("h")).agg(F.min(F.struct("doc_id", "pos")).alias("m")).select("m.doc_id", "m.pos", "h")


@query(f"""SELECT id, {name_sql("coalesce(content, '')")} AS flat, md5(content) AS digest, substr(sha256(concat_ws('|', project, id)), 1, 16) AS short_id,
  CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, (length(content) + 3) // 4) END::INT AS tokens, left(content, 80) AS head FROM {A}""")
def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "atoms").select("id", name_form(F.coalesce("content", F.lit(""))).alias("flat"), F.md5("content").alias("digest"), stable_id(F.col("project"), F.col("id"), length=16).alias("short_id"), estimate_tokens(F.col("content")).alias("tokens"), preview(F.col("content"), 80).alias("head"))


@query(f"""SELECT id, CASE WHEN length(content) > 60 THEN left(content, 57) || '...' ELSE content END AS short, array_to_string(list_transform(string_split(project, '-'), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM {A}""")
def previews(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "atoms").select("id", truncate(F.col("content"), 60).alias("short"), title_case(F.col("project")).alias("title"))


_TOOLS = "bash|python|node|npm|git|docker|caddy|liquidsoap|ffmpeg|icecast|nginx|redis|sqlite|faiss|xdotool|xclip|novnc|vnc|ssh|curl|wget|jq|claude|haiku|mcp|twilio|telegram"
_SERVICES = "youtube|chatgpt|openai|anthropic|cloudflare|github|google|perplexity|tavily|discord|slack|stripe|vultr|digitalocean|aws|gcp|azure|spotify|discogs"


@query(f"""SELECT id, CASE WHEN contains(n, '/') OR starts_with(n, '.') OR regexp_matches(n, '\\.(py|sh|md|json|yaml|yml|js|ts|toml)$') THEN 'file' WHEN regexp_matches(lower(n), '^({_TOOLS})') THEN 'tool'
  WHEN regexp_matches(lower(n), '{_SERVICES}') OR regexp_matches(n, '^\\d+\\.\\d+\\.\\d+\\.\\d+') OR starts_with(n, 'http') THEN 'service' ELSE 'concept' END AS inferred FROM (SELECT id, canonical_name AS n FROM {E})""")
def entity_type_infer(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "entities").select("id", infer_entity_type(F.col("canonical_name")).alias("inferred"))


_CLASS = """CASE WHEN atom_type IN ('outcome', 'failure') OR regexp_matches(t, '\\b(happened|occurred|deployed|shipped|fixed|broke|discovered|found|session|yesterday|today|last week|incident|outage|error|failed|succeeded|merged|commit|released|launched|ran|tried|observed)\\b') THEN 'episodic'
  WHEN atom_type IN ('pattern', 'gotcha') OR regexp_matches(t, '\\b(always|never|must|should|when you|to do|steps|procedure|workflow|pattern|recipe|rule|template|how to|make sure|remember to|approach)\\b') THEN 'procedural' ELSE 'semantic' END"""


@query(f"SELECT id, {_CLASS} AS class FROM (SELECT id, atom_type, lower(coalesce(content, '') || ' ' || coalesce(topic, '')) AS t FROM {A})")
def memory_classes(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "atoms").select("id", memory_class(F.col("content"), F.col("topic"), F.col("atom_type")).alias("class"))


@query(f"SELECT id, CASE form_type WHEN 'plan' THEN 'planned' WHEN 'question' THEN 'possible' WHEN 'preference' THEN 'user_belief' ELSE 'current' END AS world FROM {L}")
def world_assign(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "logical_forms").select("id", initial_world(F.col("form_type")).alias("world"))


@query(f"SELECT id, strftime((time_first AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d %H:%M') AS local_time, time_first::DATE AS day FROM {A}")
def local_times(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "atoms").select("id", local_time(F.col("time_first")).alias("local_time"), F.to_date("time_first").alias("day"))


@query("SELECT (json_extract_string(props, '$.k')::INT) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


_GAPS = """(SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) > 1800000000 THEN 1 ELSE 0 END AS new FROM events))"""


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return S.gap_sessions(table(spark, d, "events"), "user_id", "ts", ["event_id"])


@query(f"SELECT event_id, user_id, session_no FROM {_GAPS}")
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("event_id", "user_id", "session_no")


@query(f"""SELECT user_id, session_no, count(*) AS n_events, min(ts) AS time_first, max(ts) AS time_last, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds, bool_or(event_type = 'error') AS had_error, count(*) FILTER (event_type = 'error') AS error_count,
  arg_min(props, struct_pack(a := ts, b := props)) AS trigger, round(date_diff('microsecond', min(ts), max(ts)) / 60e6, 1) AS minutes FROM {_GAPS} GROUP BY 1, 2""")
def session_provenance(spark: SparkSession, d: str) -> DataFrame:
    out = S.session_provenance(_sessions(spark, d), "user_id", "ts", "event_type", F.col("event_type") == "error", F.col("props"))
    return out.withColumn("kinds", F.array_join("kinds", ","))


@query("SELECT user_id, window_no, a || '>' || b || '>' || c AS path FROM (SELECT user_id, row_number() OVER w - 1 AS window_no, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE c IS NOT NULL")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.sliding_windows(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", 3).select("user_id", F.col("window_no").cast("long").alias("window_no"), F.array_join("values", ">").alias("path"))


_ROLE = "CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'user' ELSE 'assistant' END"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", F.expr(_ROLE).alias("role"), "props")


@query(f"SELECT user_id, event_id, user_text, assistant_text FROM (SELECT user_id, event_id, {_ROLE} AS r, props AS user_text, lead({_ROLE}) OVER w AS nr, lead(props) OVER w AS assistant_text FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r = 'user' AND nr = 'assistant'")
def exchanges(spark: SparkSession, d: str) -> DataFrame:
    return S.exchanges(_messages(spark, d), "user_id", "event_id", "role", "props")


@query(f"""SELECT user_id, turn_n, max(props) FILTER (r = 'user') AS user_text, coalesce(string_agg(props, chr(10) ORDER BY event_id) FILTER (r = 'assistant'), '') AS response, count(*) FILTER (r = 'assistant') AS blocks FROM
  (SELECT *, sum(CASE WHEN r = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS turn_n FROM (SELECT *, {_ROLE} AS r FROM events)) WHERE turn_n > 0 GROUP BY 1, 2""")
def turn_assembly(spark: SparkSession, d: str) -> DataFrame:
    return S.assemble_turns(_messages(spark, d), "user_id", "event_id", "role", "props")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) > 1 AS is_retry FROM events")
def retry_flags(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    flagged = S.retry_flags(table(spark, d, "events"), ["user_id", "event_type", "props"], ["ts", "event_id"])
    return flagged.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"), "is_retry")


@query(f"SELECT {_K.format('form_id')} AS form_id, arg_max(confidence_after, struct_pack(t := tested_at, i := id)) AS confidence, max(tested_at) AS tested_at, count(*) AS tests FROM {BT} WHERE trim(form_id) <> '' GROUP BY 1")
def latest_test(spark: SparkSession, d: str) -> DataFrame:
    t = cur(spark, d, "belief_tests").select(ref_key(F.col("form_id")).alias("form_id"), "tested_at", "id", "confidence_after").filter("form_id is not null")
    return t.groupBy("form_id").agg(F.max_by("confidence_after", F.struct("tested_at", "id")).alias("confidence"), F.max("tested_at").alias("tested_at"), F.count("*").alias("tests"))


@query(f"SELECT id, project, used FROM (SELECT id, project, sum(length(coalesce(content, '')) + 1) OVER (PARTITION BY project ORDER BY importance DESC, id)::BIGINT AS used FROM {A}) WHERE used <= 2000")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = cur(spark, d, "atoms").select("id", "project", "content", (-F.col("importance")).alias("o"))
    return S.budget_prefix(rows, "project", ["o", "id"], "content", 2000).select("id", "project", "used")


_SESS = f"(SELECT user_id, session_no, min(ts) AS started, max(ts) AS ended FROM {_GAPS} GROUP BY 1, 2)"


@query(f"SELECT user_id, session_no, coalesce(date_diff('microsecond', lag(ended) OVER (PARTITION BY user_id ORDER BY started), started) BETWEEN 0 AND 7200000000, false) AS post_clear FROM {_SESS}")
def post_clear(spark: SparkSession, d: str) -> DataFrame:
    s = _sessions(spark, d).groupBy("user_id", "session_no").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return S.post_clear(s, "user_id", "started", "ended", 7200).select("user_id", "session_no", "post_clear")


_ACT = "event_type IN ('error', 'purchase')"


@query(f"""WITH t AS (SELECT *, {_ACT} AS live, {" , ".join(f"lead({_ACT}, {k}) OVER w AS l{k}, coalesce(date_diff('microsecond', ts, lead(ts, {k}) OVER w) <= 1800000000, false) AS n{k}" for k in range(1, 5))} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id FROM t WHERE live OR (event_type <> 'signup' AND event_type = 'view' AND ((n1 AND l1) OR (n1 AND n2 AND l2) OR (n1 AND n2 AND n3 AND l3) OR (n1 AND n2 AND n3 AND n4 AND l4))) OR (event_type = 'click' AND value > 10)""")
def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events as turns: errors and purchases act, views look around, signups are plumbing, clicks talk."""
    tools = F.expr("case event_type when 'purchase' then array('Bash') when 'view' then array('Read') when 'signup' then array('TaskList') else cast(array() as array<string>) end")
    rows = table(spark, d, "events").withColumns({"tools": tools, "err": F.col("event_type") == "error", "loops": F.lit(1), "said": F.expr("repeat('x', case when value > 10 then 101 else 100 end)")})
    return S.noise_filter(rows, "user_id", "ts", ["event_id"], "err", "tools", "loops", "said").select("event_id")


@query(f"""SELECT coalesce(a.project, b.project) AS project, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT project, count(*) AS n FROM {A} GROUP BY 1) a FULL JOIN (SELECT project_scope AS project, count(*) AS n FROM {FA} GROUP BY 1) b ON a.project = b.project""")
def full_outer_compare(spark: SparkSession, d: str) -> DataFrame:
    a = cur(spark, d, "atoms").groupBy("project").agg(F.count("*").alias("n"))
    b = cur(spark, d, "facts").groupBy(F.col("project_scope").alias("project")).agg(F.count("*").alias("n"))
    return R.compare_counts(a, b, "project", "n")


@query(f"SELECT id, content FROM {FA} WHERE project_scope IS NOT NULL AND scope = 'global' AND NOT EXISTS (SELECT 1 FROM {A} WHERE project = 'no-such-project') ORDER BY importance DESC, id LIMIT 25")
def fallback_union(spark: SparkSession, d: str) -> DataFrame:
    a = cur(spark, d, "atoms").filter("project = 'no-such-project'").select("id", "content", "importance")
    f = cur(spark, d, "facts").filter("project_scope is not null and scope = 'global'").select("id", "content", "importance")
    return R.fallback([a, f], 25, [F.desc("importance"), F.col("id")]).select("id", "content")


@query(f"SELECT id, session_id, confidence FROM {FA} WHERE (memory_type IN ('episodic', 'procedural') AND confidence >= 0.4 OR memory_type = 'semantic' AND confidence >= 0.5) AND trim(content) <> '' AND length(trim(content)) > 10 AND lower(trim(content)) NOT IN ('none', 'n/a', 'null')")
def confidence_floor(spark: SparkSession, d: str) -> DataFrame:
    text = F.trim("content")
    floor = (F.col("memory_type").isin("episodic", "procedural") & (F.col("confidence") >= 0.4)) | ((F.col("memory_type") == "semantic") & (F.col("confidence") >= 0.5))
    return cur(spark, d, "facts").filter(floor & (F.length(text) > 10) & ~F.lower(text).isin("none", "n/a", "null")).select("id", "session_id", "confidence")


@query(f"SELECT f.id, f.session_id FROM {FA} f WHERE f.session_id IN (SELECT unnest(session_ids) FROM {A}) UNION ALL SELECT f.id, f.session_id FROM {FA} f WHERE f.session_id NOT IN (SELECT s FROM (SELECT unnest(session_ids) AS s FROM {A}) WHERE s IS NOT NULL) AND f.scope = 'global'")
def incremental_keep(spark: SparkSession, d: str) -> DataFrame:
    f = cur(spark, d, "facts").select("id", "session_id", "scope")
    s = cur(spark, d, "atoms").select(F.explode("session_ids").alias("session_id")).filter("session_id is not null")
    return f.join(s, "session_id", "left_semi").select("id", "session_id").unionByName(f.join(s, "session_id", "left_anti").filter("scope = 'global' and session_id is not null").select("id", "session_id"))


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def largest_line(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_extendedprice", (-F.col("l_linenumber")).alias("n"), "l_quantity")).alias("b"))
    return best.select("l_orderkey", (-F.col("b.n")).alias("l_linenumber"), F.col("b.l_quantity").alias("l_quantity"))


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total, round(avg(c_acctbal), 4) AS balance FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def orders_by_nation(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("p"))
    c = per.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(F.sum("n").alias("orders"), F.round(F.sum("p"), 2).alias("total"), F.round(F.sum(F.col("c_acctbal") * F.col("n")) / F.sum("n"), 4).alias("balance"))


QUERIES, SQL = query.queries, query.sql
