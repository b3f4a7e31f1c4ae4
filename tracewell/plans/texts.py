"""Queries of the text, file, model and streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import CONDITION_STOPWORDS, CONFIRM_STOPWORDS, EPISODIC, disconfirmation_conditions, keywords, ref_key, stable_id
from tracewell.operators import beliefs as B
from tracewell.operators import models as M
from tracewell.operators.rows import split_holdout, top_per_group
from tracewell.plans.common import Register, cur, cur_sql
from tracewell.runtime import ensure_checkpoint_dir, table
from tracewell.sources import readers as I
from tracewell.streaming import live

query = Register()
A, E, L, FS, RL, BT, FA = (cur_sql(t) for t in ("atoms", "entities", "logical_forms", "form_status", "relations", "belief_tests", "facts"))
_K = "lower(trim({}))"


@query("""SELECT doc_id, substr(text, 1, strpos(substr(text, 5), chr(10) || '---') + 3) AS head, regexp_extract(text, 'session: "([^"\\n]*)"', 1) AS session, regexp_extract(text, 'project: "([^"\\n]*)"', 1) AS project FROM documents WHERE starts_with(text, '---' || chr(10) || 'session: "') AND regexp_matches(text, '\\A---\\nsession: "[^"\\n]*"\\nproject: "[^"\\n]*"\\ndate: [^\\n]*\\n---')""")
def frontmatter_fields(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("text").rlike('\\A---\\nsession: "[^"\\n]*"\\nproject: "[^"\\n]*"\\ndate: [^\\n]*\\n---'))
    m = I.frontmatter(F.col("text"))
    return docs.select("doc_id", F.regexp_extract("text", r"(?s)\A(---\n.*?)\n---", 1).alias("head"), m["session"].alias("session"), m["project"].alias("project"))


@query()
def text_sections(spark: SparkSession, d: str) -> DataFrame:
    return I.sections(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "ordinal", "heading", "char_start", "char_end", F.md5("content").alias("digest"))


@query()
def char_chunks(spark: SparkSession, d: str) -> DataFrame:
    return I.char_chunks(table(spark, d, "documents"), "doc_id", "text", 3000).select("doc_id", "chunk_no", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


@query(f"SELECT id, source, role FROM (SELECT id, source_unit_id AS source, 'primary' AS role FROM {L} WHERE source_unit_id IS NOT NULL UNION SELECT id, u, 'support' FROM (SELECT id, source_unit_id, unnest(source_unit_ids) AS u FROM {L}) WHERE u IS NOT NULL AND u IS DISTINCT FROM source_unit_id)")
def provenance_links(spark: SparkSession, d: str) -> DataFrame:
    f = cur(spark, d, "logical_forms")
    first = f.filter("source_unit_id is not null").select("id", F.col("source_unit_id").alias("source"), F.lit("primary").alias("role"))
    more = f.select("id", "source_unit_id", F.explode("source_unit_ids").alias("source")).filter("source is not null and not (source <=> source_unit_id)")
    return first.unionByName(more.select("id", "source", F.lit("support").alias("role"))).distinct()


_C = f"""(SELECT id, unnest(CASE WHEN form_type = 'claim' THEN CASE WHEN coalesce(subject, '') <> '' AND coalesce(predicate, '') <> '' AND coalesce(object, '') <> '' THEN ['Evidence that ' || subject || ' ' || predicate || ' something other than ' || object, 'Evidence that ' || subject || ' does not ' || predicate || ' ' || object] ELSE ['Evidence contradicting: ' || coalesce(content, '')] END
  WHEN form_type = 'decision' THEN ['Evidence that the decision was reverted or replaced: ' || coalesce(content, ''), 'Evidence that an alternative to this decision was adopted'] WHEN form_type = 'rule' THEN ['Evidence that the rule was violated and the outcome was still good', 'Evidence that following this rule caused a problem']
  WHEN form_type = 'warning' THEN ['Evidence that the warned-about situation occurred without harm', 'Evidence that the risk was mitigated and is no longer relevant'] WHEN form_type = 'plan' THEN ['Evidence that this plan was abandoned or superseded', 'Evidence that the planned item was completed with a different approach']
  WHEN form_type = 'preference' THEN ['Evidence that the preference was overridden or reversed'] ELSE ['Evidence contradicting: ' || coalesce(content, '')] END) AS condition FROM {L})"""
_STOP = "['evidence','that','the','a','an','of','or','and','is','was','were','be','been','being','this','something']"


@query(f"SELECT id, condition, array_to_string(list_filter(regexp_extract_all(lower(condition), '[0-9a-z_]+'), lambda w: NOT list_contains({_STOP}, w) AND length(w) > 2), ' ') AS keywords FROM {_C}")
def condition_keywords(spark: SparkSession, d: str) -> DataFrame:
    cond = F.explode(disconfirmation_conditions(*[F.col(c) for c in ("form_type", "content", "subject", "predicate", "object")]))
    return cur(spark, d, "logical_forms").select("id", cond.alias("condition")).select("id", "condition", F.array_join(keywords(F.col("condition"), CONDITION_STOPWORDS, 2, distinct=False), " ").alias("keywords"))


@query(f"""WITH c AS (SELECT id, condition, list_filter(regexp_extract_all(lower(condition), '[0-9a-z_]+'), lambda w: NOT list_contains({_STOP}, w) AND length(w) > 2) AS kw FROM {_C}),
  t AS (SELECT DISTINCT condition, kw FROM c), k AS (SELECT condition, len(kw) AS n, unnest(list_distinct(kw)) AS w FROM t), a AS (SELECT id AS atom_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[0-9a-z_]+'))) AS w FROM {A}),
  h AS (SELECT condition, atom_id, count(*) / n AS score FROM k JOIN a USING (w) GROUP BY condition, atom_id, n HAVING count(*) / n >= 0.5) SELECT c.id AS form_id, atom_id, round(max(score), 6) AS score FROM c JOIN h USING (condition) GROUP BY 1, 2""")
def condition_score(spark: SparkSession, d: str) -> DataFrame:
    return B.condition_scores(cur(spark, d, "logical_forms"), cur(spark, d, "atoms"), 0.5, digits=6)


_LOW = "lower(coalesce(content, '') || ' ' || coalesce(topic, ''))"
_USEFUL = f"""(SELECT id, content FROM {A} WHERE NOT (atom_type IN ('outcome', 'failure') OR regexp_matches({_LOW}, '\\b({EPISODIC})\\b')))"""


@query(f"""WITH c AS (SELECT id, condition, list_filter(regexp_extract_all(lower(condition), '[0-9a-z_]+'), lambda w: NOT list_contains({_STOP}, w) AND length(w) > 2) AS kw FROM {_C}), t AS (SELECT DISTINCT condition, kw FROM c), k AS (SELECT condition, len(kw) AS n, unnest(list_distinct(kw)) AS w FROM t),
  a AS (SELECT id AS atom_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[0-9a-z_]+'))) AS w FROM {_USEFUL}), h AS (SELECT condition, atom_id, count(*) / n AS score FROM k JOIN a USING (w) GROUP BY condition, atom_id, n HAVING count(*) / n >= 0.3), n AS (SELECT c.id AS form_id, atom_id, max(score) AS against FROM c JOIN h USING (condition) GROUP BY 1, 2),
  f AS (SELECT id, list_filter(list_distinct(regexp_extract_all(lower(concat_ws(' ', content, subject, predicate, object)), '[0-9a-z_]+')), lambda w: NOT list_contains({CONFIRM_STOPWORDS}, w)) AS fw FROM {L}), fe AS (SELECT id, len(fw) AS n, unnest(fw) AS w FROM f),
  y AS (SELECT fe.id AS form_id, a.atom_id, count(*) / n AS confirm FROM fe JOIN a USING (w) GROUP BY 1, 2, n HAVING count(*) / n >= 0.3),
  b AS (SELECT coalesce(y.form_id, n.form_id) AS form_id, coalesce(y.atom_id, n.atom_id) AS atom_id, coalesce(confirm, 0) AS confirm, coalesce(against, 0) AS against FROM y FULL JOIN n ON n.form_id = y.form_id AND n.atom_id = y.atom_id)
  SELECT form_id, atom_id, round(confirm, 6) AS confirm, round(against, 6) AS against, outcome FROM (SELECT *, CASE WHEN against >= 0.5 AND against > confirm THEN 'disconfirmed' WHEN confirm >= 0.4 THEN 'confirmed' WHEN against >= 0.3 THEN 'inconclusive' END AS outcome FROM b) WHERE outcome IS NOT NULL""")
def passive_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return B.passive_outcomes(cur(spark, d, "logical_forms"), cur(spark, d, "atoms"), digits=6)


@query(f"""SELECT f.id AS form_id, f.form_type, count(DISTINCT s.id) AS statuses, count(DISTINCT t.id) AS tests, arg_max(t.outcome, struct_pack(a := t.tested_at, b := t.id)) AS last_outcome FROM {L} f LEFT JOIN {FS} s ON {_K.format('s.form_id')} = f.id LEFT JOIN {BT} t ON {_K.format('t.form_id')} = f.id GROUP BY 1, 2""")
def explain_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """Each form with its statuses, tests and last outcome; both sides are aggregated before they meet."""
    s = cur(spark, d, "form_status").select(ref_key(F.col("form_id")).alias("form_id"), "id").groupBy("form_id").agg(F.countDistinct("id").alias("statuses"))
    t = cur(spark, d, "belief_tests").select(ref_key(F.col("form_id")).alias("form_id"), "id", "tested_at", "outcome").groupBy("form_id").agg(F.countDistinct("id").alias("tests"), F.max_by("outcome", F.struct("tested_at", "id")).alias("last_outcome"))
    f = cur(spark, d, "logical_forms").select(F.col("id").alias("form_id"), "form_type")
    return f.join(s, "form_id", "left").join(t, "form_id", "left").na.fill(0, ["statuses", "tests"])


@query(f"""SELECT id, CASE WHEN id IN (SELECT {_K.format('form_id')} FROM {FS} WHERE status = 'stable') THEN 'global' ELSE scope_type END AS scope_type FROM {L} WHERE superseded_by IS NULL""")
def promote_scope(spark: SparkSession, d: str) -> DataFrame:
    """Forms that are stable anywhere become global."""
    stable = cur(spark, d, "form_status").filter("status = 'stable'").select(ref_key(F.col("form_id")).alias("id")).filter("id is not null").distinct().withColumn("stable", F.lit(True))
    f = cur(spark, d, "logical_forms").filter("superseded_by is null").select("id", "scope_type").join(stable, "id", "left")
    return f.select("id", F.when(F.col("stable"), "global").otherwise(F.col("scope_type")).alias("scope_type"))


@query(f"SELECT id, CASE WHEN confidence >= 0.85 THEN 'invalidate' WHEN confidence >= 0.5 THEN 'review' END AS action, substr(sha256('form|' || id), 1, 32) AS key FROM {FA}")
def contradiction_policy(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "facts").select("id", M.contradiction_action(F.col("confidence")).alias("action"), stable_id(F.lit("form"), F.col("id")).alias("key"))


@query(f"""WITH t AS (SELECT DISTINCT subject AS pattern FROM {L} WHERE subject IS NOT NULL AND subject <> '' AND form_type = 'rule'), h AS (SELECT pattern, least(50, count(*)) AS n FROM t JOIN {FA} f ON contains(lower(f.content), lower(pattern)) GROUP BY 1)
  SELECT pattern AS form_id, CASE WHEN coalesce(n, 0) > 0 THEN 'confirmed' ELSE 'inconclusive' END AS outcome FROM t LEFT JOIN h USING (pattern)""")
def active_probes(spark: SparkSession, d: str) -> DataFrame:
    """The subject of every rule looked for in all facts."""
    p = cur(spark, d, "logical_forms").filter("subject != '' and form_type = 'rule'").select(F.col("subject").alias("form_id")).distinct()
    p = p.select("form_id", F.lit("1").alias("probe_id"), F.col("form_id").alias("pattern"), F.lit(False).alias("denies"))
    return M.probe_texts(cur(spark, d, "facts").select(F.col("id").alias("file"), F.col("content").alias("text")), p).select("form_id", "outcome")


@query(f"SELECT topic, id AS fact_id, rank FROM (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY importance DESC, confidence DESC, id) AS rank FROM {FA} WHERE topic IS NOT NULL AND invalidated_by IS NULL) WHERE rank <= 5")
def recall_topics(spark: SparkSession, d: str) -> DataFrame:
    f = cur(spark, d, "facts").filter("topic is not null and invalidated_by is null").select("topic", F.col("id").alias("fact_id"), "importance", "confidence")
    return top_per_group(f, ["topic"], [F.desc("importance"), F.desc("confidence"), F.col("fact_id")], 5).select("topic", "fact_id", "rank")


@query()
def holdout_sessions(spark: SparkSession, d: str) -> DataFrame:
    return split_holdout(cur(spark, d, "facts").select("session_id").filter("session_id is not null").distinct(), "session_id", 0.25, 42)


@query()
def embed_facts(spark: SparkSession, d: str) -> DataFrame:
    return M.embed(cur(spark, d, "facts").select("id", "content"), "content").select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


def _stream_dir(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4()}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("""SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS "end", count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
  (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) > 1800000000 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Gap sessions as a stream over all events; a last row far behind the others carries the watermark past every open
    session, so that all of them close."""
    at = _stream_dir(spark)
    events = table(spark, d, "events").select("user_id", "ts")
    events.agg(F.lit(None).cast("long").alias("user_id"), (F.max("ts") + F.expr("interval 90 days")).alias("ts")).write.parquet(f"{at}/end")
    end = spark.readStream.schema(events.schema).parquet(f"{at}/end")
    rows = _events(spark, d).select("user_id", "ts").unionByName(end)
    live.gap_sessions(rows, "user_id", "ts", late="40 days").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("user_id long, start timestamp, end timestamp, n long").parquet(f"{at}/out")
    return out.filter("user_id is not null").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    at = _stream_dir(spark)
    live.append_once(_events(spark, d), ["event_id"], "ts", f"{at}/out", f"{at}/c", "40 days").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "user_id", "event_type")


@query("SELECT time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    out = live.window_counts(table(spark, d, "events").select("ts", "event_type"), "ts", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


QUERIES, SQL = query.queries, query.sql
