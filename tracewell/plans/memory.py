"""Queries of the graph, belief, evaluation and storage operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import ref_key
from tracewell.operators import beliefs as B
from tracewell.operators import evaluation as V
from tracewell.operators import graph as G
from tracewell.operators import rows as R
from tracewell.operators import sessions as S
from tracewell.plans.common import Register, cur, cur_sql, name_sql
from tracewell.runtime import table

query = Register()
A, E, L, FS, RL, BT, FA = (cur_sql(t) for t in ("atoms", "entities", "logical_forms", "form_status", "relations", "belief_tests", "facts"))
_K = "lower(trim({}))"
_INDEX = f"""(SELECT n AS name, arg_min(id, struct_pack(p := p, i := id)) AS entity_id FROM (SELECT {name_sql('canonical_name')} AS n, 0 AS p, id FROM {E} UNION ALL SELECT {name_sql('al')}, 1, id FROM (SELECT id, unnest(aliases) AS al FROM {E}) WHERE al IS NOT NULL) WHERE n <> '' GROUP BY n)"""
_RES = f"""(SELECT DISTINCT id, entity_id FROM (SELECT id, {name_sql('n')} AS name FROM (SELECT id, unnest(entities) AS n FROM {A}) WHERE n IS NOT NULL) JOIN {_INDEX} USING (name))"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return G.resolve(cur(spark, d, "atoms"), "id", "entities", cur(spark, d, "entities"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return cur(spark, d, "relations").select("id", ref_key(F.col("source_entity")).alias("src"), ref_key(F.col("target_entity")).alias("dst"), "relation_type", "weight", "description", "last_seen")


_ED = f"(SELECT id, {_K.format('source_entity')} AS src, {_K.format('target_entity')} AS dst, relation_type, weight, description, last_seen FROM {RL} WHERE trim(source_entity) <> '' AND trim(target_entity) <> '')"


@query(f"SELECT id AS atom_id, entity_id FROM {_RES}")
def resolve_two_tier(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select(F.col("id").alias("atom_id"), "entity_id")


@query(f"SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS n FROM {_RES} x JOIN {_RES} y ON x.id = y.id AND x.entity_id < y.entity_id GROUP BY 1, 2")
def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.pair_counts(_resolved(spark, d), "id", "entity_id")


_SE = f"(SELECT DISTINCT s, entity_id FROM (SELECT id, unnest(session_ids) AS s FROM {A}) JOIN {_RES} USING (id))"
_CO = f"(SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS n FROM {_SE} x JOIN {_SE} y ON x.s = y.s AND x.entity_id < y.entity_id GROUP BY 1, 2 HAVING count(*) >= 2)"


def _coactive(spark: SparkSession, d: str) -> DataFrame:
    sessions = cur(spark, d, "atoms").select("id", F.explode("session_ids").alias("s"))
    rows = sessions.join(_resolved(spark, d), "id").select("s", "entity_id").filter("s is not null").distinct()
    return G.pair_counts(rows, "s", "entity_id").filter("n >= 2")


@query(f"SELECT * FROM {_CO}")
def coactivation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _coactive(spark, d)


_UE = f"(SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS weight FROM {_ED} WHERE relation_type = 'related_to' AND src <> dst GROUP BY 1, 2)"


def _related(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).filter("relation_type = 'related_to' and src != dst and src is not null and dst is not null")
    return G.undirected(e, "src", "dst").groupBy("a", "b").agg(F.max("weight").alias("weight"))


@query(f"SELECT coalesce(e.a, p.a) AS a, coalesce(e.b, p.b) AS b, round(CASE WHEN p.n IS NULL THEN e.weight ELSE greatest(coalesce(e.weight, 0), least(20.0, coalesce(e.weight, 0) + 0.3 * p.n)) END, 6) AS weight, e.a IS NOT NULL AS existed FROM {_UE} e FULL JOIN {_CO} p ON e.a = p.a AND e.b = p.b")
def hebbian_update(spark: SparkSession, d: str) -> DataFrame:
    return G.reinforce(_related(spark, d), _coactive(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"""WITH p AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS n FROM {_RES} x JOIN {_RES} y ON x.id = y.id AND x.entity_id < y.entity_id GROUP BY 1, 2)
  SELECT p.a, p.b, p.n, round(e.weight, 6) AS weight FROM p JOIN {_UE} e ON (e.a = p.a AND e.b = p.b) OR (e.a = p.b AND e.b = p.a)""")
def undirected_lookup(spark: SparkSession, d: str) -> DataFrame:
    pairs = G.pair_counts(_resolved(spark, d), "id", "entity_id")
    return pairs.join(_related(spark, d), ["a", "b"]).select("a", "b", "n", F.round("weight", 6).alias("weight"))


_HOT = f"(SELECT DISTINCT entity_id FROM {_RES} JOIN {A} USING (id) WHERE time_last >= TIMESTAMP '2026-04-01')"


@query(f"""SELECT e.id, round(CASE WHEN cold THEN weight * 0.97 ELSE weight END, 8) AS weight, cold AS decayed FROM (SELECT *, relation_type = 'related_to' AND description = 'hebbian' AND description IS NOT NULL AND src NOT IN (SELECT * FROM {_HOT}) AND dst NOT IN (SELECT * FROM {_HOT}) AS cold FROM {_ED}) e WHERE NOT cold OR weight * 0.97 >= 0.01""")
def hebbian_decay(spark: SparkSession, d: str) -> DataFrame:
    hot = _resolved(spark, d).join(cur(spark, d, "atoms").filter("time_last >= timestamp_ntz'2026-04-01 00:00:00'").select("id"), "id").select("entity_id").distinct()
    edges = _edges(spark, d).filter("src is not null and dst is not null").withColumn("before", F.col("weight"))
    out = G.decay(edges, hot, "src", "dst", "relation_type = 'related_to' and description = 'hebbian'")
    return out.select("id", F.round("weight", 8).alias("weight"), (F.col("weight") != F.col("before")).alias("decayed"))


@query(f"SELECT src AS node, count(*) AS degree FROM (SELECT src FROM {_ED} UNION ALL SELECT dst FROM {_ED}) GROUP BY 1")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_edges(spark, d).filter("src is not null and dst is not null"), "src", "dst")


@query(f"""WITH g AS (SELECT src AS node, count(*) AS degree FROM (SELECT src FROM {_ED} UNION ALL SELECT dst FROM {_ED}) GROUP BY 1) SELECT e.id, x.degree + y.degree AS combined FROM {_ED} e JOIN g x ON x.node = e.src JOIN g y ON y.node = e.dst""")
def combined_degree(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).filter("src is not null and dst is not null")
    g = G.degrees(e, "src", "dst")
    return e.join(g.select(F.col("node").alias("src"), F.col("degree").alias("x")), "src").join(g.select(F.col("node").alias("dst"), F.col("degree").alias("y")), "dst").select("id", (F.col("x") + F.col("y")).alias("combined"))


@query(f"SELECT id, relation_type FROM {_ED} WHERE src IN (SELECT id FROM {E}) AND dst IN (SELECT id FROM {E})")
def known_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.known_edges(_edges(spark, d).withColumnRenamed("id", "edge"), cur(spark, d, "entities").select("id"), "src", "dst").select(F.col("edge").alias("id"), "relation_type")


@query(f"SELECT s.entity_type AS community, count(*) AS edges, round(sum(r.weight), 4) AS weight FROM {_ED} r JOIN {E} s ON s.id = r.src JOIN {E} t ON t.id = r.dst WHERE s.entity_type = t.entity_type GROUP BY 1")
def internal_edges(spark: SparkSession, d: str) -> DataFrame:
    member = cur(spark, d, "entities").select("id", F.col("entity_type").alias("community"))
    return G.internal_edges(_edges(spark, d).drop("id"), member, "src", "dst").withColumn("weight", F.round("weight", 4))


@query(f"SELECT DISTINCT src, dst, relation_type FROM {_ED} WHERE relation_type <> 'related_to'")
def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).filter("relation_type != 'related_to' and src is not null and dst is not null").select("src", "dst", "relation_type").distinct()


@query(f"""SELECT community, count(DISTINCT s) AS session_count, min(time_first) AS first, max(time_first) AS last, greatest(1, (date_diff('microsecond', min(time_first), max(time_first)) // 86400000000) // 7 + 1)::INT AS week_span
  FROM (SELECT entity_type AS community, unnest(session_ids) AS s, a.time_first FROM {E} e JOIN {_RES} r ON r.entity_id = e.id JOIN {A} a ON a.id = r.id) GROUP BY 1""")
def trace_multi_hop(spark: SparkSession, d: str) -> DataFrame:
    member = cur(spark, d, "entities").select(F.col("id").alias("entity_id"), F.col("entity_type").alias("community"))
    member = member.join(_resolved(spark, d), "entity_id").select("community", F.col("id").alias("atom"))
    events = cur(spark, d, "atoms").select(F.col("id").alias("atom"), F.explode("session_ids").alias("s"), "time_first")
    return G.community_spans(member, events, "community", "s", "time_first")


@query("""WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2), m AS (SELECT label, list(x ORDER BY i) AS c FROM c GROUP BY label)
  SELECT x.label AS a, y.label AS b, round(list_cosine_similarity(x.c, y.c), 6) AS score FROM m x JOIN m y ON x.label < y.label WHERE list_cosine_similarity(x.c, y.c) >= -0.05""")
def cross_domain_bridges(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    m = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vec"))
    return G.bridges(m.select(F.col("label").alias("id"), F.array(F.col("label").cast("string")).alias("areas"), "vec"), -0.05).withColumn("score", F.round("score", 6))


@query(f"SELECT DISTINCT e.entity_type AS community FROM {E} e JOIN {_HOT} h ON h.entity_id = e.id")
def stale_mark(spark: SparkSession, d: str) -> DataFrame:
    hot = _resolved(spark, d).join(cur(spark, d, "atoms").filter("time_last >= timestamp_ntz'2026-04-01 00:00:00'").select("id"), "id").select("entity_id")
    return G.stale_communities(cur(spark, d, "entities").select("id", F.col("entity_type").alias("community")), hot)


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_ED} WHERE relation_type IN ('depends_on', 'part_of', 'uses', 'built_with')), r(n) AS (SELECT dst FROM e WHERE src IN (SELECT src FROM {_ED} WHERE relation_type = 'replaced_by') UNION SELECT e.dst FROM r JOIN e ON e.src = r.n) SELECT n AS node FROM r""")
def closure(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    replaced = e.filter("relation_type = 'replaced_by'").select("src")
    return R.closure(e.filter(F.col("relation_type").isin("depends_on", "part_of", "uses", "built_with")), replaced, "src", "dst").select("node")


@query(f"""SELECT upper(name) AS title, arg_min(atom_type, seq) AS type, count(*) AS frequency FROM (SELECT {name_sql('n')} AS name, atom_type, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || id AS seq FROM (SELECT id, atom_type, created_at, unnest(entities) AS n FROM {A}) WHERE n IS NOT NULL) WHERE name <> '' GROUP BY 1""")
def dedupe_first_type(spark: SparkSession, d: str) -> DataFrame:
    from tracewell.functions.text import name_form

    raw = cur(spark, d, "atoms").select(F.explode("entities").alias("n"), F.col("atom_type").alias("type"), F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "id").alias("seq"), F.col("id").alias("source_id"))
    raw = raw.select(F.upper(name_form(F.col("n"))).alias("title"), "type", F.lit(None).cast("string").alias("description"), "source_id", "seq").filter("title != ''")
    return G.dedupe_entities(raw).select("title", "type", "frequency")


@query(f"SELECT src AS source, dst AS target, round(sum(weight), 6) AS weight, count(*) AS n FROM {_ED} GROUP BY 1, 2")
def relationship_sums(spark: SparkSession, d: str) -> DataFrame:
    raw = _edges(spark, d).filter("src is not null and dst is not null").select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight")
    return G.aggregate_relationships(raw).withColumn("weight", F.round("weight", 6))


@query()
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    pull = F.create_map(*[x for k, v in G.TYPE_PULL.items() for x in (F.lit(k), F.lit(v))])
    edges = _edges(spark, d).select("src", "dst", (F.col("weight") * F.coalesce(pull[F.col("relation_type")], F.lit(1.0))).alias("weight"))
    return G.label_propagation(cur(spark, d, "entities").select("id"), edges)


@query("""WITH RECURSIVE e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings),
  w(r, leaders, id, leader) AS (SELECT r, [struct_pack(id := id, v := v)], id, id FROM e WHERE r = 1
    UNION ALL SELECT x.r, CASE WHEN hit IS NULL THEN list_append(leaders, struct_pack(id := x.id, v := x.v)) ELSE leaders END, x.id, coalesce(hit, x.id) FROM (SELECT w.leaders, e.r, e.id, e.v, list_filter(w.leaders, lambda l: list_cosine_similarity(l.v, e.v) >= 0.5)[1].id AS hit FROM w JOIN e ON e.r = w.r + 1) x)
  SELECT id::VARCHAR AS id, leader::VARCHAR AS leader FROM w""")
def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    """All embeddings in order of their ids, whatever their label."""
    e = table(spark, d, "embeddings")
    return G.leader_clusters(e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vec")), None, 0.5)


@query(f"SELECT id AS source_id, upper(trim(canonical_name)) AS title, upper(entity_type) AS type, 2.5::DOUBLE AS weight FROM {E}")
def graph_tuple_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("(\"entity\"<|>"), "canonical_name", F.lit("<|>"), "entity_type", F.lit("<|>"), F.coalesce("description", F.lit("none")), F.lit(")##(\"relationship\"<|>"), "canonical_name", F.lit("<|>x<|>tie<|>2.5)<|COMPLETE|>"))
    ents, rels = G.parse_graph_tuples(cur(spark, d, "entities").select("id", text.alias("t")), "id", "t")
    return ents.join(rels.select("source_id", "weight"), "source_id").select("source_id", "title", "type", "weight")


_ME = f"(SELECT id, extracted_at, form_type, lower(trim(coalesce(subject, ''))) AS s, lower(trim(coalesce(predicate, ''))) AS p, lower(trim(coalesce(object, ''))) AS o FROM {L})"


@query(f"""WITH f AS (SELECT s, p, o, arg_min(id, struct_pack(t := extracted_at, i := id)) AS id FROM {_ME} WHERE s <> '' AND p <> '' AND o <> '' GROUP BY 1, 2, 3)
  SELECT a.s AS subject, a.p AS predicate, least(a.id, b.id) AS form_a, greatest(a.id, b.id) AS form_b FROM f a JOIN f b ON a.s = b.s AND a.p = b.p AND a.o < b.o""")
def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    return B.conflict_pairs(cur(spark, d, "logical_forms"))


@query(f"""SELECT id AS form_id, head AS superseded_by FROM (SELECT id, first_value(id) OVER (PARTITION BY s, form_type, p ORDER BY extracted_at DESC, id) AS head FROM {_ME} WHERE s <> '') WHERE id <> head""")
def supersession(spark: SparkSession, d: str) -> DataFrame:
    return B.supersession(cur(spark, d, "logical_forms"))


_SUP = f"(SELECT id AS form_id, confidence, len(list_distinct(list_filter(list_concat(source_unit_ids, [source_unit_id]), lambda x: x IS NOT NULL))) AS support FROM {L})"


@query(f"SELECT form_id, support FROM {_SUP}")
def evidence_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.evidence_counts(cur(spark, d, "logical_forms"))


@query(f"SELECT form_id, round(least(1.0, confidence + 0.1), 6) AS confidence FROM {_SUP} WHERE support >= 2 AND form_id NOT IN (SELECT {_K.format('form_id')} FROM {FS} WHERE status IN ('stable', 'contradicted'))")
def stable_promotions(spark: SparkSession, d: str) -> DataFrame:
    s = cur(spark, d, "form_status").select(ref_key(F.col("form_id")).alias("form_id"), "status")
    return B.stable_promotions(cur(spark, d, "logical_forms"), s, least=2).withColumn("confidence", F.round("confidence", 6))


_TH = f"""(SELECT id, form_type, content, lower(trim(e)) AS e FROM (SELECT id, form_type, content, unnest(CASE WHEN len(list_filter(entity_ids, lambda x: trim(x) <> '')) > 0 THEN list_filter(entity_ids, lambda x: trim(x) <> '') ELSE [coalesce(subject, '')] END) AS e FROM {L}) WHERE trim(e) <> '')"""


@query(f"SELECT w.id AS warning_id, d.id AS decision_id, count(DISTINCT w.e) AS shared FROM {_TH} w JOIN {_TH} d ON w.e = d.e WHERE w.form_type = 'warning' AND (contains(lower(w.content), 'fail') OR contains(lower(w.content), 'block')) AND d.form_type = 'decision' GROUP BY 1, 2")
def lesson_overlap(spark: SparkSession, d: str) -> DataFrame:
    return B.lessons(cur(spark, d, "logical_forms"), ["fail", "block"])


@query(f"SELECT f.id, count(*) AS shared FROM (SELECT DISTINCT id, lower(trim(e)) AS e FROM (SELECT id, unnest(entities) AS e FROM {FA})) f WHERE e IN ('harrowgate index', 'brindle notebook', 'quillmark') GROUP BY 1")
def overlap_filter(spark: SparkSession, d: str, names: tuple[str, ...] = ("harrowgate index", "brindle notebook", "quillmark")) -> DataFrame:
    """Facts that name any of some entities, with how many of them."""
    f = cur(spark, d, "facts").select("id", F.explode("entities").alias("e")).select("id", F.lower(F.trim("e")).alias("e")).distinct()
    return f.filter(F.col("e").isin(*names)).groupBy("id").agg(F.count("*").alias("shared"))


_W = "list_distinct(regexp_extract_all(lower({}), '[0-9a-z_]+'))"
_CS = "['the','a','an','is','was','are','were','be','been','that','this','it','of','in','on','at','to','for']"


@query(f"""WITH f AS (SELECT id, list_filter({_W.format("concat_ws(' ', content, subject, predicate, object)")}, lambda w: NOT list_contains({_CS}, w)) AS fw FROM {L}), fe AS (SELECT id, len(fw) AS n, unnest(fw) AS w FROM f),
  a AS (SELECT id, unnest({_W.format("coalesce(content, '')")}) AS w FROM {A}) SELECT fe.id AS form_id, a.id AS atom_id, round(count(*) / n, 6) AS score FROM fe JOIN a USING (w) GROUP BY 1, 2, n HAVING count(*) / n >= 0.4""")
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    return B.keyword_scores(cur(spark, d, "logical_forms"), cur(spark, d, "atoms"), digits=6)


_BP = f"""(SELECT id, {_K.format('form_id')} AS form_id, outcome, 1.0 + sum((outcome = 'confirmed')::INT) OVER w AS alpha, 1.0 + sum((outcome = 'disconfirmed')::INT) OVER w AS beta FROM {BT} WINDOW w AS (PARTITION BY {_K.format('form_id')} ORDER BY tested_at, id ROWS UNBOUNDED PRECEDING))"""


def _path(spark: SparkSession, d: str) -> DataFrame:
    t = cur(spark, d, "belief_tests").withColumn("form_id", F.coalesce(ref_key(F.col("form_id")), F.lit("")))
    return B.beta_path(t, "form_id", ["tested_at", "id"], "outcome")


@query(f"SELECT id, form_id, alpha::DOUBLE AS alpha, beta::DOUBLE AS beta, round(alpha / (alpha + beta), 6) AS confidence FROM {_BP}")
def beta_bernoulli(spark: SparkSession, d: str) -> DataFrame:
    return _path(spark, d).select("id", "form_id", "alpha", "beta", F.round("confidence", 6).alias("confidence"))


@query(f"""SELECT id, action FROM (SELECT b.id, CASE WHEN alpha / (alpha + beta) < 0.2 AND alpha + beta >= 5 THEN 'retire' WHEN alpha / (alpha + beta) < 0.45 AND alpha + beta >= 3 AND f.form_type IN ('event', 'plan') THEN 'historicize' END AS action FROM {_BP} b JOIN {L} f ON f.id = b.form_id WHERE b.outcome <> 'confirmed') WHERE action IS NOT NULL""")
def repairs(spark: SparkSession, d: str) -> DataFrame:
    f = cur(spark, d, "logical_forms").select(F.col("id").alias("form_id"), "form_type")
    t = _path(spark, d).filter("outcome != 'confirmed'").join(f, "form_id")
    return t.select("id", B.repair(F.col("alpha"), F.col("beta"), F.col("form_type")).alias("action")).filter("action is not null")


@query(f"SELECT {_K.format('form_id')} AS form_id, count(*) FILTER (outcome = 'confirmed') AS confirmed, count(*) FILTER (outcome = 'disconfirmed') AS disconfirmed, count(*) FILTER (outcome = 'inconclusive') AS inconclusive FROM {BT} WHERE trim(form_id) <> '' GROUP BY 1")
def outcome_pivot(spark: SparkSession, d: str) -> DataFrame:
    t = cur(spark, d, "belief_tests").select(ref_key(F.col("form_id")).alias("form_id"), "outcome").filter("form_id is not null")
    return t.groupBy("form_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("confirmed", "disconfirmed", "inconclusive")])


@query()
def fixed_point_rules(spark: SparkSession, d: str) -> DataFrame:
    s = cur(spark, d, "form_status").select(ref_key(F.col("form_id")).alias("form_id"), "status").filter("form_id is not null")
    _, _, log = B.run_rules(cur(spark, d, "logical_forms"), s)
    return log.groupBy("pass", "rule", "kind").agg(F.count("*").alias("fired"))


_TOPIC = "contains(lower(concat_ws(chr(10), content, subject, object)), 'snapshot')"


@query(f"""WITH s AS (SELECT DISTINCT {_K.format('form_id')} AS form_id, status FROM {FS}), m AS (SELECT CASE WHEN s.status = 'stable' THEN 'stable' WHEN s.status = 'active' THEN 'active' WHEN s.status IN ('contradicted', 'decayed', 'superseded') THEN 'caution' END AS stage, f.id, f.content, f.confidence FROM {L} f JOIN s ON s.form_id = f.id WHERE {_TOPIC}),
  g AS (SELECT stage, id, any_value(content) AS content, max(confidence) AS confidence FROM m WHERE stage IS NOT NULL GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY confidence DESC, id)::INT AS rank FROM g) WHERE rank <= 8""")
def belief_retrieval(spark: SparkSession, d: str, topic: str = "snapshot") -> DataFrame:
    """The best forms of each stage on a topic."""
    s = cur(spark, d, "form_status").select(ref_key(F.col("form_id")).alias("form_id"), "status")
    return B.beliefs_for(topic, cur(spark, d, "logical_forms"), s)


@query(f"SELECT substr(sha256('form|' || id), 1, 32) AS form_id, CASE memory_type WHEN 'episodic' THEN 'event' WHEN 'procedural' THEN 'rule' ELSE 'claim' END AS form_type, content, coalesce(entities[1], topic) AS subject, confidence, CASE WHEN invalidated_by IS NULL THEN 'current' ELSE 'past' END AS world_id, CASE WHEN invalidated_by IS NULL THEN 'active' ELSE 'superseded' END AS status FROM {FA}")
def facts_to_forms(spark: SparkSession, d: str) -> DataFrame:
    return B.derive_forms(cur(spark, d, "facts"))


_CLS = "CASE WHEN atom_type IN ('outcome', 'failure') THEN 'episodic' WHEN atom_type IN ('pattern', 'gotcha') THEN 'procedural' ELSE 'semantic' END"


def _confusion_sql(rows: str, a: str, p: str, by: str) -> str:
    return f"""SELECT {by}, tp, fp, fn, tn, round(pr, 4) AS precision, round(rc, 4) AS recall, round(2 * pr * rc / greatest(pr + rc, 1e-9), 4) AS f1 FROM (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS rc FROM
  (SELECT {by}, count(*) FILTER (coalesce({a}, false) AND coalesce({p}, false)) AS tp, count(*) FILTER (NOT coalesce({a}, false) AND coalesce({p}, false)) AS fp, count(*) FILTER (coalesce({a}, false) AND NOT coalesce({p}, false)) AS fn, count(*) FILTER (NOT coalesce({a}, false) AND NOT coalesce({p}, false)) AS tn FROM {rows} GROUP BY {by}))"""


@query(_confusion_sql(A, "memory_class = 'episodic'", f"{_CLS} = 'episodic'", "project"))
def confusion_f1(spark: SparkSession, d: str) -> DataFrame:
    return V.confusion(cur(spark, d, "atoms"), F.col("memory_class") == "episodic", F.expr(f"{_CLS} = 'episodic'"), ["project"])


@query(_confusion_sql(f"{A}, (SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS floor), (SELECT unnest([1, 2, 3]) AS least)", "invalidated_by IS NOT NULL", "confidence < floor AND source_count >= least", "floor, least"))
def param_sweep(spark: SparkSession, d: str) -> DataFrame:
    score = F.struct("confidence", "source_count")
    out = V.sweep(cur(spark, d, "atoms"), F.col("invalidated_by").isNotNull(), score, {"floor": [0.5, 0.7, 0.9], "least": [1, 2, 3]}, lambda s, p: (s["confidence"] < p("floor")) & (s["source_count"] >= p("least")))
    return out


_F1W = "regexp_extract_all(lower({}), '[0-9a-z_]+')"


@query(f"""WITH t AS (SELECT f.id, {_F1W.format('f.content')} AS x, {_F1W.format('a.content')} AS y FROM {L} f JOIN {A} a ON a.id = f.source_unit_id),
  c AS (SELECT id, sum(least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w)))) AS same FROM (SELECT id, x, y, unnest(list_distinct(x)) AS w FROM t) GROUP BY id)
  SELECT id, round(CASE WHEN len(x) + len(y) > 0 THEN 2 * coalesce(same, 0) / (len(x) + len(y)) ELSE 0 END, 6) AS f1 FROM t LEFT JOIN c USING (id)""")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    f = cur(spark, d, "logical_forms").select("id", F.col("source_unit_id").alias("a"), F.col("content").alias("x"))
    rows = f.join(cur(spark, d, "atoms").select(F.col("id").alias("a"), F.col("content").alias("y")), "a")
    return V.token_f1(rows, ["id"], "x", "y").withColumn("f1", F.round("f1", 6))


_TS = f"(SELECT coalesce(topic, '') AS topic, count(DISTINCT s) AS sessions, count(DISTINCT id) AS size, max(importance) AS imp, greatest(1, (date_diff('microsecond', min(time_first), max(time_last)) // 86400000000) // 7 + 1) AS weeks FROM (SELECT *, unnest(session_ids) AS s FROM {A}) GROUP BY 1)"


@query(f"""SELECT topic, round(score, 6) AS score, score >= 0.65 AND sessions >= 2 AND weeks >= 2 AS promote FROM (SELECT *, 0.3 * least(1, imp * 10 / 10) + 0.15 * least(1, size / 20) + 0.2 * least(1, greatest(0, (sessions - 1) / 4)) + 0.15 * least(1, greatest(0, (weeks - 1) / 7)) + 0.1 AS score FROM {_TS})""")
def six_signal_score(spark: SparkSession, d: str) -> DataFrame:
    from tracewell.functions.times import week_span

    rows = cur(spark, d, "atoms").select(F.coalesce("topic", F.lit("")).alias("topic"), "id", F.explode("session_ids").alias("s"), "importance", "time_first", "time_last")
    g = rows.groupBy("topic").agg(F.countDistinct("s").alias("sessions"), F.countDistinct("id").alias("size"), F.max("importance").alias("imp"), F.min("time_first").alias("x"), F.max("time_last").alias("y"))
    g = g.withColumn("weeks", week_span(F.col("x"), F.col("y"))).withColumn("score", V.candidate_score(F.col("imp") * 10, F.col("size"), F.col("sessions"), F.col("weeks")))
    return g.select("topic", F.round("score", 6).alias("score"), V.gate(F.col("score"), F.col("sessions"), F.col("weeks")).alias("promote"))


@query("""WITH o AS (SELECT *, struct_pack(u := updated_at, c := atom_count) AS seq FROM entities), al AS (SELECT id, array_to_string(list(DISTINCT a ORDER BY a), '|') AS aliases FROM (SELECT id, unnest(aliases) AS a FROM entities) WHERE a IS NOT NULL GROUP BY 1),
  ac AS (SELECT id, count(DISTINCT a) AS atom_count FROM (SELECT id, unnest(atom_ids) AS a FROM entities) WHERE a IS NOT NULL GROUP BY 1)
  SELECT o.id, arg_max(entity_type, seq) AS entity_type, arg_min(first_seen, seq) AS first_seen, max(last_seen) AS last_seen, arg_max(description, seq) FILTER (description IS NOT NULL) AS description, coalesce(any_value(al.aliases), '') AS aliases, coalesce(any_value(ac.atom_count), 0)::INT AS atom_count
  FROM o LEFT JOIN al ON al.id = o.id LEFT JOIN ac ON ac.id = o.id GROUP BY o.id""")
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All deliveries of the entities merged into one row each."""
    e = table(spark, d, "entities").select(F.col("id").alias("canonical_name"), "entity_type", "aliases", "atom_ids", "description", "embedding", "first_seen", "last_seen", F.struct("updated_at", "atom_count").alias("seq"))
    merged = R.merge_entities(e.limit(0), e)
    return merged.select(F.col("canonical_name").alias("id"), "entity_type", "first_seen", "last_seen", "description", F.array_join("aliases", "|").alias("aliases"), "atom_count")


@query(f"SELECT id, 'old' AS origin FROM {A} WHERE project < 'm' UNION ALL SELECT id, 'new' FROM {A} WHERE project >= 'm' ")
def idempotent_insert(spark: SparkSession, d: str) -> DataFrame:
    a = cur(spark, d, "atoms").select("id", "project")
    old = a.filter("project < 'm'").select("id", F.lit("old").alias("origin"))
    return R.insert_missing(old, a.select("id", F.lit("new").alias("origin")), ["id"])


@query(f"SELECT id, CASE WHEN project >= 'm' THEN 'replaced' ELSE 'kept' END AS state FROM {A}")
def replace_rows(spark: SparkSession, d: str) -> DataFrame:
    a = cur(spark, d, "atoms").select("id", "project")
    return R.replace_rows(a.select("id", F.lit("kept").alias("state")), a.filter("project >= 'm'").select("id", F.lit("replaced").alias("state")), ["id"])


@query(f"""WITH s AS (SELECT id AS form_id, head FROM (SELECT id, first_value(id) OVER (PARTITION BY s, form_type, p ORDER BY extracted_at DESC, id) AS head FROM {_ME} WHERE s <> '') WHERE id <> head)
  SELECT f.id, coalesce(f.superseded_by, s.head) AS superseded_by FROM {L} f LEFT JOIN s ON s.form_id = f.id""")
def soft_supersede(spark: SparkSession, d: str) -> DataFrame:
    f = cur(spark, d, "logical_forms")
    changes = B.supersession(f).select(F.col("form_id").alias("id"), F.col("superseded_by").alias("value"))
    return R.set_flag(f.select("id", "superseded_by"), changes, "id", "superseded_by")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("intent"), F.array("event_type").alias("things"))


@query("""WITH a AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('microsecond', lag(ts) OVER w, ts) > 7200000000 OR event_type <> lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a), c AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) // 8 AS part FROM b),
  d AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY run, part) - 1 AS cluster_no FROM c) SELECT user_id, cluster_no, count(*) AS turns, min(ts) AS first, max(ts) AS last FROM d GROUP BY 1, 2""")
def turn_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Intent and things are the type of the event, the one column that stays the same while a user does one thing."""
    return S.turn_clusters(_turns(spark, d), "user_id", "ts", ["event_id"], "intent", "things").groupBy("user_id", "cluster_no").agg(F.count("*").alias("turns"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("""WITH RECURSIVE i AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, event_id AS s, (length(props) + trunc(value)::BIGINT)::BIGINT AS t FROM events),
  w(user_id, r, chunk, held, done) AS (SELECT user_id, r, 0, [struct_pack(s := s, t := t)], NULL::STRUCT(s BIGINT, t BIGINT)[] FROM i WHERE r = 1
    UNION ALL SELECT user_id, r, CASE WHEN ends THEN chunk + 1 ELSE chunk END, CASE WHEN ends THEN list_append(CASE WHEN coalesce(list_sum(list_transform(tail, lambda x: x.t)), 0) + t <= 400 THEN tail ELSE [] END, struct_pack(s := s, t := t)) ELSE list_append(held, struct_pack(s := s, t := t)) END, CASE WHEN ends THEN held END
    FROM (SELECT w.user_id, i.r, w.chunk, w.held, i.s, i.t, list_sum(list_transform(w.held, lambda x: x.t)) + i.t > 400 AS ends,
      list_reduce(list_reverse(list_transform(w.held, lambda y: [y])), lambda keep, y: CASE WHEN coalesce(list_sum(list_transform(keep, lambda z: z.t)), 0) + y[1].t <= 80 THEN list_concat(y, keep) ELSE keep END, list_filter(w.held, lambda y: false)) AS tail FROM w JOIN i ON i.user_id = w.user_id AND i.r = w.r + 1))
  SELECT user_id, chunk_no, list_sum(list_transform(c, lambda x: x.t))::BIGINT AS tokens, array_to_string(list_transform(c, lambda x: x.s::VARCHAR), ',') AS items FROM (SELECT user_id, chunk - 1 AS chunk_no, done AS c FROM w WHERE done IS NOT NULL UNION ALL SELECT user_id, chunk, held FROM w SEMI JOIN (SELECT user_id, max(r) AS r FROM i GROUP BY 1) USING (user_id, r))""")
def token_packing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", (F.length("props") + F.col("value").cast("int")).alias("tokens"))
    return S.token_chunks(e, "user_id", "event_id", "tokens", 400, 80).select("user_id", "chunk_no", "tokens", F.array_join(F.transform("seqs", lambda x: x.cast("string")), ",").alias("items"))


QUERIES, SQL = query.queries, query.sql
