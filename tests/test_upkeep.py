"""Incremental graph updates, communities, probes and merges."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracewell.operators import beliefs as B
from tracewell.operators import evaluation as V
from tracewell.operators import graph as G
from tracewell.operators import models as M
from tracewell.operators import rows as R
from tracewell.operators import sessions as S
from tracewell.operators import upkeep as U
from tracewell.streaming import live

D = datetime


def test_incremental_update(spark):
    atoms = spark.createDataFrame(
        [("n1", ["Alpha", "beta ", "BETA", "ghost", None, " "], ["Ops", "what"], D(2026, 5, 2), D(2026, 5, 3)), ("n2", ["alpha", "gam"], None, D(2026, 5, 4), D(2026, 5, 5)), ("n3", None, [], None, D(2026, 5, 1))],
        "id string, entities array<string>, tags array<string>, time_last timestamp_ntz, created_at timestamp_ntz",
    )
    ents = spark.createDataFrame([("a", "alpha", None, ["o1"], D(2026, 1, 1)), ("b", "Beta", [], None, None), ("c", "gamma", ["gam", "alpha"], ["o1"], D(2026, 6, 1))], "id string, canonical_name string, aliases array<string>, atom_ids array<string>, last_seen timestamp_ntz")
    rels = spark.createDataFrame([("a", "c", 2.0, ["o1", "n2"])], "a string, b string, weight double, atom_ids array<string>")
    member = spark.createDataFrame([("a", 1), ("zz", 2)], "id string, community int")
    areas = spark.createDataFrame([("operations", ["ops"], ["o1"])], "area string, tags array<string>, atom_ids array<string>")
    got = U.incremental_update(atoms, ents, rels, member, areas, 28, spark.createDataFrame([("old",), ("ghost",)], "name string"))
    assert {(r.entity_id, tuple(r.atom_ids), r.last_seen) for r in got.entities.collect()} == {("a", ("n1", "n2", "o1"), D(2026, 5, 4)), ("b", ("n1",), D(2026, 5, 2)), ("c", ("n2", "o1"), D(2026, 6, 1))}
    assert {(r.a, r.b, r.weight, r.added, r.existed) for r in got.relations.collect()} == {("a", "b", 1.0, 1, False), ("a", "c", 2.0, 0, True)}
    assert [r.community for r in got.stale.collect()] == [1] and sorted(r.name for r in got.unresolved.collect()) == ["ghost", "old"]
    assert [tuple(r.atom_ids) for r in got.areas.collect()] == [("n1", "o1")]
    s = got.state.first()
    assert (s.cursor, s.atoms, s.since_rebuild, s.should_rebuild) == (D(2026, 5, 5), 3, 31, True)
    none = U.incremental_update(atoms.limit(0), ents, rels, member, areas, 5)
    assert none.entities.count() == none.relations.count() == none.stale.count() == 0 and not none.state.first().should_rebuild


def test_communities(spark):
    schema = "id string, summary string, embedding array<float>, stale boolean"
    old = spark.createDataFrame([("x", "was", [1.0], True), ("y", "kept", None, True)], schema)
    out = {r.id: (r.summary, r.embedding, r.stale) for r in U.upsert_communities(old, spark.createDataFrame([("x", "is", None, True), ("z", "new", [2.0], True)], schema)).collect()}
    assert out == {"x": ("is", [1.0], False), "y": ("kept", None, True), "z": ("new", [2.0], False)}
    labels = spark.createDataFrame([("1", "p"), ("2", "p"), ("3", "q"), ("4", "a")], "id string, label string")
    assert [tuple(r) for r in U.label_groups(labels).orderBy("community_no").collect()] == [("p", 2, 0), ("a", 1, 1), ("q", 1, 2)]
    tree = spark.createDataFrame([(0, 0, -1, "A"), (0, 0, -1, "B"), (0, 0, -1, "C"), (1, 1, 0, "A"), (1, 1, 0, "B"), (1, 2, 0, "C"), (1, 2, 0, "GHOST")], "level int, community int, parent int, title string")
    ents = spark.createDataFrame([("A", ["u1"]), ("B", ["u2"]), ("C", None)], "title string, text_unit_ids array<string>")
    edges = spark.createDataFrame([("A", "B", ["u9"]), ("B", "C", [])], "source string, target string, text_unit_ids array<string>")
    got = {(r.level, r.community): (r.parent, r.children, r["size"], r.relations, r.text_units) for r in U.community_table(tree, ents, edges).collect()}
    assert got == {(0, 0): (-1, [1, 2], 3, 2, 3), (1, 1): (0, [], 2, 1, 3), (1, 2): (0, [], 1, 0, 0)}
    assert {tuple(r) for r in U.leaf_communities(tree).collect()} == {("A", 1), ("B", 1), ("C", 2), ("GHOST", 2)}
    member = spark.createDataFrame([("A", 1), ("B", 1), ("C", 2)], "id string, community int")
    assert {tuple(r) for r in U.touching_edges(edges, member, "source", "target").collect()} == {(1, 2), (2, 1)}
    rel = spark.createDataFrame([("a", "b", "uses", "d1", "x", 1), ("a", "b", "uses", None, "x", 2), ("a", "b", "uses", "d2", "y", 3), (None, "b", "uses", "d", "x", 1)], "src string, dst string, relation_type string, description string, atom_id string, seq int")
    assert [(r.weight, r.description, r.atom_ids) for r in U.upsert_typed_relations(rel).collect()] == [(1.0, "d2", ["x", "y"])]


def test_probes(spark):
    rows = spark.createDataFrame([("1", "alpha met beta", ["Alpha", "beta"]), ("2", "alpha alone", ["alpha"]), ("3", "delta in text", None), ("4", None, [])], "id string, content string, names array<string>")
    ids = lambda a, b: [r.id for r in U.probe_records(rows, a, b).collect()]
    assert ids("ALPHA", "beta") == ["1"] and ids("alpha", "delta") == ["1", "2", "3"] and ids("nobody", "none") == []
    groups = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s3", "a"), ("s1", "b")], "group string, item string")
    got = U.shared_groups(spark.createDataFrame([("a", "b"), ("a", "zz")], "a string, b string"), groups)
    assert {tuple(r) for r in got.collect()} == {("a", "b", 3, 1, 1, 33.3), ("a", "zz", 3, 0, 0, 0.0)}


def shuffled(spark):
    """Records shuffled so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_shared_groups_of_a_hub(spark):
    """An item of very many groups in very many pairs; what is looked up are the groups of the others, on either side."""
    rows = spark.createDataFrame([(f"g{k}", "hub") for k in range(2000)] + [(f"g{k * j % 2500}", f"{'az'[k % 2]}{k}") for k in range(300) for j in (1, 2)], "group string, item string").distinct()
    pairs = spark.createDataFrame([tuple(sorted(("hub", f"{'az'[k % 2]}{k}"))) for k in range(300)], "a string, b string")
    before, limit = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.a, r.b): r for r in U.shared_groups(pairs, rows).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert shuffled(spark) - before < 20_000
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.item, set()).add(r.group)
    assert len(got) == 300 and all((r.groups_a, r.groups_b, r.shared) == (len(groups[a]), len(groups[b]), len(groups[a] & groups[b])) for (a, b), r in got.items())


def test_merge_by_pointer(spark):
    rng = random.Random(1)
    to = {i: None for i in range(300)}
    for i in range(1, 120):
        to[i] = i - 1 if i % 2 else rng.randrange(i)
    for i in range(120, 180):
        to[i] = i + 1 if i < 179 else 120  # a ring
    to.update({180: 150, 181: 180, 182: 999, 183: 183})

    def end(i):
        path = []
        while to[i] is not None and to[i] in to and to[i] != i:
            if i in path:
                return min(path[path.index(i) :])
            path.append(i)
            i = to[i]
        return i

    df = spark.createDataFrame([(i, t) for i, t in to.items()], "k int, t int")
    assert {r.k: r.root for r in U.merge_by_pointer(df, "k", "t").collect()} == {i: end(i) for i in to}
    assert U.merge_by_pointer(df.limit(0), "k", "t").count() == 0


def test_metrics_and_over_fetch(spark):
    before = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 2.5, "d": {"e": 3, "f": "x"}}, "g": true, "h": [1]}'), (2, "no json"), (3, None)], "k int, j string")
    after = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 4, "d": {"e": -3e1}}}')], "k int, j string")
    flat = U.flatten_metrics(before, "k", "j")
    assert {(r.name, r.value) for r in flat.collect()} == {("a", 1.0), ("b.c", 2.5), ("b.d.e", 3.0)}
    assert {(r.name, r.delta) for r in U.metric_deltas(flat, U.flatten_metrics(after, "k", "j"), "k").collect()} == {("b.c", 1.5), ("b.d.e", -33.0)}
    rows = spark.createDataFrame([(i, float(10 - i), i % 4 == 0) for i in range(10)], "id int, s double, ok boolean")
    assert [r.id for r in U.over_fetch(rows, F.col("s"), F.col("ok"), 2, "id").collect()] == [0, 4]
    assert [r.id for r in U.over_fetch(rows, F.col("s"), F.col("id") > 7, 2, "id").collect()] == []


def test_sessions_of_upkeep(spark):
    rows = spark.createDataFrame([("a", D(2026, 1, 1, 0, 0, 5), 2, "x", " "), ("a", D(2026, 1, 1), 1, "y", None), ("a", D(2026, 1, 1, 0, 0, 9), 3, "y", "go"), ("b", D(2026, 1, 1), 1, None, None)], "k string, ts timestamp_ntz, n int, v string, said string")
    got = {r.k: r for r in S.provenance(rows, ["k"], "ts", ["n"], ["v"], F.col("v") == "x", F.col("said")).collect()}
    assert got["a"].v == ["y", "x"] and (got["a"].source_count, got["a"].duration_s, got["a"].had_errors, got["a"].retry_count, got["a"].trigger) == (3, 9.0, True, 1, "go")
    assert got["b"].v == [] and not got["b"].had_errors and got["b"].trigger == ""
    talk = spark.createDataFrame([("d", 1, "user", "so it is"), ("d", 2, "assistant", "why?"), ("d", 3, "user", "how come"), ("d", 4, "assistant", "x"), ("e", 1, "user", "why")], "k string, n int, role string, t string")
    assert {tuple(r) for r in S.question_windows(talk, "k", "n", "role", "t", 2).collect()} == {("d", 1), ("d", 2)}
    sizes = spark.createDataFrame([(2, None, None), (1, True, None), (1, None, True), (1, False, None), (0, True, True)], "n int, e boolean, a boolean")
    assert [r[0] for r in sizes.select(S.significant(F.col("n"), F.col("e"), F.col("a"))).collect()] == [True, True, True, False, False]
    done = spark.createDataFrame([("a", 1)], "k string, x int").select("k")
    at = lambda t: spark.createDataFrame([(t,)], "cursor timestamp_ntz")
    assert {r.n for r in S.fresh_or_missed(rows, at(D(2026, 1, 1, 0, 0, 5)), "ts", done, "k").collect()} == {3}
    assert {r.k for r in S.fresh_or_missed(rows, at(D(2027, 1, 1)), "ts", done, "k").collect()} == {"b"}
    assert S.fresh_or_missed(rows, at(None), "ts", done, "k").count() == 4


def test_cluster_rules(spark):
    """Intent is compared with the turn before alone, and the overlap is a share of the turn's own things."""
    step = lambda intents, gap=1, things=None: [c for c in S._cluster([{"ts": D(2026, 1, 1) + timedelta(seconds=gap * i), "intent": t, "things": (things or [[]] * len(intents))[i]} for i, t in enumerate(intents)])]
    assert step(["a", "", "b"]) == [0, 0, 0]  # a turn without intent hides the change
    assert step(["a", "b"], 1, [["x"], ["y"]]) == [0, 1] and step(["x" * 60 + "1", "x" * 60 + "2"]) == [0, 0]
    many = [[f"f{k}" for k in range(9)], ["f0"]]
    assert step(["", ""], 1801, many) == [0, 0] and step(["", ""], 1801, [["f0"], ["f0", "g1", "g2", "g3"]]) == [0, 1]
    assert step(["", ""], 1800, [["a"], ["b"]]) == [0, 0] and step(["", ""], 7201, [["a"], ["a"]]) == [0, 1]
    assert step([""] * 9) == [0] * 8 + [1]


def test_token_chunks(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate([200, 150, 60, 50, 500, 10, 10])] + [("b", 0, None)], "k string, s int, t int")
    got = {(r.k, r.chunk_no): (r.seqs, r.tokens) for r in S.token_chunks(rows, "k", "s", "t", 400, 80).collect()}
    assert got == {("a", 0): ([0, 1], 350), ("a", 1): ([2, 3], 110), ("a", 2): ([4], 500), ("a", 3): ([5, 6], 20), ("b", 0): ([0], 0)}
    assert S.token_chunks(rows.limit(0), "k", "s", "t").count() == 0


def test_beliefs_of_upkeep(spark):
    forms = spark.createDataFrame(
        [("1", "claim", "all know", "global", None, 0.9, D(2026, 1, 1), "s", "p"), ("2", "rule", "here only", "project", "x", 0.8, D(2026, 1, 2), "s", "p"), ("3", "claim", "doubted", "global", None, 0.1, D(2026, 1, 3), "s", "p")],
        "id string, form_type string, content string, scope_type string, scope_id string, confidence double, extracted_at timestamp_ntz, subject string, predicate string",
    )
    status = spark.createDataFrame([("1", "stable", "current"), ("2", "active", "current"), ("3", "active", "contested")], "form_id string, status string, world_id string")
    assert B.belief_block(forms, status, slug="x").first().block == "### Known Beliefs (global stable)\n- [claim] all know [STABLE]\n\n### Project Beliefs (this slug)\n- [rule] here only\n\n### Caution (contested/rejected)\n- [!] doubted (status: active)"
    assert B.belief_block(forms, status, "know").first().block.count("- ") == 1 and B.belief_block(forms, status, "nothing").first().block == ""
    assert B.belief_block(forms, status, slug="x", chars=40).first().block.endswith("... (truncated)")
    derived = spark.createDataFrame([("lesson", ["2", None], None), ("task", ["3"], None)], "type string, source_form_ids array<string>, invalidated_at timestamp")
    assert {(r.id, r.scope_type, r.scope_id) for r in B.promote_sources(forms, derived, "x").collect()} == {("1", "global", None), ("2", "global", None), ("3", "global", None)}
    assert B.promote_sources(forms, derived, "y").filter("id = '2'").first().scope_id == "x"
    reviews = spark.createDataFrame([("n", "o", 0.7, None), ("n", "o", 0.7, None), ("m", "o", 0.6, "kept"), (None, "o", 0.9, None)], "new_id string, old_id string, score double, decided string")
    assert [(r.type, len(r.source_form_ids), r.confidence) for r in B.pending_contradictions(reviews).collect()] == [("contradiction", 2, 0.7)]
    log = spark.createDataFrame([("conflict", "derive", "1", "2")], "rule string, kind string, form_id string, other_id string")
    named = derived.select(F.lit("d").alias("derived_id"), "type", "source_form_ids")
    assert {r.part for r in B.explain("2", forms, status, named, log).collect()} == {"form", "status", "derived", "log"}
    found = spark.createDataFrame([("a", "b"), ("a", "c")], "form_a string, form_b string")
    assert [tuple(r) for r in B.new_pairs(found, spark.createDataFrame([("c", "a")], "form_a string, form_b string")).collect()] == [("a", "b")]
    B.register_module("mine", B.RULES[:1])
    assert [r.name for r in B.module_rules("mine")] == ["conflict"]
    for wrong in (lambda: B.register_module("mine", []), lambda: B.module_rules("none")):
        try:
            wrong()
            raise AssertionError("no error")
        except ValueError:
            pass
    del B.MODULES["mine"]


def test_models_of_upkeep(spark):
    assert M.json_array("see: [1, 2] and") == "[1, 2]" and M.json_array("[x] then ```[\"a]\"]```") == '["a]"]' and M.json_array(None) is None and M.json_array("[") is None
    rows = spark.createDataFrame([("a", "short"), ("b", "l" * 50), ("c", None)], "id string, t string")
    out = {r.id: r.t for r in M.synthesize_if_long(rows, "t", "Say less", 20, lambda texts: [f"{len(t)} chars" for t in texts]).collect()}
    assert out == {"a": "short", "b": f"{len('Say less') + 2 + 4 + 50 + 4} chars", "c": None}
    assert M.synthesize_if_long(rows, "t", "", 0, None) is rows
    forms = spark.createDataFrame([("1", "claim", "", "redis", "cache"), ("2", "rule", "always backup volumes nightly carefully", None, None), ("3", "claim", "x", None, None)], "id string, form_type string, content string, subject string, object string")
    got = {(r.form_id, r.pattern, r.denies) for r in M.build_probes(forms).collect()}
    assert {("1", "redis", False), ("1", "cache", False), ("1", "replaced redis", True), ("2", "backup", False), ("2", "volumes", False)} <= got and not any(f == "3" for f, *_ in got) and ("2", "nightly", False) not in got
    files = spark.createDataFrame([("f", "we REPLACED Redis"), ("g", "the cache")], "file string, text string")
    assert {(r.form_id, r.outcome) for r in M.probe_texts(files, M.build_probes(forms)).collect()} == {("1", "confirmed"), ("2", "inconclusive")}
    a, b = spark.range(1).select(*M.prior_of(F.lit(0.75))).first()
    assert (a, b) == (6.0, 2.0)
    figures = spark.createDataFrame([(2, 0.5), (1, 0.5), (3, 0.1)], "p int, f1 double")
    assert V.best_point(figures, ["p"]).first().p == 1


def test_batches_over_a_whole_order(spark):
    rows = spark.range(1000).withColumn("x", F.xxhash64("id"))
    got = {r.id: r.batch_no for r in G.batched(rows, ["x", "id"], 30).collect()}
    order = [r.id for r in rows.orderBy("x", "id").collect()]
    assert all(got[i] == k // 30 for k, i in enumerate(order))


def test_decay_by_batch_and_chain(spark, tmp_path):
    held = [spark.createDataFrame([("e", "a", "b", 1.0), ("f", "c", "d", 1.0)], "id string, src string, dst string, weight double")]
    src = str(tmp_path / "in")
    for k, who in enumerate(["a", "c"]):
        spark.createDataFrame([(who,)], "entity_id string").coalesce(1).write.mode("append").parquet(src)
        live.decay_per_batch(spark.readStream.schema("entity_id string").parquet(src), str(tmp_path / "c"), lambda: held[-1], lambda df: held.append(df.checkpoint()), "weight > 0").awaitTermination(120)
    assert {(r.id, round(r.weight, 6)) for r in held[-1].collect()} == {("e", 0.97), ("f", 0.97)} and len(held) == 3
    seen = []
    assert live.run_chain([("one", lambda: seen.append(1)), ("two", lambda: 1 / 0), ("three", lambda: seen.append(3))]) == [("one", "ok"), ("two", "failed: division by zero"), ("three", "not run")] and seen == [1]


def test_expire(spark):
    rows = spark.createDataFrame([("1", "a", None), ("2", "a", D(2026, 1, 1)), ("3", "b", None)], "id string, k string, until timestamp_ntz")
    ends = spark.createDataFrame([("a", D(2026, 3, 1)), ("a", D(2026, 2, 1))], "k string, at timestamp_ntz")
    assert {(r.id, r.until) for r in R.expire(rows, ends, ["k"], "until").collect()} == {("1", D(2026, 2, 1)), ("2", D(2026, 1, 1)), ("3", None)}


def test_trace_hops(spark):
    ents = spark.createDataFrame([(0, ["t1"]), (0, ["t2", "lost"]), (1, ["t3"]), (2, None), (None, ["t1"])], "community int, text_unit_ids array<string>")
    units = spark.createDataFrame([("t1", ["d1"], None), ("t2", None, "d2"), ("t3", [], "chunk-c3")], "id string, document_ids array<string>, document_id string")
    docs = spark.createDataFrame([("d1", "chunk-c1.txt"), ("d2", "chunk-c2.txt"), ("chunk-c3", "other")], "id string, title string")
    meta = spark.createDataFrame([("c1", ["sA"], D(2026, 3, 1)), ("c2", ["sB", "sA"], D(2026, 3, 22)), ("c3", ["sC"], D(2026, 3, 2))], "chunk_id string, session_ids array<string>, first_timestamp timestamp_ntz")
    got = {r.community: (r.chunks, r.sessions, r.week_span) for r in U.trace_hops(ents, units, docs, meta).collect()}
    assert got == {0: (2, 2, 4), 1: (1, 1, 1), 2: (0, 0, 0)}
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("z", [0.0, 0.0])], "id string, vec array<double>")
    to = spark.createDataFrame([("q", [2.0, 0.1]), ("p", [2.0, 0.1]), ("r", [0.0, 1.0])], "target string, vec array<double>")
    assert {(r.id, r.target) for r in U.nearest_above(v, to, 0.9).collect()} == {("a", "p")}
    talk = spark.createDataFrame([("s", 1, "user", "ask", False), ("s", 2, "assistant", "a1", False), ("s", 3, "user", "result of a tool", True), ("s", 4, "assistant", "a2", None)], "k string, n int, role string, t string, skip boolean")
    assert [(r.user_text, r.response, r.blocks) for r in S.assemble_turns(talk, "k", "n", "role", "t", F.col("skip")).collect()] == [("ask", "a1\na2", 2)]


def test_calls_keep_their_rows(spark):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(20)] + [(20, None)], "id int, t string").repartition(4)
    out = {r.id: r.up for r in G.map_text(rows, "t", "up", lambda texts: [t.upper() for t in texts]).collect()}
    assert out == {k: f"T{k}" for k in range(20)} | {20: ""}
    batches = M.call_in_batches(rows.withColumn("g", F.lit("x")), ["g"], ["id"], "t", 8, lambda texts: [f"{len(texts)}:{t}" for t in texts]).collect()
    assert {(r.id // 8, r.batch_no) for r in batches} == {(0, 0), (1, 1), (2, 2)} and {r.answer.split(":")[0] for r in batches if r.id >= 16} == {"5"}
    answers = spark.createDataFrame([("x {\"a\": {\"b\": 1}} y",), ("none",), (None,)], "t string")
    assert [r.json for r in M.json_answers(answers, "t").collect()] == ['{"a": {"b": 1}}', None, None]
    assert spark.range(1).select(M.dry_refine(F.lit("x" * 300))).first()[0] == "x" * 200
