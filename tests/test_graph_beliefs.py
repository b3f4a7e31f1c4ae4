"""Graph, belief, evaluation and orphan operators."""

import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.functions.times import parse_time, week_span
from tracewell.functions.vectors import cosine, usable
from tracewell.operators import beliefs as B
from tracewell.operators import evaluation as V
from tracewell.operators import graph as G
from tracewell.operators.orphans import OrphanLedger, findings, parent_rows, reference_rows, snapshots, track
from tracewell.plans.memory import leader_clusters
from tracewell.streaming.live import track_orphans

D = datetime


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first()["x"]


def test_resolution_prefers_names(spark):
    e = spark.createDataFrame([("1", "alpha", ["beta", None, " "]), ("2", "Beta", None), ("3", "gamma", ["ALPHA  x"])], "id string, canonical_name string, aliases array<string>")
    m = spark.createDataFrame([("m", ["BETA", "alpha x", "nobody", None, ""])], "k string, names array<string>")
    assert {tuple(r) for r in G.resolve(m, "k", "names", e).collect()} == {("m", "2"), ("m", "3")}


def test_pair_counts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "PAIR_BLOCK", 3)
    rows = [("g", f"i{k}") for k in range(11)] + [("h", "i1"), ("h", "i2")]
    got = {(r.a, r.b): r.n for r in G.pair_counts(spark.createDataFrame(rows, "grp string, itm string"), "grp", "itm").collect()}
    assert len(got) == 55 and got["i1", "i2"] == 2 and got["i3", "i4"] == 1


def test_reinforce_and_decay(spark):
    edges = spark.createDataFrame([("a", "b", 5.0), ("c", "d", 19.9), ("e", "f", 30.0)], "a string, b string, weight double")
    pairs = spark.createDataFrame([("a", "b", 1), ("c", "d", 1), ("e", "f", 1), ("x", "y", 2)], "a string, b string, n int")
    assert {(r.a, round(r.weight, 6), r.existed) for r in G.reinforce(edges, pairs).collect()} == {("a", 5.3, True), ("c", 20.0, True), ("e", 30.0, True), ("x", 0.6, False)}
    e = spark.createDataFrame([("a", "b", "related_to", "hebbian", 5.0), ("c", "d", "related_to", "hebbian", 4.0), ("c", "e", "related_to", "hebbian", 0.0099), ("c", "f", "related_to", "co-occurrence", 7.0), ("c", "g", "uses", None, 1.0)], "s string, t string, relation_type string, description string, weight double")
    rule = "relation_type = 'related_to' and description = 'hebbian'"
    fired = spark.createDataFrame([("a",)], "entity_id string")
    assert sorted((r.t, round(r.weight, 6)) for r in G.decay(e, fired, "s", "t", rule).collect()) == [("b", 5.0), ("d", 3.88), ("f", 7.0), ("g", 1.0)]
    assert sorted((r.t, round(r.weight, 6)) for r in G.decay(e, fired.limit(0), "s", "t", rule).collect()) == [("b", 4.85), ("d", 3.88), ("f", 7.0), ("g", 1.0)]


@pytest.mark.parametrize("run", [G.label_propagation])
def test_two_cliques(spark, run):
    a, b = [f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]
    edges = [(x, y, 1.0) for c in (a, b) for i, x in enumerate(c) for y in c[:i]] + [("a0", "b0", 0.1), ("a0", "ghost", 9.0)]
    nodes = spark.createDataFrame([(x,) for x in [*a, *b, "alone"]], "id string")
    label = {r.id: r.label for r in run(nodes, spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    assert len({label[x] for x in a}) == len({label[x] for x in b}) == 1 and label["a1"] != label["b1"] and label["alone"] == "alone"


@pytest.mark.parametrize("size", [16, 2048])
def test_leaders_of_the_whole_table(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(G, "LEADER_ROWS", size)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 6))[rng.integers(0, 12, 150)] + rng.normal(scale=0.6, size=(150, 6))
    rows = [(k, k % 3, v.tolist()) for k, v in enumerate(x)] + [(150, 0, [0.0] * 6), (151, 0, None), (152, 1, x[0].tolist() + [0.0]), (153, 1, x[1].tolist() + [None])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    leaders, want = [], {}
    for k, _, v in rows:
        u = np.array(v if v is not None else [0.0], float)
        u = u / np.linalg.norm(u) if np.linalg.norm(u) > 0 else None
        hit = next((n for n, w in leaders if u is not None and u.shape == w.shape and u @ w >= 0.5), None)
        if hit is None and u is not None:
            leaders.append((str(k), u))
        want[str(k)] = hit or str(k)
    got = leader_clusters(spark, str(tmp_path)).collect()
    assert {r.id: r.leader for r in got} == want and len(got) == len(rows)


def test_leaders_and_bridges(spark):
    v = spark.createDataFrame([("a", 1, [1.0, 0.0], "k"), ("b", 2, [0.9, 0.1], "k"), ("c", 3, [0.0, 1.0], "k"), ("z", 4, [0.0, 0.0], "k"), ("n", 5, None, "k")], "id string, seq int, vec array<double>, blk string")
    assert {r.id: r.leader for r in G.leader_clusters(v, "blk").collect()} == {"a": "a", "b": "a", "c": "c", "z": "z", "n": "n"}
    c = spark.createDataFrame([("1", ["x"], [1.0, 0.0]), ("2", ["y"], [1.0, 0.1]), ("3", ["x"], [1.0, 0.0]), ("4", [], [1.0, 0.0]), ("5", ["w"], [0.0, 0.0])], "id string, areas array<string>, vec array<double>")
    assert {(r.a, r.b) for r in G.bridges(c).collect()} == {("1", "2"), ("2", "3")}


def test_graph_tuples(spark):
    text = '("entity"<|>alice<|>person<|>a dev)##("entity"<|>ACME<|>org<|>firm)##("relationship"<|>alice<|>acme<|>works at<|>7)##("relationship"<|>a<|>b<|>c<|>heavy)##("entity"<|>x)<|COMPLETE|>'
    ents, rels = G.parse_graph_tuples(spark.createDataFrame([("u", text), ("v", ""), ("w", None)], "s string, t string"), "s", "t")
    assert [(r.title, r.type) for r in ents.orderBy("seq").collect()] == [("ALICE", "PERSON"), ("ACME", "ORG")]
    assert [(r.source, r.weight) for r in rels.orderBy("seq").collect()] == [("ALICE", 7.0), ("A", 1.0)]
    raw = spark.createDataFrame([("ALICE", "P", "a dev", "u", 1), ("ALICE", "Q", "dev", "v", 2), ("ALICE", "Q", "lead", "v", 3)], "title string, type string, description string, source_id string, seq int")
    r = G.dedupe_entities(raw).first()
    assert (r.type, r.description, r.frequency, r.source_ids) == ("P", "a dev; lead", 3, ["u", "v"])


FORMS = "id string, form_type string, content string, subject string, predicate string, object string, source_unit_id string, source_unit_ids array<string>, entity_ids array<string>, confidence double, extracted_at timestamp_ntz, superseded_by string"


def form(i, kind="claim", content="", s=None, p=None, o=None, unit=None, units=(), things=(), c=0.5, day=1):
    return (i, kind, content, s, p, o, unit, list(units), list(things), c, D(2026, 1, day), None)


def test_conflicts_and_supersession(spark):
    f = spark.createDataFrame([form("1", s="X", p="is", o="red"), form("2", s=" x", p="IS", o="blue", day=2), form("3", s="x", p="is", o="Blue ", day=3), form("4", s=None, p="is", o="a"), form("5", s="y", p="is", o="a")], FORMS)
    assert [(r.form_a, r.form_b) for r in B.conflict_pairs(f).collect()] == [("1", "2")]
    assert {(r.form_id, r.superseded_by) for r in B.supersession(f).collect()} == {("1", "3"), ("2", "3")}


def test_promotion_and_lessons(spark):
    f = spark.createDataFrame([form("1", unit="a", units=["a", "b"]), form("2", unit="a", units=["b", "c"], c=0.95), form("3", unit="a", units=["b", "c"]), form("w", "warning", "deploys FAIL often", things=["Db"]), form("d", "decision", "use db", things=["db ", "x"]), form("e", "decision", "use y", things=["y"])], FORMS)
    status = spark.createDataFrame([("3", "stable")], "form_id string, status string")
    assert [(r.form_id, r.confidence) for r in B.stable_promotions(f, status).collect()] == [("2", 1.0)]
    assert [(r.warning_id, r.decision_id, r.shared) for r in B.lessons(f).collect()] == [("w", "d", 1)]


def test_rules_reach_a_fixed_point(spark):
    f = spark.createDataFrame([form("1", s="x", p="is", o="red"), form("2", s="x", p="is", o="blue", day=2), form("3", unit="a", units=["b", "c"])], FORMS)
    forms, status, log = B.run_rules(f, spark.createDataFrame([], "form_id string, status string"))
    assert {(r["pass"], r.rule) for r in log.collect()} == {(1, "conflict"), (1, "supersession"), (1, "stable")}
    assert {r.id: r.superseded_by for r in forms.collect()}["1"] == "2" and [r.form_id for r in status.collect()] == ["3"]


def test_scores_match_brute_force(spark):
    f = spark.createDataFrame([form("1", content="the cache of alpha was moved"), form("2", content="a of the"), form("3", "rule", "never restart alpha")], FORMS)
    a = spark.createDataFrame([("a", "alpha cache moved", None, "decision"), ("b", "nothing here", None, "decision"), ("c", None, None, "decision"), ("d", "the rule was violated and the outcome was still good", None, "decision")], "id string, content string, topic string, atom_type string")
    assert {(r.form_id, r.atom_id, round(r.score, 3)) for r in B.keyword_scores(f, a).collect()} == {("1", "a", 1.0)}
    got = {(r.form_id, r.atom_id): r.score for r in B.condition_scores(f, a).collect()}
    assert got["3", "d"] == 1.0
    assert {(r.form_id, r.atom_id, r.outcome) for r in B.passive_outcomes(f, a).collect()} >= {("1", "a", "confirmed")}


ATOMS = "id string, content string, topic string, atom_type string"


def crowd():
    """Forms and atoms over few words, with frequent and rare ones, repeats, blanks and nulls."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    say = lambda n: " ".join(words[min(int(rng.expovariate(0.12)), 39)] for _ in range(n))
    kinds = ["claim", "rule", "decision", "warning", "plan", "preference", "event"]
    forms = [form(f"f{i:03}", kinds[i % 7], say(rng.randint(0, 9)), *((say(1), say(2), say(2)) if i % 2 else (None, "", None))) for i in range(300)]
    stock = "evidence that the rule was violated and the outcome was still good caused a problem risk mitigated reverted".split()
    atoms = [(f"a{i:03}", None if i % 50 == 0 else say(rng.randint(0, 12)) + " " + " ".join(rng.sample(stock, i % 6)), None, "decision") for i in range(400)]
    return forms, atoms


def scored_by_hand(spark, forms, atoms):
    """(form, atom) -> share of words, and best share of a condition's words."""
    conditions = X.disconfirmation_conditions(*[F.col(c) for c in ("form_type", "content", "subject", "predicate", "object")])
    con, dis = {}, {}
    texts = {r.id: (r.t, r.c) for r in forms.select("id", F.concat_ws(" ", "content", "subject", "predicate", "object").alias("t"), conditions.alias("c")).collect()}
    cut = lambda t: re.findall("[0-9a-z_]+", t.lower())
    has = {r.id: set(cut(r.content or "")) for r in atoms.collect()}
    for f, (t, c) in texts.items():
        own = {w for w in cut(t) if w not in X.CONFIRM_STOPWORDS}
        lists = [kw for x in c if (kw := [w for w in cut(x) if w not in X.CONDITION_STOPWORDS and len(w) > 2])]
        for a, words in has.items():
            con[f, a] = len(own & words) / len(own) if own else 0.0
            dis[f, a] = max((len(set(kw) & words) / len(kw) for kw in lists), default=0.0)
    return con, dis


def small_blocks(monkeypatch):
    for name, size in (("FORM_BLOCK", 100), ("ATOM_BLOCK", 150), ("LINES", 70), ("CELLS", 5000)):
        monkeypatch.setattr(B, name, size, raising=False)


def moves_no_pairs(df):
    """Nothing is shuffled, joined or grouped after forms and atoms have met."""
    above = df._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    return not any(w in above for w in ("Join", "Aggregate", "Repartition"))


def test_keyword_scores_move_no_pairs(spark, monkeypatch):
    small_blocks(monkeypatch)
    forms, atoms = crowd()
    f, a = spark.createDataFrame(forms, FORMS), spark.createDataFrame(atoms, ATOMS)
    con, _ = scored_by_hand(spark, f, a)
    got = B.keyword_scores(f, a, 0.4)
    rows = got.collect()
    assert {(r.form_id, r.atom_id): r.score for r in rows} == {k: v for k, v in con.items() if v >= 0.4} and len(rows) == len({(r.form_id, r.atom_id) for r in rows}) > 1000
    assert {r.score for r in B.keyword_scores(f, a, 0.4, digits=2).collect()} == {round(r.score * 100 + 1e-9) / 100 for r in rows}
    assert B.keyword_scores(f.limit(0), a).count() == B.keyword_scores(f, a.limit(0)).count() == 0
    assert moves_no_pairs(got)


def test_condition_scores_move_no_pairs(spark, monkeypatch):
    small_blocks(monkeypatch)
    forms, atoms = crowd()
    f, a = spark.createDataFrame(forms, FORMS), spark.createDataFrame(atoms, ATOMS)
    _, dis = scored_by_hand(spark, f, a)
    got = B.condition_scores(f, a, 0.3)
    rows = got.collect()
    assert {(r.form_id, r.atom_id): r.score for r in rows} == {k: v for k, v in dis.items() if v >= 0.3} and len(rows) == len({(r.form_id, r.atom_id) for r in rows}) > 1000
    assert moves_no_pairs(got)


def test_passive_outcomes_move_no_pairs(spark, monkeypatch):
    small_blocks(monkeypatch)
    forms, atoms = crowd()
    f, a = spark.createDataFrame(forms, FORMS), spark.createDataFrame(atoms, ATOMS)
    useful = a.filter(X.memory_class(F.col("content"), F.col("topic"), F.col("atom_type")) != "episodic")
    con, dis = scored_by_hand(spark, f, useful)
    want = {}
    for k in con:
        c, d = con[k] if con[k] >= 0.3 else 0.0, dis[k] if dis[k] >= 0.3 else 0.0
        if kind := "disconfirmed" if d >= 0.5 and d > c else "confirmed" if c >= 0.4 else "inconclusive" if d >= 0.3 else None:
            want[k] = (c, d, kind)
    got = B.passive_outcomes(f, a)
    assert {(r.form_id, r.atom_id): (r.confirm, r.against, r.outcome) for r in got.collect()} == want and len({v[2] for v in want.values()}) == 3
    assert moves_no_pairs(got)


def test_blocks_are_not_copied_for_each_other(spark, monkeypatch):
    """Each form and atom is shuffled once at most, however many blocks the other side has."""
    forms, atoms = crowd()
    f, a = spark.createDataFrame(forms, FORMS), spark.createDataFrame(atoms, ATOMS)

    def shuffled(get):
        run = get(f, a)
        run.write.format("noop").mode("overwrite").save()
        run.collect()
        text, total = run._jdf.queryExecution().executedPlan(), 0
        todo = [text]
        while todo:
            node = todo.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                todo.append(node.executedPlan())
            elif "QueryStage" in node.nodeName():
                todo.append(node.plan())
            else:
                if node.nodeName() == "Exchange":
                    total += node.metrics().apply("shuffleRecordsWritten").value()
                kids = node.children()
                todo += [kids.apply(k) for k in range(kids.size())]
        return total

    for get in (B.keyword_scores, B.passive_outcomes):
        small_blocks(monkeypatch)
        assert 0 < shuffled(get) <= len(forms) + len(atoms)
        monkeypatch.setattr(B, "TASKS", 3)
        few = {tuple(r) for r in get(f, a).collect()}
        monkeypatch.undo()
        assert few == {tuple(r) for r in get(f, a).collect()}


def test_beta_path_and_repair(spark):
    t = spark.createDataFrame([("f", 1, "confirmed"), ("f", 2, "inconclusive"), ("g", 1, "disconfirmed")], "f string, n int, outcome string")
    assert [round(r.confidence, 4) for r in B.beta_path(t, "f", ["n"], "outcome").orderBy("f", "n").collect()] == [0.6667, 0.6667, 0.3333]
    r = B.repair(F.lit(1.0), F.lit(6.0), F.lit("claim")), B.repair(F.lit(1.0), F.lit(2.0), F.lit("plan")), B.repair(F.lit(1.0), F.lit(2.0), F.lit("claim"))
    assert tuple(spark.range(1).select(*r).first()) == ("retire", "historicize", None)


def test_evaluation(spark):
    p = spark.createDataFrame([(True, True), (False, True), (True, False), (False, False), (None, True)], "a boolean, p boolean")
    r = V.confusion(p, F.col("a"), F.col("p")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.f1) == (1, 2, 1, 1, 0.3333, 0.5, 0.4)
    assert V.confusion(p.limit(0), F.col("a"), F.col("p")).first().f1 == 0.0
    t = spark.createDataFrame([(1, "A b b", "b a B"), (2, "x", "y"), (3, "", None), (4, "a b", "a")], "i int, x string, y string")
    assert [round(r.f1, 4) for r in V.token_f1(t, ["i"], "x", "y").orderBy("i").collect()] == [1.0, 0.0, 0.0, 0.6667]
    s = spark.range(1).select(V.candidate_score(F.lit(10), F.lit(40), F.lit(5), F.lit(8)).alias("s"), V.gate(F.lit(0.65), F.lit(2), F.lit(2)).alias("g"), V.gate(F.lit(0.65), F.lit(1), F.lit(2)).alias("h")).first()
    assert abs(s.s - 0.9) < 1e-9 and s.g and not s.h


def test_scalars(spark):
    assert [one(spark, X.estimate_tokens(F.col("t")), t=("string", v)) for v in ("", None, "x" * 11, "x" * 1600)] == [0, 0, 3, 400]
    assert one(spark, X.name_form(F.col("t")), t=("string", "  A  \tb ")) == "a b" and one(spark, X.ref_key(F.col("t")), t=("string", "  ")) is None
    kinds = [("Deployed it yesterday", "outcome"), ("Always restart", "pattern"), ("a fact", "decision"), ("x", "failure"), ("ran it", "gotcha"), (None, None)]
    assert [one(spark, X.memory_class(F.col("c"), F.lit(None).cast("string"), F.col("k")), c=("string", c), k=("string", k)) for c, k in kinds] == ["episodic", "procedural", "semantic", "episodic", "episodic", "semantic"]
    assert one(spark, X.section(F.col("t"), "Next"), t=("string", "# a\n## Now\nx\n## Next\ny\nz\n## End\n")) == "y\nz"
    assert one(spark, X.labelled_line(F.col("t"), "Goal"), t=("string", "a\nGoal:  win \nb")) == "win"
    assert one(spark, X.commit_message(F.col("t")), t=("string", 'git commit -m "Fix it"')) == "Fix it"
    assert one(spark, X.commit_message(F.col("t")), t=("string", "git commit -m \"$(cat <<'EOF'\nPay $5\nEOF\n)\"")) == "Pay $5" and one(spark, X.commit_message(F.col("t")), t=("string", 'git commit -m "Cost $5"')) == "Cost $5"
    assert tuple(one(spark, X.commit_flags(F.col("t")), t=("string", "git commit --amend"))) == (True, False, False)
    wrapped = "<command-name>/go</command-name>\n<command-message>go</command-message> <command-args> a b </command-args>"
    assert one(spark, X.rewrite_command(F.col("t")), t=("string", wrapped)) == "/go a b" and one(spark, X.rewrite_command(F.col("t")), t=("string", " hi ")) == "hi"
    assert [one(spark, X.asks(F.col("t")), t=("string", v)) for v in ("HOW does it", "it ends", None)] == [True, False, False]
    assert [one(spark, X.meaningful(F.col("t")), t=("string", v)) for v in (" Unknown ", "short text", "long enough text", None)] == [False, False, True, False]
    assert one(spark, X.loads_or_empty(F.col("t")), t=("string", '["a", "b", "a"]')) == ["a", "b"] and one(spark, X.loads_or_empty(F.col("t")), t=("string", "no")) == []
    assert one(spark, X.probe_keywords(F.col("t")), t=("string", "Chose Redis and redis for the 2nd cache_key")) == ["Redis", "cache_key"]
    assert one(spark, X.short_hash(F.col("t")), t=("string", "x")) == "11f6ad8ec52a2984" and one(spark, X.has_transcript_error(F.col("t")), t=("string", "Exit code 1"))
    assert [one(spark, X.valid_pair(F.col("q"), F.lit("right"), F.lit("s")), q=("string", v)) for v in ("a question", " short  q ", None)] == [True, False, False]
    assert one(spark, X.strip_ansi(F.col("t")), t=("string", "\x1b[31mred\x1b[0m")) == "red"
    assert one(spark, X.strip_tags(F.col("t"), ["sys"]), t=("string", "a<sys>b\nc</sys>d")) == "ad"
    assert one(spark, X.file_paths(F.col("t")), t=("array<string>", ['{"file_path": "/a/b"}', "no json", '{"command": "ls"}'])) == ["/a/b"]
    assert one(spark, week_span(F.col("a"), F.col("b")), a=("timestamp_ntz", D(2026, 3, 1)), b=("timestamp_ntz", D(2026, 3, 22))) == 4
    assert one(spark, parse_time(F.col("t"), "2000-01-01"), t=("string", "nonsense")) == D(2000, 1, 1)
    assert one(spark, cosine(F.col("a"), F.col("b")), a=("array<float>", [0.0, 0.0]), b=("array<float>", [1.0, 0.0])) == 0.0
    assert one(spark, usable(F.col("a"), 2), a=("array<float>", None)) is False


def _refs(spark, rows):
    return reference_rows("p", "t.ref", spark.createDataFrame(rows, "record_id string, ref string, at timestamp_ntz"), "ref", "record_id", "at")


def _parents(spark, rows):
    return parent_rows("p", spark.createDataFrame(rows, "id string, created timestamp_ntz"), "id", "created")


def test_orphans(spark):
    parents = _parents(spark, [("P1 ", D(2026, 1, 5)), ("p1", D(2026, 1, 3)), ("p2", D(2026, 2, 1)), (None, D(2026, 1, 1)), ("p3", None)])
    rows = [("r1", " P1", D(2026, 1, 4)), ("r2", "p2", D(2026, 1, 4)), ("r3", "gone", D(2026, 3, 4)), ("r3", "gone", D(2026, 3, 4)), ("r4", " ", D(2026, 1, 1)), ("r5", None, D(2026, 1, 1)), ("r6", "p3", D(2026, 1, 1)), ("r7", "p2", None), ("r8", "gone", None)]
    ledger, history = track(parents, _refs(spark, rows), lambda at: F.coalesce(F.date_format(at, "yyyyMM").cast("int"), F.lit(0)))
    got = {tuple(r) for r in findings(ledger.waiting()).collect()}
    assert got == {("t", "ref", "r2", "late", "2026-01"), ("t", "ref", "r3", "missing", "2026-03"), ("t", "ref", "r8", "missing", None)}
    counts = {(r.as_of, r.kind): r.n for r in snapshots(history).collect()}
    assert counts == {(0, "missing"): 2, (202601, "missing"): 3, (202602, "missing"): 1, (202602, "late"): 1, (202603, "missing"): 2, (202603, "late"): 1}
    ledger, history = track(parents.limit(0), _refs(spark, rows).limit(0))
    assert history == [] and snapshots(history) is None


def test_orphan_state_over_batches(spark):
    refs, none = _refs(spark, [("r1", "a", D(2026, 1, 1)), ("r2", "b", D(2026, 1, 1)), ("r3", "c", D(2026, 1, 1))]), _parents(spark, [])
    ledger = OrphanLedger()
    state = lambda: {(r.record_id, r.kind) for r in ledger.waiting().collect()}
    ledger.apply(refs, none)
    assert state() == {("r1", "missing"), ("r2", "missing"), ("r3", "missing")}
    changed = ledger.apply(refs.limit(0), _parents(spark, [("a", D(2026, 2, 1)), ("b", D(2025, 1, 1))]))
    assert {(r.record_id, r.kind) for r in changed.collect()} == {("r1", "late"), ("r2", None)} and state() == {("r1", "late"), ("r3", "missing")}
    gone = lambda *k: spark.createDataFrame([("p", x) for x in k], "scope string, key string")
    ledger.apply(refs.limit(0), none, gone("b"))
    assert state() == {("r1", "late"), ("r2", "missing"), ("r3", "missing")}
    # deleted and delivered again in one batch: there afterwards, by its new time
    ledger.apply(refs.limit(0), _parents(spark, [("a", D(2025, 6, 1)), ("b", D(2026, 5, 1))]), gone("a", "b"))
    assert state() == {("r2", "late"), ("r3", "missing")}
    for _ in range(8):  # over a fold of the logs
        ledger.apply(refs, none)
    assert state() == {("r2", "late"), ("r3", "missing")} and len(ledger.parents) < 8
    ledger.apply(refs.limit(0), none, gone("b", "nothing"))
    assert state() == {("r2", "missing"), ("r3", "missing")}


def test_orphan_batches_equal_one_pass(spark):
    rng = random.Random(3)
    day = lambda: D(2026, rng.randrange(1, 7), rng.randrange(1, 28))
    parents = [(f"k{rng.randrange(40)}", day()) for _ in range(60)]
    refs = [(f"r{i}", "k0" if i % 3 == 0 else f"k{rng.randrange(60)}", day()) for i in range(300)]
    first = {}
    for k, t in parents:
        first[k] = min(t, first.get(k, t))
    want = {(r, "missing" if k not in first else "late") for r, k, t in refs if k not in first or first[k] > t}
    ledger, _ = track(_parents(spark, parents), _refs(spark, refs))
    assert {(r.record_id, r.kind) for r in ledger.waiting().collect()} == want


def test_orphans_from_a_stream(spark, tmp_path):
    schema = "what string, scope string, key string, source string, record_id string, at timestamp"
    write = lambda *rows: spark.createDataFrame(list(rows), schema).write.mode("append").parquet(str(tmp_path / "in"))
    ledger = OrphanLedger()
    write(("ref", "p", "a", "t.ref", "r1", D(2026, 1, 1)), ("ref", "p", "b", "t.ref", "r2", D(2026, 1, 1)))
    for more in ([("parent", "p", "a", None, None, D(2025, 1, 1))], [("delete", "p", "a", None, None, D(2026, 2, 1))]):
        track_orphans(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "c"), ledger).awaitTermination(120)
        write(*more)
    assert {r.record_id for r in ledger.waiting().collect()} == {"r2"}
    track_orphans(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "c"), ledger).awaitTermination(120)
    assert {r.record_id for r in ledger.waiting().collect()} == {"r1", "r2"}
