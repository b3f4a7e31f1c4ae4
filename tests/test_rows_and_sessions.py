"""Row and session operators on small fixtures with nulls, ties, repeats and empty tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.operators import rows as R
from tracewell.operators import sessions as S
from tracewell.plans.memory import turn_clusters

T0 = datetime(2026, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def events(spark, rows, extra=""):
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long" + extra)


def test_current_takes_the_last_version(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), ("b", 0, "w")], "id string, v int, s string")
    assert {(r.id, r.s) for r in R.current(df, ["id"], ["v"]).collect()} == {("a", "y"), ("b", "w")}
    assert R.current(df.limit(0), ["id"], ["v"]).count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, R.insert_missing(old, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, R.replace_rows(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    flagged = R.set_flag(spark.createDataFrame([(1, None), (2, "old")], "id int, gone string"), spark.createDataFrame([(1, "x"), (2, "y")], "id int, value string"), "id", "gone")
    assert sorted(map(tuple, flagged.collect())) == [(1, "x"), (2, "old")]


def test_merge_entities(spark):
    schema = "canonical_name string, entity_type string, aliases array<string>, atom_ids array<string>, description string, embedding array<float>, first_seen int, last_seen int, seq int"
    old = spark.createDataFrame([("a", "tool", ["x"], ["1", "2"], "d", None, 5, 6, 1)], schema)
    new = spark.createDataFrame([("a", "service", None, ["2", "3"], None, [1.0], 1, 9, 2), ("b", "tool", [], None, None, None, 3, 3, 3)], schema)
    got = {r.canonical_name: r for r in R.merge_entities(old, new).collect()}
    a = got["a"]
    assert (a.entity_type, a.first_seen, a.last_seen, a.description, a.embedding, sorted(a.atom_ids), a.atom_count) == ("service", 5, 9, "d", [1.0], ["1", "2", "3"], 3)
    assert got["b"].atom_count == 0


def test_closure_chain_diamond_ring(spark):
    e = spark.createDataFrame([("f", "d1"), ("d1", "d2"), ("f", "d2"), ("x", "y"), ("d2", "f"), (None, "z"), ("d2", None)], "s string, t string")
    got = {(r.node, r.depth) for r in R.closure(e, spark.createDataFrame([("f",)], "s string"), "s", "t").collect()}
    assert got == {("d1", 1), ("d2", 1), ("f", 2)}
    assert R.closure(e, spark.createDataFrame([("q",)], "s string"), "s", "t").count() == 0


def test_fallback_and_holdout(spark):
    a = spark.createDataFrame([], "id string, n int")
    b = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "id string, n int")
    assert [r.id for r in R.fallback([a, b], 2, [F.desc("n")]).collect()] == ["z", "y"]
    twenty = spark.createDataFrame([(f"s{i}", j) for i in range(20) for j in range(2)], "s string, j int")
    held = R.split_holdout(twenty, "s", 0.25, 7).filter("holdout").select("s").distinct().collect()
    assert len(held) == 5 and held.sort() == R.split_holdout(twenty, "s", 0.25, 7).filter("holdout").select("s").distinct().collect().sort()


def test_gap_of_exactly_the_limit_stays(spark):
    df = events(spark, [("a", at(0), 1), ("a", at(1800), 2), ("a", at(3601), 3), ("b", at(0), 4), (None, at(0), 5), ("b", None, 6)])
    got = {r.id: r.session_no for r in S.gap_sessions(df, "k", "ts", ["id"]).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}


def test_windows_and_exchanges(spark):
    df = events(spark, [("a", at(i), i) for i in range(4)] + [("b", at(0), 9)])
    assert sorted(r["values"] for r in S.sliding_windows(df, "k", ["ts", "id"], "id", 3).collect()) == [[0, 1, 2], [1, 2, 3]]
    talk = spark.createDataFrame([("s", 1, "user", "u1"), ("s", 2, "user", "u2"), ("s", 3, "assistant", "a1"), ("s", 4, "system", "x"), ("s", 5, "assistant", "a2"), ("t", 1, "assistant", "a")], "k string, seq int, role string, text string")
    assert [tuple(r) for r in S.exchanges(talk, "k", "seq", "role", "text").collect()] == [("s", 2, "u2", "a1")]
    turns = {(r.turn_n, r.user_text, r.response, r.blocks) for r in S.assemble_turns(talk, "k", "seq", "role", "text").collect()}
    assert turns == {(1, "u1", "", 0), (2, "u2", "a1\na2", 2)}


def test_budget_is_a_prefix(spark):
    df = spark.createDataFrame([("a", 1, "xxxx"), ("a", 2, None), ("a", 3, "y" * 50), ("a", 4, "z")], "k string, o int, t string")
    assert sorted(r.o for r in S.budget_prefix(df, "k", ["o"], "t", 10).collect()) == [1, 2]


def test_noise_filter(spark):
    rows = [
        ("a", at(0), 1, False, ["Read"], 1, ""), ("a", at(100), 2, False, ["Edit"], 1, ""), ("b", at(0), 3, False, ["Read"], 1, ""), ("b", at(1801), 4, False, ["Edit"], 1, ""),
        ("c", at(0), 5, True, None, 0, None), ("c", at(1), 6, False, ["Skill", "Monitor"], 5, ""), ("c", at(2), 7, False, [], 1, "x" * 100), ("c", at(3), 8, False, [], 1, "x" * 101), ("c", at(4), 9, False, ["Read"], 2, ""),
    ]
    df = events(spark, rows, ", err boolean, tools array<string>, loops int, said string")
    assert sorted(r.id for r in S.noise_filter(df, "k", "ts", ["id"], "err", "tools", "loops", "said").collect()) == [2, 4, 5, 8, 9, 1][:0] + [1, 2, 4, 5, 8, 9]


def test_turn_clusters(spark):
    def run(rows):
        df = events(spark, rows, ", intent string, things array<string>")
        return [r.cluster_no for r in S.turn_clusters(df, "k", "ts", ["id"], "intent", "things").orderBy("k", "ts", "id").collect()]

    assert run([("a", at(0), 1, "x", ["p"]), ("a", at(7200), 2, "x", ["p"]), ("a", at(14401), 3, "x", ["p"])]) == [0, 0, 1]
    assert run([("a", at(i), i, "x", None) for i in range(9)]) == [0] * 8 + [1]
    assert run([("a", at(0), 1, "x", ["p"]), ("a", at(10), 2, "y", ["q"])]) == [0, 1]
    assert run([("a", at(0), 1, "x", ["p"]), ("a", at(10), 2, "y", ["p"])]) == [0, 0]  # ended provisionally, merged again
    assert run([("a", at(0), 1, None, ["p"]), ("a", at(1801), 2, None, ["q"])]) == [0, 1]
    assert run([("a", at(0), 1, None, []), ("a", at(1801), 2, None, ["q"])]) == [0, 0]
    assert run([("a", at(0), 1, None, None), ("b", at(0), 2, None, None)]) == [0, 0]
    assert run([]) == []


def test_turn_clusters_of_events_break_where_the_intent_changes(spark, tmp_path):
    kinds, gaps = ["view"] * 10 + ["click", "click", "view", None, "view", "error"], [0, 60, 60, 1900, 60, 60, 60, 60, 60, 60, 60, 7300, 60, 60, 1900, 60]
    rows = [(1, at(sum(gaps[: k + 1])), k, kind, "{}") for k, kind in enumerate(kinds)] + [(2, at(0), 99, "view", "{}")]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    # one thing a turn, so neighbours that ended provisionally share none and stay apart, unless one of them has none
    want, size, intent = [], 0, None
    for kind, gap in zip(kinds, gaps, strict=True):
        changed = kind is not None and intent is not None and kind != intent
        if not want or gap > 7200 or changed or size >= 8:
            want.append(0)
            size, intent = 0, None
        want[-1], size, intent = want[-1] + 1, size + 1, kind or intent
    got = turn_clusters(spark, str(tmp_path)).orderBy("user_id", "cluster_no").collect()
    assert [(r.user_id, r.turns) for r in got] == [(1, n) for n in want] + [(2, 1)]


def test_token_chunks(spark):
    def run(sizes):
        df = spark.createDataFrame([("a", i, n) for i, n in enumerate(sizes)], "k string, seq int, n int")
        return [(r.seqs, r.tokens) for r in S.token_chunks(df, "k", "seq", "n").orderBy("chunk_no").collect()]

    assert run([5]) == [([0], 5)]
    assert run([5] * 10) == [(list(range(10)), 50)]
    assert run([200, 200, 200]) == [([0, 1], 400), ([2], 200)]
    assert run([900, 10]) == [([0], 900), ([1], 10)]
    assert run([300, 60, 100]) == [([0, 1], 360), ([1, 2], 160)]
    assert run([]) == []


def test_post_clear_and_retry(spark):
    s = spark.createDataFrame([("a", at(0), at(100)), ("a", at(220), at(300)), ("a", at(421), None)], "k string, started timestamp_ntz, ended timestamp_ntz")
    assert [r.post_clear for r in S.post_clear(s, "k", "started", "ended").orderBy("started").collect()] == [False, True, False]
    df = events(spark, [("a", at(0), 1), ("a", at(1), 2), ("b", at(1), 3)])
    assert [r.is_retry for r in S.retry_flags(df, ["k"], ["ts", "id"]).orderBy("id").collect()] == [False, True, False]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_inputs(spark, n):
    df = events(spark, [("a", at(0), 1)][:n])
    assert S.gap_sessions(df, "k", "ts", ["id"]).count() == n
    assert S.sliding_windows(df, "k", ["ts"], "id", 3).count() == 0
