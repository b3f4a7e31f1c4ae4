"""Readers, sinks and streams on small files."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.sources import readers as I
from tracewell.sources import writers as O
from tracewell.streaming import live

T0 = datetime(2026, 1, 1)


def test_transcripts(spark, tmp_path):
    good = [{"entrypoint": "cli", "type": "user", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "hi"}}, {"type": "assistant", "message": {"role": "assistant", "content": "yo"}}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, good)) + "\nnot json\n")
    (tmp_path / "b.jsonl").write_text(json.dumps({"entrypoint": "sdk", "type": "user"}) + "\n")
    rows = I.read_transcripts(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.type for r in rows] == ["user", "assistant"] and rows[0].ts is not None and rows[1].ts is None


def test_corpus(spark, tmp_path):
    lines = [{"role": "user", "text": "long enough text", "timestamp": "1767225600000"}, {"role": "user", "text": "short"}, {"role": "tool", "text": "long enough text"}, {"type": "assistant", "content": '[{"type": "text", "text": "block of text"}, {"type": "tool_use", "name": "Read"}]'}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = I.read_corpus(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.text for r in got] == ["long enough text", "block of text\n[tool:Read]"] and got[0].ts == T0


def test_frontmatter_and_sections(spark, tmp_path):
    (tmp_path / "n.md").write_text('---\ntitle: "A b"\nday: 2026\n---\nbody text\n')
    doc = I.read_documents(spark, str(tmp_path), "*.md").select(I.frontmatter(F.col("text")).alias("m"), I.body(F.col("text")).alias("b")).first()
    assert doc.m == {"title": "A b", "day": "2026"} and doc.b.strip() == "body text"
    text = "intro text that is long enough to keep\n# One\n" + "x" * 40 + "\n## Two\n" + "y" * 40 + "\n# Three\nshort\n"
    df = spark.createDataFrame([("d", text), ("e", "first block here\n\nsecond block here\n"), ("f", ""), ("g", None)], "k string, t string")
    parts = I.sections(df, "k", "t", 10).orderBy("k", "ordinal").collect()
    assert [r.heading for r in parts if r.k == "d"] == ["", "One", "Two", "Three"] and sum(r.k == "e" for r in parts) == 2
    assert all(text[r.char_start : r.char_end] == r.content for r in parts if r.k == "d")
    assert {r.k for r in parts} == {"d", "e"}


def test_char_chunks(spark):
    text = "a" * 70 + "\n\n" + "b" * 60
    got = [r.content for r in I.char_chunks(spark.createDataFrame([("d", text), ("e", ""), ("f", None), ("g", "c" * 250)], "k string, t string"), "k", "t", 100).orderBy("k", "chunk_no").collect()]
    assert "".join(got[:-3]) == text and len(got[0]) in (70, 71, 72) and [len(x) for x in got[-3:]] == [100, 100, 50]


def test_versioned_table(spark, tmp_path):
    t = O.VersionedTable(spark, str(tmp_path / "t"))
    df = lambda *r: spark.createDataFrame(r, "id int, v string")
    assert t.read() is None and t.append(df((1, "a")), ["id"]) == 1
    t.append(df((1, "z"), (2, "b")), ["id"])
    t.replace(df((1, "c")), ["id"])
    assert sorted(map(tuple, t.read().collect())) == [(1, "c"), (2, "b")]
    t.rollback()
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "b")] and t.version() == 4 and t.log().count() == 4


def test_named_snapshots_forks_and_locks(spark, tmp_path):
    df = lambda *r: spark.createDataFrame(r, "id int, v string")
    rows = lambda t: sorted(map(tuple, t.read().collect()))
    t = O.VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        t.snapshot("empty")
    t.append(df((1, "a")), ["id"])
    t.snapshot("first")
    t.append(df((1, "z"), (2, "b")), ["id"])
    assert len(t._last()["parts"]) == 2 and t._last()["rows"] == 2  # an append adds a folder
    t.snapshot("second")
    with pytest.raises(ValueError):
        t.snapshot("first")
    assert [r.name for r in t.snapshots().collect()] == ["first", "second"]
    t.checkout("first")
    assert rows(t) == [(1, "a")]
    t.checkout("second")
    assert rows(t) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        t.checkout("third")
    name, fork = O.fork_experiment(t, spark.createDataFrame([("007-x",)], "n string"), "n", "try", str(tmp_path / "x"))
    fork.append(df((3, "c")), ["id"])
    assert name == "008-try" and len(rows(fork)) == 3 and len(rows(t)) == 2
    t.rollback(), t.rollback()
    assert len(rows(t)) in (1, 2)
    lock = lambda: O.SingleWriter(spark, str(tmp_path / "lock"))
    with lock() as one, lock() as two:
        assert one and not two
    with lock() as again:
        assert again


def test_notes_index_html_and_logs(spark, tmp_path):
    index = spark.createDataFrame([("# Index",), ("- [One](n1)",)], "line string")
    more = spark.createDataFrame([("n1", "One"), ("n2", "Two"), ("n2", "Two")], "id string, title string")
    once = O.index_append(index, more)
    assert sorted(r.line for r in once.collect()) == ["# Index", "- [One](n1)", "- [Two](n2)"] and O.index_append(once, more).count() == 3
    O.export_html(spark.createDataFrame([(1, "</script>"), (2, None)], "a int, b string").coalesce(1), str(tmp_path / "h"), "T")
    page = "".join(r.value for r in spark.read.text(str(tmp_path / "h")).collect())
    assert page.count("</script>") == 1 and '"b":null' in page
    log = spark.createDataFrame([("a", "ok"), ("b", "error"), ("c", "success"), ("d", "queued"), (None, "ok"), ("a", "error")], "session_id string, status string")
    done, tried = O.status_sets(log)
    assert sorted(r[0] for r in done.collect()) == ["a", "c"] and sorted(r[0] for r in tried.collect()) == ["a", "b", "c"]
    old = spark.createDataFrame([("p", None), ("q", "k")], "kind string, u string")
    assert O.verify_migration(old, O.backfill(old, "u", "kind", {}, "other"), "u") == {"before": 2, "after": 2, "unfilled": 0}


def test_documents_notes_and_hooks(spark, tmp_path):
    files = spark.createDataFrame([("/w/-home-proj/a.md", "---\ntitle: \"T\"\nproject: p\ndate: 2026-01-02\n---\nbody"), ("/w/-home-proj/b.md", "# Head\ntext"), ("/w/-home-proj/c.md", "plain"), ("/w/x/d.md", " ")], "file string, text string")
    got = {r.title: (r.project, r.text) for r in I.document_rows(files).collect()}
    assert got == {"T": ("p", "body"), "Head": ("proj", "# Head\ntext"), "c": ("proj", "plain")}
    assert I.note_row(spark, "first line\nmore", "p").first().title == "first line"
    with pytest.raises(ValueError):
        I.note_row(spark, " \n", "p")
    lines = spark.createDataFrame([('{"session_id": "s", "cwd": "/a/b", "tool_name": "Bash", "tool_input": {"command": "ls"}, "tool_response": "fatal: no", "timestamp": "2026-01-01T00:00:00Z"}',), ("junk",), ('{"cwd": "/a"}',)], "value string")
    rows = I.hook_events(lines, "value").collect()
    assert [(r.session_id, r.project, r.tool, r.had_error, len(r.input_hash)) for r in rows] == [("s", "b", "Bash", True, 16)]
    chunks = spark.createDataFrame([(1, k, f"c{k}") for k in range(6)], "doc int, chunk int, text string")
    assert sorted(r.chunk for r in I.pull_sections(chunks, "doc", "chunk", spark.createDataFrame([(1, 0), (1, 4)], "doc int, chunk int"), 1).collect()) == [0, 1, 3, 4, 5]
    (tmp_path / "m.json").write_text('{"k": {"a": 1}, "l": {"a": 2}}')
    assert sorted(map(tuple, I.read_map_file(spark, str(tmp_path / "m.json"), "struct<a: int>").collect())) == [("k", 1), ("l", 2)]


def test_queue_and_names(spark, tmp_path):
    q = spark.createDataFrame([("a",)], "session_id string")
    q = O.queue_add(q, spark.createDataFrame([("a",), ("b",)], "session_id string"))
    assert sorted(r[0] for r in q.collect()) == ["a", "b"] and [r[0] for r in O.queue_remove(q, q.filter("session_id = 'a'")).collect()] == ["b"]
    assert O.next_experiment(spark.createDataFrame([("002-x",), ("010-y",), ("junk",)], "n string"), "n", "new") == "011-new"
    assert O.next_experiment(spark.createDataFrame([], "n string"), "n", "new") == "001-new"
    b = O.backfill(spark.createDataFrame([("p", None), ("q", "kept"), ("r", None)], "kind string, u string"), "u", "kind", {"p": "P"}, "other")
    assert sorted(r.u for r in b.collect()) == ["P", "kept", "other"]
    O.write_notes(spark.createDataFrame([("1", 't"x', "hello")], "id string, title string, body string"), str(tmp_path / "n"), ["id", "title"], "body")
    assert "title: \"t'x\"" in "".join(r[0] for r in spark.read.text(str(tmp_path / "n"), wholetext=True).collect())
    O.export_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"a": 1, "b": None}
    O.write_graph_outputs(str(tmp_path / "g"), {"entities": q})
    assert set(I.read_graph_outputs(spark, str(tmp_path / "g"))) == {"entities"}


def write(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, "k string, ts timestamp, id long, intent string, things array<string>").coalesce(1).write.mode(mode).parquet(path)


@pytest.fixture
def stream(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, [("a", T0 + timedelta(seconds=s), i, None, ["x"]) for i, s in enumerate([0, 1800, 3601, 3601])], src)
    return lambda: spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), src


def test_stream_sessions(spark, stream, tmp_path):
    read, src = stream
    write(spark, [("z", T0 + timedelta(days=2), 99, None, None)], src)
    q = live.gap_sessions(read(), "k", "ts").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "o")).filter("k = 'a'").collect()) == [2, 2]


def test_stream_append_is_idempotent(spark, stream, tmp_path):
    read, src = stream
    for _ in range(2):
        live.append_once(read(), ["id"], "ts", str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    write(spark, [("a", T0 + timedelta(seconds=3601), 3, None, None)], src)
    live.append_once(read(), ["id"], "ts", str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [0, 1, 2, 3]


def test_stream_clusters_carry_state(spark, stream, tmp_path):
    read, src = stream
    run = lambda: live.turn_clusters(read(), "k", "ts", "intent", "things").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    run()
    write(spark, [("a", T0 + timedelta(seconds=3700), 5, None, ["x"]), ("a", T0 + timedelta(seconds=20000), 6, None, ["x"])], src)
    run()
    assert [(r.key, r["size"], r.closed) for r in spark.read.parquet(str(tmp_path / "o")).orderBy("first").collect()][0] == ("a", 5, True)


def test_threshold_and_windows(spark, stream, tmp_path):
    read, _ = stream
    seen = []
    live.on_threshold(read(), str(tmp_path / "c"), 3, seen.append).awaitTermination(120)
    assert seen == [4]
    df = spark.createDataFrame([("a", T0), ("a", T0 + timedelta(minutes=59)), ("b", T0 + timedelta(hours=1))], "k string, ts timestamp")
    assert sorted(r.n for r in live.window_counts(df, "ts", ["k"]).collect()) == [1, 2]
