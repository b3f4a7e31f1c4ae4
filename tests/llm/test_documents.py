"""Packing, mixing and subject areas."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import packing
from tracewell.llm.mixing import mix_documents, mix_report, mixing_rates
from tracewell.llm.packing import nnls, pack, patterns, plan_windows
from tracewell.llm.subjects import subject_areas
from tracewell.llm.tokens import TOKENIZERS, encoder, with_tokens


def test_tokens_are_whole_and_exact(spark):
    texts = [("a", "Hello, wörld"), ("b", ""), ("c", None), ("d", "x y " * 30000)]
    got = {r["doc_id"]: r["n_tokens"] for r in with_tokens(spark.createDataFrame(texts, "doc_id string, text string"), "text", ["doc_id"]).collect()}
    enc = encoder(TOKENIZERS)
    assert got == {k: len(enc.encode_ordinary(t or "")) for k, t in texts}
    assert enc.decode(enc.encode_ordinary(texts[3][1])) == texts[3][1]


def test_patterns_and_nnls():
    pats = patterns(10, 3)
    assert all(sum(p) == 10 and len(p) <= 3 for p in pats) and len(set(pats)) == len(pats) == 14
    a = np.abs(np.random.default_rng(0).normal(size=(6, 4)))
    x = np.array([1.0, 0.0, 2.0, 0.5])
    assert np.allclose(nnls(a, a @ x, 3000), x, atol=1e-3)


@pytest.mark.parametrize("capacity", [1, 7, 64, 500])
def test_plan_holds_everything(capacity):
    rng = np.random.default_rng(capacity)
    items = Counter(int(v) for v in rng.integers(1, capacity + 1, 3000))
    plan = plan_windows(dict(items), capacity)
    held = Counter()
    for take, times in plan:
        assert sum(n * k for n, k in take.items()) <= capacity
        for n, k in take.items():
            held[n] += k * times
    assert held == items
    assert sum(n * c for n, c in items.items()) / capacity / sum(t for _, t in plan) > (0.9 if capacity > 7 else 0.7)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 20)
    rows = [(i, n) for i, n in enumerate([0, 0, 5, 100, 101, 250, 1000, None] + [7] * 300 + list(range(1, 90)))]
    out = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 100).toPandas()
    assert set(out.doc_id) == {r[0] for r in rows}
    assert (out.groupby("window_id").n_tokens.sum() <= 100).all()
    assert (out.groupby("doc_id").n_tokens.sum() == [r[1] or 0 for r in rows]).all()
    assert out[out.n_tokens < 100].groupby("doc_id").part.count().max() == 1
    assert out.n_tokens.sum() / (out.window_id.nunique() * 100) > 0.95
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 10).count() == 0
    with pytest.raises(ValueError):
        pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 0)


def test_mix(spark):
    docs = spark.createDataFrame([(i, "big" if i % 10 else "small", 10 + i % 7) for i in range(5000)] + [(9000, None, 5), (9001, "other", 4)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", " BIG", 0.5, 1, 0.4), ("m", "small", 0.4, 3, 0.4), ("m", "absent", 0.1, 5, 0.4), ("n", "small", 1.0, 2, 0.9)], "mix_id string, doc_source string, target_share double, max_repeats int, budget_ratio double")
    rates = mixing_rates(docs, targets)
    mixed = mix_documents(docs, rates)
    report = {(r["mix_id"], r["source"]): r for r in mix_report(mixed, rates).collect()}
    assert mixed.filter("mix_id = 'n' and copies > 2 or mix_id = 'm' and source = 'small' and copies > 3").count() == 0
    assert abs(report["m", "big"]["tokens"] / report["m", "big"]["wanted"] - 1) < 0.08
    assert report["n", "small"]["rate"] == 2.0 and report["m", "absent"]["tokens"] == 0
    assert abs(sum(r["actual_share"] for k, r in report.items() if k[0] == "m") - 1) < 1e-9
    assert mix_documents(docs, rates).exceptAll(mixed).count() == 0
    assert mix_report(mix_documents(docs.limit(0), rates), rates).filter("tokens > 0").count() == 0


def test_subjects(spark):
    rng = np.random.default_rng(4)
    vocabulary = {s: [f"{s}{'abcdefghij'[k]}" for k in range(10)] for s in ("sport", "music", "law")}
    filler = [f"filler{c}" for c in "abcdefghijklmnopqrst"]
    docs, truth = [], {}
    for i in range(600):
        about = {["sport", "music", "law"][i % 3]} | ({"law"} if i % 11 == 0 else set())
        words = [w for s in about for w in rng.choice(vocabulary[s], 6)] + list(rng.choice(filler, 12))
        truth[i] = about
        docs.append((i, " ".join(rng.permutation(words))))
    docs += [(900, ""), (901, None), (902, "filler " * 50000)]
    labels = [(i, s) for i in range(0, 600, 4) for s in truth[i]] + [(902, "none")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("doc", F.lit("clash"))
    got = subject_areas(df, "doc_id", "text", spark.createDataFrame(labels, "doc long, subject string"), ["law", "music", "sport"]).collect()
    said = {(r["doc"], r["subject"]) for r in got}
    want = {(i, s) for i, a in truth.items() for s in a}
    assert len(said & want) / len(want) > 0.9 and len(said & want) / len(said) > 0.9
    assert not any(d >= 900 for d, _ in said)


def test_subjects_of_copies_and_of_a_large_subject(spark):
    """A third of the documents are copies of one text, and half of the others are about one subject."""
    rng = random.Random(9)
    stock = ["the", "and", "with", "from", "this"]
    terms = {a: [f"{a}{c}" for c in "abcdefgh"] for a in ("law", "music", "sport")}
    docs = [(f"t{k}", a, " ".join(stock + rng.sample(terms[a], 6))) for k, a in enumerate(["law"] * 60 + ["music"] * 30 + ["sport"] * 30)]
    docs += [(f"c{k}", "sport", " ".join(stock + ["regatta", "rowing", "oarsman", "coxswain", "sculling", "paddle"])) for k in range(60)]
    labels = [(i, a) for k, (i, a, _) in enumerate(docs) if k % 3 == 0]
    got = subject_areas(spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id string, text string"), "doc_id", "text", spark.createDataFrame(labels, "doc string, subject string"), list(terms)).collect()
    assert {(r["doc"], r["subject"]) for r in got} == {(i, a) for i, a, _ in docs}


def test_subjects_of_little(spark):
    """Empty tables, texts without words, no labels, one document, and labels of documents that are not there."""
    schema, labelled = "doc_id long, text string, key string, terms string", "doc long, subject string"
    none = spark.createDataFrame([], labelled)
    some = spark.createDataFrame([(1, "law"), (1, "law"), (2, None), (None, "law"), (9, "law"), (3, "unknown")], labelled)
    docs = [(1, "court judge court contract", "k", "t"), (2, None, "k", "t"), (3, "", "k", "t"), (4, "1 2 ab", "k", "t"), (5, "court judge court contract", "k", "t"), (None, "court judge", "k", "t")]
    for rows in ([], docs[1:4], docs[:1], docs):
        for labels in (none, some):
            for areas in ([], ["law"], ["law", "music"]):
                got = subject_areas(spark.createDataFrame(rows, schema), "doc_id", "text", labels, areas).collect()
                assert all(r["subject"] in areas for r in got) and not any(r["doc"] in (2, 3, 4) for r in got)
    # a corpus of one text says nothing of its words, so two kinds are needed
    two = [(k, "court judge contract verdict" if k % 2 else "guitar piano chord melody", "k", "t") for k in range(40)]
    got = subject_areas(spark.createDataFrame(two, schema), "doc_id", "text", spark.createDataFrame([(k, "law" if k % 2 else "music") for k in range(10)], labelled), ["law", "music"]).collect()
    assert {tuple(r) for r in got} == {(k, "law" if k % 2 else "music") for k in range(40)}
