"""Co-occurrence, neighbours, restatements and spellings against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from tracewell.llm import cooccurrence, neighbors, restatements
from tracewell.llm.components import connected_groups
from tracewell.llm.cooccurrence import pair_lift
from tracewell.llm.neighbors import nearest_pairs, usable_vectors
from tracewell.llm.queries import p4_pairs
from tracewell.llm.restatements import LEAST_DEPTH, restatement_groups, tree_recall
from tracewell.llm.spellings import Judge, star_clusters, typing_cost, variant_names


def test_pair_lift_matches_brute_force_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "BLOCK", 4)
    rng = random.Random(1)
    rows = [(f"s{rng.randrange(12)}", f"i{rng.randrange(25):02d}") for _ in range(400)] + [(None, "i01"), ("s1", None)]
    held = {(s, i) for s, i in rows if s and i}
    items = {i: {s for s, j in held if j == i} for _, i in held}
    n = len({s for s, _ in held})
    want = {(a, b): (len(items[a] & items[b]), len(items[a]), len(items[b])) for a, b in itertools.combinations(sorted(items), 2) if items[a] & items[b]}
    got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"]) for r in pair_lift(spark.createDataFrame(rows, "basket string, item string"), "basket", "item").collect()}
    assert got == want
    few = pair_lift(spark.createDataFrame(rows, "basket string, item string"), "basket", "item", 6, 1.1).collect()
    assert {(r["item_a"], r["item_b"]) for r in few} == {k for k, (c, x, y) in want.items() if c >= 6 and c * n >= 1.1 * x * y}
    assert all(math.isclose(r["pmi"], math.log2(r["n_ab"] * n / r["n_a"] / r["n_b"])) for r in few)
    assert pair_lift(spark.createDataFrame([], "basket string, item string"), "basket", "item").count() == 0


def test_all_pairs_with_what_was_measured(spark, tmp_path):
    tables = {
        "atoms": ([(["s1", "s2"], ["Ann", "Bob"]), (["s2"], ["Cid", "bob "])], "session_ids array<string>, entities array<string>"),
        "entities": ([("1", "Ann"), ("2", "Bob"), ("3", "Cid")], "id string, canonical_name string"),
        "relations": ([("2", "3", "related_to", 0.5)], "source_entity string, target_entity string, relation_type string, weight double"),
        "metrics": ([("1", "3", 1)], "entity_a string, entity_b string, coactivations long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["weight"], r["coactivations"]) for r in p4_pairs(spark, str(tmp_path)).collect()}
    assert got == {("ann", "bob"): (2, None, None), ("ann", "cid"): (1, None, 1.0), ("bob", "cid"): (1, 0.5, None)}


def vectors(spark, rows):
    return usable_vectors(spark.createDataFrame(rows, "id string, v array<float>, vec string"), "id", "v", 8)


def test_neighbours_with_copies_and_dirt(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 8))
    x = np.concatenate([centres + rng.normal(scale=0.1, size=centres.shape) for _ in range(8)]).astype(np.float32)
    x[100:130] = x[100]  # many equal vectors
    rows = [(f"{i:04d}", [float(v) for v in x[i]], "clash") for i in range(len(x))]
    dirt = [("n1", None, ""), ("n2", [], ""), ("n3", [0.0] * 8, ""), ("n4", [1.0] * 7, ""), ("n5", [1.0] * 7 + [None], ""), ("n6", [float("nan")] * 8, ""), (None, [1.0] * 8, "")]
    got = {tuple(r) for r in nearest_pairs(vectors(spark, rows + dirt + rows[:20]), 8, 5).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -9)
    want = set()
    for i in range(len(y)):
        best = sorted(range(len(y)), key=lambda j: (-round(s[i, j], 9), j))[:5]
        want |= {(f"{min(i, j):04d}", f"{max(i, j):04d}") for j in best}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97
    copies = {p for p in want if 100 <= int(p[0]) < 130 and 100 <= int(p[1]) < 130}
    assert copies <= got


def test_neighbours_of_few(spark):
    assert nearest_pairs(vectors(spark, []), 8).count() == 0
    assert nearest_pairs(vectors(spark, [("a", [1.0] * 8, "")]), 8).count() == 0
    assert [tuple(r) for r in nearest_pairs(vectors(spark, [("b", [1.0] * 8, ""), ("a", [2.0] * 8, "")]), 8).collect()] == [("a", "b")]


def test_tree_walk_is_best_bin_first():
    rng = np.random.default_rng(4)
    x = neighbors._unit(np.concatenate([rng.normal(size=(60, 16))[:, None] + rng.normal(scale=0.3, size=(60, 40, 16))]).reshape(-1, 16).astype(np.float32))
    tree = neighbors.fit_tree(x, 20)
    order = tree.walk(x[::50], tree.leaves)
    assert (np.sort(order, axis=1) == np.arange(tree.leaves)).all() and (tree.walk(x[::50], 5) == order[:, :5]).all()
    leaf = tree.descend(x)
    assert np.bincount(leaf, minlength=tree.leaves).min() > 0
    s = x[::50] @ x.T
    near = np.argsort(-s, axis=1)[:, 1:6]
    few = tree.walk(x[::50], max(1, tree.leaves // 6))
    assert np.mean([[leaf[j] in set(few[i]) for j in near[i]] for i in range(len(near))]) > 0.9
    one = neighbors.fit_tree(x[:5], 20)
    assert one.leaves == 1 and (one.walk(x[:3], 4) == 0).all() and (one.descend(x[:3]) == 0).all()


def test_large_leaf_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbors, "GUEST_ROWS", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    got = {tuple(r) for r in nearest_pairs(vectors(spark, [(f"{i:03d}", [float(v) for v in x[i]], "") for i in range(120)]), 8, 3).collect()}
    y = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -9)
    want = {(f"{min(i, j):03d}", f"{max(i, j):03d}") for i in range(120) for j in np.argsort(-s[i])[:3]}
    assert len(got & want) / len(want) > 0.97


def restated(texts):
    sets = {}
    for i, t in texts:
        runs = re.findall("[0-9a-z]+", (t or "").lower())
        if i is not None and len(runs) >= 8:
            sets.setdefault(i, []).append(set(runs))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if any(len(a & b) >= 0.75 * min(len(a), len(b)) for a in sets[i] for b in sets[j]):
            up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {i: root(i) for i in up}
    return {i: g for i, g in groups.items() if list(groups.values()).count(g) > 1}


def test_restatements_match_brute_force(spark):
    rng = random.Random(2)
    stock = [f"word{k}" for k in range(60)]
    texts = [("empty", ""), ("null", None), (None, "a b c d e f g h i"), ("short", "a b c d e f g"), ("long", " ".join(f"u{k}" for k in range(20000)))]
    for k in range(150):
        base = rng.sample(stock, rng.randrange(10, 30)) + [f"rare{k}x{j}" for j in range(rng.randrange(4))]
        texts.append((f"{k:03d}", " ".join(base)))
        if k % 3 == 0:
            more = base + rng.sample(stock, rng.randrange(6))
            rng.shuffle(more)
            texts.append((f"{k:03d}b", " ".join(more[rng.randrange(3) :])))
    texts += [(f"copy{k}", "the same eight words again and again here") for k in range(40)] + texts[10:20] + [("010", "other text with more than eight words in it now")]
    df = spark.createDataFrame(texts, "id string, content string").selectExpr("id", "content", "'x' as words", "1 as n")
    got = {r["node"]: r["group"] for r in restatement_groups(df, "id", "content").collect()}
    assert got == restated(texts)


def test_restatements_tied_by_one_rare_word(spark, monkeypatch):
    """Twelve words, four of them rare; one rare and eight frequent ones are shared."""
    monkeypatch.setattr(restatements, "FREQUENT", 0.2)
    rng = random.Random(4)
    stock, texts = [f"stock{k}" for k in range(20)], []
    for k in range(100):
        base = rng.sample(stock, 8) + [f"tie{k}"]
        texts += [(f"{k:03d}{side}", " ".join(base + [f"own{k}{side}{j}" for j in range(3)])) for side in "ab"]
    got = {r["node"]: r["group"] for r in restatement_groups(spark.createDataFrame(texts, "id string, content string"), "id", "content").collect()}
    assert got == restated(texts) and len(got) == 200


def test_restatements_in_a_large_family(spark, monkeypatch):
    """Outliers alike to one member of a family whose distinctive words crowd the nodes of the tries."""
    monkeypatch.setattr(restatements, "FREQUENT", 0.5)
    rng = random.Random(6)
    kin, texts = [f"kin{k}" for k in range(24)], [(f"z{k}", " ".join(f"z{k}w{j}" for j in range(9))) for k in range(180)]
    for k in range(60):
        own = [f"own{k}x{j}" for j in range(6)]
        texts += [(f"m{k:02d}", " ".join(kin + own)), (f"o{k:02d}", " ".join(rng.sample(kin, 17) + own + [f"far{k}x{j}" for j in range(7)]))]
    got = {r["node"]: r["group"] for r in restatement_groups(spark.createDataFrame(texts, "id string, content string"), "id", "content").collect()}
    assert got == restated(texts) and len(got) == 120


def test_restatements_of_different_sizes_and_of_near_copies(spark):
    """Short texts within longer ones, pairs that share most words of the shorter, and a family all of whose members are alike."""
    rng = random.Random(12)
    stock = [f"stock{k}" for k in range(300)]
    own = lambda tag, n: [f"{tag}w{j}" for j in range(n)]
    texts = [(f"n{k}", " ".join(own(f"n{k}", 18) + rng.sample(stock, 12))) for k in range(1500)]
    for k in range(60):
        whole = own(f"i{k}", 36) + rng.sample(stock, 14)
        texts += [(f"in{k}", " ".join(whole[:12] + whole[36:40])), (f"io{k}", " ".join(whole))]
        part = own(f"p{k}", 14) + rng.sample(stock, 10)
        texts += [(f"pa{k}", " ".join(part)), (f"pb{k}", " ".join(part[:13] + part[14:23] + own(f"q{k}", 26)))]
    kin = own("kin", 30)
    texts += [(f"k{k:02d}", " ".join(rng.sample(kin, 29) + own(f"k{k}x", 2))) for k in range(60)]
    got = {r["node"]: r["group"] for r in restatement_groups(spark.createDataFrame(texts, "id string, content string"), "id", "content").collect()}
    assert LEAST_DEPTH == 3
    for k in range(60):
        assert got[f"in{k}"] == got[f"io{k}"] and got[f"pa{k}"] == got[f"pb{k}"]
    assert {got[f"k{k:02d}"] for k in range(60)} == {"k00"} and not any(i.startswith("n") for i in got)


def test_restatements_by_frequent_words_in_several_blocks(spark):
    """What the second stage gives is alike by frequent words, with no pair left open, whatever the size of its blocks."""
    rng = np.random.default_rng(3)
    words = [np.unique(np.r_[rng.choice(40, 14, replace=False), 1000 + 3 * k + np.arange(rng.integers(0, 3))]).astype(np.uint32) for k in range(600)]
    words += [w[: len(w) - k % 4] for k, w in enumerate(words[:100])]
    rows = [(k, len(w), w.tobytes()) for k, w in enumerate(words)]
    sets = spark.createDataFrame(rows, "rid long, n int, words binary").repartition(3)
    freq, counts = restatements.frequent_words(sets, len(rows), 15.0)
    freq, counts = freq[counts > 9], counts[counts > 9]
    alike = lambda a, b: len(set(a) & set(b)) >= 0.75 * min(len(a), len(b))
    want = [(a, b) for a, b in itertools.combinations(range(len(words)), 2) if alike(words[a], words[b])]
    groups = {r["node"]: r["group"] for r in connected_groups(spark.createDataFrame(want, "a long, b long"), "a", "b").collect()}
    rare = restatements.verified(restatements.rare_pairs(sets, freq, 0.75), sets, 0.75)
    for block_rows in (37, 100_000):
        within = restatements.contained_pairs(sets, freq, counts, 0.75, block_rows)
        assert within.columns == ["a", "b"]
        assert {r["node"]: r["group"] for r in connected_groups(within.unionByName(rare), "a", "b").collect()} == groups


def test_restatements_of_nothing(spark):
    assert restatement_groups(spark.createDataFrame([], "id string, content string"), "id", "content").count() == 0
    assert restatement_groups(spark.createDataFrame([("a", "one two three four five six seven eight")], "id string, content string"), "id", "content").count() == 0
    assert tree_recall(0.9, 3) > 0.99 > tree_recall(0.3, 6)


@pytest.mark.parametrize("size", [100, 1000, 4000])
def test_planted_variants_are_linked_at_every_size(spark, size):
    """The same variants of the same names, among more and more others; short forms become common words on the way."""
    rng = random.Random(8)
    piece = [c + v for c in "bdfgjklmnprstvz" for v in "aeiou"]
    kinds = [("service", "svc"), ("broker", "brkr"), ("protocol", "proto"), ("station", "stn"), ("initiative", "init."), ("threshold", "thresh"), ("foundation", "fdn")]
    coined = sorted({"".join(rng.choice(piece) for _ in range(4)) for _ in range(size)})
    names = [f"{c} {kinds[k % 7][0]}" for k, c in enumerate(coined)]
    others = [f"{c} {kinds[k % 7][1]}" for k, c in enumerate(coined) if k % 5 == 0]
    want = []
    for k in range(0, len(names), max(1, len(names) // 40)):
        stem, (full, short) = coined[k], kinds[k % 7]
        want += [(f"{stem} {short}", str(k)), (f"{short} {stem}", str(k)), (f"{stem}_{full}", str(k)), (f"{stem[:3]}{stem[4]}{stem[3]}{stem[5:]} {full}", str(k)), (f"{stem[:5]}{stem[6:]} {full}", str(k)), (f"{stem[:4]}{stem[4]}{stem[4:]} {short}", str(k))]
    want = {w for w in want if w[0] not in names}
    records = spark.createDataFrame([(str(k), n, None) for k, n in enumerate(names)], "id string, canonical_name string, aliases array<string>")
    said = spark.createDataFrame([(n,) for n in others] + [(w[0],) for w in want], "n string")
    got = {tuple(r) for r in variant_names(records, "id", "canonical_name", "aliases", said).collect()}
    assert len(want & got) >= 0.97 * len(want), sorted(want - got)


def test_typing_cost():
    assert [typing_cost(a, b, 2) for a, b in [("abc", "abc"), ("abcd", "abdc"), ("abcd", "abd"), ("hello", "helllo"), ("lab", "kab"), ("lab", "zab"), ("abcdef", "uvwxyz")]] == [0, 1, 1, 1, 1, 2, 3]


def test_judge():
    j = Judge({"service": (900, True), "svc": (40, True), "relay": (900, True), "hanae": (700, False), "ingrid": (700, False), "py": (500, True), "samuel": (600, False), "relya": (20, True)})
    yes = [("lenlafuk service", "lenlafuk svc"), ("lenlafuk service", "lenlauk serivce"), ("qunvuni samuel", "sam qunvuni"), ("hanae nimakbok", "hanae b. nimakbok"), ("src/lasimemli_zebu.py", "lasimemli_zebu"), ("hinnomlavamrelay", "hinnomlavam relay"), ("wotfolxu relay", "wötfolxu relay"), ("wotfolxu relya", "wotfolxu relay"), ("oksa svc lenlafuk", "oksa lenlafuk service")]
    no = [("hanae nimakbok", "ingrid nimakbok"), ("milepipa service 2", "milepipa service 3"), ("lenlafuk service", "lenlafuk relay"), ("cedar xakbuxu", "amber xakbuxu"), ("service", "relay"), ("", "x")]
    assert all(j.score(a, b) > 0 for a, b in yes), [(a, b) for a, b in yes if not j.score(a, b)]
    assert not any(j.score(a, b) for a, b in no), [(a, b) for a, b in no if j.score(a, b)]


def test_star_clusters(spark):
    links = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.9), ("a", "d", 0.9), ("d", "e", 0.8), ("x", "y", 0.7)], "a string, b string, score double")
    got = {r["name"]: r["centre"] for r in star_clusters(links).collect()}
    assert got["b"] == got["c"] == got["d"] == got["a"] == got["e"] == "a" and got["x"] == got["y"]
    assert star_clusters(links.limit(0)).count() == 0


def test_variant_names(spark):
    schema = "id string, canonical_name string, aliases array<string>, name string"
    rows = [("1", "Dulanka protocol", None, "clash"), ("1", "Dulanka protocol", [None, " ", "amber tovik"], ""), ("2", "dulanak  protocol", [], ""), ("3", "Vexirum", ["amber tovik"], ""), ("4", None, ["zz"], ""), ("5", "", None, "")]
    mentions = spark.createDataFrame([("DULANKA  PROTOCOL",), ("dulnka protocol",), (None,), ("",), ("vexorum",)], "n string")
    got = {tuple(r) for r in variant_names(spark.createDataFrame(rows, schema), "id", "canonical_name", "aliases", mentions).collect()}
    assert got == {("dulanak protocol", "1"), ("dulanka protocol", "2"), ("dulnka protocol", "1"), ("dulnka protocol", "2"), ("vexorum", "3")} - ({("vexorum", "3")} if typing_cost("vexirum", "vexorum", 2) > 2 else set())
    assert variant_names(spark.createDataFrame([], schema), "id", "canonical_name", "aliases", mentions.limit(0)).count() == 0


def test_variants_of_names_made_of_common_tokens(spark):
    coined = [a + b for a in ("bak", "dul", "fim", "gon") for b in ("zurt", "vexo", "lipa", "moqu")]
    people = ["john smith", "robert smith"] + [f"{g} {c}" for g, c in zip(["john", "robert"] * 12, coined + [c[::-1] for c in coined[:8]], strict=True)]
    people += [f"{c}a smith" for c in coined]
    records = spark.createDataFrame([(str(k), n, None) for k, n in enumerate(people)], "id string, canonical_name string, aliases array<string>")
    said = ["smith john", "bob smith", "smith, bob", "john b. smith"]
    got = {tuple(r) for r in variant_names(records, "id", "canonical_name", "aliases", spark.createDataFrame([(n,) for n in said], "n string")).collect()}
    assert {r for r in got if r[0] in said} == {("smith john", "0"), ("john b. smith", "0"), ("bob smith", "1"), ("smith, bob", "1")}
    j = Judge({"john": (40, False), "smith": (40, True)})
    assert all(j.score(a, b) > 0 for a, b in [("jhon smith", "john smith"), ("john smith", "jonh smith")])
    assert not j.score("john smith", "john jones") and not j.score("john", "john smith")
