import random
from collections import defaultdict

import pytest

from tracewell.llm.components import connected_groups, star_pairs


def brute(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def run(spark, pairs, kind="string"):
    df = spark.createDataFrame(pairs, f"src {kind}, dst {kind}, node string, group string") if pairs and len(pairs[0]) == 4 else spark.createDataFrame(pairs, f"src {kind}, dst {kind}")
    return {r["node"]: r["group"] for r in connected_groups(df).collect()}


CASES = {
    "empty": [],
    "nulls and loops": [(None, "a"), ("b", None), ("c", "c"), ("d", "e"), ("e", "d"), ("d", "e")],
    "path": [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)],
    "ring": [(f"{i:03d}", f"{(i + 1) % 23:03d}") for i in range(23)],
    "star": [("hub", f"x{i}") for i in range(300)],
    "clique": [(f"k{i}", f"k{j}") for i in range(8) for j in range(i)],
    "ring with tails": [(f"{i}", f"{(i + 1) % 9}") for i in range(9)] + [(f"{i}", f"t{i}") for i in range(9)] + [(f"t{i}", f"u{i}") for i in range(9)],
    "theta": [("a", "1"), ("1", "2"), ("2", "z"), ("a", "3"), ("3", "z"), ("a", "4"), ("4", "5"), ("5", "6"), ("6", "z")],
}


@pytest.mark.parametrize("name", CASES)
def test_shapes(spark, name):
    assert run(spark, CASES[name]) == brute(CASES[name])


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(110 + 60 * seed)]
    assert run(spark, pairs, "long") == brute(pairs)


def test_clashing_columns(spark):
    assert run(spark, [("a", "b", "q", "r"), ("b", "c", "q", "r")]) == {"a": "a", "b": "a", "c": "a"}


def test_star_pairs_is_linear(spark):
    rows = [("hot", f"n{i:04d}") for i in range(500)] + [("k", "n0001"), ("k", None), (None, "n0002"), ("lone", "z")]
    got = star_pairs(spark.createDataFrame(rows, "key string, id string"), "key", "id").collect()
    assert len(got) == 499 and {r["src"] for r in got} == {"n0000"}
    assert defaultdict(int) == {}
