"""Groups of records linked directly or over others (connected components of pairwise matches).

Method: leaves are stripped and chains of degree-two vertices compressed by list ranking (pointer
doubling) in turns; what is left, a core of vertices with three or more neighbours, is solved by
alternating large-star and small-star steps; the removed vertices then get their labels back in
reverse order. Every step is a join or a partial aggregation on vertices, so a vertex with a third of
all edges is pre-aggregated before any shuffle, and skewed joins are split by adaptive execution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.runtime import cut

#: A round of stripping and compressing that leaves more than this share of the edges ends in the core solver.
CORE_SHARE = 0.5


def _edges(df: DataFrame) -> DataFrame:
    """Undirected edges once, ``a`` < ``b``; nulls and loops dropped."""
    return df.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _halves(edges: DataFrame) -> DataFrame:
    """Each edge from both ends, as (v, u)."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("h")).select("h.*")


def _degrees(edges: DataFrame, most: int) -> DataFrame:
    """(v, deg, lo, hi) of the vertices with at most ``most`` neighbours; lo and hi are the smallest and largest."""
    return _halves(edges).groupBy("v").agg(F.count("*").alias("deg"), F.min("u").alias("lo"), F.max("u").alias("hi")).filter(F.col("deg") <= most)


def _strip(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove vertices of degree one: (edges left, removed as (v, parent)). Of a lone edge the smaller end stays."""
    leaves = cut(_degrees(edges, 1).select("v", F.col("lo").alias("parent")))
    lone = leaves.alias("x").join(leaves.alias("y"), (F.col("x.parent") == F.col("y.v")) & (F.col("y.parent") == F.col("x.v")) & (F.col("x.v") < F.col("y.v"))).select("x.v")
    removed = cut(leaves.join(lone, "v", "left_anti"))
    gone = removed.select(F.least("v", "parent").alias("a"), F.greatest("v", "parent").alias("b"))
    return cut(edges.join(gone, ["a", "b"], "left_anti")), removed


def _doubled(arcs: DataFrame) -> DataFrame:
    """Every open pointer goes on to where the arc it points to points."""
    ahead = arcs.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("nx").alias("nx2"), F.col("ny").alias("ny2"), F.col("end").alias("end2"), F.col("least").alias("least2"))
    return arcs.join(ahead, ["nx", "ny"], "left").select(
        "x", "y", F.least("least", "least2").alias("least"),
        F.when(F.col("end").isNull() & F.col("end2").isNull(), F.col("nx2")).alias("nx"),
        F.when(F.col("end").isNull() & F.col("end2").isNull(), F.col("ny2")).alias("ny"),
        F.coalesce("end", "end2").alias("end"),
    )


def _compress(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace every chain of degree-two vertices by one edge between its ends: (edges left, removed).

    An arc x -> y out of a chain vertex points to the next arc of the walk; pointers double until they
    leave the chain. Rings have no end: their smallest vertex, carried along, becomes the parent.
    """
    mid = cut(_degrees(edges, 2).filter("deg = 2").select("v", "lo", "hi"))
    if mid.isEmpty():
        return edges, mid.select("v", F.col("lo").alias("parent"))
    arcs = mid.select(F.col("v").alias("x"), F.explode(F.array("lo", "hi")).alias("y"))
    step = mid.select(F.col("v").alias("y"), "lo", "hi")
    arcs = arcs.join(step, "y", "left").select(
        "x", "y", F.least("x", "y").alias("least"),
        F.when(F.col("lo").isNotNull(), F.col("y")).alias("nx"),
        F.when(F.col("lo").isNotNull(), F.when(F.col("lo") == F.col("x"), F.col("hi")).otherwise(F.col("lo"))).alias("ny"),
        F.when(F.col("lo").isNull(), F.col("y")).alias("end"),
    )
    arcs, before = cut(arcs), None
    while True:
        state = arcs.agg(F.count_if(F.col("end").isNull()).alias("open"), F.sum(F.when(F.col("end").isNull(), F.xxhash64("x", "y", "least").cast("decimal(38,0)"))).alias("mark")).first()
        if state["open"] == 0 or state == before:
            break
        before = state
        arcs = cut(_doubled(_doubled(arcs)))
    chains = cut(arcs.groupBy("x").agg(F.min("end").alias("e1"), F.max("end").alias("e2"), F.min("least").alias("least")))
    removed = cut(chains.select(F.col("x").alias("v"), F.coalesce("e1", "least").alias("parent")).filter("v != parent"))
    chain_v = chains.select(F.col("x").alias("v"))
    kept = edges.join(chain_v.withColumnRenamed("v", "a"), "a", "left_anti").join(chain_v.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b")
    bridges = chains.filter("e1 < e2").select(F.col("e1").alias("a"), F.col("e2").alias("b"))
    return cut(kept.unionByName(bridges).distinct()), removed


def _core(edges: DataFrame) -> DataFrame:
    """(v, parent) with parent the smallest vertex of the component, by large-star and small-star steps."""
    before = None
    while True:
        half = _halves(edges)
        low = half.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = _edges(half.join(low, "v").filter("u > v").select(F.col("u").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut(_edges(small))
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")).first()
        if state == before:
            return edges.select(F.col("b").alias("v"), F.col("a").alias("parent"))
        before = state


def connected_groups(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, group) for every node of ``pairs``; group is the smallest node linked directly or over others.

    Nodes may be of any ordered type. Pairs with a null end are ignored, repeated and reversed pairs and
    loops add nothing (a node that occurs in loops only gives no row); an empty input gives no row. Other
    columns of ``pairs`` are ignored, whatever their names.
    """
    edges = cut(_edges(pairs.select(F.col(src).alias("a"), F.col(dst).alias("b"))))
    nodes = _halves(edges).select("v").distinct()
    removed: list[DataFrame] = []
    left = edges.count()
    while left:
        edges, out = _strip(edges)
        removed.append(out)
        if edges.isEmpty():
            left = 0
            break
        edges, out = _compress(edges)
        removed.append(out)
        before, left = left, edges.count()
        if left > CORE_SHARE * before:
            removed.append(_core(edges))
            break
    labels: DataFrame | None = None
    for k, out in enumerate(reversed(removed)):
        if labels is None:
            labels = out.select("v", F.col("parent").alias("label"))
        else:
            found = out.join(labels.select(F.col("v").alias("parent"), "label"), "parent", "left").select("v", F.coalesce("label", "parent").alias("label"))
            labels = found.unionByName(labels)
        if k % 4 == 3:
            labels = cut(labels)
    if labels is None:
        return nodes.select(F.col("v").alias("node"), F.col("v").alias("group"))
    labels = cut(nodes.join(labels, "v", "left").select("v", F.coalesce("label", "v").alias("label")))
    names = labels.groupBy("label").agg(F.min("v").alias("group"))
    return labels.join(names, "label").select(F.col("v").alias("node"), "group")


def star_pairs(keyed: DataFrame, key: str, node: str) -> DataFrame:
    """(src, dst): every node that shares ``key`` tied to the smallest node with that key, one row per node and key.

    Linear in the input however many nodes share a key; the minimum is pre-aggregated before the shuffle.
    """
    pairs = keyed.select(F.col(key).alias("k"), F.col(node).alias("n")).filter("k is not null and n is not null").distinct()
    low = pairs.groupBy("k").agg(F.min("n").alias("m"), F.count("*").alias("c")).filter("c > 1").select("k", "m")
    return pairs.join(low, "k").filter("n != m").select(F.col("m").alias("src"), F.col("n").alias("dst"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
