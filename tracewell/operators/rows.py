"""Operators on keyed rows: versions, top-k, upserts, closures of change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.runtime import cut


def current(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order`` (all falling, nulls last). Rows of a key that tie in all of ``order`` are
    taken as equal. The row limit is applied before the shuffle, so a key with very many versions stays cheap."""
    w = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank from 1. ``order`` should end in a unique column."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)


def new_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not in ``old``, one per key."""
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*new.columns)


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key is not there yet, one per key (idempotent insert)."""
    return old.unionByName(new_rows(old, new, key))


def expire(rows: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``rows`` with ``column`` set to the time of a change (keys, at) where it is still null; others stay as they are."""
    c = changes.groupBy(*keys).agg(F.min("at").alias("__at"))
    return rows.join(c, keys, "left").withColumn(column, F.coalesce(column, "__at")).select(*rows.columns)


def replace_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with rows of equal key replaced by those of ``new`` (one per key)."""
    fresh = new.dropDuplicates(key)
    return old.join(fresh.select(*key), key, "left_anti").select(*old.columns).unionByName(fresh)


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of entities on canonical_name: arrays united, counts taken anew, latest type and last_seen, earliest
    first_seen, description and embedding only replaced by known values.

    Both have (canonical_name, entity_type, aliases, atom_ids, description, embedding, first_seen, last_seen, seq), seq
    giving the order of arrival; null arrays count as empty. Array elements are united as a set of rows before they are
    gathered, so a repeated id costs nothing; they come out sorted.
    """
    rows = old.unionByName(new)

    def united(column: str) -> DataFrame:
        each = rows.select("canonical_name", F.explode(column).alias("x")).filter("x is not null").distinct()
        return each.groupBy("canonical_name").agg(F.array_sort(F.collect_list("x")).alias(column))

    one = rows.groupBy("canonical_name").agg(
        F.max_by("entity_type", "seq").alias("entity_type"),
        F.min_by("first_seen", "seq").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max_by("description", F.when(F.col("description").isNotNull(), F.col("seq"))).alias("description"),
        F.max_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("seq"))).alias("embedding"),
    )
    one = one.join(united("aliases"), "canonical_name", "left").join(united("atom_ids"), "canonical_name", "left")
    none = F.array().cast("array<string>")
    return one.withColumns({"aliases": F.coalesce("aliases", none), "atom_ids": F.coalesce("atom_ids", none)}).withColumn("atom_count", F.size("atom_ids"))


def set_flag(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Soft delete: ``column`` of rows whose key is in ``changes`` (key, value) is set where it is null."""
    c = changes.select(F.col(key), F.col("value").alias("__value")).dropDuplicates([key])
    return df.join(c, key, "left").withColumn(column, F.coalesce(column, "__value")).drop("__value").select(*df.columns)


def closure(edges: DataFrame, roots: DataFrame, src: str, dst: str, node: str = "node") -> DataFrame:
    """(node, depth) of everything that depends on ``roots`` directly or over others, once each, at its least depth.

    The roots themselves are not included unless a ring leads back to them. Each step joins only the newest nodes and
    drops the known ones, so rings end; nulls have no dependents.
    """
    e = cut(edges.select(F.col(src).alias("s"), F.col(dst).alias("t")).filter("s is not null and t is not null").distinct())
    front, found, depth = roots.select(F.col(roots.columns[0]).alias("s")).distinct(), None, 0
    while True:
        depth += 1
        step = e.join(front, "s").select(F.col("t").alias(node)).distinct()
        if found is not None:
            step = step.join(found.select(node), node, "left_anti")
        step = cut(step.withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            return step if found is None else found
        found = step if found is None else cut(found.unionByName(step))
        front = step.select(F.col(node).alias("s"))


def compare_counts(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b, delta) over all keys of two (key, value) frames; a missing value counts as 0."""
    left, right = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    both = left.join(right, key, "full_outer").na.fill(0, ["a", "b"])
    return both.withColumn("delta", F.col("b") - F.col("a"))


def fallback(frames: list[DataFrame], limit: int, order: list[Column]) -> DataFrame:
    """Rows of the first frame that has any, in order, ``limit`` at most; all frames share one schema."""
    rows = None
    for k, f in enumerate(frames):
        f = f.withColumn("__p", F.lit(k))
        rows = f if rows is None else rows.unionByName(f)
    first = rows.agg(F.min("__p").alias("__first"))
    return rows.join(F.broadcast(first), F.col("__p") == F.col("__first")).drop("__p", "__first").orderBy(*order).limit(limit)


def split_holdout(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """``df`` with ``holdout``: true for the share ``ratio`` of keys with the smallest seeded hashes, the same for the
    same seed. The quantile is exact: the number of held-out keys is ``floor(ratio * keys)``, at least one."""
    keys = df.select(key).distinct().withColumn("__h", F.xxhash64(F.lit(seed), key))
    n = max(1, int(keys.count() * ratio))
    last = keys.orderBy("__h", key).limit(n).agg(F.max(F.struct("__h", key)).alias("m"))
    marked = keys.join(F.broadcast(last)).select(key, (F.struct("__h", key) <= F.col("m")).alias("holdout"))
    return df.join(marked, key)
