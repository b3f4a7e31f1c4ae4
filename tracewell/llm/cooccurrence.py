"""Items that appear together in a basket, and how much more often than chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one basket that are paired in one task; larger baskets are cut into blocks of about this size.
BLOCK = 512


def pair_lift(baskets: DataFrame, basket: str, item: str, min_count: int = 1, min_lift: float = 0.0, total: int | None = None) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, pmi), item_a < item_b, of pairs in at least ``min_count`` baskets
    with lift = n_ab * n / (n_a * n_b) of at least ``min_lift``; n is ``total`` or the number of baskets with an item.

    Items count once per basket. Rows with a null basket or item are ignored; an empty input gives no row; other
    columns are ignored. Exact: before pairing, an item is left out only if no pair with it can qualify (it is in
    fewer than ``min_count`` baskets, or in more than n / ``min_lift``, where the lift of any pair is too small).
    A basket of any size is paired in blocks by several tasks, so none is collected.
    """
    rows = baskets.select(F.col(basket).alias("s"), F.col(item).alias("i")).filter("s is not null and i is not null").distinct()
    n = total if total is not None else rows.select("s").distinct().count()
    marg = rows.groupBy("i").agg(F.count("*").alias("c")).filter(F.col("c") >= min_count)
    if min_lift > 0:
        marg = marg.filter(F.col("c") * F.lit(min_lift) <= F.lit(n))
    rows = rows.join(marg, "i")
    size = rows.groupBy("s").agg(F.count("*").alias("m")).filter(F.col("m") > 1).select("s", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(size, "s").withColumn("block", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("lo"), F.greatest(F.col("block"), j).alias("hi")))
    rows = rows.select("s", "i", "c", "block", F.explode(meet).alias("m")).select("s", "i", "c", "block", "m.lo", "m.hi")
    a = rows.select("s", "lo", "hi", F.col("i").alias("item_a"), F.col("c").alias("n_a"), F.col("block").alias("ba"))
    b = rows.select("s", "lo", "hi", F.col("i").alias("item_b"), F.col("c").alias("n_b"), F.col("block").alias("bb"))
    pairs = a.join(b, ["s", "lo", "hi"]).filter("item_a < item_b and (lo = hi or ba != bb)")
    counts = pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("n_ab"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    counts = counts.filter((F.col("n_ab") >= min_count) & (F.col("n_ab") * F.lit(n) >= F.lit(min_lift) * F.col("n_a") * F.col("n_b")))
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a") * F.col("n_b"))
    return counts.withColumns({"n": F.lit(n).cast("long"), "lift": lift, "pmi": F.log2(lift)})
