"""Mixing sources to target shares of the total token count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import name_form


def mixing_rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, available, wanted, rate): copies of each document per source.

    sized: (doc_id, source, n_tokens) with source in name form or null; targets: (mix_id, doc_source, target_share,
    max_repeats, budget_ratio). wanted = target_share * budget_ratio * all tokens; rate = wanted / available, at most
    max_repeats, 0 where nothing is available. Shares of sources that hit the cap are not handed to others.
    """
    per = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    total = sized.agg(F.sum("n_tokens").alias("corpus"))
    want = targets.select("mix_id", name_form(F.col("doc_source")).alias("source"), "target_share", "max_repeats", "budget_ratio")
    want = want.join(F.broadcast(total)).withColumn("wanted", F.col("target_share") * F.col("budget_ratio") * F.col("corpus"))
    rate = F.when(F.col("available") > 0, F.least(F.col("wanted") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return want.join(per, "source", "left").select("mix_id", "source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), "wanted", rate.alias("rate"))


def mix_documents(sized: DataFrame, rates: DataFrame, seed: int = 11) -> DataFrame:
    """(mix_id, doc_id, source, n_tokens, copies): each document floor(rate) times plus one hash-seeded Bernoulli copy
    with probability equal to the fraction; documents with no copy give no row. Documents without a source or of a
    source that no mix names are in no mix. ``rates`` has one row per mix and source, so it is small whatever the
    corpus; the join is on source and leaves broadcast to the size the session allows.
    """
    r = rates.filter("rate > 0").select("mix_id", "source", "rate")
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("mix_id"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + F.when(unit < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return sized.join(r, "source").select("mix_id", "doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).filter("copies > 0")


def mix_report(mixed: DataFrame, rates: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, rate, docs, tokens, actual_share, wanted) per mix and source; sources
    that gave nothing have 0."""
    got = mixed.groupBy("mix_id", "source").agg(F.count("*").alias("docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    total = got.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"))
    rows = rates.join(got, ["mix_id", "source"], "left").join(total, "mix_id", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return rows.select("mix_id", "source", "target_share", "max_repeats", "rate", F.coalesce("docs", F.lit(0)).alias("docs"), tokens.alias("tokens"), F.when(F.col("all_tokens") > 0, tokens / F.col("all_tokens")).otherwise(0.0).alias("actual_share"), "wanted")
