"""The pN queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import name_form, ref_key
from tracewell.llm.components import connected_groups, star_pairs
from tracewell.llm.cooccurrence import pair_lift
from tracewell.llm.mixing import mix_documents, mix_report, mixing_rates
from tracewell.llm.neighbors import nearest_pairs, usable_vectors
from tracewell.llm.packing import pack
from tracewell.llm.restatements import restatement_groups
from tracewell.llm.spellings import variant_names
from tracewell.llm.subjects import NONE, subject_areas
from tracewell.llm.tokens import with_tokens
from tracewell.runtime import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").select("id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array()))).alias("s"))
    keyed = rows.select("id", name_form(F.col("s")).alias("s")).filter("s != ''")
    groups = connected_groups(star_pairs(keyed, "s", "id"))
    return groups.select(F.col("node").alias("entity_id"), F.col("group").alias("group_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").select("id", "embedding").unionByName(table(spark, d, "logical_forms").select("id", "embedding"))
    return nearest_pairs(usable_vectors(rows, "id", "embedding", 64), 64, 5)


def _session_names(spark: SparkSession, d: str) -> DataFrame:
    atoms = table(spark, d, "atoms").select("session_ids", "entities")
    rows = atoms.select(F.explode(F.array_distinct("session_ids")).alias("session"), "entities").select("session", F.explode("entities").alias("n"))
    return rows.select("session", name_form(F.col("n")).alias("name")).filter("name != ''")


def _sessions(spark: SparkSession, d: str) -> int:
    return table(spark, d, "atoms").select(F.explode("session_ids").alias("s")).filter("s is not null").distinct().count()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = pair_lift(_session_names(spark, d), "session", "name", 6, 4.0, _sessions(spark, d))
    return pairs.select(F.col("item_a").alias("name_a"), F.col("item_b").alias("name_b"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs with their counts, lift and mutual information, beside the weight of the relation between records of
    those names and the co-activations measured before (the largest of each; null where there is none)."""
    pairs = pair_lift(_session_names(spark, d), "session", "name", 1, 0.0, _sessions(spark, d))
    ids = table(spark, d, "entities").select("id", name_form(F.col("canonical_name")).alias("n")).filter("n != ''").distinct()

    def edges(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
        ends = rows.select(ref_key(F.col(a)).alias("a"), ref_key(F.col(b)).alias("b"), F.col(value).cast("double").alias("v"))
        named = ends.join(ids.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(ids.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
        return named.groupBy(F.least("na", "nb").alias("item_a"), F.greatest("na", "nb").alias("item_b")).agg(F.max("v").alias(value))

    weights = edges(table(spark, d, "relations").filter("relation_type = 'related_to'"), "source_entity", "target_entity", "weight")
    measured = edges(table(spark, d, "metrics"), "entity_a", "entity_b", "coactivations")
    pairs = pairs.withColumns({"lift": F.round("lift", 6), "pmi": F.round("pmi", 6)})
    return pairs.join(weights, ["item_a", "item_b"], "left").join(measured, ["item_a", "item_b"], "left")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "atoms").select("id", "content").unionByName(table(spark, d, "facts").select("id", "content"))
    groups = restatement_groups(texts, "id", "content", 0.75, 8)
    return groups.select(F.col("node").alias("record_id"), F.col("group").alias("group_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    mentions = table(spark, d, "atoms").select(F.explode("entities").alias("n"))
    return variant_names(table(spark, d, "entities"), "id", "canonical_name", "aliases", mentions)


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", name_form(F.col("source")).alias("source"))
    return cut(with_tokens(docs, "text", ["doc_id", "source"]))


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    """(spec_id, doc_id, part, n_tokens, window_id): every document placed in a window of each capacity."""
    sized = _sized(spark, d)
    specs = table(spark, d, "pack_specs").select("spec_id", "capacity_tokens").distinct().collect()  # a few specs
    packed = [pack(sized, r["capacity_tokens"]).select(F.lit(r["spec_id"]).alias("spec_id"), "doc_id", "part", "n_tokens", "window_id") for r in specs]
    return reduce(DataFrame.unionByName, packed)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Windows, tokens and the share of room used, per capacity."""
    windows = p7_windows(spark, d).groupBy("spec_id", "window_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    specs = table(spark, d, "pack_specs").select("spec_id", "capacity_tokens").distinct()
    total = windows.groupBy("spec_id").agg(F.count("*").alias("windows"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return total.join(specs, "spec_id").withColumn("room_used", F.col("tokens") / (F.col("windows") * F.col("capacity_tokens")))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the windows, per capacity: all documents placed, none with tokens lost or twice, no window over its
    capacity, and no document split that would fit."""
    sized = _sized(spark, d).select("doc_id", "n_tokens")
    specs = table(spark, d, "pack_specs").select("spec_id", "capacity_tokens").distinct()
    out = None
    for r in specs.collect():  # a few specs
        placed = cut(pack(sized, r["capacity_tokens"]))
        full = placed.groupBy("window_id").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > r["capacity_tokens"]).alias("overfull"))
        per = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("parts"), F.countDistinct("part").alias("distinct"))
        both = sized.join(per, "doc_id", "left")
        wrong = (F.coalesce("got", F.lit(-1)) != F.col("n_tokens")) | (F.col("parts") != F.col("distinct"))
        row = both.agg(F.count("*").alias("documents"), F.count_if(F.col("got").isNull()).alias("missing"), F.count_if(wrong).alias("wrong"), F.count_if((F.col("parts") > 1) & (F.col("n_tokens") <= r["capacity_tokens"])).alias("split"))
        row = row.join(full).select(F.lit(r["spec_id"]).alias("spec_id"), "documents", "missing", "wrong", "split", "overfull")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of each mix: no document more often than allowed, none of a source without a share, and sizes within a
    tenth of what rate and source give, but for a document or two."""
    sized = _sized(spark, d)
    rates = mixing_rates(sized, table(spark, d, "mix_targets"))
    mixed = mix_documents(sized, rates)
    asked = rates.select("mix_id", "source", "max_repeats", "target_share", "rate", "available")
    over = mixed.join(asked, ["mix_id", "source"], "left").groupBy("mix_id").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("over_repeated"), F.count_if(F.col("target_share").isNull()).alias("unasked"))
    most = sized.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    got = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    off = asked.join(got, ["mix_id", "source"], "left").join(most, "source", "left").na.fill(0, ["tokens", "longest"])
    far = F.abs(F.col("tokens") - F.col("rate") * F.col("available")) > 0.1 * F.col("rate") * F.col("available") + 2 * F.col("longest")
    return over.join(off.groupBy("mix_id").agg(F.count_if(far).alias("off_target")), "mix_id")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """(mix_id, doc_id, source, n_tokens, copies): the selection of each mix."""
    sized = _sized(spark, d)
    return mix_documents(sized, mixing_rates(sized, table(spark, d, "mix_targets")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Targets and the shares really reached, per mix and source."""
    sized = _sized(spark, d)
    rates = mixing_rates(sized, table(spark, d, "mix_targets"))
    return mix_report(mix_documents(sized, rates), rates)


def p9_subjects(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, subject_area) of all documents, hand-labelled or not."""
    areas = sorted(r["subject_area"] for r in table(spark, d, "subject_areas").select("subject_area").distinct().collect() if r["subject_area"] not in (None, NONE))
    labels = table(spark, d, "doc_labels").select(F.col("doc_id").alias("doc"), F.col("subject_area").alias("subject"))
    return subject_areas(table(spark, d, "documents"), "doc_id", "text", labels, areas).select(F.col("doc").alias("doc_id"), F.col("subject").alias("subject_area"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_subjects(spark, d).join(table(spark, d, "doc_labels").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "subject_area").distinct()


def p9_makeup(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters of each subject, and their share of the corpus."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    total = docs.agg(F.count("*").alias("all_docs"), F.sum("n_chars").alias("all_chars"))
    per = p9_subjects(spark, d).distinct().join(docs, "doc_id").groupBy("subject_area").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return per.join(F.broadcast(total)).select("subject_area", "docs", "chars", (F.col("docs") / F.col("all_docs")).alias("doc_share"), (F.col("chars") / F.col("all_chars")).alias("char_share"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p4_pairs, p5_found, p7_windows, p7_report, p7_checks, p8_mix, p8_shares, p8_checks, p9_found, p9_makeup)
}
