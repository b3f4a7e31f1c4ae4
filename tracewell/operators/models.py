"""Where models plug in: embeddings, text calls in batches, and what is read from their answers.

No model is part of the engine. A call is an injected function over a batch of texts; the stand-ins here are
deterministic, so pipelines can run and be tested without one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import probe_keywords
from tracewell.runtime import cut

#: Scores from which a contradicted fact is invalidated, or sent to review.
INVALIDATE, REVIEW = 0.85, 0.5
#: Patterns that one pass over the texts tests.
PROBE_BLOCK = 4096


def hash_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Unit vectors of hashed word counts; zero vectors for texts without words."""
    import re
    import zlib

    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1 if h >> 31 else -1
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).tolist()


def embed(rows: DataFrame, text: str, out: str = "embedding", call: Callable[[list[str]], list[list[float]]] = hash_embedding) -> DataFrame:
    """``rows`` with a vector column from a batch function; null texts count as empty."""
    schema = rows.withColumn(out, F.array(F.lit(0.0))).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{out: call(pdf[text].fillna("").tolist())})

    return rows.mapInPandas(run, schema)


def call_in_batches(rows: DataFrame, group: list[str], order: list[str], text: str, size: int, call: Callable[[list[str]], list[str]]) -> DataFrame:
    """``rows`` with ``answer``: texts go to the model in batches of ``size`` per group, in order."""
    w = Window.partitionBy(*group).orderBy(*order)
    rows = rows.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    schema = rows.withColumn("answer", F.lit("")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(answer=call(pdf[text].fillna("").tolist()))

    return rows.groupBy(*group, "batch_no").applyInPandas(run, schema)


def json_object(text: str | None) -> str | None:
    """The first balanced JSON object in a text, fences and talk around it ignored; null without one."""
    start = (text or "").find("{")
    while start >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif c == "\\":
                skip = quoted
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += (c == "{") - (c == "}")
                if depth == 0:
                    try:
                        return json.dumps(json.loads(text[start : i + 1]))
                    except ValueError:
                        break
        start = text.find("{", start + 1)
    return None


def json_answers(rows: DataFrame, text: str, out: str = "json") -> DataFrame:
    """``rows`` with the first JSON object of each answer."""
    get = F.pandas_udf(lambda s: s.map(json_object), "string")
    return rows.withColumn(out, get(F.col(text)))


def contradiction_action(score: Column) -> Column:
    """invalidate, review or null."""
    return F.when(score >= INVALIDATE, "invalidate").when(score >= REVIEW, "review")


def dry_refine(turn_text: Column) -> Column:
    """What stands in for a model's summary of a cluster: its first 200 characters."""
    return F.substring(F.coalesce(turn_text, F.lit("")), 1, 200)


def probe_texts(files: DataFrame, probes: DataFrame, most: int = 50) -> DataFrame:
    """(form_id, outcome, confirms, denies) from pattern probes over texts.

    files: (file, text); probes: (form_id, probe_id, pattern, denies), patterns being substrings, any case. A probe hits
    if any file holds its pattern; ``most`` matches of a probe are counted. Distinct patterns are dealt into blocks of about
    ``PROBE_BLOCK``; a pass over the texts tests one block, which is all that is sent to the tasks, and hits are combined
    before the shuffle. Empty and null patterns hit nothing.
    """
    patterns = cut(probes.select(F.lower("pattern").alias("pattern")).filter("pattern != ''").distinct())
    blocks = max(1, -(-patterns.count() // PROBE_BLOCK))
    patterns = patterns.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks)))
    texts, hits = files.select("file", F.lower("text").alias("t")), None
    for k in range(blocks):
        packed = patterns.filter(F.col("block") == k).agg(F.collect_list("pattern").alias("ps"))
        found = texts.join(F.broadcast(packed)).select(F.explode(F.filter("ps", lambda p: F.contains(F.col("t"), p))).alias("pattern"))
        found = found.groupBy("pattern").agg(F.least(F.count("*"), F.lit(most)).alias("n"))
        hits = found if hits is None else hits.unionByName(found)
    hits = probes.select("form_id", "probe_id", F.lower("pattern").alias("pattern")).join(hits, "pattern").select("form_id", "probe_id", "n")
    rows = probes.join(hits, ["form_id", "probe_id"], "left").groupBy("form_id").agg(F.count_if((F.col("n") > 0) & ~F.col("denies")).alias("confirms"), F.count_if((F.col("n") > 0) & F.col("denies")).alias("denies"))
    outcome = F.when(F.col("confirms") > F.col("denies"), "confirmed").when(F.col("denies") > F.col("confirms"), "disconfirmed").otherwise("inconclusive")
    return rows.select("form_id", outcome.alias("outcome"), "confirms", "denies")


def json_array(text: str | None) -> str | None:
    """The first JSON list in a text, fences and talk around it ignored; null without one."""
    decoder, start = json.JSONDecoder(), (text or "").find("[")
    while start >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, start)[0])
        except ValueError:
            start = text.find("[", start + 1)
    return None


def list_prompts(rows: DataFrame, group: str, order: str, line: Column, title: str) -> DataFrame:
    """(group, prompt): a prompt per group that lists its rows in order below a title; callers keep the rows of a group few."""
    lines = rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda s: s["l"]), "\n").alias("ls"))
    return lines.select(group, F.concat(F.lit(title), group, F.lit("\n"), "ls").alias("prompt"))


def synthesize_if_long(rows: DataFrame, text: str, instruction: str, threshold: int, call: Callable[[list[str]], list[str]] | None) -> DataFrame:
    """``rows`` with ``text`` replaced by a model's answer where it is longer than ``threshold``; without a call nothing is."""
    if call is None:
        return rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            long = pdf[text].fillna("").str.len() > threshold
            if long.any():
                pdf = pdf.copy()
                pdf.loc[long, text] = call([f"{instruction}\n\n---\n{t}\n---" for t in pdf.loc[long, text]])
            yield pdf

    return rows.mapInPandas(run, rows.schema)


def build_probes(forms: DataFrame) -> DataFrame:
    """(form_id, probe_id, pattern, denies): what is looked for to test a form. A claim by its subject and object, and denied by
    words for replacing or removing its subject; a decision by three keywords, rules and plans by two, others by three."""
    kw = probe_keywords(F.col("content"))
    many = F.when(F.col("form_type").isin("rule", "plan"), 2).otherwise(3)
    words = F.transform(F.slice(kw, 1, 3), lambda w, k: F.struct(F.concat(F.lit("word"), k.cast("string")).alias("probe_id"), w.alias("pattern"), F.lit(False).alias("denies")))
    subject, obj = F.coalesce("subject", F.lit("")), F.coalesce("object", F.lit(""))
    one = lambda name, p, no: F.struct(F.lit(name).alias("probe_id"), p.alias("pattern"), F.lit(no).alias("denies"))
    gone = [one(f"gone{k}", F.concat(F.lit(v + " "), subject), True) for k, v in enumerate(("replaced", "replace", "removed", "remove", "dropped", "drop", "migrated", "migrate", "switched", "switch"))]
    claim = F.filter(F.array(one("subject", subject, False), one("object", F.when(obj != subject, obj).otherwise(""), False), *[F.when(subject != "", g) for g in gone]), lambda p: p["pattern"] != "")
    probes = F.when(F.col("form_type") == "claim", claim).otherwise(F.slice(words, 1, many))
    return forms.select(F.col("id").alias("form_id"), F.explode(probes).alias("p")).select("form_id", "p.*")


def prior_of(confidence: Column) -> tuple[Column, Column]:
    """Alpha and beta that stand for a confidence held before: eight tests' worth."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))
    return 8 * c, 8 * (1 - c)
