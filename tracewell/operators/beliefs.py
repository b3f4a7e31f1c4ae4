"""Operators on claims and their tests: conflicts, supersession, promotion, lessons, evidence, retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import CONDITION_STOPWORDS, CONFIRM_STOPWORDS, disconfirmation_conditions, keywords, memory_class, stable_id
from tracewell.runtime import cut

#: Signs of failure in a warning.
FAILURE = ["fail"]
# The worlds a form may hold in, with their labels.
WORLDS = {
    "current": "Current", "past": "Past", "planned": "Planned", "possible": "Possible", "contested": "Contested", "rejected": "Rejected",
    "user_belief": "User Belief", "system_belief": "System Belief",
}
#: Forms and atoms of one task, about, unless that gives more than so many tasks; forms (atoms) of a piece, and counters held at once.
FORM_BLOCK, ATOM_BLOCK, TASKS, LINES, CELLS = 32768, 32768, 4096, 8192, 1_000_000
#: Lines of a block that have a word, from which on it is held as a row of all lines.
OFTEN = 64
#: A firing: what a rule wants done; kind is derive, supersede or promote.
FIRING = "rule string, kind string, form_id string, other_id string, content string, confidence double"


def _norm(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def conflict_pairs(forms: DataFrame) -> DataFrame:
    """(subject, predicate, form_a, form_b), form_a < form_b: same subject and predicate (regardless of case and outer
    space), different objects. Of several forms with one object the first (extracted_at, id) stands for it; forms with
    a blank part are ignored. A subject's objects are paired, not its forms."""
    rows = forms.select("id", "extracted_at", _norm("subject").alias("s"), _norm("predicate").alias("p"), _norm("object").alias("o")).filter("s != '' and p != '' and o != ''")
    first = rows.groupBy("s", "p", "o").agg(F.min(F.struct("extracted_at", "id")).alias("f")).select("s", "p", "o", F.col("f.id").alias("id"))
    a, b = first.select("s", "p", F.col("o").alias("oa"), F.col("id").alias("ia")), first.select("s", "p", F.col("o").alias("ob"), F.col("id").alias("ib"))
    pairs = a.join(b, ["s", "p"]).filter("oa < ob")
    return pairs.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.least("ia", "ib").alias("form_a"), F.greatest("ia", "ib").alias("form_b"))


def supersession(forms: DataFrame) -> DataFrame:
    """(form_id, superseded_by): per subject, type and predicate the newest form supersedes all older ones; ties go to
    the smaller id. Forms without a subject are left alone. The newest is found by aggregation, not by a sort of the
    whole group."""
    rows = forms.select("id", "extracted_at", "form_type", _norm("subject").alias("s"), _norm("predicate").alias("p")).filter("s != ''")
    newest = rows.groupBy("s", "form_type", "p").agg(F.max("extracted_at").alias("t"))
    head = rows.join(newest, ["s", "form_type", "p"]).filter("extracted_at = t").groupBy("s", "form_type", "p").agg(F.min("id").alias("head"))
    return rows.join(head, ["s", "form_type", "p"]).filter("id != head").select(F.col("id").alias("form_id"), F.col("head").alias("superseded_by"))


def evidence_counts(forms: DataFrame) -> DataFrame:
    """(form_id, support): distinct sources of a form, its primary one included. Null sources do not count."""
    return forms.select(F.col("id").alias("form_id"), F.size(F.array_distinct(F.filter(F.concat(F.coalesce("source_unit_ids", F.array()), F.array("source_unit_id")), lambda x: x.isNotNull()))).alias("support"))


def stable_promotions(forms: DataFrame, statuses: DataFrame, least: int = 3) -> DataFrame:
    """(form_id, confidence): forms with at least ``least`` sources that are neither stable nor contradicted anywhere;
    confidence rises by 0.1, at most to 1."""
    settled = statuses.filter(F.col("status").isin("stable", "contradicted")).select("form_id").distinct()
    rows = forms.join(evidence_counts(forms), forms["id"] == F.col("form_id")).filter(F.col("support") >= least)
    return rows.join(settled, "form_id", "left_anti").select("form_id", F.least(F.lit(1.0), F.col("confidence") + 0.1).alias("confidence"))


def lessons(forms: DataFrame, signs: list[str] = FAILURE) -> DataFrame:
    """(warning_id, decision_id, shared): warnings that hold a sign of failure with decisions that share an entity.

    A form without entities is matched by its subject. Entities are compared in lower case. A frequent entity is
    split by adaptive execution; the pairs themselves are the result.
    """
    own = F.filter(F.transform(F.coalesce("entity_ids", F.array()), lambda e: F.lower(F.trim(e))), lambda e: e != "")
    things = F.when(F.size(own) > 0, own).otherwise(F.filter(F.array(_norm("subject")), lambda e: e != ""))
    rows = forms.select("id", "form_type", "content", F.explode(F.array_distinct(things)).alias("e"))
    w = rows.filter((F.col("form_type") == "warning") & F.lower(F.coalesce("content", F.lit(""))).rlike("|".join(signs))).select(F.col("id").alias("warning_id"), "e")
    d = rows.filter("form_type = 'decision'").select(F.col("id").alias("decision_id"), "e")
    return w.join(d, "e").groupBy("warning_id", "decision_id").agg(F.count("*").alias("shared"))


def keyword_scores(forms: DataFrame, atoms: DataFrame, least: float = 0.4, digits: int | None = None) -> DataFrame:
    """(form_id, atom_id, score): share of the words of a form (content and triple, without stop words) that an atom has,
    rounded half up to ``digits`` places if given. Forms and atoms without words give no row."""
    return _met(forms.select(F.col("id").alias("form_id"), _said().alias("words"), _no_conditions().alias("conditions")), atoms, "form_id {f}, atom_id {a}, score double", _keyword_rows(least, digits))


def condition_scores(forms: DataFrame, atoms: DataFrame, least: float = 0.3, digits: int | None = None) -> DataFrame:
    """(form_id, atom_id, score): the best share, over the disconfirmation conditions of a form, of its words that an
    atom has, rounded as by ``keyword_scores``. Repeated words of a condition count in its length. Conditions of equal
    words are scored once per atom, not once per form, since most wordings are fixed."""
    return _met(forms.select(F.col("id").alias("form_id"), F.array().cast("array<bigint>").alias("words"), _conditions().alias("conditions")), atoms, "form_id {f}, atom_id {a}, score double", _condition_rows(least, digits))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _said() -> Column:
    return _hashed(keywords(F.concat_ws(" ", "content", "subject", "predicate", "object"), CONFIRM_STOPWORDS))


#: What the conditions of a form are sent as: their length, counting repeats, and their distinct words.
_CONDITIONS = "array<struct<n:int,words:array<bigint>>>"


def _no_conditions() -> Column:
    return F.array().cast(_CONDITIONS)


def _conditions() -> Column:
    texts = disconfirmation_conditions(F.col("form_type"), F.col("content"), F.col("subject"), F.col("predicate"), F.col("object"))
    kw = lambda t: keywords(t, CONDITION_STOPWORDS, 2, distinct=False)
    return F.transform(texts, lambda t: F.struct(F.size(kw(t)).alias("n"), F.array_distinct(_hashed(kw(t))).alias("words")))


def _met(lines: DataFrame, atoms: DataFrame, schema: str, rows: Callable[[_Block, np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """What ``rows`` finds between all forms (form_id, words, conditions) and all atoms.

    Forms and atoms are packed in pieces, a piece a row, and pieces are dealt into partitions; each pair of partitions is one task of a
    cartesian product, which reads both where they lie, and compares in numpy. Pairs go straight into the result, and each form and
    each atom is shuffled once, however many partitions the other side has: disk follows the input. Words are compared as 64-bit hashes.
    """
    lines = cut(lines.filter("size(words) > 0 or size(conditions) > 0"))
    heard = cut(atoms.select(F.col("id").alias("atom_id"), _hashed(keywords(F.coalesce("content", F.lit("")), [])).alias("words")).filter("size(words) > 0"))
    many = heard.count()
    across = max(1, -(-lines.count() // FORM_BLOCK))
    down = max(1, -(-many // ATOM_BLOCK), -(-2 * lines.sparkSession.sparkContext.defaultParallelism // across))
    while across * down > TASKS:
        across, down = (-(-across // 2), down) if across > down else (across, -(-down // 2))
    schema = schema.format(f=lines.schema["form_id"].dataType.simpleString(), a=heard.schema["atom_id"].dataType.simpleString())
    left = _pieces(lines.select("form_id", "words", "conditions"), LINES, "forms").repartition(across)
    right = _pieces(heard, max(1, min(LINES, -(-many // down))), "atoms").repartition(down)
    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(_compare(schema, rows), schema)


def _pieces(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(name): the rows of each partition in pieces of ``size`` rows, each a compressed Arrow stream of one batch."""

    def packed(t: pa.Table) -> pa.RecordBatch:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t.combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=[name])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for b in batches:
            held.append(b)
            many += b.num_rows
            if many >= size:
                t = pa.Table.from_batches(held)
                full = many - many % size
                for lo in range(0, full, size):
                    yield packed(t.slice(lo, size))
                held, many = t.slice(full).to_batches(), many - full
        if many:
            yield packed(pa.Table.from_batches(held))

    return rows.mapInArrow(pack, f"{name} binary")


def _unpacked(piece: pa.Buffer) -> list[pa.Array]:
    return pa.ipc.open_stream(piece).read_next_batch().columns


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and how many each row has."""
    return np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))


class _Block:
    """Forms of a block and the lines in it, one for each form and, after them, one for each different condition."""

    def __init__(self, ids: pa.Array, words: pa.Array, conditions: pa.Array) -> None:
        self.ids, self.forms = ids, len(ids)
        flat, many = _lists(words)
        each, number = conditions.flatten(), np.diff(np.asarray(conditions.offsets))
        cw, cmany = _lists(each.field("words"))
        length, end, at = np.asarray(each.field("n")), np.cumsum(cmany), {}
        line = np.array([at.setdefault((int(n), cw[e - m : e].tobytes()), (len(at), k))[0] for k, (n, m, e) in enumerate(zip(length, cmany, end, strict=True))], np.int64)
        first = np.array([k for _, k in at.values()], np.int64)
        # forms of each condition
        o = np.argsort(line, kind="stable")
        self.holder, self.held = np.repeat(np.arange(self.forms), number)[o], np.r_[0, np.cumsum(np.bincount(line, minlength=len(first)))].astype(np.int64)
        flat = np.concatenate([flat, *(cw[end[k] - cmany[k] : end[k]] for k in first)])
        many = np.r_[many, cmany[first]].astype(np.int64)
        self.size = np.r_[many[: self.forms], length[first]].astype(np.int64)
        row = np.repeat(np.arange(len(many)), many)
        self.names, code = np.unique(flat, return_inverse=True)
        seen = np.bincount(code, minlength=len(self.names))
        # words of many lines are added as whole rows, others by the lines that have them
        self.kind = np.uint8 if self.size.max(initial=0) < 255 else np.int32
        often = seen >= OFTEN
        self.place = np.where(often, np.cumsum(often) - 1, -1)
        self.table = np.zeros((int(often.sum()), len(many)), self.kind)
        top = often[code]
        self.table[self.place[code[top]], row[top]] = 1
        o = np.argsort(code, kind="stable")
        self.lines, self.start = row[o], np.r_[0, np.cumsum(seen)].astype(np.int64)

    def need(self, least: float) -> np.ndarray:
        """Words that a line asks for at least; more than it has where it has none."""
        return np.maximum(1, np.ceil(least * self.size - 1e-9)).astype(self.kind)

    def counts(self, words: np.ndarray, many: np.ndarray) -> np.ndarray:
        """How many words of each line (across) each atom (down) has."""
        out = np.zeros((len(many), len(self.size)), self.kind)
        if not len(self.names) or not len(words):
            return out
        code = np.minimum(np.searchsorted(self.names, words), len(self.names) - 1)
        known = self.names[code] == words
        code, row = code[known], np.repeat(np.arange(len(many)), many)[known]
        place = self.place[code]
        top = place >= 0
        edge = np.searchsorted(row[top], np.arange(len(many) + 1))
        place = place[top]
        for k in np.nonzero(np.diff(edge))[0]:
            np.add.reduce(self.table[place[edge[k] : edge[k + 1]]], axis=0, dtype=self.kind, out=out[k])
        code, row = code[~top], row[~top]
        n = self.start[code + 1] - self.start[code]
        entry = np.repeat(self.start[code], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        np.add.at(out.reshape(-1), np.repeat(row, n) * len(self.size) + self.lines[entry], self.kind(1))
        return out

    def best(self, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(atom * forms + form, score), rising: the best score of the conditions of a form that reach ``least``."""
        x, y = np.nonzero(counts[:, self.forms :] >= self.need(least)[self.forms :])
        score = counts[x, y + self.forms] / self.size[y + self.forms]
        n = self.held[y + 1] - self.held[y]
        entry = np.repeat(self.held[y], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key, score = np.repeat(x, n) * self.forms + self.holder[entry], np.repeat(score, n)
        o = np.lexsort((score, key))
        key, score = key[o], score[o]
        last = np.r_[key[1:] != key[:-1], True] if len(key) else np.zeros(0, bool)
        return key[last], score[last]


def _rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Half up, as SQL has it; exact for shares of counts."""
    return x if digits is None else np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _keyword_rows(least: float, digits: int | None) -> Callable[[_Block, np.ndarray], tuple[np.ndarray, ...]]:
    def rows(block: _Block, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        hit = np.flatnonzero(counts >= block.need(least))
        return hit, _rounded(counts.reshape(-1)[hit] / block.size[hit % block.forms], digits)

    return rows


def _condition_rows(least: float, digits: int | None) -> Callable[[_Block, np.ndarray], tuple[np.ndarray, ...]]:
    def rows(block: _Block, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        key, score = block.best(counts, least)
        return key, _rounded(score, digits)

    return rows


def _compare(schema: str, rows: Callable[[_Block, np.ndarray], tuple[np.ndarray, ...]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the forms and atoms of pairs of pieces; ``rows`` gives atom * forms + form and further columns."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, block = None, None
        for b in batches:
            for left, right in zip(b.column(0), b.column(1), strict=True):
                if piece is None or not piece.equals(left.as_buffer()):  # a piece of forms comes with all atoms of the task in turn
                    piece = left.as_buffer()
                    block = _Block(*_unpacked(piece))
                atoms, heard = _unpacked(right.as_buffer())
                words, many = _lists(heard)
                end, step = np.cumsum(many), max(1, CELLS // len(block.size))
                for lo in range(0, len(many), step):
                    n = many[lo : lo + step]
                    key, *more = rows(block, block.counts(words[end[lo] - many[lo] : end[lo + len(n) - 1]], n))
                    if len(key):
                        x, y = key // block.forms, key % block.forms
                        yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(y)), atoms.take(pa.array(x + lo)), *(pa.array(c) for c in more)], names=names)

    return run


def beta_path(tests: DataFrame, key: str, order: list[str], outcome: str) -> DataFrame:
    """``tests`` with alpha, beta and confidence after each test, from a uniform prior; inconclusive ones change nothing."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    yes, no = (F.sum((F.col(outcome) == v).cast("int")).over(w) for v in ("confirmed", "disconfirmed"))
    out = tests.withColumns({"alpha": 1.0 + yes, "beta": 1.0 + no})
    return out.withColumn("confidence", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def repair(alpha: Column, beta: Column, form_type: Column) -> Column:
    """retire, historicize or null by confidence and weight of evidence."""
    c, n = alpha / (alpha + beta), alpha + beta
    return F.when((c < 0.2) & (n >= 5), "retire").when((c < 0.45) & (n >= 3) & form_type.isin("event", "plan"), "historicize")


def passive_outcomes(forms: DataFrame, atoms: DataFrame, digits: int | None = None) -> DataFrame:
    """(form_id, atom_id, confirm, against, outcome) of semantic and procedural atoms against forms, where there is any signal;
    shares are rounded as by ``keyword_scores``."""
    useful = atoms.filter(memory_class(F.col("content"), F.col("topic"), F.col("atom_type")) != "episodic")
    both = forms.select(F.col("id").alias("form_id"), _said().alias("words"), _conditions().alias("conditions"))
    return _met(both, useful, "form_id {f}, atom_id {a}, confirm double, against double, outcome string", _outcome_rows(digits))


def _outcome_rows(digits: int | None) -> Callable[[_Block, np.ndarray], tuple[np.ndarray, ...]]:
    names = pa.array(["inconclusive", "confirmed", "disconfirmed"])

    def rows(block: _Block, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        said = counts[:, : block.forms]
        against, share = block.best(counts, 0.3)
        x, y = np.nonzero(said >= block.need(0.4)[: block.forms])
        # a pair that neither confirms nor speaks against tells nothing
        key = np.union1d(x * block.forms + y, against)
        dis = np.zeros(len(key))
        dis[np.searchsorted(key, against)] = share
        x, y = key // block.forms, key % block.forms
        n = said[x, y]
        con = np.where(n >= block.need(0.3)[y], n / np.maximum(block.size[y], 1), 0.0)
        kind = np.where((dis >= 0.5) & (dis > con), 2, np.where(con >= 0.4, 1, 0))
        return key, _rounded(con, digits), _rounded(dis, digits), names.take(pa.array(kind))

    return rows


@dataclass
class Rule:
    """A rule sees the state at the start of a pass and says what it wants done."""

    name: str
    evaluate: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def _firing(df: DataFrame, rule: str, kind: str, form: str, other: Column, content: Column, confidence: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.col(form).alias("form_id"), other.cast("string").alias("other_id"), content.cast("string").alias("content"), confidence.cast("double").alias("confidence"))


def _conflict_rule(forms: DataFrame, derived: DataFrame, statuses: DataFrame) -> DataFrame:
    live = forms.filter("superseded_by is null")
    return _firing(conflict_pairs(live), "conflict", "derive", "form_a", F.col("form_b"), F.concat_ws(" ", "subject", "predicate"), F.lit(0.8))


def _supersession_rule(forms: DataFrame, derived: DataFrame, statuses: DataFrame) -> DataFrame:
    return _firing(supersession(forms.filter("superseded_by is null")), "supersession", "supersede", "form_id", F.col("superseded_by"), F.lit(None), F.lit(1.0))


def _stable_rule(forms: DataFrame, derived: DataFrame, statuses: DataFrame) -> DataFrame:
    return _firing(stable_promotions(forms.filter("superseded_by is null"), statuses), "stable", "promote", "form_id", F.lit(None), F.lit(None), F.col("confidence"))


def _lesson_rule(forms: DataFrame, derived: DataFrame, statuses: DataFrame) -> DataFrame:
    return _firing(lessons(forms.filter("superseded_by is null")), "lesson", "derive", "warning_id", F.col("decision_id"), F.lit("lesson"), F.lit(0.7))


RULES = [Rule("conflict", _conflict_rule), Rule("supersession", _supersession_rule), Rule("stable", _stable_rule), Rule("lesson", _lesson_rule)]


def run_rules(forms: DataFrame, statuses: DataFrame, rules: list[Rule] = RULES, max_passes: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(forms, statuses, log) after passes to a fixed point, ``max_passes`` at most: all rules see the state at the start
    of a pass, then what fired is applied; a derived object that exists already does not fire again."""
    spark = forms.sparkSession
    log = spark.createDataFrame([], "pass int, " + FIRING)
    forms, statuses = cut(forms), cut(statuses)
    for n in range(1, max_passes + 1):
        fired = None
        for rule in rules:
            f = rule.evaluate(forms, log, statuses)
            fired = f if fired is None else fired.unionByName(f)
        seen = log.select("rule", "form_id", F.coalesce("other_id", F.lit("")).alias("o"))
        fired = fired.withColumn("o", F.coalesce("other_id", F.lit(""))).join(seen, ["rule", "form_id", "o"], "left_anti").drop("o").distinct()
        fired = cut(fired.select(F.lit(n).alias("pass"), "rule", "kind", "form_id", "other_id", "content", "confidence"))
        if fired.isEmpty():
            break
        log = cut(log.unionByName(fired))
        by = fired.filter("kind = 'supersede'").groupBy(F.col("form_id").alias("id")).agg(F.min("other_id").alias("__by"))
        up = fired.filter("kind = 'promote'").groupBy(F.col("form_id").alias("id")).agg(F.max("confidence").alias("__c"))
        columns = forms.columns
        forms = cut(forms.join(by, "id", "left").join(up, "id", "left").withColumn("superseded_by", F.coalesce("superseded_by", "__by")).withColumn("confidence", F.coalesce("__c", "confidence")).select(*columns))
        new = up.select(F.col("id").alias("form_id"), F.lit("stable").alias("status"))
        statuses = cut(statuses.select("form_id", "status").unionByName(new).distinct())
    return forms, statuses, log


def beliefs_for(topic: str, forms: DataFrame, statuses: DataFrame, n: int = 8) -> DataFrame:
    """(stage, rank, id, content, confidence): the best stable, active and doubtful forms on a topic (a substring of
    content, subject or object, any case), at most ``n`` of each stage."""
    t = topic.lower()
    near = F.lower(F.concat_ws("\n", "content", "subject", "object")).contains(t)
    rows = forms.filter(near).join(statuses.select("form_id", "status").distinct(), forms["id"] == F.col("form_id"))
    stage = F.when(F.col("status") == "stable", "stable").when(F.col("status") == "active", "active").when(F.col("status").isin("contradicted", "decayed", "superseded"), "caution")
    rows = rows.withColumn("stage", stage).filter("stage is not null").groupBy("stage", "id").agg(F.first("content").alias("content"), F.max("confidence").alias("confidence"))
    w = Window.partitionBy("stage").orderBy(F.desc("confidence"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def derive_forms(facts: DataFrame) -> DataFrame:
    """Facts as forms: semantic to claim, episodic to event, procedural to rule; the subject is the first entity, else the
    topic; an invalidated fact is past and superseded."""
    kind = F.when(F.col("memory_type") == "episodic", "event").when(F.col("memory_type") == "procedural", "rule").otherwise("claim")
    gone = F.col("invalidated_by").isNotNull()
    return facts.select(
        stable_id(F.lit("form"), F.col("id")).alias("form_id"), kind.alias("form_type"), "content", F.coalesce(F.try_element_at("entities", F.lit(1)), F.col("topic")).alias("subject"),
        "confidence", F.when(gone, "past").otherwise("current").alias("world_id"), F.when(gone, "superseded").otherwise("active").alias("status"),
    )


def new_pairs(found: DataFrame, known: DataFrame, a: str = "form_a", b: str = "form_b") -> DataFrame:
    """``found`` without the pairs that ``known`` holds in either direction."""
    seen = known.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()
    return found.join(seen, [a, b], "left_anti")


def belief_block(forms: DataFrame, statuses: DataFrame, topic: str | None = None, slug: str | None = None, most: tuple[int, int, int] = (8, 5, 3), chars: int = 2000) -> DataFrame:
    """One row (block): bullets of what holds everywhere and now, of what holds for a project, and of what is contested or
    rejected, ``most`` of each, cut to ``chars`` characters. statuses: (form_id, status, world_id), those that have not ended.

    A topic is a substring of content, subject or predicate. A stage without rows is left out; without any the block is empty.
    """
    rows = forms.join(statuses, forms["id"] == F.col("form_id"))
    if topic:
        rows = rows.filter(F.lower(F.concat_ws("\n", "content", "subject", "predicate")).contains(topic.lower()))
    live = F.col("status").isin("active", "stable")
    kind = F.concat(F.lit("- ["), "form_type", F.lit("] "), F.substring("content", 1, 120))
    stages = [
        ("### Known Beliefs (global stable)", (F.col("scope_type") == "global") & (F.col("world_id") == "current") & live, [F.desc("confidence"), F.desc("extracted_at"), F.col("id")], F.concat(kind, F.when(F.col("status") == "stable", " [STABLE]").otherwise(""))),
        ("\n### Project Beliefs (this slug)", (F.col("scope_type") == "project") & (F.col("scope_id") == F.lit(slug)) & F.col("world_id").isin("current", "planned") & live, [F.desc("confidence"), F.col("id")], kind),
        ("\n### Caution (contested/rejected)", F.col("world_id").isin("contested", "rejected"), [F.desc("extracted_at"), F.col("id"), F.col("world_id")], F.concat(F.lit("- [!] "), F.substring("content", 1, 100), F.lit(" (status: "), F.coalesce("status", F.lit("?")), F.lit(")"))),
    ]
    lines = None
    for k, ((title, which, order, line), n) in enumerate(zip(stages, most, strict=True)):
        top = rows.filter(which).orderBy(*order).limit(n).select(*forms.columns, "status", "world_id")
        part = top.select(F.lit(k).alias("stage"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("r"), line.alias("l"))  # n rows
        part = part.unionByName(part.limit(1).select("stage", F.lit(0).alias("r"), F.lit(title).alias("l")))
        lines = part if lines is None else lines.unionByName(part)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stage", "r", "l"))), lambda s: s["l"]), "\n")
    return lines.agg(text.alias("t")).select(F.when(F.length("t") > chars, F.concat(F.substring("t", 1, chars - 20), F.lit("\n... (truncated)"))).otherwise(F.col("t")).alias("block"))


# Derived objects whose sources are promoted.
DURABLE = ["lesson", "design_rule", "anti_pattern", "heuristic", "stable_belief"]


def promote_sources(forms: DataFrame, derived: DataFrame, slug: str | None = None) -> DataFrame:
    """``forms`` in which the sources of durable derived objects (type, source_form_ids, invalidated_at) that are of a project, of
    ``slug`` if given, hold everywhere; what was invalidated promotes nothing."""
    live = derived.filter(F.col("type").isin(DURABLE) & F.col("invalidated_at").isNull())
    source = live.select(F.explode("source_form_ids").alias("id")).filter("id is not null").distinct().withColumn("__s", F.lit(True))
    mine = (F.col("scope_type") == "project") & ((F.col("scope_id") == slug) if slug else F.lit(True))
    up = F.coalesce(F.col("__s"), F.lit(False)) & F.coalesce(mine, F.lit(False))
    rows = forms.join(source, "id", "left").withColumn("__up", up)
    return rows.withColumn("scope_type", F.when(F.col("__up"), "global").otherwise(F.col("scope_type"))).withColumn("scope_id", F.when(~F.col("__up"), F.col("scope_id"))).select(*forms.columns)


def pending_contradictions(reviews: DataFrame) -> DataFrame:
    """(derived_id, type, source_form_ids, confidence): a derived object for each review (new_id, old_id, score, decided) that is
    not decided yet; both facts are its sources, by the ids their forms got."""
    form = lambda c: stable_id(F.lit("form"), F.col(c))
    rows = reviews.filter("decided is null and new_id is not null and old_id is not null")
    return rows.select(stable_id(F.lit("contradiction"), F.col("new_id"), F.col("old_id")).alias("derived_id"), F.lit("contradiction").alias("type"), F.array(form("new_id"), form("old_id")).alias("source_form_ids"), F.col("score").alias("confidence")).dropDuplicates(["derived_id"])


def explain(form_id: str, forms: DataFrame, statuses: DataFrame, derived: DataFrame, log: DataFrame) -> DataFrame:
    """(part, detail) on one form: itself, its statuses, what was derived from it and what rules did with it. derived:
    (derived_id, type, source_form_ids); log: (rule, kind, form_id, other_id)."""
    me = F.lit(form_id)
    parts = [
        forms.filter(F.col("id") == me).select(F.lit("form").alias("part"), F.concat_ws(" ", "form_type", "content").alias("detail")),
        statuses.filter(F.col("form_id") == me).select(F.lit("status").alias("part"), F.concat_ws(" ", "world_id", "status").alias("detail")),
        derived.filter(F.array_contains("source_form_ids", me)).select(F.lit("derived").alias("part"), F.concat_ws(" ", "type", "derived_id").alias("detail")),
        log.filter((F.col("form_id") == me) | (F.col("other_id") == me)).select(F.lit("log").alias("part"), F.concat_ws(" ", "rule", "kind").alias("detail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Rules by the name of their module; ``personal`` is what comes with the engine.
MODULES: dict[str, list[Rule]] = {"personal": RULES}


def register_module(name: str, rules: list[Rule]) -> None:
    """Add a module of rules; a name is given once."""
    if name in MODULES:
        raise ValueError(f"there is a module {name} already")
    MODULES[name] = rules


def module_rules(name: str) -> list[Rule]:
    if name not in MODULES:
        raise ValueError(f"there is no module {name}; known are {', '.join(sorted(MODULES))}")
    return MODULES[name]


def world_counts(statuses: DataFrame) -> DataFrame:
    """(world_id, label, status, n) of statuses by world, with the world's label; worlds that are not known have none."""
    worlds = statuses.sparkSession.createDataFrame(list(WORLDS.items()), "world_id string, label string")
    return statuses.groupBy("world_id", "status").agg(F.count("*").alias("n")).join(F.broadcast(worlds), "world_id", "left").select("world_id", "label", "status", "n")
