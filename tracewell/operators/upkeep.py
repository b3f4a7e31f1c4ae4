"""Keeping a graph up to date: one batch of new records at a time, communities, probes of pairs, merges by pointer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import name_form
from tracewell.functions.times import week_span
from tracewell.functions.vectors import cosine
from tracewell.operators.graph import name_index, pair_rows, stale_communities
from tracewell.runtime import cut

#: New records after which communities are built anew.
REBUILD_AFTER = 30
#: Targets that are sent to all tasks at once.
TARGET_ROWS = 4096
_NONE = "cast(array() as array<string>)"


@dataclass
class GraphUpdate:
    """``entities``: (entity_id, atom_ids, atom_count, last_seen); ``relations``: (a, b, weight, atom_ids, added, existed);
    ``stale``: (community); ``unresolved``: (name); ``areas``: (area, atom_ids); ``state``: one row (cursor, atoms,
    since_rebuild, should_rebuild)."""

    entities: DataFrame
    relations: DataFrame
    stale: DataFrame
    unresolved: DataFrame
    areas: DataFrame
    state: DataFrame


def _united(old: str, new: str) -> Column:
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(old, F.expr(_NONE)), F.coalesce(new, F.expr(_NONE)))))


def incremental_update(atoms: DataFrame, entities: DataFrame, relations: DataFrame, member: DataFrame, areas: DataFrame, since: int = 0, pending: DataFrame | None = None) -> GraphUpdate:
    """Bring new ``atoms`` (id, entities, tags, time_last, created_at) into the graph; each key of a result is one row.

    Names resolve by ``name_index`` (a canonical name before an alias); those that do not are queued, once each, with what
    is ``pending`` (name). Entities gain the atoms that name them. Every pair named by one atom gains weight 1 for each
    atom its relation (a, b, weight, atom_ids; a < b) does not list yet; pairs without a relation get one. Communities of
    ``member`` (id, community) with a touched entity are stale. Tags resolve to ``areas`` (area, tags, atom_ids) the same
    way as names do: the area's own name first, then its tags. A batch of none changes nothing. ``since``: atoms taken in
    since communities were built last.
    """
    said = cut(atoms.select("id", "time_last", F.explode("entities").alias("n")).select("id", "time_last", name_form(F.col("n")).alias("name")).filter("name != ''").distinct())
    known = cut(said.join(name_index(entities), "name", "left"))
    hits = cut(known.filter("entity_id is not null").select("id", "entity_id", "time_last").distinct())
    gained = hits.groupBy("entity_id").agg(F.collect_set("id").alias("new"), F.max("time_last").alias("seen"))
    old = entities.select(F.col("id").alias("entity_id"), "atom_ids", "last_seen")
    ents = gained.join(old, "entity_id").select("entity_id", _united("atom_ids", "new").alias("atom_ids"), F.greatest("last_seen", "seen").alias("last_seen"))
    ents = ents.withColumn("atom_count", F.size("atom_ids"))
    pairs = pair_rows(hits.select("id", "entity_id").distinct(), "id", "entity_id").groupBy("a", "b").agg(F.collect_set("g").alias("new"))
    rel = pairs.join(relations.select("a", "b", "weight", "atom_ids"), ["a", "b"], "left")
    added = F.size(F.array_except("new", F.coalesce("atom_ids", F.expr(_NONE))))
    rel = rel.select("a", "b", (F.coalesce("weight", F.lit(0.0)) + added).alias("weight"), _united("atom_ids", "new").alias("atom_ids"), added.alias("added"), F.col("weight").isNotNull().alias("existed"))
    unresolved = known.filter("entity_id is null").select("name").distinct()
    if pending is not None:
        unresolved = unresolved.unionByName(pending.select("name")).distinct()
    tags = atoms.select("id", F.explode("tags").alias("t")).select("id", name_form(F.col("t")).alias("name")).filter("name != ''").distinct()
    index = name_index(areas.select(F.col("area").alias("canonical_name"), F.col("tags").alias("aliases"), F.col("area").alias("id"))).withColumnRenamed("entity_id", "area")
    tagged = tags.join(index, "name").groupBy("area").agg(F.collect_set("id").alias("new"))
    grown = tagged.join(areas.select("area", "atom_ids"), "area").select("area", _united("atom_ids", "new").alias("atom_ids"))
    n = F.countDistinct("id")
    state = atoms.agg(F.max("created_at").alias("cursor"), n.alias("atoms"), (F.lit(since) + n).alias("since_rebuild"), (F.lit(since) + n >= REBUILD_AFTER).alias("should_rebuild"))
    return GraphUpdate(ents, rel, stale_communities(member, hits), unresolved, grown, state)


def upsert_communities(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the communities of ``new`` written over whole, but for an embedding that ``new`` does not know; what is
    written is not stale any more. Both have the same columns, ``embedding`` and ``stale`` among them, one row a key."""
    fresh = new.join(old.select(key, F.col("embedding").alias("__e")), key, "left").withColumn("embedding", F.coalesce("embedding", "__e")).withColumn("stale", F.lit(False)).drop("__e")
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def upsert_typed_relations(rows: DataFrame) -> DataFrame:
    """(src, dst, relation_type, weight, description, atom_ids): one row per directed edge and type, its weight 1 however
    many atoms tell of it, the last description, atoms once each. rows: (src, dst, relation_type, description, atom_id, seq)."""
    one = rows.filter("src is not null and dst is not null").groupBy("src", "dst", "relation_type")
    return one.agg(F.lit(1.0).alias("weight"), F.max_by("description", F.when(F.col("description").isNotNull(), F.col("seq"))).alias("description"), F.array_sort(F.collect_set("atom_id")).alias("atom_ids"))


def label_groups(labels: DataFrame) -> DataFrame:
    """(label, size, community_no) from (id, label): groups by size, the largest first, then by label. Members stay rows of
    ``labels``, so that a group of any size is no single row. There is a row per group, so numbering them is bounded."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    return sizes.withColumn("community_no", F.row_number().over(Window.orderBy(F.desc("size"), "label")) - 1)


def leaf_communities(clusters: DataFrame) -> DataFrame:
    """(title, community): the community of each node at its deepest level. clusters: (level, community, parent, title)."""
    return clusters.groupBy("title").agg(F.max_by("community", F.struct("level", "community")).alias("community"))


def community_table(clusters: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, community, parent, children, size, relations, text_units) of a hierarchy (level, community, parent, title)
    that a clustering gave: known members, edges with both ends inside, text units of both, ids of the communities below.

    entities: (title, text_unit_ids); edges: (source, target, text_unit_ids). Members that are no known entity count for
    nothing; parents below zero are none.
    """
    keys = ["level", "community"]
    known = clusters.select(*keys, "title").distinct().join(entities.select("title", F.col("text_unit_ids").alias("units")), "title")
    inside = edges.join(known.select(*keys, F.col("title").alias("source")), "source").join(known.select(*keys, F.col("title").alias("target")), [*keys, "target"])
    units = known.select(*keys, F.explode("units").alias("u")).unionByName(inside.select(*keys, F.explode("text_unit_ids").alias("u"))).groupBy(*keys).agg(F.countDistinct("u").alias("text_units"))
    below = clusters.filter("parent >= 0").select(F.col("parent").alias("community"), F.col("community").alias("child")).distinct().groupBy("community").agg(F.array_sort(F.collect_set("child")).alias("children"))
    base = clusters.groupBy(*keys).agg(F.min("parent").alias("parent"))
    out = base.join(known.groupBy(*keys).agg(F.count("*").alias("size")), keys, "left").join(inside.groupBy(*keys).agg(F.count("*").alias("relations")), keys, "left").join(units, keys, "left").join(below, "community", "left")
    return out.na.fill(0, ["size", "relations", "text_units"]).select(*keys, "parent", F.coalesce("children", F.array().cast("array<int>")).alias("children"), "size", "relations", "text_units")


def community_areas(member: DataFrame, areas: DataFrame) -> DataFrame:
    """(community, area) that share an atom; member: (community, atom), areas: (area, atom)."""
    return member.select("community", "atom").distinct().join(areas.select("area", "atom").distinct(), "atom").select("community", "area").distinct()


def touching_edges(edges: DataFrame, member: DataFrame, src: str, dst: str) -> DataFrame:
    """(community, edges) of edges with an end in the community; one with both ends inside counts once. member: (id, community)."""
    ends = edges.select(src, dst).withColumn("e", F.monotonically_increasing_id()).select("e", F.explode(F.array_distinct(F.array(src, dst))).alias("id"))
    return ends.join(member.select("id", "community"), "id").select("e", "community").distinct().groupBy("community").agg(F.count("*").alias("edges"))


def probe_records(rows: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """The first ``k`` rows (id, content, names) that speak of both names, or, if none does, of either. A name is looked for
    among ``names`` (a substring, any case) and, if no row names it, in the content."""
    text, said = F.lower(F.coalesce("content", F.lit(""))), F.lower(F.array_join(F.coalesce("names", F.array().cast("array<string>")), "\n"))
    at = rows.select("*", *[c for n, name in (("a", a.lower()), ("b", b.lower())) for c in (said.contains(name).alias(f"{n}_named"), text.contains(name).alias(f"{n}_told"))])
    every = at.agg(F.bool_or("a_named").alias("fa"), F.bool_or("b_named").alias("fb"))
    hit = lambda n: F.when(F.col(f"f{n}"), F.col(f"{n}_named")).otherwise(F.col(f"{n}_told"))
    at = at.join(F.broadcast(every)).withColumn("both", hit("a") & hit("b")).withColumn("either", hit("a") | hit("b"))
    found = at.filter("either")
    any_both = found.agg(F.bool_or("both").alias("any_both"))
    return found.join(F.broadcast(any_both)).filter(F.col("both") | ~F.col("any_both")).orderBy("id").limit(k).select(*rows.columns)


def shared_groups(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, groups_a, groups_b, shared, overlap_pct): in how many groups two items are, each and together, and what share
    of the larger number that is, in percent with one digit. pairs: (a, b); rows: (group, item), distinct."""
    rows = cut(rows)
    size = rows.groupBy("item").agg(F.count("*").alias("n"))
    sized = cut(pairs.join(size.select(F.col("item").alias("a"), F.col("n").alias("groups_a")), "a", "left").join(size.select(F.col("item").alias("b"), F.col("n").alias("groups_b")), "b", "left").na.fill(0, ["groups_a", "groups_b"]))
    # the groups of the item that is in fewer are looked up, so that an item of very many groups is not spread over its pairs
    less = F.col("groups_a") <= F.col("groups_b")
    asked = sized.filter("groups_a > 0 and groups_b > 0").select("a", "b", F.when(less, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("many"))
    both = asked.join(rows.select(F.col("item").alias("few"), "group"), "few").join(rows.select(F.col("item").alias("many"), "group"), ["many", "group"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = sized.join(both, ["a", "b"], "left").na.fill(0, ["shared"])
    return out.select("a", "b", "groups_a", "groups_b", "shared", overlap_pct(F.col("shared"), F.col("groups_a"), F.col("groups_b")).alias("overlap_pct"))


def overlap_pct(shared: Column, a: Column, b: Column) -> Column:
    return F.round(100 * shared / F.greatest(a, b, F.lit(1)), 1)


def merge_by_pointer(rows: DataFrame, key: str, to: str) -> DataFrame:
    """(key, root): where each row ends up when rows are merged into the one they point to. A row that points nowhere, or to a
    key that is not there, is its own root; one that points to a merged row follows on. Pointers double, so a chain of
    n takes log n joins; the rows of a ring go to its smallest key."""
    keys = rows.select(key).distinct()
    at = rows.select(key, F.col(to).alias("p")).join(keys.withColumnRenamed(key, "p"), "p", "left_semi").filter(F.col(key) != F.col("p")).groupBy(key).agg(F.min("p").alias("p"))
    at = cut(keys.join(at, key, "left").select(key, F.coalesce("p", key).alias("root"), F.col("p").isNull().alias("ends"), F.col(key).alias("least")))
    before = None
    while True:
        ahead = at.select(F.col(key).alias("root"), F.col("root").alias("next"), F.col("ends").alias("e"), F.col("least").alias("l"))
        # a row has ended once the row it points to has; what never ends goes round in a ring and collects its smallest key
        at = cut(at.join(ahead, "root").select(key, F.when(F.col("ends"), F.col("root")).otherwise(F.col("next")).alias("root"), (F.col("ends") | F.col("e")).alias("ends"), F.least("least", "l").alias("least")))
        state = at.filter("not ends").agg(F.count("*").alias("n"), F.sum(F.xxhash64(key, "least").cast("decimal(38,0)")).alias("mark")).first()
        if state["n"] == 0 or state == before:
            break
        before = state
    ring = at.select(F.col(key).alias("root"), F.col("least").alias("ring"))
    return at.join(ring, "root").select(key, F.when(F.col("ends"), F.col("root")).otherwise(F.col("ring")).alias("root"))


def flatten_metrics(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value): the numbers of a JSON object, nested names joined by dots, up to three levels; true and false,
    texts and lists are left out, and texts that are no JSON give no row."""
    level = rows.select(key, F.lit("").alias("name"), F.col(text).alias("j"))
    out = None
    for _ in range(3):
        inner = level.select(key, "name", F.explode(F.from_json("j", "map<string, string>")).alias("__k", "__v"))
        inner = inner.select(key, F.when(F.col("name") == "", F.col("__k")).otherwise(F.concat_ws(".", "name", "__k")).alias("name"), F.col("__v").alias("j"))
        numbers = inner.filter(F.col("j").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")).select(key, "name", F.col("j").cast("double").alias("value"))
        out = numbers if out is None else out.unionByName(numbers)
        level = inner.filter(F.col("j").startswith("{"))
    return out


def metric_deltas(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, name, before, after, delta) of the metrics (key, name, value) that changed and are in both."""
    both = before.select(key, "name", F.col("value").alias("before")).join(after.select(key, "name", F.col("value").alias("after")), [key, "name"])
    return both.filter("before != after").withColumn("delta", F.col("after") - F.col("before"))


def over_fetch(rows: DataFrame, score: Column, keep: Column, k: int, tie: str) -> DataFrame:
    """At most ``k`` rows in order of score: the best 3 k are fetched first, then those that ``keep`` holds for stay, so that
    fewer than k may come out though more would qualify."""
    best = rows.withColumn("score", score).orderBy(F.desc("score"), tie).limit(3 * k)
    return best.filter(keep).orderBy(F.desc("score"), tie).limit(k)


def trace_hops(entities: DataFrame, text_units: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(community, chunks, sessions, first, last, week_span): from communities over their entities, text units and documents to
    chunks and the sessions those were cut from.

    entities: (community, text_unit_ids); text_units: (id, document_ids or document_id); documents: (id, title), the chunk id being
    what follows ``chunk-`` in the title, else in the id; chunks: (chunk_id, session_ids, first_timestamp). Every hop drops
    what leads nowhere; a community of which nothing is left has zeros and no times; entities without a community do not count.
    """
    known = entities.filter("community is not null")
    unit = known.select("community", F.explode("text_unit_ids").alias("unit")).distinct()
    many = F.coalesce("document_ids", F.array().cast("array<string>")) if "document_ids" in text_units.columns else F.array().cast("array<string>")
    one = F.array("document_id") if "document_id" in text_units.columns else F.array().cast("array<string>")
    docs = text_units.select(F.col("id").alias("unit"), F.explode(F.concat(many, one)).alias("doc")).filter("doc is not null")
    pattern = "chunk-([a-f0-9]+)"
    named, other = F.regexp_extract("title", pattern, 1), F.regexp_extract("id", pattern, 1)
    chunk = documents.select(F.col("id").alias("doc"), F.when(named != "", named).otherwise(other).alias("chunk_id")).filter("chunk_id != ''")
    reached = cut(unit.join(docs, "unit").join(chunk, "doc").select("community", "chunk_id").distinct().join(chunks.select("chunk_id", "session_ids", "first_timestamp"), "chunk_id"))
    times = reached.groupBy("community").agg(F.count("*").alias("chunks"), F.min("first_timestamp").alias("first"), F.max("first_timestamp").alias("last"))
    said = reached.select("community", F.explode("session_ids").alias("s")).groupBy("community").agg(F.countDistinct("s").alias("sessions"))
    out = known.select("community").distinct().join(times, "community", "left").join(said, "community", "left").na.fill(0, ["chunks", "sessions"])
    return out.select("community", "chunks", "sessions", "first", "last", week_span(F.col("first"), F.col("last")).alias("week_span"))


def nearest_above(vectors: DataFrame, targets: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, target, score): the most similar target of each vector if its cosine reaches the threshold; ties to the smaller target.

    vectors: (id, vec); targets: (target, vec), known to be few, such as the centres of areas, and broadcast in parts of
    ``TARGET_ROWS``, so that what is sent at once is bounded whatever their number. Zero vectors are near nothing.
    """
    parts = max(1, -(-targets.count() // TARGET_ROWS))
    best = None
    for k in range(parts):
        some = targets.filter(F.pmod(F.xxhash64("target"), F.lit(parts)) == k).select("target", F.col("vec").alias("to"))
        near = vectors.join(F.broadcast(some)).select("id", "target", cosine(F.col("vec"), F.col("to")).alias("score")).filter(F.col("score") >= threshold)
        best = near if best is None else best.unionByName(near)
    top = best.groupBy("id").agg(F.max("score").alias("score"))
    return best.join(top, ["id", "score"]).groupBy("id").agg(F.min("target").alias("target"), F.first("score").alias("score"))
