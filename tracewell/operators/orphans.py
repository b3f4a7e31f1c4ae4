"""References to records that do not exist, as keyed state that is advanced batch by batch.

State is a log of keyed changes in three parts, none of which a batch rewrites:

* ``parents``: (scope, key, step, gone, arrived), arrivals and deletions of the records referred to;
* ``refs``: (scope, key, source, record_id, at), every reference seen, read only where deletions reopen some;
* ``waiting``: (scope, key, source, record_id, at, kind, step), the orphans; a later row of kind null resolves one.

A batch probes the parent log for the keys it names, no others: new references, waiting references to keys that arrive
or vanish, and references to deleted keys. It adds rows to the log for what changed. Every ``COMPACT`` batches the
logs are folded, so that reading them stays cheap. ``scope`` names the table referred to, ``source`` the referring one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import ref_key
from tracewell.runtime import cut, stage

#: Batches after which the logs are folded.
COMPACT = 8
#: Batches a feed is dealt into at most; neighbouring periods share one beyond that.
MOST_BATCHES = 60
#: Parts that the writing of a feed spreads each period over.
FEED_PARTS = 32
REF = ["scope", "key", "source", "record_id", "at"]


def parent_rows(scope: str, rows: DataFrame, key: str, arrived: str) -> DataFrame:
    """(scope, key, arrived) of existing records. Null and blank keys are ignored, keys compared as ``ref_key``."""
    return rows.select(F.lit(scope).alias("scope"), ref_key(F.col(key)).alias("key"), F.col(arrived).cast("timestamp_ntz").alias("arrived")).filter("key is not null")


def reference_rows(scope: str, source: str, rows: DataFrame, ref: str, record_id: str, at: str) -> DataFrame:
    """(scope, key, source, record_id, at) of references. Null and blank references are no case."""
    return rows.select(F.lit(scope).alias("scope"), ref_key(F.col(ref)).alias("key"), F.lit(source).alias("source"), F.col(record_id).alias("record_id"), F.col(at).cast("timestamp_ntz").alias("at")).filter("key is not null")


class OrphanLedger:
    """The state, and the steps that advance it. Frames in it are cut, so it survives lost executors."""

    def __init__(self) -> None:
        self.step = 0
        self.parents: list[DataFrame] = []
        self.refs: list[DataFrame] = []
        self.changes: list[DataFrame] = []

    @staticmethod
    def _log(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    def _present(self, keys: DataFrame) -> DataFrame:
        """(scope, key, arrived) of those of ``keys`` (scope, key) that exist now: the earliest arrival since the last
        deletion. A record without a time is there from the start."""
        log = self._log(self.parents).join(keys, ["scope", "key"], "left_semi")
        per = log.groupBy("scope", "key", "step").agg(F.max(F.col("gone").cast("int")).alias("gone"), F.count_if(~F.col("gone")).alias("came"), F.min(F.when(~F.col("gone"), F.coalesce("arrived", F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))))).alias("arrived"))
        # at most one row a key and batch since the last fold is gathered here
        all_ = per.groupBy("scope", "key").agg(F.max(F.when(F.col("gone") == 1, F.col("step"))).alias("last"), F.collect_list(F.when(F.col("came") > 0, F.struct("step", "arrived"))).alias("rows"))
        live = F.filter("rows", lambda r: F.col("last").isNull() | (r["step"] >= F.col("last")))
        return all_.select("scope", "key", F.array_min(F.transform(live, lambda r: r["arrived"])).alias("arrived")).filter("arrived is not null")

    def apply(self, refs: DataFrame, parents: DataFrame, deleted: DataFrame | None = None, stored: bool = False) -> DataFrame:
        """Advance by one batch and return what changed, as rows of the ``waiting`` log.

        refs: (scope, key, source, record_id, at); parents: (scope, key, arrived); deleted: (scope, key). Deletions come
        before the arrivals of the same batch: a key in both is there afterwards. A reference is ``missing`` while its
        key is absent, ``late`` if the record arrived after it; one without a time is never late. Repeated rows add
        nothing. ``stored``: the frames are read from storage that stays, so that they need not be kept once more.
        """
        self.step += 1
        now = F.lit(self.step)
        refs = refs.select(*REF).distinct() if stored else cut(refs.select(*REF).distinct())
        came = parents.select("scope", "key", now.alias("step"), F.lit(False).alias("gone"), "arrived").groupBy("scope", "key", "step", "gone").agg(F.min(F.coalesce("arrived", F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00")))).alias("arrived"))
        if deleted is not None:
            gone = deleted.select("scope", "key", now.alias("step"), F.lit(True).alias("gone"), F.lit(None).cast("timestamp_ntz").alias("arrived")).distinct()
            came = came.unionByName(gone)
        came = cut(came)
        self.parents.append(came)
        probe = refs.withColumn("was", F.lit(None).cast("string"))
        if self.changes:
            again = self.waiting().join(came.select("scope", "key").distinct(), ["scope", "key"], "left_semi")
            probe = probe.unionByName(again.select(*REF, F.col("kind").alias("was")))
        if deleted is not None and self.refs:
            back = self._log(self.refs).join(came.filter("gone").select("scope", "key"), ["scope", "key"], "left_semi")
            probe = probe.unionByName(back.withColumn("was", F.lit(None).cast("string")))
        probe = probe.groupBy(*REF).agg(F.max("was").alias("was"))
        there = self._present(probe.select("scope", "key").distinct())
        hit = probe.join(there, ["scope", "key"], "left")
        kind = F.when(F.col("arrived").isNull(), "missing").when(F.col("arrived") > F.col("at"), "late")
        changed = cut(hit.select(*REF, kind.alias("kind"), "was").filter("not (kind <=> was)").select(*REF, "kind", now.alias("step")))
        self.refs.append(refs)
        self.changes.append(changed)
        if self.step % COMPACT == 0:
            self._fold()
        return changed

    def _fold(self) -> None:
        keys = self._log(self.parents).select("scope", "key").distinct()
        self.parents = [cut(self._present(keys).select("scope", "key", F.lit(self.step).alias("step"), F.lit(False).alias("gone"), "arrived"))]
        self.changes = [cut(self.waiting().withColumn("step", F.lit(self.step)))]
        self.refs = [cut(self._log(self.refs).distinct())]

    def waiting(self) -> DataFrame:
        """(scope, key, source, record_id, at, kind) of the orphans there are now."""
        last = self._log(self.changes).groupBy(*REF).agg(F.max(F.struct("step", "kind")).alias("s"))
        return last.select(*REF, F.col("s.kind").alias("kind")).filter("kind is not null")


def quarter_of(at: Column) -> Column:
    """A time's quarter as a number, such as 20261; 0 without a time."""
    return F.coalesce(F.year(at) * 10 + F.quarter(at), F.lit(0))


def track(parents: DataFrame, refs: DataFrame, period: Callable[[Column], Column] = quarter_of) -> tuple[OrphanLedger, list[tuple[int, DataFrame]]]:
    """Feed parents (scope, key, arrived) and refs (scope, key, source, record_id, at) through a ledger, period by period, in
    the order of their own times; rows without a time come first.

    Gives the ledger and, per batch, its last period and the rows that changed. The feed is written once, parted by
    period, so that a batch reads its own rows only; there are as many batches as periods, ``MOST_BATCHES`` at most.
    """
    events = parents.select("scope", "key", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("record_id"), F.col("arrived").alias("at")).unionByName(refs.select(*REF))
    events = events.withColumn("period", period(F.col("at")))
    spread = F.pmod(F.xxhash64("key", "record_id"), F.lit(FEED_PARTS))
    feed = stage(events.repartition("period", spread), "period")
    periods = sorted(r["period"] for r in feed.select("period").distinct().collect())  # calendar periods, a short list
    size = max(1, -(-len(periods) // MOST_BATCHES))
    ledger, history = OrphanLedger(), []
    for k in range(0, len(periods), size):
        part = feed.filter(F.col("period").between(periods[k], periods[min(k + size, len(periods)) - 1]))
        changed = ledger.apply(part.filter("source is not null").select(*REF), part.filter("source is null").select("scope", "key", F.col("at").alias("arrived")), stored=True)
        history.append((periods[min(k + size, len(periods)) - 1], changed))
    return ledger, history


def findings(waiting: DataFrame) -> DataFrame:
    """(table_name, column_name, record_id, kind, period) of waiting rows whose source is ``table.column``."""
    name = F.split("source", "[.]")
    return waiting.select(name[0].alias("table_name"), name[1].alias("column_name"), "record_id", "kind", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def snapshot_counts(rows: DataFrame) -> DataFrame:
    """Orphans per table, column, kind and month from rows (table_name, column_name, record_id, kind, period)."""
    return rows.groupBy("table_name", "column_name", "kind", "period").agg(F.count("*").alias("n"))


def snapshots(history: list[tuple[int, DataFrame]]) -> DataFrame | None:
    """(as_of, source, kind, n): references waiting after each batch, from the changes alone. A change from one kind to
    another takes the reference out of the old count; counts of zero are left out. None without a batch."""
    if not history:
        return None
    rows = reduce(DataFrame.unionByName, [c.withColumn("as_of", F.lit(p)) for p, c in history])
    before = F.lag("kind").over(Window.partitionBy(*REF).orderBy("step"))
    moves = rows.withColumn("before", before).select("as_of", "source", F.explode(F.array(F.struct(F.col("kind").alias("kind"), F.lit(1).alias("d")), F.struct(F.col("before").alias("kind"), F.lit(-1).alias("d")))).alias("m"))
    net = moves.select("as_of", "source", "m.kind", "m.d").filter("kind is not null").groupBy("as_of", "source", "kind").agg(F.sum("d").alias("d"))
    steps = rows.sparkSession.createDataFrame([(p,) for p, _ in history], "as_of int")
    grid = steps.join(F.broadcast(net.select("source", "kind").distinct()))  # batches x referring columns x two kinds
    total = F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy("source", "kind").orderBy("as_of"))
    return grid.join(net, ["as_of", "source", "kind"], "left").withColumn("n", total).filter("n > 0").select("as_of", "source", "kind", "n")
