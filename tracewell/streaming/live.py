"""Streaming forms of the event operators. All take and give streaming frames and run on batch frames alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.operators.graph import decay
from tracewell.operators.orphans import OrphanLedger
from tracewell.operators.sessions import cluster_step


def gap_sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): sessions closed by a gap; an event exactly one gap later still belongs. Rows later than the
    watermark are dropped."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_counts(events: DataFrame, ts: str, by: list[str], size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window start, by, n): tumbling windows with a watermark."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def append_once(stream: DataFrame, key: list[str], ts: str, path: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Append new events to a parquet table, each key once within the watermark; runs over what is there and stops."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


CLUSTER = "key string, first timestamp, last timestamp, size int, things array<string>, closed boolean"
_STATE = "first timestamp, last timestamp, intent string, things array<string>, size int"


def turn_clusters(turns: DataFrame, key: str, ts: str, intent: str, things: str, late: str = "2 hours") -> DataFrame:
    """Clusters of turns per key, with the open cluster and its turns' things carried in state across batches; a
    cluster is given out when the next one begins or when event time has passed the hard gap."""
    rows = turns.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(intent).alias("intent"), F.col(things).alias("things")).withWatermark("ts", late)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(("first", "last", "intent", "things", "size"), state.get, strict=True)) if state.exists else None
        done = []

        def close(closed: bool) -> None:
            done.append((k[0], now["first"], now["last"], now["size"], sorted(now["things"]), closed))

        if now is not None:
            now["things"] = set(now["things"])
        if state.hasTimedOut:
            close(True)
            state.remove()
            now = None
        else:
            for pdf in frames:
                for row in pdf.sort_values("ts").to_dict("records"):
                    row["things"] = list(row["things"]) if row["things"] is not None else []
                    row["intent"] = (row["intent"] or "").strip()[:80]
                    new, closed = cluster_step(now, row)
                    if new:
                        if now is not None:
                            close(closed)
                        now = {"first": row["ts"], "things": set(), "intent": "", "size": 0}
                    now["last"], now["size"], now["intent"] = row["ts"], now["size"] + 1, row["intent"]
                    now["things"] |= set(row["things"])
            if now is not None:
                state.update((now["first"], now["last"], now["intent"], sorted(now["things"]), now["size"]))
                state.setTimeoutTimestamp(int(pd.Timestamp(now["last"]).timestamp() * 1000) + 7_200_001)
        if done:
            yield pd.DataFrame(done, columns=["key", "first", "last", "size", "things", "closed"])

    return rows.groupBy("key").applyInPandasWithState(run, CLUSTER, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def on_threshold(stream: DataFrame, checkpoint: str, least: int, action: Callable[[int], None]) -> StreamingQuery:
    """Call ``action`` with the number of rows since the last call whenever ``least`` new ones have come.

    The counter lies beside the checkpoint, one small file per batch, so that a restart goes on from it and a batch that
    is run again counts once."""
    spark = stream.sparkSession
    schema = "batch long, waiting long"

    def step(df: DataFrame, batch: int) -> None:
        try:
            seen = spark.read.schema(schema).json(f"{checkpoint}/waiting").filter(F.col("batch") < batch).agg(F.max_by("waiting", "batch").alias("w")).first()["w"] or 0
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            seen = 0
        waiting = seen + df.count()
        if waiting >= least:
            action(waiting)
            waiting = 0
        spark.createDataFrame([(batch, waiting)], schema).coalesce(1).write.mode("overwrite").json(f"{checkpoint}/waiting/batch={batch:012d}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def track_orphans(stream: DataFrame, checkpoint: str, ledger: OrphanLedger) -> StreamingQuery:
    """Advance a ledger by every micro-batch of a change feed (what: ``ref``, ``parent`` or ``delete``; scope, key,
    source, record_id, at), at being the time of the reference or of the arrival."""

    def step(df: DataFrame, _: int) -> None:
        refs = df.filter("what = 'ref'").select("scope", "key", "source", "record_id", "at")
        parents = df.filter("what = 'parent'").select("scope", "key", F.col("at").alias("arrived"))
        ledger.apply(refs, parents, df.filter("what = 'delete'").select("scope", "key"))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decay_per_batch(stream: DataFrame, checkpoint: str, edges: Callable[[], DataFrame], keep: Callable[[DataFrame], None], eligible: str) -> StreamingQuery:
    """One step of decay for every micro-batch of fired entities (entity_id), whatever time has passed: ``edges`` gives the edges
    (id, src, dst, weight, ...) as they are, ``keep`` stores those after the step."""

    def step(df: DataFrame, _: int) -> None:
        keep(decay(edges(), df.select("entity_id"), "src", "dst", eligible))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_chain(steps: list[tuple[str, Callable[[], object]]]) -> list[tuple[str, str]]:
    """Run named steps one after the other and stop at the first that fails: (name, ``ok``, ``failed: why`` or ``not run``)."""
    done, broken = [], False
    for name, step in steps:
        if broken:
            done.append((name, "not run"))
            continue
        try:
            step()
            done.append((name, "ok"))
        except Exception as e:  # noqa: BLE001
            broken = True
            done.append((name, f"failed: {e}"))
    return done
