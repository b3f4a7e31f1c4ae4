"""Sinks: versioned tables, upserts on parquet, text files, exports, work queues."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.rows import new_rows, replace_rows


class VersionedTable:
    """A parquet table kept as numbered versions with a log, since plain parquet has no merge.

    A version is a list of part folders. A write makes one new folder and then one row of the log, which names the folders
    of the version, so readers see the old or the new one; a lost job leaves a folder nobody refers to. An append adds a
    folder and rewrites nothing. The last version counts; ``pick`` tells which earlier one it repeats, after a rollback.
    """

    LOG = "version int, note string, name string, parts array<string>, rows long, pick int, at string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(self.LOG).json(f"{self.path}/_log")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _last(self):
        log = self.log()
        return log.orderBy(F.desc("version")).first() if log is not None else None

    def version(self) -> int:
        """The version that counts; 0 if there is none."""
        last = self._last()
        return last["version"] if last else 0

    def _row(self, version: int):
        row = self.log().filter(F.col("version") == version).first() if version else None
        if version and row is None:
            raise ValueError(f"there is no version {version}")
        return row

    def read(self, version: int | None = None) -> DataFrame | None:
        v = version or self.version()
        row = self._row(v)
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in row["parts"]]) if row else None

    def _note(self, note: str, parts: list[str], rows: int, pick: int | None = None, name: str | None = None) -> int:
        last = self._last()
        v = (last["version"] if last else 0) + 1
        row = (v, note, name, parts, rows, pick or v, datetime.now().isoformat())
        self.spark.createDataFrame([row], self.LOG).coalesce(1).write.mode("append").json(f"{self.path}/_log")
        return v

    def _part(self, df: DataFrame) -> tuple[str, int]:
        """A new folder of rows, and how many there are, counted while they are written."""
        part, seen = f"part-{uuid.uuid4()}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{part}")
        return part, seen.get["n"]

    def write(self, df: DataFrame, note: str = "write") -> int:
        part, rows = self._part(df)
        return self._note(note, [part], rows)

    def append(self, df: DataFrame, key: list[str]) -> int:
        """Idempotent insert: rows whose key is there already are left out; only the new rows are written."""
        v = self.version()
        if not v:
            return self.write(df.dropDuplicates(key), "append")
        row = self._row(v)
        part, rows = self._part(new_rows(self.read(v), df, key))
        return self._note("append", [*row["parts"], part], row["rows"] + rows)

    def replace(self, df: DataFrame, key: list[str]) -> int:
        old = self.read()
        return self.write(df.dropDuplicates(key) if old is None else replace_rows(old, df, key), "replace")

    def snapshot(self, name: str) -> int:
        """Give the version that counts a name; a name is given once."""
        log, v = self.log(), self.version()
        if not v:
            raise ValueError("there is nothing to name yet")
        if not log.filter(F.col("name") == name).isEmpty():
            raise ValueError(f"there is a snapshot {name} already")
        row = self._row(v)
        return self._note("snapshot", row["parts"], row["rows"], name=name)

    def snapshots(self) -> DataFrame | None:
        """(name, version, rows, at) of the named versions, in order."""
        log = self.log()
        return log.filter("name is not null and note = 'snapshot'").select("name", "version", "rows", "at").orderBy("version") if log is not None else None

    def checkout(self, name: str) -> int:
        """The named version counts from now on; no row is copied."""
        log = self.log()
        row = log.filter((F.col("name") == name) & (F.col("note") == "snapshot")).first() if log is not None else None
        if row is None:
            raise ValueError(f"there is no snapshot {name}")
        return self._note(f"checkout of {name}", row["parts"], row["rows"])

    def rollback(self) -> int:
        """The version before becomes the newest again; rolling back once more goes one further. No row is copied."""
        last = self._last()
        if last is None or last["pick"] <= 1:
            return last["version"] if last else 0
        row = self._row(last["pick"] - 1)
        return self._note(f"rollback of {last['pick']}", row["parts"], row["rows"], pick=row["pick"])

    def fork(self, path: str) -> "VersionedTable":
        """A table of its own below ``path`` that starts with the rows of the version that counts."""
        new = VersionedTable(self.spark, path)
        rows = self.read()
        if rows is not None:
            new.write(rows, f"fork of {self.path} {self.version()}")
        return new


class SingleWriter:
    """A lock by a file that only one can create; a writer that finds it taken gets ``False``. ``with`` frees it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.mine = False

    def __enter__(self) -> bool:
        try:
            self.files.create(self.path, False).close()
            self.mine = True
        except Exception as e:  # noqa: BLE001
            if "AlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
        return self.mine

    def __exit__(self, *_: object) -> None:
        if self.mine:
            self.files.delete(self.path, False)
            self.mine = False


def index_append(index: DataFrame, notes: DataFrame) -> DataFrame:
    """``index`` (line) and a line for each of ``notes`` (id, title) whose id no line names yet in ``(id)``."""
    named = index.select(F.explode(F.regexp_extract_all("line", F.lit(r"\(([^()\s]+)\)"), 1)).alias("id")).distinct()
    fresh = notes.dropDuplicates(["id"]).join(named, "id", "left_anti")
    return index.unionByName(fresh.select(F.concat(F.lit("- ["), "title", F.lit("]("), "id", F.lit(")")).alias("line")))


def export_html(df: DataFrame, path: str, title: str) -> None:
    """A page per partition with its rows as a JSON list in a script; ``</`` in the data is broken up."""
    row = F.regexp_replace(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), "</", r"<\\/")
    head = f"<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1><pre id=rows></pre><script>const rows=["

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began = False
        for pdf in frames:
            for r in pdf.value.tolist():
                yield pd.DataFrame({"value": [(head if not began else "") + ("," if began else "") + r]})
                began = True
        if began:
            yield pd.DataFrame({"value": ["];document.getElementById('rows').textContent=JSON.stringify(rows,null,1)</script>"]})

    df.select(row.alias("value")).mapInPandas(pages, "value string").write.mode("overwrite").text(path)


def status_sets(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((session_id) done, (session_id) tried) of a log (session_id, status): ``ok`` and ``success`` are done; those, skipped
    ones, errors and what was promoted before are not tried again."""
    rows = log.filter("session_id is not null")
    done = rows.filter(F.col("status").isin("ok", "success")).select("session_id").distinct()
    tried = rows.filter(F.col("status").isin("ok", "success", "skipped", "already_promoted", "error")).select("session_id").distinct()
    return done, tried


def fork_experiment(table: VersionedTable, names: DataFrame, name: str, slug: str, base: str) -> tuple[str, VersionedTable]:
    """The next numbered experiment and a table of its own for it, below ``base``."""
    new = next_experiment(names, name, slug)
    return new, table.fork(f"{base}/{new}")


def verify_migration(old: DataFrame, new: DataFrame, column: str) -> dict[str, int]:
    """Rows before and after, and rows after without a value in the new column."""
    return {"before": old.count(), **new.agg(F.count("*").alias("after"), F.count_if(F.col(column).isNull()).alias("unfilled")).first().asDict()}


def write_notes(df: DataFrame, path: str, meta: list[str], text: str) -> None:
    """One markdown text per row with its ``meta`` columns as frontmatter; rows are the values of a text table, spread
    over as many files as there are partitions."""
    lines = [F.concat(F.lit(f"{m}: \""), F.regexp_replace(F.coalesce(F.col(m).cast("string"), F.lit("")), '"', "'"), F.lit('"')) for m in meta]
    df.select(F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""), F.col(text)).alias("value")).write.mode("overwrite").option("lineSep", "\n\f\n").text(path)


def write_graph_outputs(path: str, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def queue_add(queue: DataFrame, new: DataFrame) -> DataFrame:
    return queue.unionByName(new).dropDuplicates(["session_id"])


def queue_remove(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("session_id"), "session_id", "left_anti")


def next_experiment(names: DataFrame, name: str, slug: str) -> str:
    """The next numbered name, three digits, after the largest number in use."""
    top = names.agg(F.max(F.split_part(F.col(name), F.lit("-"), F.lit(1)).try_cast("int")).alias("n")).first()["n"]
    return f"{(top or 0) + 1:03d}-{slug}"


def backfill(df: DataFrame, column: str, by: str, mapping: dict[str, str], default: str) -> DataFrame:
    """``df`` with nulls of ``column`` (added if absent) filled by a map of another column."""
    have = F.col(column) if column in df.columns else F.lit(None).cast("string")
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]).cast("map<string, string>")
    return df.withColumn(column, F.coalesce(have, m[F.col(by)], F.lit(default)))
