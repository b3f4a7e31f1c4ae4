"""Shared by the query modules: current rows of the domain tables, in Spark and in SQL, and a register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.operators.rows import current
from tracewell.runtime import table

Query = Callable[[SparkSession, str], DataFrame]

#: What tells the last version of a row, since rows may be delivered again with other measures.
VERSION = {
    "atoms": ["created_at", "confidence", "importance", "source_count"],
    "facts": ["ingestion_time", "confidence", "importance"],
    "entities": ["updated_at", "atom_count"],
    "relations": ["updated_at", "weight"],
    "logical_forms": ["extracted_at", "confidence"],
    "form_status": ["valid_from", "confidence"],
    "belief_tests": ["tested_at", "confidence_after", "alpha_after"],
}


def cur(spark: SparkSession, d: str, name: str) -> DataFrame:
    return current(table(spark, d, name), ["id"], VERSION[name])


def cur_sql(name: str) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in VERSION[name])
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order}) AS rn FROM {name}) WHERE rn = 1)"


def name_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
