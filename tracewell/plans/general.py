"""Queries of the general operators for training data (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.operators.orphans import findings, parent_rows, reference_rows, snapshot_counts, snapshots, track
from tracewell.runtime import table


def _tracked(spark: SparkSession, d: str):
    """The ledger after all rows, fed quarter by quarter, and what each quarter changed."""
    rows = {n: table(spark, d, n) for n in ("entities", "logical_forms", "atoms", "relations", "form_status", "belief_tests")}
    parents = parent_rows("entities", rows["entities"], "id", "created_at")
    parents = parents.unionByName(parent_rows("logical_forms", rows["logical_forms"], "id", "extracted_at")).unionByName(parent_rows("atoms", rows["atoms"], "id", "created_at"))
    refs = reference_rows("entities", "relations.source_entity", rows["relations"], "source_entity", "id", "created_at")
    refs = refs.unionByName(reference_rows("entities", "relations.target_entity", rows["relations"], "target_entity", "id", "created_at"))
    refs = refs.unionByName(reference_rows("logical_forms", "form_status.form_id", rows["form_status"], "form_id", "id", "valid_from"))
    refs = refs.unionByName(reference_rows("atoms", "belief_tests.atom_id", rows["belief_tests"], "atom_id", "id", "tested_at"))
    return track(parents, refs)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return findings(_tracked(spark, d)[0].waiting())


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_counts(p6_found(spark, d))


def p6_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """(as_of, source, kind, n): how many references wait at the end of each quarter (yyyyq), by what was known then."""
    return snapshots(_tracked(spark, d)[1])


QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts, "p6_snapshots": p6_snapshots}
_PARENTS = {"relations": ("entities", "created_at", "created_at"), "form_status": ("logical_forms", "extracted_at", "valid_from"), "belief_tests": ("atoms", "created_at", "tested_at")}


def _p6_part(table_name: str, column: str) -> str:
    parent, arrived, at = _PARENTS[table_name]
    key = f"lower(regexp_replace(r.{column}, '^\\s+|\\s+$', '', 'g'))"
    return f"""SELECT DISTINCT '{table_name}' AS table_name, '{column}' AS column_name, r.id AS record_id,
      CASE WHEN p.k IS NULL THEN 'missing' ELSE 'late' END AS kind, strftime(r.{at}, '%Y-%m') AS period
      FROM {table_name} r LEFT JOIN (SELECT lower(trim(id)) AS k, min({arrived}) AS t FROM {parent} GROUP BY 1) p ON p.k = {key}
      WHERE r.{column} IS NOT NULL AND {key} <> '' AND (p.k IS NULL OR p.t > r.{at})"""


_P6 = " UNION ALL ".join(_p6_part(t, c) for t, c in (("relations", "source_entity"), ("relations", "target_entity"), ("form_status", "form_id"), ("belief_tests", "atom_id")))


def _p6_history(table_name: str, column: str) -> str:
    parent, arrived, at = _PARENTS[table_name]
    key = f"lower(regexp_replace(r.{column}, '^\\s+|\\s+$', '', 'g'))"
    return f"""SELECT DISTINCT '{table_name}.{column}' AS source, r.id, {key} AS k, r.{at} AS made, p.t AS arrived, CAST(year(r.{at}) * 10 + quarter(r.{at}) AS INT) AS at_quarter, CAST(year(p.t) * 10 + quarter(p.t) AS INT) AS parent_quarter
      FROM {table_name} r LEFT JOIN (SELECT lower(trim(id)) AS k, min({arrived}) AS t FROM {parent} GROUP BY 1) p ON p.k = {key} WHERE r.{column} IS NOT NULL AND {key} <> ''"""


_REFS = [("relations", "source_entity"), ("relations", "target_entity"), ("form_status", "form_id"), ("belief_tests", "atom_id")]
_QUARTERS = " UNION ".join(f"SELECT CAST(year({c}) * 10 + quarter({c}) AS INT) AS as_of FROM {t}" for t, c in (("entities", "created_at"), ("logical_forms", "extracted_at"), ("atoms", "created_at"), ("relations", "created_at"), ("form_status", "valid_from"), ("belief_tests", "tested_at")))
_P6_SNAPSHOTS = f"""WITH r AS ({" UNION ALL ".join(_p6_history(t, c) for t, c in _REFS)}), m AS ({_QUARTERS}),
  s AS (SELECT as_of, source, CASE WHEN parent_quarter IS NULL OR parent_quarter > as_of THEN 'missing' WHEN arrived > made THEN 'late' END AS kind FROM m JOIN r ON r.at_quarter <= m.as_of)
  SELECT as_of, source, kind, count(*) AS n FROM s WHERE kind IS NOT NULL GROUP BY 1, 2, 3"""
SQL = {"p6_snapshots": _P6_SNAPSHOTS, "p6_found": _P6, "p6_counts": f"SELECT table_name, column_name, kind, period, count(*) AS n FROM ({_P6}) GROUP BY 1, 2, 3, 4"}
