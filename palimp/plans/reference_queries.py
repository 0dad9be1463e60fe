"""Queries over references to records that do not exist, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimp.operators.references import Parent, Reference, count_by_period, dangling_references
from palimp.runtime import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every orphan, deleted or late reference of comparisons and changes."""
    files = table(spark, sf_dir, "document_files", "id", "loaded_at")
    comparisons = table(spark, sf_dir, "comparisons", "id", "old_document_id", "new_document_id", "loaded_at")
    changes = table(spark, sf_dir, "changes", "id", "comparison_id", "loaded_at")
    return dangling_references(
        [Parent("document_files", files), Parent("comparisons", comparisons)],
        [
            Reference("comparisons", comparisons, "old_document_id", "document_files"),
            Reference("comparisons", comparisons, "new_document_id", "document_files"),
            Reference("changes", changes, "comparison_id", "comparisons"),
        ],
        table(spark, sf_dir, "deletions"),
    )


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of such references per table, field, reason and month."""
    return count_by_period(p6_found(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}

_FOUND = """
WITH refs AS (
  SELECT 'comparisons' AS child_table, 'old_document_id' AS child_field, 'document_files' AS parent_table, id AS child_id, old_document_id AS ref, loaded_at FROM comparisons
  UNION ALL SELECT 'comparisons', 'new_document_id', 'document_files', id, new_document_id, loaded_at FROM comparisons
  UNION ALL SELECT 'changes', 'comparison_id', 'comparisons', id, comparison_id, loaded_at FROM changes
), child AS (
  SELECT child_table, child_field, parent_table, child_id, lower(trim(ref, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) AS key, min(loaded_at) AS child_loaded
  FROM refs WHERE ref IS NOT NULL GROUP BY ALL
), parent AS (
  SELECT parent_table, key, min(loaded_at) AS first_loaded, max(loaded_at) AS last_loaded FROM (
    SELECT 'document_files' AS parent_table, lower(trim(id)) AS key, loaded_at FROM document_files
    UNION ALL SELECT 'comparisons', lower(trim(id)), loaded_at FROM comparisons) GROUP BY ALL
), gone AS (
  SELECT record_table AS parent_table, lower(trim(record_id)) AS key, max(deleted_at) AS deleted_at FROM deletions GROUP BY ALL
), judged AS (
  SELECT c.child_table, c.child_field, c.child_id, c.child_loaded,
    CASE WHEN g.key IS NOT NULL AND NOT coalesce(p.last_loaded > g.deleted_at, false) THEN 'deleted'
         WHEN p.key IS NULL THEN 'missing'
         WHEN p.first_loaded > c.child_loaded THEN 'late' END AS reason
  FROM child c LEFT JOIN parent p USING (parent_table, key) LEFT JOIN gone g USING (parent_table, key)
)
SELECT child_table, child_field, child_id, reason, strftime(child_loaded, '%Y-%m') AS period FROM judged WHERE reason IS NOT NULL
"""
ORACLES = {
    "p6_found": _FOUND,
    "p6_report": f"SELECT child_table, child_field, reason, period, count(*) AS n_references FROM ({_FOUND}) GROUP BY ALL",
}
