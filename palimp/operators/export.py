"""Exports of change rows: CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.functions.views import effective_risk, table_cell

# The columns of the export, in order.
CSV_COLUMNS = ["change_id", "section", "change_type", "source", "old_text", "new_text", "risk_level", "reason", "old_page", "new_page", "confidence", "reviewer_comment", "accepted", "table_cell"]


def csv_rows(changes: DataFrame) -> DataFrame:
    """The fourteen columns of the CSV export; accepted is written True or False, a null comment is empty."""
    return changes.select(
        "change_id", "section", "change_type", "source", "old_text", "new_text", effective_risk(F.col("reviewer_risk_level"), F.col("ai_risk_level")).alias("risk_level"), "reason", "old_page", "new_page",
        "confidence", F.coalesce("reviewer_comment", F.lit("")).alias("reviewer_comment"), F.when(F.col("accepted"), "True").otherwise("False").alias("accepted"),
        table_cell(F.col("old_table_position"), F.col("new_table_position")).alias("table_cell"),
    )


def write_csv(changes: DataFrame, path: str) -> None:
    """CSV as RFC 4180 has it: quotes doubled, line breaks kept."""
    csv_rows(changes).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def json_documents(comparisons: DataFrame, summaries: DataFrame, changes: DataFrame) -> DataFrame:
    """comparison_id and its export as one JSON text; null fields are kept, changes are in the report's order.

    A comparison's changes are one JSON text by definition, so they meet in one
    row; large ones should be exported as :func:`json_rows`.
    """
    listed = json_rows(changes).groupBy("comparison_id").agg(F.sort_array(F.collect_list(F.struct("change_ord", "change"))).alias("_c"))
    joined = comparisons.join(summaries, "comparison_id", "left").join(listed, "comparison_id", "left")
    counts = F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in summaries.columns if c != "comparison_id"])
    head = F.to_json(F.struct("comparison_id", "old_document", "new_document", counts.alias("summary")), {"ignoreNullFields": "false"})
    items = F.array_join(F.transform(F.coalesce("_c", F.array().cast("array<struct<change_ord:bigint,change:string>>")), lambda x: x["change"]), ",")
    return joined.select("comparison_id", F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"changes":['), items, F.lit("]}")).alias("json"))


def json_rows(changes: DataFrame) -> DataFrame:
    """comparison_id, change_ord and each change as a JSON object."""
    change = F.struct(
        "change_id", "section", "change_type", "source", "old_text", "new_text", effective_risk(F.col("reviewer_risk_level"), F.col("ai_risk_level")).alias("risk_level"), "ai_risk_level", "reviewer_risk_level",
        "reason", "old_page", "new_page", "confidence", "reviewer_comment", "accepted", "old_table_position", "new_table_position",
    )
    return changes.select("comparison_id", "change_ord", F.to_json(change, {"ignoreNullFields": "false"}).alias("change"))
