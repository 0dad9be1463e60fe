"""Projections of change rows for reports, exports and displays; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The risk of each change type, the default, and the order of severity.
RISKS = {
    "numeric_change": "High", "unit_change": "High", "process_sequence_change": "High", "qualitative_specification_change": "High", "role_responsibility_change": "Medium",
    "reference_document_change": "Medium", "date_change": "Medium", "clarification_no_meaning_change": "Low", "formatting_only": "Informational", "section_renumbered": "Informational",
    "section_renumbered_cascade": "Informational", "section_reordered": "Informational", "section_added": "High", "section_deleted": "High", "section_heading_changed": "Medium",
    "table_row_added": "Medium", "table_row_deleted": "Medium", "table_row_moved": "Informational", "table_column_added": "Medium", "table_column_deleted": "Medium",
    "table_column_moved": "Informational", "table_cell_merge_changed": "Informational",
}
DEFAULT_RISK = "Medium"
SEVERITY = ["High", "Medium", "Low", "Informational"]
# Signs of the levels, and the change types with a special display.
SIGNS = {"High": "\U0001f534", "Medium": "\U0001f7e1", "Low": "\U0001f7e2", "Informational": "⚪"}
WHOLE_SECTION = ["section_added", "section_deleted"]
MATCH_DERIVED = ["section_heading_changed", "section_renumbered", "section_renumbered_cascade", "section_reordered", "moved_paragraph", "moved_table_content"]


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def risk_of(change_type: Column) -> Column:
    """The risk level of a change type; unknown and null types have the default."""
    return F.coalesce(F.try_element_at(_map(RISKS), change_type), F.lit(DEFAULT_RISK))


def effective_risk(reviewer: Column, ai: Column) -> Column:
    """The reviewer's level where there is one (not null, not empty)."""
    return F.coalesce(F.nullif(reviewer, F.lit("")), ai)


def category(section: Column, source: Column, change_type: Column) -> Column:
    """Tables, Headers, Footers or Body."""
    in_table = (F.coalesce(source, F.lit("Body")) == "Table") & ~F.coalesce(change_type.isin(WHOLE_SECTION), F.lit(False))
    return F.when(in_table, "Tables").when(section.startswith("Page Header"), "Headers").when(section.startswith("Page Footer"), "Footers").otherwise("Body")


def two_decimals(c: Column) -> Column:
    """A number with two decimals, rounded by its exact binary value and half to even, as C and Python do.

    The JVM's format rounds the shortest decimal of the number instead, which
    differs where that ends in 5. From 0 to 7 integers count the exact value in
    units of 2**-60; other numbers are left to the JVM's format.
    """
    one = F.lit(1 << 60).cast("decimal(20,0)")
    t = (c * F.lit(float(1 << 60))).cast("long").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)") + F.lit(1 << 59).cast("decimal(20,0)")
    up = F.call_function("div", t, one)
    hundredths = F.when((t % one == 0) & (up % 2 == 1), up - 1).otherwise(up)
    text = F.concat(F.call_function("div", hundredths, F.lit(100)).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    return F.when(c.between(0.0, 7.0), text).otherwise(F.format_string("%.2f", c))


def match_confidence(change_type: Column, confidence: Column) -> Column:
    """The match score with two decimals, for the types that come from a match; else the empty text."""
    return F.when(change_type.isin(MATCH_DERIVED) & confidence.isNotNull(), two_decimals(confidence)).otherwise("")


def _cell(p: Column) -> Column:
    return F.format_string("Table %d, Row %d, Col %d", p["table_id"], p["row"], p["col"])


def table_cell(old: Column, new: Column) -> Column:
    """Both positions of a cell as text, 0-based."""
    return (
        F.when(old.isNull() & new.isNull(), "")
        .when(old.isNotNull() & new.isNotNull() & (old != new), F.concat(_cell(old), F.lit(" -> "), _cell(new)))
        .otherwise(_cell(F.coalesce(new, old)))
    )


def coordinate(old: Column, new: Column, key: str) -> Column:
    """One coordinate (row or col), 1-based, with an arrow where it differs."""
    text = lambda p: (p[key] + 1).cast("string")
    return (
        F.when(old.isNull() & new.isNull(), "")
        .when(old.isNotNull() & new.isNotNull() & (old[key] != new[key]), F.concat(text(old), F.lit(" → "), text(new)))
        .otherwise(text(F.coalesce(new, old)))
    )


def table_key(old: Column, new: Column) -> Column:
    """The table that a row belongs to; -1 where it has no position."""
    return F.coalesce(F.coalesce(new, old)["table_id"], F.lit(-1))


def position(prefix: str) -> Column:
    """The coordinate of a persisted row, whose three columns carry a prefix; null where there is no table."""
    c = lambda k: F.col(f"{prefix}_table_{k}")
    return F.when(c("id").isNotNull(), F.struct(c("id").alias("table_id"), c("row").alias("row"), c("col").alias("col")))


def changed_fields(original: dict[str, Column], edited: dict[str, Column]) -> Column:
    """The names of the fields whose edited value differs from the original one, nulls being equal."""
    return F.array_compact(F.array(*[F.when(~original[k].eqNullSafe(edited[k]), F.lit(k)) for k in original]))
