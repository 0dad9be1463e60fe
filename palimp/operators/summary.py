"""Aggregates of change rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp.functions.views import SEVERITY, SIGNS, effective_risk, table_key

_RISKS = {"high_risk": "High", "medium_risk": "Medium", "low_risk": "Low", "informational": "Informational"}
_TYPES = {
    "sections_added": "section_added", "sections_deleted": "section_deleted", "sections_renamed": "section_heading_changed", "sections_renumbered": "section_renumbered",
    "sections_cascaded": "section_renumbered_cascade", "sections_moved": "section_reordered",
}


def summarize(changes: DataFrame, comparisons: DataFrame | None = None, group: str = "comparison_id") -> DataFrame:
    """Counts per comparison, by the unreviewed risk and by type; with ``comparisons``, also those without a change."""
    counts = [F.count("*").alias("total_changes")]
    counts += [F.count_if(F.coalesce(F.col("ai_risk_level") == v, F.lit(False))).alias(k) for k, v in _RISKS.items()]
    counts += [F.count_if(F.coalesce(F.col("change_type") == v, F.lit(False))).alias(k) for k, v in _TYPES.items()]
    out = changes.groupBy(group).agg(*counts)
    if comparisons is None:
        return out
    return comparisons.select(group).distinct().join(out, group, "left").na.fill(0)


def risk_counts(changes: DataFrame, *group: str) -> DataFrame:
    """Changes per group and effective risk; other levels than the four are left out; severity is 1 for the highest."""
    risk = effective_risk(F.col("reviewer_risk_level"), F.col("ai_risk_level"))
    levels = F.array(*[F.lit(x) for x in SEVERITY])
    found = changes.withColumn("risk", risk).groupBy(*group, "risk").agg(F.count("*").alias("n_changes"))
    return found.withColumn("severity", F.array_position(levels, F.col("risk"))).where(F.col("severity") > 0)


def table_order(changes: DataFrame, *group: str) -> DataFrame:
    """The tables that the changes of each group are in, with the number they are shown under and their place in the display."""
    keys = changes.select(*group, table_key(F.col("old_table_position"), F.col("new_table_position")).alias("table_key")).where("table_key >= 0").distinct()
    place = F.row_number().over(Window.partitionBy(*group).orderBy("table_key"))
    return keys.select(*group, "table_key", (F.col("table_key") + 1).alias("shown_as"), place.alias("place"))


def group_labels(changes: DataFrame, name: str, *group: str) -> DataFrame:
    """The label of each group: sign of its highest risk, name, number of changes and counts by risk.

    A group without any of the four levels is labelled as having 0 changes.
    """
    risk = effective_risk(F.col("reviewer_risk_level"), F.col("ai_risk_level"))
    g = changes.groupBy(*group).agg(F.count("*").alias("_n"), *[F.count_if(F.coalesce(risk == x, F.lit(False))).alias(f"_{x}") for x in SEVERITY])
    counts = F.concat_ws(", ", *[F.when(F.col(f"_{x}") > 0, F.concat(F.col(f"_{x}").cast("string"), F.lit(f" {x}"))) for x in SEVERITY])
    top: Column = F.lit(None).cast("string")
    for x in reversed(SEVERITY):
        top = F.when(F.col(f"_{x}") > 0, SIGNS[x]).otherwise(top)
    title = F.coalesce(F.col(name), F.lit(""))
    label = F.when(top.isNull(), F.concat(title, F.lit(" — 0 changes"))).otherwise(
        F.concat(top, F.lit(" "), title, F.lit(" — "), F.col("_n").cast("string"), F.when(F.col("_n") == 1, " change (").otherwise(" changes ("), counts, F.lit(")"))
    )
    return g.select(*group, F.col("_n").alias("n_changes"), (F.col("_High") > 0).alias("has_high_risk"), label.alias("label"))
