"""Stored changes: decoding, reviewer updates, lookups and read-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.functions.views import effective_risk, position

REVIEW_FIELDS = ("reviewer_risk_level", "reviewer_comment", "accepted")


def latest_delivery(df: DataFrame, key: str = "id", loaded_at: str = "loaded_at") -> DataFrame:
    """One row per key: the one loaded last; of rows loaded together, the greatest by the other columns."""
    rest = [c for c in df.columns if c not in (key, loaded_at)]
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(loaded_at, *rest)).alias("_r"))
    return one.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def decoded(changes: DataFrame) -> DataFrame:
    """Persisted change rows with their positions as structs, source Body where it is null, accepted as a boolean."""
    flat = [f"{s}_table_{k}" for s in ("old", "new") for k in ("id", "row", "col")]
    return changes.withColumns(
        {
            "old_table_position": position("old"), "new_table_position": position("new"), "source": F.coalesce("source", F.lit("Body")),
            "accepted": F.coalesce(F.col("accepted").cast("boolean"), F.lit(False)),
        }
    ).drop(*flat)


def encoded(changes: DataFrame) -> DataFrame:
    """Change rows with their positions as flat columns, as they are persisted; spans are dropped."""
    out = changes
    for s in ("old", "new"):
        for name, key in (("id", "table_id"), ("row", "row"), ("col", "col")):
            out = out.withColumn(f"{s}_table_{name}", F.col(f"{s}_table_position.{key}"))
    return out.drop("old_table_position", "new_table_position")


def merged_patches(patches: DataFrame, key: str = "change_id", at: str = "submitted_at") -> DataFrame:
    """One patch per change: of each field the last value that is not null; of values given together, the greatest."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at, c))).getField(c)
    return patches.where(F.col(key).isNotNull()).groupBy(key).agg(*[last(c).alias(c) for c in REVIEW_FIELDS])


def apply_reviews(changes: DataFrame, patches: DataFrame, id_col: str = "id") -> DataFrame:
    """Changes with the reviewers' partial updates: a null in a patch leaves a field as it is.

    Patches of unknown changes have no effect; values are not validated. Many
    patches of one change are combined before the join.
    """
    p = merged_patches(patches).select(F.col("change_id").alias(id_col), *[F.col(c).alias(f"_p_{c}") for c in REVIEW_FIELDS])
    return changes.join(p, id_col, "left").select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in REVIEW_FIELDS else F.col(c) for c in changes.columns])


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of a key, given as a value or as a column such as a scalar subquery; the filter on a value reaches the scan."""
    return df.where(F.col(key) == (value if isinstance(value, Column) else F.lit(value)))


def filter_changes(changes: DataFrame, risk: str | None = None, section: str | None = None, change_type: str | None = None) -> DataFrame:
    """The changes with the given effective risk, section and type; what is None is left open. A null matches no given value."""
    wanted = {"section": section, "change_type": change_type}
    out = changes if risk is None else changes.where(effective_risk(F.col("reviewer_risk_level"), F.col("ai_risk_level")) == risk)
    for c, value in wanted.items():
        out = out if value is None else out.where(F.col(c) == value)
    return out


def read_back(comparisons: DataFrame, documents: DataFrame) -> DataFrame:
    """Comparisons with the names of both documents, empty where a document is missing."""
    names = documents.select("id", "filename")
    old = names.select(F.col("id").alias("old_document_id"), F.col("filename").alias("old_document"))
    new = names.select(F.col("id").alias("new_document_id"), F.col("filename").alias("new_document"))
    joined = comparisons.join(old, "old_document_id", "left").join(new, "new_document_id", "left")
    return joined.select(*comparisons.columns, F.coalesce("old_document", F.lit("")).alias("old_document"), F.coalesce("new_document", F.lit("")).alias("new_document"))


def deterministic_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)
