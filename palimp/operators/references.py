"""References to rows that do not exist, were deleted or arrive later.

Parent and child keys are brought into one tagged long form and grouped by
(parent table, key); a group without a parent flag is an orphan. Every
aggregate is a partial min/max/count, so a key that holds a third of all rows
is combined before the exchange, and only keys with something to report are
joined back to their children.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parent:
    """A table that is referred to: its name, rows, key and load time."""

    name: str
    rows: DataFrame
    key: str = "id"
    loaded_at: str = "loaded_at"


@dataclass(frozen=True)
class Reference:
    """A field of a child table that holds keys of ``parent``."""

    table: str
    rows: DataFrame
    field: str
    parent: str
    id: str = "id"
    loaded_at: str = "loaded_at"


#: The white space that str.strip removes from ASCII texts, and the no-break space.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
SALTS = 16


def normal_key(c: Column) -> Column:
    """A key without regard to letter case and surrounding blanks."""
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def _children(references: Iterable[Reference]) -> DataFrame:
    """One row per (child record, key) with the child's earliest load time."""
    parts = []
    for r in references:
        rows = r.rows.select(
            F.lit(r.table).alias("child_table"),
            F.lit(r.field).alias("child_field"),
            F.lit(r.parent).alias("parent_table"),
            F.col(r.id).alias("child_id"),
            normal_key(F.col(r.field)).alias("key"),
            F.col(r.loaded_at).alias("_loaded"),
        )
        parts.append(rows.groupBy("child_table", "child_field", "parent_table", "child_id", "key").agg(F.min("_loaded").alias("child_loaded")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dangling_references(parents: Iterable[Parent], references: Iterable[Reference], deletions: DataFrame | None = None) -> DataFrame:
    """References whose parent is deleted, missing or loaded later.

    Columns: child_table, child_field, child_id, reason, period (``yyyy-MM`` of
    the child's earliest load). ``deletions`` has record_table, record_id and
    deleted_at. The first reason that holds is given: ``deleted`` (the key was
    deleted and no parent row was loaded after its last deletion), ``missing``
    (no parent row), ``late`` (the parent's earliest load is after the child's).

    Null references are no cases; an empty reference is one to a missing key.
    A child row delivered again counts once, with its earliest load. A child
    record whose deliveries hold different keys is reported for each of them.
    A child without any load time is never late and has a null period; a parent
    row without a load time counts as present but says nothing about lateness.
    Columns other than those named are ignored, so clashing names do no harm.
    """
    references = list(references)
    children = _children(references)
    tagged = []
    for p in parents:
        tagged.append(
            p.rows.select(
                F.lit(p.name).alias("parent_table"), normal_key(F.col(p.key)).alias("key"),
                F.lit(1).alias("is_parent"), F.col(p.loaded_at).alias("loaded"), F.lit(None).cast("timestamp_ntz").alias("deleted"), F.lit(None).cast("timestamp_ntz").alias("needed"),
            )
        )
    if deletions is not None:
        tagged.append(
            deletions.select(
                F.col("record_table").alias("parent_table"), normal_key(F.col("record_id")).alias("key"),
                F.lit(0).alias("is_parent"), F.lit(None).cast("timestamp_ntz").alias("loaded"), F.col("deleted_at").alias("deleted"), F.lit(None).cast("timestamp_ntz").alias("needed"),
            )
        )
    for r in references:
        tagged.append(
            r.rows.select(
                F.lit(r.parent).alias("parent_table"), normal_key(F.col(r.field)).alias("key"),
                F.lit(0).alias("is_parent"), F.lit(None).cast("timestamp_ntz").alias("loaded"), F.lit(None).cast("timestamp_ntz").alias("deleted"), F.col(r.loaded_at).alias("needed"),
            )
        )
    long = None
    for t in tagged:
        t = t.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("loaded", "deleted", "needed")})
        long = t if long is None else long.unionByName(t)
    keys = (
        long.where(F.col("key").isNotNull())
        .groupBy("parent_table", "key")
        .agg(
            F.max("is_parent").alias("has_parent"), F.min("loaded").alias("first_loaded"), F.max("loaded").alias("last_loaded"),
            F.max("deleted").alias("deleted_at"), F.min("needed").alias("first_needed"),
        )
        .withColumn(
            "reason",
            F.when(F.col("deleted_at").isNotNull() & ~F.coalesce(F.col("last_loaded") > F.col("deleted_at"), F.lit(False)), "deleted").when(F.col("has_parent") == 0, "missing"),
        )
        # A key nobody waits for early enough can't make any of its references late.
        .where(F.col("reason").isNotNull() | (F.col("first_loaded") > F.col("first_needed")))
        .select("parent_table", "key", "reason", "first_loaded")
    )
    # A single orphan key may be referred to by a third of the rows: both sides are salted.
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = (
        children.where(F.col("key").isNotNull())
        .withColumn("_salt", F.pmod(F.xxhash64("child_id"), F.lit(SALTS)).cast("int"))
        .join(salted, ["parent_table", "key", "_salt"])
        .withColumn("reason", F.coalesce(F.col("reason"), F.when(F.col("first_loaded") > F.col("child_loaded").cast("timestamp_ntz"), F.lit("late"))))
        .where(F.col("reason").isNotNull())
    )
    return found.select("child_table", "child_field", "child_id", "reason", F.date_format("child_loaded", "yyyy-MM").alias("period"))


def count_by_period(found: DataFrame) -> DataFrame:
    """The report of dangling references: how many, per table, field, reason and month."""
    return found.groupBy("child_table", "child_field", "reason", "period").agg(F.count("*").alias("n_references"))
