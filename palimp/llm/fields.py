"""Text fields of a table in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_fields(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """id, field, text for each non-null text field of each row with an id."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]))
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), each.alias("_f")).select("id", "_f.field", "_f.text").where(F.col("text").isNotNull())
