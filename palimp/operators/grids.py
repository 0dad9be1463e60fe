"""Tables of a document as cells, rows and columns, declaratively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(value: str, separator: str, *order: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, value))), lambda x: x[value]), separator)


def cells(paragraphs: DataFrame) -> DataFrame:
    """document_id, table_id, row, col, text (paragraphs joined by a blank), row_span, col_span (of the first paragraph)."""
    p = paragraphs.where(F.col("table_position.table_id").isNotNull()).select("document_id", "seq", F.coalesce("text", F.lit("")).alias("text"), "table_position.*")
    first = lambda c: F.coalesce(F.min_by(c, "seq"), F.lit(1)).alias(c)
    return p.groupBy("document_id", "table_id", "row", "col").agg(_joined("text", " ", "seq").alias("text"), first("row_span"), first("col_span"))


def _dense(grid: DataFrame) -> DataFrame:
    """Every row of a table with every column, absent cells being empty. A table is one document's, so this stays small."""
    key = ["document_id", "table_id"]
    rows, cols = grid.select(*key, "row").distinct(), grid.select(*key, "col").distinct()
    return rows.join(cols, key).join(grid.select(*key, "row", "col", "text"), [*key, "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def row_texts(grid: DataFrame) -> DataFrame:
    """document_id, table_id, row and its text: the cells joined by a bar."""
    return _dense(grid).groupBy("document_id", "table_id", "row").agg(_joined("text", " | ", "col").alias("text"))


def col_texts(grid: DataFrame) -> DataFrame:
    return _dense(grid).groupBy("document_id", "table_id", "col").agg(_joined("text", " | ", "row").alias("text"))


def flat_texts(grid: DataFrame) -> DataFrame:
    """document_id, table_id and the text of the whole table."""
    return row_texts(grid).groupBy("document_id", "table_id").agg(_joined("text", " | ", "row").alias("text"))
