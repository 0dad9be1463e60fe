"""Schemas of the tables that the engine exchanges."""

from __future__ import annotations

from pyspark.sql import types as T

TABLE_POSITION = T.StructType([T.StructField(c, T.IntegerType()) for c in ("table_id", "row", "col", "row_span", "col_span")])
PARAGRAPHS = T.StructType(
    [
        T.StructField("document_id", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("page", T.IntegerType()),
        T.StructField("paragraph_index", T.IntegerType()), T.StructField("is_heading", T.BooleanType()), T.StructField("allow_text_pattern_heading", T.BooleanType()),
        T.StructField("from_table", T.BooleanType()), T.StructField("table_position", TABLE_POSITION),
    ]
)
COORDINATE = "struct<table_id:int,row:int,col:int>"
CHANGES = (
    "comparison_id string, change_ord long, change_id string, section string, change_type string, source string, old_text string, new_text string, "
    "old_page int, new_page int, confidence double, ai_risk_level string, reviewer_risk_level string, reason string, reviewer_comment string, accepted boolean, "
    f"old_table_position {COORDINATE}, new_table_position {COORDINATE}"
)
