"""Plain text as paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.functions.text import strip, universal_newlines


def paragraphs_of(text: Column) -> Column:
    """Pieces of a text between empty lines, with their numbers: array of (paragraph_index, text); empty pieces only count."""
    pieces = F.transform(F.split(universal_newlines(text), "\n\n"), lambda x, i: F.struct(i.alias("paragraph_index"), strip(x).alias("text")))
    return F.filter(pieces, lambda p: p["text"] != "")


def split_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Paragraph rows (document_id, seq, text, page, ...) of a table of texts; null and empty texts have none."""
    each = df.select(F.col(id_col).alias("document_id"), F.posexplode(paragraphs_of(F.col(text_col))).alias("seq", "_p"))
    return each.select(
        "document_id", "seq", "_p.text", F.lit(None).cast("int").alias("page"), "_p.paragraph_index", F.lit(False).alias("is_heading"), F.lit(True).alias("allow_text_pattern_heading"),
        F.lit(False).alias("from_table"), F.lit(None).cast("struct<table_id:int,row:int,col:int,row_span:int,col_span:int>").alias("table_position"),
    )


def read_txt(spark: SparkSession, *paths: str) -> DataFrame:
    """Paragraph rows of text files; the document is the file's path."""
    files = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return split_texts(files, "path", "value")
