"""Paragraphs of page layouts: text blocks with sizes, as a page reader gives them.

A reader, such as that of PDF files, gives rows of blocks; everything after the
parser is declarative and needs one exchange by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp.functions.text import heading_shape, strip

#: Points by which a heading is larger than the body.
SIZE_DELTA = 2.0
#: The lines of a block: each line is an array of spans (text, size).
LINES = "array<array<struct<text:string,size:double>>>"


def block_text(lines: Column) -> Column:
    """Spans joined as they are, lines by a blank."""
    return strip(F.array_join(F.transform(lines, lambda line: F.array_join(F.transform(line, lambda s: s["text"]), "")), " "))


def block_size(lines: Column) -> Column:
    """The size of the first span of the first line that has one."""
    return F.get(F.get(F.filter(lines, lambda line: F.size(line) > 0), F.lit(0)), F.lit(0))["size"]


def with_body_size(blocks: DataFrame) -> DataFrame:
    """The blocks with ``baseline``: the most frequent size of their document, of equally frequent ones the first seen; null where none has a size."""
    alike = Window.partitionBy("document_id", "size")
    b = blocks.withColumns({"_n": F.when(F.col("size").isNotNull(), F.count("*").over(alike)), "_first": F.min("seq").over(alike)})
    best = Window.partitionBy("document_id").orderBy(F.desc_nulls_last("_n"), "_first").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return b.withColumn("baseline", F.first("size").over(best)).drop("_n", "_first")


def paragraphs_of_blocks(blocks: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """Paragraph rows of blocks (document_id, seq, page, lines and, if there is one, titles).

    A block is a heading if it is a title of its page - in the array ``titles`` of
    its row or in ``toc`` (document_id, page, title) -, or larger than the body and
    shaped like a heading. Blocks without text are left out; a document without
    sizes has no headings by size.
    """
    p = with_body_size(blocks.withColumns({"text": block_text(F.col("lines")), "size": block_size(F.col("lines"))}).where(F.col("text") != ""))
    by_size = F.coalesce((F.col("size") >= F.col("baseline") + SIZE_DELTA) & heading_shape(F.col("text")), F.lit(False))
    if "titles" in blocks.columns:
        by_size = by_size | F.coalesce(F.array_contains("titles", F.col("text")), F.lit(False))
    if toc is not None:
        titles = toc.select("document_id", "page", strip(F.col("title")).alias("text"), F.lit(True).alias("_toc")).distinct()
        p = p.join(titles, ["document_id", "page", "text"], "left")
        by_size = by_size | F.coalesce("_toc", F.lit(False))
    return p.select(
        "document_id", "seq", "text", "page", F.lit(None).cast("int").alias("paragraph_index"), by_size.alias("is_heading"), F.lit(True).alias("allow_text_pattern_heading"),
        F.lit(False).alias("from_table"), F.lit(None).cast("struct<table_id:int,row:int,col:int,row_span:int,col_span:int>").alias("table_position"),
    )
