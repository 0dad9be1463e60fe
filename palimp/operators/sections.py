"""Splitting documents into sections: gaps and islands over paragraphs in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimp.functions.text import heading_boundary, is_synthetic, strip


def one_per_seq(paragraphs: DataFrame) -> DataFrame:
    """One row per (document_id, seq): of several, the first by text, then by the other columns."""
    rest = [c for c in paragraphs.columns if c not in ("document_id", "seq", "text")]
    row = F.struct("text", *rest)
    one = paragraphs.where(F.col("document_id").isNotNull() & F.col("seq").isNotNull()).groupBy("document_id", "seq").agg(F.min(row).alias("_r"))
    return one.select("document_id", "seq", "_r.text", *[F.col(f"_r.{c}") for c in rest])


def split_into_sections(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs with section_idx, heading, is_body and synthetic.

    A heading opens a section and is no body; what stands before the first
    heading is the section ``Preamble``; a document without any heading has one
    section ``Paragraph n`` per paragraph, which is its body. Rows with equal
    seq should be made one first (:func:`one_per_seq`). A null text is no heading.
    """
    in_order = Window.partitionBy("document_id").orderBy("seq")
    whole = Window.partitionBy("document_id")
    p = paragraphs.withColumn("_h", heading_boundary(F.col("text"), F.col("is_heading"), F.col("allow_text_pattern_heading")))
    p = p.withColumns({"_n": F.sum(F.col("_h").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)), "_at": F.row_number().over(in_order)})
    p = p.withColumns({"_any": F.max("_n").over(whole), "_lead": F.max(F.when(F.col("_at") == 1, (~F.col("_h")).cast("int"))).over(whole)})
    named = F.last(F.when(F.col("_h"), F.col("text")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    return p.select(
        *paragraphs.columns,
        F.when(F.col("_any") == 0, F.col("_at") - 1).otherwise(F.col("_n") - 1 + F.col("_lead")).cast("int").alias("section_idx"),
        F.when(F.col("_any") == 0, F.concat(F.lit("Paragraph "), F.col("_at"))).when(F.col("_n") == 0, "Preamble").otherwise(named).alias("heading"),
        (~F.col("_h")).alias("is_body"),
    ).withColumn("synthetic", is_synthetic(F.col("heading")))


def section_texts(sectioned: DataFrame) -> DataFrame:
    """document_id, section_idx, heading and text (heading and bodies in order) of every section."""
    bodies = F.transform(F.sort_array(F.collect_list(F.when(F.col("is_body"), F.struct("seq", "text")))), lambda x: x["text"])
    return (
        sectioned.groupBy("document_id", "section_idx", "heading")
        .agg(F.count(F.when(F.col("is_body"), 1)).alias("n_paragraphs"), bodies.alias("_b"))
        .select("document_id", "section_idx", "heading", "n_paragraphs", strip(F.concat(F.col("heading"), F.lit(" "), F.array_join("_b", " "))).alias("text"))
    )
