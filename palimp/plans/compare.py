"""The whole comparison: from paragraphs of document pairs to change rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.functions.detect import detections, residual
from palimp.functions.views import risk_of
from palimp.operators import structure
from palimp.operators.align import align
from palimp.operators.classify import UNAVAILABLE, Classifier, ask, parse_answers, resolved
from palimp.operators.matching import Embedder
from palimp.operators.sections import one_per_seq, split_into_sections
from palimp.runtime import checkpoint
from palimp.schemas import COORDINATE

#: The stages of a report in their order.
_STAGES = ["renumbered", "heading", "reordered", "pair", "added", "deleted", "move", "table", "removed", "new"]
_EMPTY = ["reviewer_risk_level", "reviewer_comment"]


def _rows(df: DataFrame, stage: str, section: Column, confidence: Column, source: Column, sub: Column | None = None, old_text: str = "old_text", new_text: str = "new_text") -> DataFrame:
    zero = F.lit(0).cast("long")
    return df.select(
        "comparison_id", F.struct(F.lit(_STAGES.index(stage)).alias("stage"), F.col("ord"), F.coalesce(F.col("sub"), zero).alias("sub"), (zero if sub is None else sub.cast("long")).alias("n")).alias("_ord"),
        section.alias("section"), "change_type", source.alias("source"), F.col(old_text).alias("old_text"), F.col(new_text).alias("new_text"), "old_page", "new_page", confidence.alias("confidence"), "reason",
        "old_table_position", "new_table_position", F.array().cast("array<string>").alias("already_detected") if "already_detected" not in df.columns else F.col("already_detected"),
    )


def paragraph_changes(pairs: DataFrame) -> DataFrame:
    """Detections of each paired paragraph, and a pending row where the rest of the texts still differs."""
    d = pairs.withColumn("_d", detections(F.col("old_text"), F.col("new_text")))
    d = d.withColumn("_differs", residual(F.col("old_text"), F.col("_d")) != residual(F.col("new_text"), F.col("_d")))
    kinds = F.transform("_d", lambda x: x["change_type"])
    pending = F.when(F.col("_differs"), F.array(F.struct(F.lit("pending_llm_classification").alias("change_type"), F.lit("").alias("reason"), F.lit(0.0).alias("confidence")))).otherwise(
        F.array().cast("array<struct<change_type:string,reason:string,confidence:double>>")
    )
    found = F.transform("_d", lambda x: F.struct(x["change_type"].alias("change_type"), x["reason"].alias("reason"), x["confidence"].alias("confidence")))
    out = d.select("*", F.posexplode(F.concat(found, pending)).alias("_n", "_x"), kinds.alias("already_detected"))
    return out.withColumns({"change_type": F.col("_x.change_type"), "reason": F.col("_x.reason"), "_confidence": F.col("_x.confidence")}).drop("_d", "_differs", "_x")


def changes_of(aligned: DataFrame) -> DataFrame:
    """All change rows of the alignment, pending ones among them."""
    body, table = F.lit("Body"), F.when(F.col("from_table"), "Table").otherwise("Body")
    one, of = F.lit(1.0), lambda kind: aligned.where(F.col("kind") == kind)
    pairs = paragraph_changes(aligned.where(F.col("kind").isin("pair", "move")))
    moves = of("move").withColumns(
        {
            "change_type": F.when(F.col("from_table"), "moved_table_content").otherwise("moved_paragraph"),
            "reason": F.concat(F.when(F.col("from_table"), "Table content moved from '").otherwise("Paragraph moved from '"), "old_heading", F.lit("' to '"), "new_heading", F.lit("'.")),
        }
    )
    rest = lambda kind, verb, word: of(kind).withColumns(
        {"change_type": F.when(F.col("from_table"), f"{verb}_table_content").otherwise(f"{verb}_paragraph"), "reason": F.when(F.col("from_table"), word[0]).otherwise(word[1])}
    )
    heading = F.col("old_heading")
    sections = aligned.where(F.col("kind").isin("match", "inserted", "deleted"))
    parts = [
        _rows(structure.renumbered(sections), "renumbered", heading, F.col("score"), body, old_text="old_heading", new_text="new_heading"),
        _rows(structure.heading_changed(sections), "heading", heading, F.col("score"), body, old_text="old_heading", new_text="new_heading"),
        _rows(structure.reordered(sections).withColumn("ord", F.col("old_idx").cast("long")), "reordered", heading, F.col("score"), body, old_text="old_heading", new_text="new_heading"),
        _rows(pairs.where("kind = 'pair'"), "pair", heading, F.col("_confidence"), table, F.col("_n")),
        _rows(structure.added_or_deleted(of("inserted")), "added", F.col("new_heading"), one, table),
        _rows(structure.added_or_deleted(of("deleted")), "deleted", heading, one, table),
        _rows(moves, "move", F.concat("old_heading", F.lit(" -> "), "new_heading"), F.col("score"), table),
        _rows(pairs.where("kind = 'move'"), "move", F.col("new_heading"), F.col("_confidence"), table, F.col("_n") + 1),
        _rows(of("table"), "table", heading, one, F.lit("Table")),
        _rows(rest("removed", "deleted", ("Table content removed.", "Paragraph removed.")), "removed", heading, one, table),
        _rows(rest("added", "added", ("New table content added.", "New paragraph added.")), "new", heading, one, table),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def finished(changes: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """Change rows with a deterministic id, their place in the report, their risk, and no pending row left."""
    place = F.concat_ws(".", "_ord.stage", "_ord.ord", "_ord.sub", "_ord.n")
    changes = changes.withColumn("change_id", F.sha2(F.concat_ws("|", "comparison_id", place), 256))
    pending = F.col("change_type") == "pending_llm_classification"
    if classifier is None:
        done = changes.withColumns({"reason": F.when(pending, UNAVAILABLE).otherwise(F.col("reason")), "change_type": F.when(pending, "unclassified").otherwise(F.col("change_type"))})
    else:
        asked = checkpoint(changes.where(pending))
        done = changes.where(~pending).unionByName(resolved(asked, parse_answers(ask(asked, classifier))))
    order = F.col("_ord.stage") * F.lit(1 << 52) + F.col("_ord.ord") * F.lit(1 << 28) + F.col("_ord.sub") * F.lit(1 << 4) + F.col("_ord.n")
    return done.select(
        "comparison_id", order.cast("long").alias("change_ord"), "change_id", "section", "change_type", "source", "old_text", "new_text", "old_page", "new_page", "confidence",
        risk_of(F.col("change_type")).alias("ai_risk_level"), *[F.lit(None).cast("string").alias(c) for c in _EMPTY[:1]], "reason", F.lit(None).cast("string").alias("reviewer_comment"), F.lit(False).alias("accepted"),
        F.col("old_table_position").cast(COORDINATE).alias("old_table_position"), F.col("new_table_position").cast(COORDINATE).alias("new_table_position"),
    )


def compare(pairs: DataFrame, paragraphs: DataFrame, embed: Embedder | None = None, classifier: Classifier | None = None) -> DataFrame:
    """Change rows of every pair (comparison_id, old_document_id, new_document_id).

    Comparing a document with itself gives no rows; so does a pair of unknown
    documents. The paragraphs of a document and of its pair are handled by one
    task; comparisons are spread over all tasks.
    """
    aligned = checkpoint(align(pairs, split_into_sections(one_per_seq(paragraphs)), embed))
    return finished(changes_of(aligned), classifier)
