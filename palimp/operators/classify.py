"""Classification of wording changes that no detector explains; the classifier is a plug-in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The semantic change types, the fallback's reason, and the shape of an answer.
SEMANTIC_TYPES = ["role_responsibility_change", "reference_document_change", "qualitative_specification_change", "process_sequence_change", "clarification_no_meaning_change", "formatting_only"]
UNAVAILABLE = "Automatic classification unavailable — needs manual review."
ANSWER = "array<struct<change_id:string,change_type:string,reason:string,confidence:double>>"
#: Takes the items of a batch (change_id, old_text, new_text, already_detected), gives the answer as JSON text.
Classifier = Callable[[list[dict]], str]
# Answers of a service that are worth another try.
RETRYABLE = frozenset({429, 500, 502, 503, 504})


def request_items(pending: DataFrame) -> DataFrame:
    """comparison_id, change_id and the JSON object that asks for its classification."""
    item = F.to_json(F.struct("change_id", "old_text", "new_text", F.when(F.size("already_detected") > 0, F.col("already_detected")).alias("already_detected")))
    return pending.select("comparison_id", "change_id", item.alias("item"))


def parse_answers(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """change_id, change_type, reason and confidence out of JSON answers.

    Types outside the semantic ones become ``unclassified``; missing reasons and
    confidences are empty and 0; of several answers to a change the last of its
    batch counts; a malformed batch gives no rows.
    """
    each = answers.select(F.posexplode(F.from_json(raw, ANSWER)).alias("_p", "_a")).where(F.col("_a.change_id").isNotNull())
    one = each.groupBy("_a.change_id").agg(F.max_by("_a", "_p").alias("_a"))
    known = F.col("_a.change_type").isin(SEMANTIC_TYPES)
    return one.select("change_id", F.when(known, F.col("_a.change_type")).otherwise("unclassified").alias("change_type"), F.coalesce("_a.reason", F.lit("")).alias("reason"), F.coalesce("_a.confidence", F.lit(0.0)).alias("confidence"))


def resolved(pending: DataFrame, answers: DataFrame) -> DataFrame:
    """Pending changes with the answer's type, reason and confidence; without an answer they are unclassified."""
    a = answers.select("change_id", F.col("change_type").alias("_t"), F.col("reason").alias("_r"), F.col("confidence").alias("_c"))
    return pending.join(a, "change_id", "left").withColumns(
        {"change_type": F.coalesce("_t", F.lit("unclassified")), "reason": F.when(F.col("_t").isNull(), UNAVAILABLE).otherwise(F.col("_r")), "confidence": F.coalesce("_c", F.lit(0.0))}
    ).drop("_t", "_r", "_c")


def ask(pending: DataFrame, classifier: Classifier, attempts: int = 3, batch: int = 50, pause: float = 2.0) -> DataFrame:
    """raw answers of the classifier, called in batches; a failure that stays gives no answer."""

    def call(items: list[dict]) -> str:
        import time

        for k in range(attempts):
            try:
                text = classifier(items)
                json.loads(text)
                return text
            except Exception as e:  # any failure leaves the items unclassified
                if getattr(e, "code", None) not in RETRYABLE or k == attempts - 1:
                    break
                time.sleep(pause * 2**k)
        return "[]"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                yield pa.RecordBatch.from_arrays([pa.array([call(b.slice(lo, batch).to_pylist())])], ["raw"])

    return pending.select("change_id", "old_text", "new_text", "already_detected").mapInArrow(run, "raw string")


def prompt(items: list[dict]) -> str:
    """The request for a batch as text: what to do, then one JSON object per item."""
    lines = [
        "Each item below is a passage of a document before and after a revision. Name the one kind of change that fits it best:",
        *(f"* {t}" for t in SEMANTIC_TYPES),
        "Answer with a JSON array only; its elements have change_id, change_type, reason (a sentence) and confidence (0 to 1).",
    ]
    if any(i.get("already_detected") for i in items):
        lines.append("Where already_detected is given, those changes are known: name only what else changed.")
    keys = ("change_id", "old_text", "new_text")
    asked = [{k: i[k] for k in keys} | ({"already_detected": i["already_detected"]} if i.get("already_detected") else {}) for i in items]
    return "\n".join([*lines, "", "Items:", *(json.dumps(a, ensure_ascii=False) for a in asked)])
