import csv
import glob
import json

import pytest

from palimp.operators.classify import prompt
from palimp.operators.export import CSV_COLUMNS, write_csv
from palimp.plans.store import Store


def test_store(spark, tmp_path):
    (tmp_path / "old.txt").write_text('1.0 SCOPE\n\nWeigh 50 mg, "mixed"\nwell.\n\n2.0 END\n\nDone here.')
    (tmp_path / "new.txt").write_text('1.0 SCOPE\n\nWeigh 55 mg, "mixed"\nwell.\n\n2.0 END\n\nDone here.')
    store = Store(spark, str(tmp_path / "store"))
    assert store.documents().count() == 0 and store.changes().count() == 0
    store.ingest("txt", str(tmp_path / "old.txt"))
    store.ingest("txt", str(tmp_path / "new.txt"))
    with pytest.raises(ValueError):
        store.ingest("odt", "x")
    ids = {r.filename: r.id for r in store.documents().collect()}
    pairs = spark.createDataFrame([(ids["old.txt"], ids["new.txt"]), (ids["old.txt"], "unknown")], "old_document_id string, new_document_id string")
    for _ in range(2):  # the same comparison again adds nothing
        made = store.compare(pairs).collect()
    assert len(made) == 1
    comparison, counts, changes = store.load(made[0].comparison_id)
    assert [(r.old_document, r.new_document) for r in comparison.collect()] == [("old.txt", "new.txt")]
    change = changes.collect()
    assert [c.change_type for c in change] == ["numeric_change"] and counts.first().high_risk == 1
    store.review(spark.createDataFrame([(change[0].change_id, "Low")], "change_id string, reviewer_risk_level string"))
    store.review(spark.createDataFrame([(change[0].change_id, True), ("unknown", True)], "change_id string, accepted boolean"))
    row = store.changes(made[0].comparison_id).first()
    assert (row.reviewer_risk_level, row.accepted, row.reviewer_comment, row.ai_risk_level) == ("Low", True, None, "High")
    text = json.loads(store.export(made[0].comparison_id).first().json)
    assert text["summary"]["total_changes"] == 1 and text["changes"][0]["risk_level"] == "Low" and text["changes"][0]["old_page"] is None
    assert store.export(made[0].comparison_id, "csv").columns == CSV_COLUMNS
    write_csv(store.changes(), str(tmp_path / "csv"))
    with open(glob.glob(str(tmp_path / "csv/*.csv"))[0], newline="") as f:
        rows = list(csv.DictReader(f))
    assert rows[0]["old_text"] == 'Weigh 50 mg, "mixed"\nwell.' and rows[0]["accepted"] == "True" and rows[0]["reviewer_comment"] == ""
    plan = store.changes(made[0].comparison_id)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_prompt():
    text = prompt([{"change_id": "1", "old_text": "a", "new_text": "b", "already_detected": ["date_change"]}, {"change_id": "2", "old_text": "ü", "new_text": "c"}])
    assert "already_detected" in text and "formatting_only" in text
    assert [json.loads(x)["change_id"] for x in text.split("Items:\n")[1].splitlines()] == ["1", "2"]
    assert "already_detected" not in prompt([{"change_id": "2", "old_text": "a", "new_text": "c", "already_detected": []}])


def test_compare_counts_match(spark, tmp_path):
    from palimp.operators.summary import group_labels, risk_counts, summarize

    rows = [("c", "High", None, "section_added", "S"), ("c", "High", "Low", "numeric_change", "S"), ("c", "odd", None, None, "T"), ("d", None, "", "section_reordered", None)]
    df = spark.createDataFrame(rows, "comparison_id string, ai_risk_level string, reviewer_risk_level string, change_type string, section string")
    s = {r.comparison_id: r for r in summarize(df, spark.createDataFrame([("c",), ("none",)], "comparison_id string")).collect()}
    assert (s["c"].total_changes, s["c"].high_risk, s["c"].low_risk, s["c"].sections_added, s["none"].total_changes) == (3, 2, 0, 1, 0)
    assert {(r.risk, r.n_changes, r.severity) for r in risk_counts(df, "comparison_id").collect()} == {("High", 1, 1), ("Low", 1, 3)}
    labels = {r.section: r.label for r in group_labels(df, "section", "section").collect()}
    assert labels == {"S": "\U0001f534 S — 2 changes (1 High, 1 Low)", "T": "T — 0 changes", None: " — 0 changes"}
    assert summarize(df.limit(0)).count() == 0
