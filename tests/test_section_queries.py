"""The queries over matched sections, on a comparison with an inserted section and a renamed and a reworded one."""

import datetime

import pytest

from palimp.plans.core_queries import QUERIES
from palimp.schemas import PARAGRAPHS

BODIES = {
    "samples": "This procedure describes the weighing of samples on the balance.", "site": "It applies to all laboratories and stores of the site in the north.", "gross": "Gross means with the vessel, net means without.",
    "train": "Training is given every second year by the head of the department.",
}
OLD = [("1.0 Purpose", "samples"), ("2.0 Scope", "site"), ("3.0 Training", "train")]
NEW = [("1.0 Purpose", "samples"), ("2.0 Definitions", "gross"), ("3.0 Where it applies", "site"), ("4.0 Training", "train")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    f = str(tmp_path_factory.mktemp("sections"))
    rows = []
    for name, sections in (("a", OLD), ("b", NEW)):
        for k, (heading, body) in enumerate(sections):
            rows += [(name, 2 * k, heading, None, 2 * k, True, True, False, None), (name, 2 * k + 1, BODIES[body], None, 2 * k + 1, False, True, False, None)]
    spark.createDataFrame(rows, PARAGRAPHS).write.parquet(f"{f}/paragraphs.parquet")
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("c", "a", "b", at, at)], "id string, old_document_id string, new_document_id string, created_at timestamp, loaded_at timestamp").write.parquet(f"{f}/comparisons.parquet")
    return f


def _rows(spark, folder, name):
    return sorted(((r.old_idx, r.change_type, r.reason) for r in QUERIES[name](spark, folder).collect()), key=str)


def test_heading_changed(spark, folder):
    rows = _rows(spark, folder, "q_heading_changed")
    assert [r[:2] for r in rows] == [(1, "section_heading_changed")]
    assert rows[0][2].startswith("Section heading changed from '2.0 Scope' to '3.0 Where it applies'. Headings differ substantially")


def test_renumbered(spark, folder):
    assert [r[:2] for r in _rows(spark, folder, "q_renumbered")] == [(1, "section_renumbered_cascade"), (2, "section_renumbered_cascade")]


def test_added_deleted(spark, folder):
    assert _rows(spark, folder, "q_sections_added_deleted") == [(None, "section_added", "New section added: '2.0 Definitions'. 1 paragraph.")]


def test_as_in_the_comparison(spark, folder):
    whole = [(r.change_type, r.reason) for r in QUERIES["q_compare_full"](spark, folder).collect()]
    parts = [r[1:] for q in ("q_heading_changed", "q_renumbered", "q_sections_added_deleted") for r in _rows(spark, folder, q)]
    assert sorted(parts) == sorted(whole)
