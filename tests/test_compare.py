import pytest

from palimp.operators.matching import greedy_match, longest_increasing, similarity
from palimp.operators.tables import Table, col_targets, merge_changes, row_targets, structure_changes
from palimp.plans.compare import compare
from palimp.schemas import PARAGRAPHS

import numpy as np


def test_greedy():
    assert greedy_match(np.array([[0.9, 0.1], [0.2, 0.8]]), 0.5) == [(0, 0, 0.9), (1, 1, 0.8)]
    assert greedy_match(np.array([[0.3, 0.2]]), 0.5) == []
    assert greedy_match(np.array([[0.95, 0.90], [0.85, 0.10]]), 0.5) == [(0, 0, 0.95)]
    assert greedy_match(np.array([[0.7, 0.7], [0.7, 0.7]]), 0.5) == [(0, 0, 0.7), (1, 1, 0.7)]
    assert greedy_match(np.array([[np.nan]]), 0.0) == [] and greedy_match(np.zeros((0, 3)), 0.5) == []


def test_longest_increasing():
    assert longest_increasing([0, 1, 2]) == {0, 1, 2}
    assert longest_increasing([2, 0, 1]) == {1, 2}
    assert longest_increasing([1, 0]) == {0}
    assert longest_increasing([]) == set()


def test_similarity():
    s = similarity(["Assay | 95%", "", "x"], ["Assay | 98%", "Assay | 95%", ""])
    assert s[0, 1] == 1.0 and s[0, 0] >= 0.85 and np.isnan(s[1]).all()


def cells(rows, table_id=0, seq=0):
    out = []
    for r, row in enumerate(rows):
        for c, x in enumerate(row):
            if x is not None:
                text, rs, cs = x if isinstance(x, tuple) else (x, 1, 1)
                out.append({"seq": seq + len(out), "text": text, "table_id": table_id, "row": r, "col": c, "row_span": rs, "col_span": cs})
    return out


HEAD = ["Parameter", "Specification", "Method"]
ROWS = [["Assay by titration", "95 percent", "HPLC one"], ["Water content", "2.0 percent", "Karl Fischer"], ["Hardness of core", "8 kg", "Tester device"]]


def kinds(old, new):
    changes, gone, come = structure_changes(cells(old), cells(new))
    return sorted(c["change_type"] for c in changes), len(gone), len(come)


@pytest.mark.parametrize(
    "new,want",
    [
        ([HEAD, *ROWS], ([], 0, 0)),
        ([HEAD, ROWS[0], ROWS[2]], (["table_row_deleted"], 3, 0)),
        ([HEAD, *ROWS, ["Colour of powder", "white", "visual check"]], (["table_row_added"], 0, 3)),
        ([HEAD, ROWS[1], ROWS[2], ROWS[0]], (["table_row_moved"], 0, 0)),
        ([HEAD, ["Assay by titration", "98 percent", "HPLC one"], *ROWS[1:]], ([], 0, 0)),
        ([[r[0], r[2], r[1]] for r in [HEAD, *ROWS]], (["table_column_moved"], 0, 0)),
        ([r[:2] for r in [HEAD, *ROWS]], (["table_column_deleted"], 4, 0)),
    ],
)
def test_tables(new, want):
    assert kinds([HEAD, *ROWS], new) == want


def test_merges_and_spans():
    a, b = Table.of(0, cells([["A", "B"], ["c", "d"]])), Table.of(3, cells([[("A", 1, 2), None], ["c", "d"]]))
    assert b.span[0, 0].tolist() == [1, 2] and b.text[0, 1] == "" and a.all_text() == "A | B | c | d"
    assert a.lines(1) == ["A | c", "B | d"] and a.lines(0, np.array([1])) == ["B", "d"]
    merged = list(merge_changes(a, b, np.array([0, 1]), np.array([0, 1])))
    assert [c["reason"] for c in merged] == ["Table cell at row 1, column 1 changed from spanning 1x1 to 1x2 cells."]
    assert merged[0]["old_position"] == (0, 0, 0) and merged[0]["new_position"] == (3, 0, 0) and merged[0]["section"] == "Table 4"
    assert (row_targets(a, b) >= 0).any() and col_targets(a, b, np.array([-1, 1])).tolist() == [0, 1]
    apart = Table.of(1, [*cells([["x", None, "y"]]), {"seq": 9, "text": "z", "table_id": 0, "row": 5, "col": 2, "row_span": 1, "col_span": 1}, {"seq": 10, "text": "more", "table_id": 0, "row": 5, "col": 2, "row_span": 3, "col_span": 1}])
    assert apart.numbers[0].tolist() == [0, 5] and apart.numbers[1].tolist() == [0, 2] and apart.lines(0) == ["x | y", " | z more"] and apart.span[1, 1].tolist() == [1, 1]


def table_changes(old, new, **k):
    return structure_changes(cells(old), cells(new), **k)


def test_cells_of_a_moved_row_are_still_compared():
    changes, gone, come = table_changes([HEAD, *ROWS], [HEAD, ROWS[1], ROWS[2], ["Assay by titration", "98 percent", "HPLC one"]])
    assert [c["change_type"] for c in changes] == ["table_row_moved"] and not gone and not come
    assert changes[0]["reason"] == "Table row moved from position 2 to position 4." and changes[0]["old_position"] == (0, 1, 0) and changes[0]["new_position"] == (0, 3, 0)


def test_column_edit_leaves_the_rows_matched():
    wide = [[*r, x] for r, x in zip([HEAD, *ROWS], ["Limit of the year", "five by ten", "none at all", "two in three"])]
    changes, gone, come = table_changes([HEAD, *ROWS], wide)
    assert [(c["change_type"], c["new_text"]) for c in changes] == [("table_column_added", "Limit of the year | five by ten | none at all | two in three")] and len(come) == 4 and not gone
    changes, gone, come = table_changes(wide, [HEAD, *ROWS])
    assert [c["change_type"] for c in changes] == ["table_column_deleted"] and len(gone) == 4 and not come


def test_row_and_column_at_once():
    wide = [[*r, x] for r, x in zip([HEAD, *ROWS[:2], ["Colour of powder", "white", "visual check"], ROWS[2]], ["Limit of the year", "five by ten", "none at all", "as agreed", "two in three"])]
    changes, gone, come = table_changes([HEAD, *ROWS], wide)
    assert [c["change_type"] for c in changes] == ["table_row_added", "table_column_added"] and len(come) == 4 + 5 - 1


def test_tables_match_by_content_and_others_are_left_out():
    other = [["Name", "Grade"], ["first pupil", "good work"], ["second pupil", "fair work"]]
    old, new = cells([HEAD, *ROWS]), cells(other) + cells([HEAD, *ROWS[:2]], table_id=1, seq=50)
    changes, gone, come = structure_changes(old, new)
    assert [(c["change_type"], c["section"]) for c in changes] == [("table_row_deleted", "Table 2")] and not come
    assert structure_changes(cells(other), cells([HEAD, *ROWS])) == ([], set(), set())
    assert structure_changes([], cells(other)) == ([], set(), set()) and structure_changes([], []) == ([], set(), set())


def test_no_column_in_common_keeps_the_rows_of_the_first_match():
    # An embedding that only tells texts apart by their first word makes any case possible.
    def embed(texts):
        return np.array([[1.0, 0.0] if t.startswith("k") else [0.0, 1.0] for t in texts])

    changes, _, _ = table_changes([["k a", "k b"]], [["k c", "k d"]], embed=embed)
    assert changes == []
    changes, _, _ = table_changes([["k a"], ["x b"]], [["k c"], ["k d"]], embed=embed)
    assert [c["change_type"] for c in changes] == ["table_row_deleted", "table_row_added"]


@pytest.mark.parametrize("seed", range(20))
def test_longest_run_against_all_runs(seed):
    from itertools import combinations

    rng = np.random.default_rng(seed)
    values = rng.permutation(9).tolist() if seed % 2 else rng.integers(0, 6, 8).tolist()
    rising = [c for k in range(len(values), 0, -1) for c in combinations(range(len(values)), k) if all(values[a] < values[b] for a, b in zip(c, c[1:]))]
    longest = [c for c in rising if len(c) == len(rising[0])]
    # Of the longest: the one that ends first, then has the first place before it, and so on.
    assert longest_increasing(values) == set(min(longest, key=lambda c: c[::-1]))


def test_similarity_in_blocks(monkeypatch):
    from palimp.operators import matching

    texts = ["Weigh the sample twice", "Weigh a sample", "wholly other words", "", "Weigh the sample"]
    whole = similarity(texts, texts[::-1])
    monkeypatch.setattr(matching, "BLOCK_SCORES", 40)
    assert np.array_equal(whole, similarity(texts, texts[::-1]), equal_nan=True)


def document(name, items):
    return [(name, i, t, None, i, h, True, False, None) for i, (t, h) in enumerate(items)]


OLD = [
    ("1.0 Purpose", True), ("This procedure describes the weighing of samples.", False), ("2.0 Scope", True), ("It applies to all laboratories on the site.", False), ("Training is given every second year by the head.", False),
    ("3.0 Equipment", True), ("Weigh 50 mg on the balance until 01 Jan 2024.", False),
]


def run(spark, old, new, **k):
    rows = document("a", old) + document("b", new)
    pairs = spark.createDataFrame([("c", "a", "b"), ("same", "a", "a"), ("unknown", "x", "y")], "comparison_id string, old_document_id string, new_document_id string")
    got = compare(pairs, spark.createDataFrame(rows, PARAGRAPHS), **k).collect()
    assert {r.comparison_id for r in got} <= {"c"}  # a document differs in nothing from itself
    assert all(r.change_type != "pending_llm_classification" for r in got)
    assert len({r.change_id for r in got}) == len(got)
    return sorted(got, key=lambda r: r.change_ord)


def test_detections(spark):
    new = OLD[:-1] + [("Weigh 55 mg on the balance until 15 Mar 2024.", False)]
    assert [(r.change_type, r.ai_risk_level, r.section) for r in run(spark, OLD, new)] == [("date_change", "Medium", "3.0 Equipment"), ("numeric_change", "High", "3.0 Equipment")]


def test_inserted_section_pushes_numbers(spark):
    new = [("1.0 Purpose", True), OLD[1], ("2.0 Definitions", True), ("Gross means with the vessel, net means without.", False), ("3.0 Scope", True), *OLD[3:5], ("4.0 Equipment", True), OLD[6]]
    got = run(spark, OLD, new)
    assert [r.change_type for r in got] == ["section_renumbered_cascade"] * 2 + ["section_added"]
    assert got[0].reason.endswith("as a side effect of 1 section added above it; wording unchanged.")
    assert got[2].reason == "New section added: '2.0 Definitions'. 1 paragraph."


def test_moved_and_edited(spark):
    got = run(spark, OLD, [*OLD[:4], OLD[5], OLD[6], OLD[4]])
    assert [r.change_type for r in got] == ["moved_paragraph"]
    assert got[0].section == "2.0 Scope -> 3.0 Equipment" and got[0].confidence == 1.0
    old = [*OLD[:4], ("The load cell of the second press is checked at 15 kN by the crew.", False), *OLD[5:]]
    new = [*OLD[:4], *OLD[5:], ("The load cell of the second press is checked at 18 kN by the crew.", False)]
    got = run(spark, old, new)
    assert [r.change_type for r in got] == ["moved_paragraph", "numeric_change"] and got[1].section == "3.0 Equipment"


def test_classifier(spark):
    import json

    def classifier(items):
        return json.dumps([{"change_id": i["change_id"], "change_type": "formatting_only", "reason": "said so", "confidence": 0.7} for i in items])

    new = [("1.0 Purpose", True), ("This procedure describes the careful weighing of samples.", False), *OLD[2:]]
    assert [(r.change_type, r.confidence) for r in run(spark, OLD, new)] == [("unclassified", 0.0)]
    assert [(r.change_type, r.reason, r.ai_risk_level) for r in run(spark, OLD, new, classifier=classifier)] == [("formatting_only", "said so", "Informational")]

    def broken(items):
        raise RuntimeError

    assert [r.change_type for r in run(spark, OLD, new, classifier=broken)] == ["unclassified"]
