"""Comparisons with known outcomes, all in one run, and renumbered sections with their reasons."""

import json

import pytest

from palimp.operators.structure import renumbered
from palimp.plans.compare import compare
from palimp.schemas import PARAGRAPHS

S = [("1.0 Aim", True), ("This sheet tells how trays are dried.", False), ("2.0 Reach", True), ("It is used by all kitchens of the school and by the canteen of the sports hall, on every working day of the year but not in the summer holidays.", False), ("3.0 Tools", True), ("The oven is kept at 80 °C for 40 min. Two pairs of gloves, a rack for plates and a clock hang on the wall beside it, where everybody can reach them.", False)]
NEW_SECTION = [("2.0 Words", True), ("A tray is a flat plate with a rim and two handles.", False)]

# Name: old paragraphs, new paragraphs (text, whether a heading), expected (change type, risk) in the report's order.
CASES = {
    "number": ([("Yield: 91.0% to 99.0%.", False)], [("Yield: 92.0% to 98.0%.", False)], [("numeric_change", "High")]),
    "unit, number and words": ([("Keep the trays at 20°C ± 3°C.", False)], [("Keep the trays at 20°C ± 3°C and 55% RH ± 4% RH.", False)], [("unit_change", "High"), ("numeric_change", "High"), ("asked", "")]),
    "words only": ([("The kitchen chief shall sign the list.", False)], [("The canteen chief shall sign the list.", False)], [("asked", "")]),
    "unit and number": ([("Pour 15 mL of soap.", False)], [("Pour 30 L of soap.", False)], [("unit_change", "High"), ("numeric_change", "High")]),
    "number and words": ([("Take 70 mg of salt, finely ground.", False)], [("Take 75 mg of salt, roughly ground.", False)], [("numeric_change", "High"), ("asked", "")]),
    "date and number": ([("Drawn on 02 Feb 2023, mass 40 mg.", False)], [("Drawn on 09 Apr 2023, mass 45 mg.", False)], [("date_change", "Medium"), ("numeric_change", "High")]),
    "same": (S, S, []),
    "nothing before": ([], [("All of it is new here.", False)], [("added_paragraph", None)]),
    "nothing after": ([("All of it was here once.", False)], [], [("deleted_paragraph", None)]),
    "section above": (S, [*S[:2], *NEW_SECTION, ("3.0 Reach", True), S[3], ("4.0 Tools", True), S[5]], [("section_renumbered_cascade", None), ("section_renumbered_cascade", None), ("section_added", None)]),
    "section gone": ([*S[:2], *NEW_SECTION, ("3.0 Reach", True), S[3]], [*S[:2], ("2.0 Reach", True), S[3]], [("section_renumbered_cascade", None), ("section_deleted", None)]),
    "order": ([("Aim", True), S[1], ("Reach", True), S[3], ("Tools", True), S[5]], [("Tools", True), S[5], ("Aim", True), S[1], ("Reach", True), S[3]], [("section_reordered", None)]),
    "moved and edited": (
        [*S[:4], ("The big mixer of the second kitchen is oiled after 12 h of use by the cook.", False), *S[4:]], [*S, ("The big mixer of the second kitchen is oiled after 16 h of use by the cook.", False)],
        [("moved_paragraph", None), ("numeric_change", "High")],
    ),
    "moved into a new section": (
        [*S[:4], ("Every tray has a number that is burnt into its rim.", False), *S[4:]], [*S, ("4.0 Numbers", True), ("Every tray has a number that is burnt into its rim.", False)],
        [("section_added", None), ("moved_paragraph", None)],
    ),
}


@pytest.fixture(scope="module")
def outcome(spark):
    rows, pairs = [], []
    for name, sides in CASES.items():
        pairs.append((name, f"{name}/old", f"{name}/new"))
        for side, paragraphs in zip(("old", "new"), sides):
            rows += [(f"{name}/{side}", k, t, None, k, h, True, False, None) for k, (t, h) in enumerate(paragraphs)]

    def classifier(items):
        assert all(i["already_detected"] == (["numeric_change"] if "salt" in i["old_text"] else []) or "RH" in i["new_text"] for i in items)
        return json.dumps([{"change_id": i["change_id"], "change_type": "role_responsibility_change", "reason": "asked", "confidence": 0.9} for i in items])

    got = compare(spark.createDataFrame(pairs, "comparison_id string, old_document_id string, new_document_id string"), spark.createDataFrame(rows, PARAGRAPHS), classifier=classifier).collect()
    out = {name: [] for name in CASES}
    for r in sorted(got, key=lambda r: r.change_ord):
        out[r.comparison_id].append(r)
    return out


@pytest.mark.parametrize("name", sorted(CASES))
def test_outcome(outcome, name):
    want = CASES[name][2]
    got = outcome[name]
    assert [("asked" if r.reason == "asked" else r.change_type) for r in got] == [t for t, _ in want]
    assert all(risk in (None, "", r.ai_risk_level) for r, (_, risk) in zip(got, want))
    assert all(r.change_type == "role_responsibility_change" and r.ai_risk_level == "Medium" for r in got if r.reason == "asked")


def test_what_is_told_of_moves_and_sections(outcome):
    added, moved = outcome["moved into a new section"]
    assert added.new_text == "4.0 Numbers" and added.reason == "New section added: '4.0 Numbers'. All content moved; see the related move entries."
    assert moved.section == "2.0 Reach -> 4.0 Numbers"
    assert [r.reason for r in outcome["section above"]][:2] == [f"Section renumbered from '{a}' to '{b}' as a side effect of 1 section added above it; wording unchanged." for a, b in (("2.0", "3.0"), ("3.0", "4.0"))]
    assert outcome["section gone"][0].reason.endswith("as a side effect of 1 section removed above it; wording unchanged.")


# Matches (old, new), inserted and deleted sections by their headings, and the reasons of the renumbered ones.
CASCADES = {
    "insertion": (["1.0 A", "2.0 B", "3.0 C"], ["1.0 A", "2.0 N", "3.0 B", "4.0 C"], [(0, 0), (1, 2), (2, 3)], ["1 section added", "1 section added"]),
    "deletion": (["1.0 A", "2.0 D", "3.0 C"], ["1.0 A", "2.0 C"], [(0, 0), (2, 1)], ["1 section removed"]),
    "two insertions": (["1.0 A", "2.0 B"], ["1.0 A", "2.0 N", "3.0 M", "4.0 B"], [(0, 0), (1, 3)], ["2 sections added"]),
    "swap": (["1.0 A", "2.0 B", "3.0 C"], ["1.0 A", "2.0 C", "3.0 B"], [(0, 0), (1, 2), (2, 1)], [None, None]),
    "jump": (["1.0 A", "2.0 B"], ["1.0 A", "2.0 N", "4.0 B"], [(0, 0), (1, 2)], [None]),
    "number below": (["3.1 A"], ["3.1 N", "3.2 A"], [(0, 1)], [None]),
    "label": (["1.0 A", "2.0 B"], ["Page Header", "1.0 A", "3.0 B"], [(0, 1), (1, 2)], [None]),
    "reworded": (["1.0 A", "2.0 B"], ["1.0 A", "2.0 N", "3.0 B and more"], [(0, 0), (1, 2)], ["1 section added above it."]),
}


def test_cascades(spark):
    rows = []
    for name, (old, new, matches, _) in CASCADES.items():
        rows += [(name, "match", i, j, old[i], new[j]) for i, j in matches]
        rows += [(name, "deleted", i, None, old[i], None) for i in range(len(old)) if i not in {a for a, _ in matches}]
        rows += [(name, "inserted", None, j, None, new[j]) for j in range(len(new)) if j not in {b for _, b in matches}]
    df = spark.createDataFrame(rows, "comparison_id string, kind string, old_idx int, new_idx int, old_heading string, new_heading string")
    got = {}
    for r in sorted(renumbered(df).collect(), key=lambda r: r.old_idx):
        got.setdefault(r.comparison_id, []).append(r)
    for name, (_, _, _, want) in CASCADES.items():
        assert [r.change_type for r in got[name]] == ["section_renumbered_cascade" if w else "section_renumbered" for w in want], name
        for r, w in zip(got[name], want):
            assert (f"as a side effect of {w}" in r.reason) if w else "side effect" not in r.reason, name
        if name == "reworded":
            assert "unchanged" not in got[name][0].reason
