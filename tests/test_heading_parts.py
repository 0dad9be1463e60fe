"""q_heading_parts against Python's patterns, on headings that are not all ASCII."""

import re

from palimp.plans.core_queries import QUERIES

HEADINGS = [
    "35.0 Étiquetage", "3.8.4 Хранение", "39.0 保管条件", "Text Box 5 (33.0 Prüfumfang, after paragraph 4)", "Footnote 9 (洗浄手順, paragraph 11)", "37.0 Хранение ", "Weighing -> Хранение",
    "洗浄手順", "٣.0 التخزين", "４.０ 保管", "४.० भंडारण", "Text Box ５", "Footnote ٣ (a)", "Page Header\u00a0(x)", "5.0\u00a0Öl\u2003und  Fett", "7\u3000保管", "Page Footer (é\u2028x)", "8.0\tÉtat\n", "1.0 Purpose", "", "12",
]


def _parts(h):
    m = re.match(r"^(\d+(?:\.\d+)*)\s+(.*)$", h)
    number = m.group(1) if m else None
    label = re.match(r"^(Page (Header|Footer)|Text Box \d+|Footnote \d+)(\s\(.+\))?$", h)
    return number, " ".join((m.group(2) if m else h).split()), bool(number) and all(int(p) == 0 for p in number.split(".")[1:]), bool(label)


def test_all_headings(spark, tmp_path):
    spark.createDataFrame([(h,) for h in [*HEADINGS, *HEADINGS, None]], "section string").write.parquet(f"{tmp_path}/changes.parquet")
    rows = QUERIES["q_heading_parts"](spark, str(tmp_path)).collect()
    assert len(rows) == len(HEADINGS)
    assert {r.heading: (r.number, r.rest, r.top_level, r.label) for r in rows} == {h: _parts(h) for h in HEADINGS}
