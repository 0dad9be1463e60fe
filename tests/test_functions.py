import random
import re

import pytest
from pyspark.sql import functions as F

from palimp.functions import detect, text, views
from palimp.functions.detect import DATE, NUMBER, UNIT


def column(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string").select("k", f(F.col("t")).alias("v"))
    return [r.v for r in df.orderBy("k").collect()]


def test_headings(spark):
    texts = ["2.1 Scope", "2 Scope", "10.5 | 20.3 | conforms", "SCOPE", "Scope", "1.0 This ends.", "SAMPLE 12", "12", "A" * 121, "", None, " ".join(["W"] * 13), "1.2.3  Deep Heading"]
    assert column(spark, texts, text.numbered_heading)[:9] == [True, False, True, False, False, False, False, False, False]
    assert column(spark, texts, text.all_caps_heading)[:9] == [False, False, False, True, False, False, True, False, False]
    assert column(spark, ["2.0 Scope", "2  a  b ", "x", "2.1 y", "2.0.0 z"], text.heading_number) == ["2.0", "2", None, "2.1", "2.0.0"]
    assert column(spark, ["2.0 Scope", "2  a  b ", " x  y "], text.heading_rest) == ["Scope", "a b", "x y"]
    assert column(spark, ["2 a", "2.0 a", "2.0.0 a", "2.1 a", "a", None], text.top_level_numbered) == [True, True, True, False, False, False]
    assert column(spark, ["Preamble", "Paragraph 3", "Paragraph x"], text.is_synthetic) == [True, True, False]
    labels = ["Page Header", "Page Footer (Section 2, First Page)", "Text Box 1 (4.0 P (x), paragraph 2)", "Footnote 9", "Footnotes", "Page Header 2"]
    assert column(spark, labels, text.is_label) == [True, True, True, True, False, False]


def test_blanks(spark):
    odd = ["  a\tb \n", " x ", "", "a\r\nb\rc", None]
    assert column(spark, odd, text.strip) == ["a\tb", "x", "", "a\r\nb\rc", None]
    assert column(spark, odd, text.collapsed) == ["a b", "x", "", "a b c", None]
    assert column(spark, odd[3:4], text.universal_newlines) == ["a\nb\nc"]


def python_detections(old, new):
    out = []
    for kind, p, g in (("date_change", DATE, 0), ("unit_change", UNIT, 1), ("numeric_change", NUMBER, 0)):
        a, b = ([m.group(g) for m in re.finditer(p, t)] for t in (old, new))
        if a != b:
            out.append((kind, a, b, [m.span(g) for m in re.finditer(p, old)], [m.span(g) for m in re.finditer(p, new)]))
    return out


def test_detections_and_residuals_as_by_python(spark):
    r = random.Random(1)
    parts = ["Weigh ", "5 mg", "10.5 mL", " by 03 Mar 2024", " 2024-01-15", "25°C", " ± ", "-2", "98.0%", "text", "\n", "é", " 12 hours", "3kg ", "RH 60 % RH"]
    pairs = [("".join(r.choice(parts) for _ in range(r.randint(0, 7))), "".join(r.choice(parts) for _ in range(r.randint(0, 7)))) for _ in range(300)] + [("", ""), ("a", "a")]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string").withColumn("d", detect.detections(F.col("a"), F.col("b")))
    df = df.withColumns({"ra": detect.residual(F.col("a"), F.col("d")), "rb": detect.residual(F.col("b"), F.col("d"))})
    for row in df.orderBy("k").collect():
        want = python_detections(row.a, row.b)
        assert [(d.change_type, d.old_values, d.new_values) for d in row.d] == [w[:3] for w in want]
        for got, t, at in ((row.ra, row.a, 3), (row.rb, row.b, 4)):
            for s, e in sorted((s for w in want for s in w[at]), reverse=True):
                t = t[:s] + t[e:]
            assert got == t


def test_reasons(spark):
    df = spark.createDataFrame([("5 mg on 01 Jan 2024", "6 g on 02 Jan 2024"), (None, "7")], "a string, b string")
    rows = [[d.reason for d in r.d] for r in df.select(detect.detections(F.col("a"), F.col("b")).alias("d")).collect()]
    assert rows[0] == ["Date changed from 01 Jan 2024 to 02 Jan 2024.", "Unit changed from ['mg'] to ['g'].", "Numeric value(s) changed from 5, 01, 2024 to 6, 02, 2024."]
    assert rows[1] == ["Numeric value(s) changed from  to 7."]


def test_views(spark):
    p = "struct<table_id:int,row:int,col:int>"
    rows = [("numeric_change", None, None, (1, 2, 3), 0.5, ""), ("moved_paragraph", "Table", (1, 2, 3), (1, 2, 4), 0.956, "Low"), ("section_added", "Table", None, None, None, None), (None, "Body", (0, 0, 0), (0, 0, 0), 1.0, "odd")]
    df = spark.createDataFrame(rows, f"t string, source string, old {p}, new {p}, c double, r string")
    got = df.select(
        views.risk_of(F.col("t")).alias("risk"), views.effective_risk(F.col("r"), F.lit("High")).alias("eff"), views.category(F.lit("Page Header (x)"), F.col("source"), F.col("t")).alias("cat"),
        views.match_confidence(F.col("t"), F.col("c")).alias("conf"), views.table_cell(F.col("old"), F.col("new")).alias("cell"), views.coordinate(F.col("old"), F.col("new"), "col").alias("col"), views.table_key(F.col("old"), F.col("new")).alias("key"),
    ).collect()
    assert [tuple(x) for x in got] == [
        ("High", "High", "Headers", "", "Table 1, Row 2, Col 3", "4", 1), ("Medium", "Low", "Tables", "0.96", "Table 1, Row 2, Col 3 -> Table 1, Row 2, Col 4", "4 → 5", 1),
        ("High", "High", "Headers", "", "", "", -1), ("Medium", "odd", "Headers", "", "Table 0, Row 0, Col 0", "1", 0),
    ]


@pytest.mark.parametrize("kind,risk", [("numeric_change", "High"), ("formatting_only", "Informational"), ("unclassified", "Medium"), ("table_row_added", "Medium")])
def test_risks(spark, kind, risk):
    assert column(spark, [kind], views.risk_of) == [risk]


def test_two_decimals_as_python(spark):
    values = [0.0, 1.0, 0.125, 0.375, 0.005, 0.015, 2.675, 0.995, 6.999, 7.0] + [k / 1000 for k in range(1, 1000, 3)] + [random.Random(3).random() for _ in range(200)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", views.two_decimals(F.col("v")).alias("t"))
    assert [r.t for r in df.orderBy("k").collect()] == [f"{v:.2f}" for v in values]
