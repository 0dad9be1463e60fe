import numpy as np
import pytest
from pyspark.sql import functions as F

from palimp.llm.termfreq import ARRAY, BITMAP, RUNS, packed, pieces, single, term_containers, term_frequencies, union, unpacked

SCHEMA = "id string, kind string, section string, term string, records long, field string, loaded int"


def test_counts(spark):
    rows = [(f"r{k}", "hot" if k % 3 else None, "1.0 Cold  Room" if k % 2 else "") for k in range(90)] + [("x", "once", None)]
    rows += rows[:20]  # delivered again
    rows += [(None, "nobody", "a"), ("r1", "second value", None)]
    df = spark.createDataFrame([(i, a, b, "t", 1, "f", k) for k, (i, a, b) in enumerate(rows)], SCHEMA)
    got = {(r.field, r.term): r for r in term_frequencies(df, "id", {"kind": ("kind", single), "word": ("section", pieces)}).collect()}
    assert (got["kind", "hot"].records, got["kind", "hot"].occurrences, got["kind", "hot"].mark) == (60, 60, "common")
    assert got["kind", "once"].mark == "rare" and got["kind", "second value"].records == 1
    assert got["word", "Cold"].records == 45 and got["word", "Cold"].share == 0.5
    assert ("kind", "nobody") not in got and ("word", "") not in got


def test_more_records_than_a_bitmap_holds(spark):
    df = spark.range(100_000).select(F.concat(F.lit("r"), "id").alias("id"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("v"))
    got = {r.term: r.records for r in term_frequencies(df, "id", {"v": ("v", single)}).collect()}
    assert got == {"even": 50_000, "odd": 50_000}
    assert term_frequencies(df.limit(0), "id", {"v": ("v", single)}).count() == 0


def test_occurrences_within_a_record(spark):
    df = spark.createDataFrame([("a", "x x y"), ("b", "x"), ("c", None)], "id string, v string")
    got = {r.term: (r.occurrences, r.records, r.share) for r in term_frequencies(df, "id", {"v": ("v", pieces)}).collect()}
    assert got == {"x": (3, 2, 1.0), "y": (1, 1, 0.5)}


@pytest.mark.parametrize("positions,form", [([7], ARRAY), ([0, 65535], ARRAY), (list(range(100, 40_000)), RUNS), (list(range(0, 65536, 3)), BITMAP), (list(range(65536)), RUNS)])
def test_containers(positions, form):
    c = packed(np.array(positions))
    assert c[:1] == form and unpacked(c).tolist() == positions
    assert len(packed(np.array([7]))) == 3
    assert union([c, packed(np.array([5, 7])), c]).tolist() == sorted({*positions, 5, 7})


def test_rare_terms_cost_bytes(spark):
    df = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("id"), F.concat(F.lit("only"), "id").alias("v"))
    rows = term_containers(df, "id", {"v": ("v", single)}).where("term <> ''").collect()
    assert len(rows) == 3000 and all(len(r.container) == 3 for r in rows)
