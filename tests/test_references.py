from datetime import datetime

from palimp.operators.references import Parent, Reference, count_by_period, dangling_references

D = lambda d: datetime(2024, 1, d)
PARENT = "id string, loaded_at timestamp_ntz, key string, reason string"
CHILD = "id string, ref string, loaded_at timestamp_ntz, key string, parent_table string"
GONE = "record_table string, record_id string, deleted_at timestamp_ntz"


def run(spark, parents, children, gone):
    p = spark.createDataFrame([(i, t, "k", "r") for i, t in parents], PARENT)
    c = spark.createDataFrame([(i, r, t, "k", "p") for i, r, t in children], CHILD)
    found = dangling_references([Parent("P", p)], [Reference("C", c, "ref", "P")], spark.createDataFrame(gone, GONE))
    return found


def test_reasons(spark):
    parents = [("a", D(1)), ("B ", D(1)), ("late", D(9)), ("late", D(20)), ("back", D(1)), ("back", D(8)), ("gone", D(1)), (None, D(1)), ("untimed", None)]
    children = [
        ("1", " A", D(2)), ("2", "b", D(2)), ("3", "late", D(3)), ("3", "late", D(30)), ("4", "late", D(10)), ("5", "back", D(9)), ("6", "GONE ", D(9)), ("7", "never", D(9)), ("8", None, D(9)),
        ("9", "", D(9)), ("10", "untimed", D(1)), ("11", "late", None), ("12", "gone2", D(9)), (None, "a", D(2)),
    ]
    gone = [("P", "back", D(5)), ("P", "gone", D(5)), ("P", "gone2", D(5)), ("other", "a", D(5)), ("P", None, D(5))]
    got = {(r.child_id, r.reason, r.period) for r in run(spark, parents, children, gone).collect()}
    m = "2024-01"
    assert got == {("3", "late", m), ("6", "deleted", m), ("7", "missing", m), ("9", "missing", m), ("12", "deleted", m)}


def test_hot_orphan_and_repeats(spark):
    children = [(f"c{k % 500}", "nowhere" if k % 3 else "a", D(1 + k % 20)) for k in range(1500)]
    found = run(spark, [("a", D(1))], children, [])
    rows = found.collect()
    want = {i for i, r, _ in children if r == "nowhere"}
    assert {r.child_id for r in rows} == want and len(rows) == len(want)
    assert [(r.reason, r.n_references) for r in count_by_period(found).collect()] == [("missing", len(want))]


def test_empty_tables(spark):
    assert run(spark, [], [], []).count() == 0
    assert {r.reason for r in run(spark, [], [("1", "x", D(1))], []).collect()} == {"missing"}
