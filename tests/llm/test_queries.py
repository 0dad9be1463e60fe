import os

import pytest

from palimp.llm.queries import ORACLES, QUERIES
from tests.sql import DATA, same_rows

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")

FOUND = {
    "p1_found": ["change_id_1", "change_id_2"], "p2_found": ["change_id", "field"], "p3_found": ["change_id", "field"], "p4_found": ["field", "value", "mark"],
    "p5_found": ["change_id", "field", "kind"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "start_pos"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_by_sql(spark, name):
    same_rows(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_no_row_twice(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns == FOUND[name]
    rows = df.collect()
    assert rows and len(set(rows)) == len(rows) and not any(None in r for r in rows)
    if name == "p1_found":
        assert all(r.change_id_1 < r.change_id_2 for r in rows)
