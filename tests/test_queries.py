import os

import pytest

from palimp.plans import core_queries, reference_queries
from tests.sql import DATA, same_rows

QUERIES = core_queries.QUERIES | reference_queries.QUERIES
ORACLES = core_queries.ORACLES | reference_queries.ORACLES
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_by_sql(spark, name):
    same_rows(spark, QUERIES[name], ORACLES[name])


def test_entry_and_invariants(spark):
    import __spark_entry__ as entry

    changes = entry.entry(spark).collect()
    assert changes and set(entry.oracle_sql()) <= set(entry.queries())
    assert all(c.change_type != "pending_llm_classification" for c in changes)
    assert len({c.change_id for c in changes}) == len(changes)
    counts = QUERIES["q_compare_summary"](spark, DATA).collect()
    assert sum(r.total_changes for r in counts) == len(changes)
    matches = [r for r in QUERIES["q_section_matches"](spark, DATA).collect() if r.kind == "match"]
    assert len({(r.comparison_id, r.old_idx) for r in matches}) == len({(r.comparison_id, r.new_idx) for r in matches}) == len(matches)
