"""The queries over vectors against every pair of a label, on vectors whose partners have far ids."""

import numpy as np
import pytest

from palimp.operators import matching
from palimp.plans.core_queries import QUERIES


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(420, 16)).astype("float32")
    v[[5, 8]] = 0  # a zero vector matches nothing
    rows = [(k, [float(x) for x in v[k]], k % 7 % 3) for k in range(len(v))]
    folder = tmp_path_factory.mktemp("vectors")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), rows


def _pairs(rows):
    """Every even-odd pair of a label with a cosine of at least 0.25."""
    out = []
    for i, a, k in rows:
        for j, b, m in rows:
            if i % 2 == 0 and j % 2 == 1 and k == m and any(a) and any(b):
                x, y = np.array(a, float), np.array(b, float)
                s = round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9)
                if s >= 0.25:
                    out.append((k, i, j, s))
    return out


def _matches(pairs):
    used, out = set(), set()
    for k, i, j, _ in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if not {i, j} & used:
            used |= {i, j}
            out.add((k, i, j))
    return out, used


def test_cosine_threshold(spark, vectors):
    folder, rows = vectors
    pairs = _pairs(rows)
    assert sum(i // 100 != j // 100 for _, i, j, _ in pairs) > len(pairs) / 2
    got = {(r.grp, r.i, r.j): r.score for r in QUERIES["q_cosine_threshold"](spark, folder).collect()}
    assert got == pytest.approx({(k, i, j): s for k, i, j, s in pairs}, abs=2e-5)


@pytest.mark.parametrize("block", [1, 1000, matching.BLOCK_SCORES])
def test_greedy_match(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_SCORES", block)
    folder, rows = vectors
    got = [(r.grp, r.i, r.j) for r in QUERIES["q_greedy_match"](spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == _matches(_pairs(rows))[0]


def test_unmatched(spark, vectors):
    folder, rows = vectors
    used = _matches(_pairs(rows))[1]
    got = sorted((r.grp, r.ord, r.kind) for r in QUERIES["q_unmatched"](spark, folder).collect())
    assert got == sorted((k, i, "inserted" if i % 2 else "deleted") for i, _, k in rows if i not in used)
