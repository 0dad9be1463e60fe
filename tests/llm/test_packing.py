import bisect
import os

import numpy as np
import pytest

from palimp.llm.packing import TOKENIZERS, best_fit_decreasing, faults, fill, pack, token_counts


def plain(sizes, capacity):
    """Best-fit decreasing with a sorted list of remaining capacities."""
    left, out = [], {}
    n = 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect.bisect_left(left, sizes[k])
        room = left.pop(at) if at < len(left) else capacity
        n += room == capacity and at >= len(left) + 0
        bisect.insort(left, room - sizes[k])
        out[k] = room - sizes[k]
    return sorted(left)


@pytest.mark.parametrize("seed", range(5))
def test_same_fill_as_the_plain_method(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 101, 400)
    bins = best_fit_decreasing(sizes, 100)
    used = np.bincount(bins, sizes)
    assert used.max() <= 100
    assert sorted((100 - used).astype(int).tolist()) == plain(sizes.tolist(), 100)


def test_pack(spark):
    rows = [(k, int(s)) for k, s in enumerate(np.random.default_rng(1).integers(0, 300, 500))] + [(1000, 2500), (1001, 2000), (1002, None), (7, 20)]
    sizes = spark.createDataFrame(rows, "id long, n_tokens long")
    packs = spark.createDataFrame([(1, 512), (2, 1000), (3, 0)], "pack_id int, capacity_tokens int")
    got = pack(sizes, packs, shard_items=200).collect()
    for p, capacity in ((1, 512), (2, 1000)):
        mine = [r for r in got if r.pack_id == p]
        bins, per = {}, {}
        for r in mine:
            bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_tokens
            per.setdefault(r.id, []).append((r.start_token, r.n_tokens))
        assert max(bins.values()) <= capacity
        want = {}
        for i, n in rows:
            want[i] = want.get(i, 0) + (n or 0)
        assert {i: sum(n for _, n in x) for i, x in per.items()} == want
        assert all(len(x) == 1 for i, x in per.items() if i not in (7, 1000, 1001))
        assert sorted(per[1000]) == [(k * capacity, min(capacity, 2500 - k * capacity)) for k in range(-(-2500 // capacity))]
    share = {r.pack_id: r.used for r in fill(pack(sizes, packs), packs).collect()}
    assert share[1] > 0.97 and 3 not in share
    assert pack(sizes.limit(0), packs).count() == 0


def test_faults_are_counted(spark):
    packs = spark.createDataFrame([(1, 100), (2, 40)], "pack_id int, capacity_tokens int")
    sizes = spark.createDataFrame([(k, 7 * k) for k in range(30)], "id long, n_tokens long")
    good = pack(sizes, packs)
    assert sorted(tuple(r) for r in faults(good, packs).collect()) == [(1, 30, 0, 0, 0), (2, 30, 0, 0, 0)]
    # (pack, bin, item, piece, start, tokens): an overfull container, an item with a gap, and one split without need.
    bad = spark.createDataFrame([(1, 1, 1, 0, 0, 90), (1, 1, 2, 0, 0, 20), (1, 2, 3, 0, 0, 100), (1, 3, 3, 1, 110, 50), (1, 4, 4, 0, 0, 10), (1, 5, 4, 1, 10, 10)], good.schema)
    assert [tuple(r) for r in faults(bad, packs).collect()] == [(1, 4, 1, 1, 1)]


@pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", 3), (2, "", 3), (3, None, 3), (4, "a b " * 50_000, 3), (5, "<|endoftext|>", 3)], "doc_id long, text string, n_tokens int")
    got = {r.id: r.n_tokens for r in token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 99_000 and got[5] > 1
