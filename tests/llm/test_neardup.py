import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from palimp.llm import neardup
from palimp.llm.neardup import Banding, near_duplicate_pairs, similar_sets

SCHEMA = "id string, old_text string, new_text string, similarity double, fp long, key string, text string"


def brute(rows, t, size, least):
    sets = {}
    for i, a, b in rows:
        if i is None:
            continue
        w = [re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in (x or ""))) for x in (a, b)]
        s = {g for x in w for g in zip(*(x[k:] for k in range(size)))}
        if sum(map(len, w)) >= least and s:
            sets[i] = s
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def fixture(seed=1):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(120):
        base = [r.choice(words) for _ in range(r.randint(20, 60))]
        rows.append((f"a{k}", " ".join(base), None))
        for v in range(r.randint(0, 2)):
            other = list(base)
            for _ in range(r.randint(0, 2)):
                other[r.randrange(len(other))] = r.choice(words)
            rows.append((f"b{k}.{v}", " ".join(other).upper(), ""))
    text = " ".join(r.choice(words) for _ in range(40))
    rows += [(f"copy{k}", text, None) for k in range(30)]  # a group of copies
    rows += [("long", " ".join(r.choice(words) for _ in range(60_000)), None), ("empty", "", ""), ("null", None, None), ("short", "one two", None), (None, text, None)]
    rows += rows[:10]  # repeated rows
    return rows


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, a, b, 1.0, 7, "k", "t") for i, a, b in rows], SCHEMA)
    return {(r.id_1, r.id_2) for r in near_duplicate_pairs(df, "id", ["old_text", "new_text"], **k).collect()}


def test_pairs_as_by_brute_force(spark):
    rows = fixture()
    want = brute(rows, 0.6, 3, 20)
    got = run(spark, rows, threshold=0.6, size=3, least_words=20)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_large_buckets_are_split_with_the_same_result(spark):
    rows = fixture(2)
    plain = run(spark, rows, threshold=0.6, size=3, least_words=20)
    for hold in (1, 3, 20):
        assert run(spark, rows, threshold=0.6, size=3, least_words=20, hold=hold) == plain


def test_buckets_of_a_sorted_stream():
    rng = np.random.default_rng(5)
    for hold in (1, 4, 50, 10_000):
        key = np.sort(rng.choice([1, 2, 3, 5, 5, 5, 5, 8, 9], 300))
        value = np.arange(300)
        cuts = [0, *sorted(rng.integers(0, 300, 12)), 300]
        batches = [pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(value[a:b])], ["key", "v"]) for a, b in zip(cuts, cuts[1:])]
        for split in (True, False):
            seen = []
            finished = set()
            for k, (v,), hot in neardup.buckets(iter(batches), hold, split):
                seen += list(zip(k.tolist(), v.tolist()))
                assert split or not hot
                if not hot:  # a bucket that is not passed on in parts comes whole
                    assert not finished & set(k.tolist()) and all((k == x).sum() == (key == x).sum() for x in set(k.tolist()))
                    finished |= set(k.tolist())
                else:
                    assert all((key == x).sum() > hold for x in set(k.tolist()))
            assert sorted(seen) == list(zip(key.tolist(), value.tolist()))


def test_copies_share_a_class_and_are_not_paired(spark):
    rows = fixture(3)
    df = spark.createDataFrame([(i, a, b, 1.0, 7, "k", "t") for i, a, b in rows], SCHEMA)
    pairs, members = similar_sets(df, "id", ["old_text", "new_text"], threshold=0.8, size=5)
    by = {}
    for r in members.collect():
        by.setdefault(r.fp, set()).add(r.id)
    assert {f"copy{k}" for k in range(30)} in by.values()
    assert all(r.fp_1 != r.fp_2 and r.similarity >= 0.8 - 1e-9 for r in pairs.collect())


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert near_duplicate_pairs(df, "id", ["text"]).count() == 0


def test_banding_cuts_minhashes_to_a_root():
    b = Banding.of(0.6)
    assert b.hashes < b.a * b.b
    assert (1 - 0.6**b.rows) ** b.a < 0.01


def test_groups_join_chains(spark):
    rows = [("x1", "x2"), ("x2", "x3"), ("x3", "x4"), ("y1", "y2")]
    got = neardup.components(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "a string, b string"))
    by = {r.node: r.component for r in got.collect()}
    assert by == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"} and rows


def sets_of(lists):
    return np.concatenate([[0], np.cumsum([len(s) for s in lists])]), np.concatenate([np.sort(np.array(s, np.uint64)) for s in lists])


def rows_of(lists, banding):
    """Fingerprints and packed minhash bytes, parities and sizes of sets, as they are routed."""
    offsets, shingles = sets_of(lists)
    low = np.ascontiguousarray((neardup._sketch(offsets, shingles, banding) >> np.uint64(40)).astype(np.uint8).T)
    return np.arange(len(lists)), np.concatenate([low.view("<u8"), neardup._parities(offsets, shingles).T], 1)


def test_candidates_of_a_dense_bucket_are_passed_on_once_and_in_bounded_parts(monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(neardup, "_PAIRS", 1 << 14)
    monkeypatch.setattr(neardup, "_SQUARE", 1 << 7, raising=False)
    monkeypatch.setattr(neardup, "_FOUND", 1 << 15, raising=False)
    banding, n = Banding.of(0.6), 600
    fp, packed = rows_of([[*range(198), r.randrange(1000, 1 << 40), r.randrange(1000, 1 << 40)] for _ in range(n)], banding)
    columns = [pa.array(np.full(n, 64)), pa.array(fp), *(pa.array(np.ascontiguousarray(c)) for c in packed.view(np.int64).T)]
    batch = pa.RecordBatch.from_arrays(columns, ["key", "fp", *neardup._longs(banding)])
    tracemalloc.start()
    sizes, seen = [], set()
    for b in neardup._bucket_pairs(banding, 1 << 17, 0.6)(iter([batch])):
        sizes.append(b.num_rows)
        seen.update(zip(b["fp_1"].to_pylist(), b["fp_2"].to_pylist())) if len(seen) < 1000 else None
        some = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == n * (n - 1) // 2 and max(sizes) <= 1 << 16 and all(a < b for a, b in seen)
    assert some < 60e6


def test_sieve_keeps_every_pair_at_the_threshold_and_few_others():
    r = random.Random(6)
    for t in (0.5, 0.6, 0.8, 0.95):
        lists = []
        for size in [*range(3, 60, 4)] * 2 + [200, 1000]:
            base = r.sample(range(1 << 40), size)
            for d in (0, 1, size // 20, size // 8, size // 4, size // 3):
                lists.append(base[d:] + r.sample(range(1 << 40), d // 2 + 1))
        lists += [range(70_000), range(69_000)]
        banding = Banding(2, 12, 12, 0)
        fp, packed = rows_of(lists, banding)
        x, y = np.triu_indices(len(lists), 1)
        kept = set(zip(*(c.tolist() for c in neardup.Sieve(fp, packed, banding, t)(x, y))))
        sets = [set(s) for s in lists]
        for a, b in zip(x.tolist(), y.tolist()):
            if min(len(sets[a]), len(sets[b])) >= t * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                assert (a, b) in kept
        pairs = [p for p in neardup.Sieve(fp, packed, banding, t).pairs(np.zeros(len(lists)), np.arange(len(lists)))]
        assert kept == {p for x, y in pairs for p in zip(x.tolist(), y.tolist())} and len(kept) == sum(len(x) for x, _ in pairs)
        small = [(a, b) for a, b in kept if len(sets[a] | sets[b]) < 100 and len(sets[a] & sets[b]) < 0.6 * t * len(sets[a] | sets[b])]
        assert len(small) < 0.02 * len(x)
