import random
import re

import numpy as np
import pytest

from palimp.llm.leakage import Index, find_leaks, simhashes, weighted_similarity, weights, window_shingles
from palimp.llm.words import text_buffer, words


def w(t):
    return re.findall("[a-z0-9]+", re.sub(r"\\[A-Za-z]+", " ", t or "").lower())


def brute(docs, items, n=12):
    ix = {}
    for i, t in items:
        x = w(t)
        for k in range(len(x) - n + 1):
            ix.setdefault(tuple(x[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for x in [w(t)] for k in range(len(x) - n + 1) for i in ix.get(tuple(x[k : k + n]), ())}


def data():
    r = random.Random(4)
    vocabulary = [f"word{k}" for k in range(500)] + ["a", "of", "the", "in"] * 20
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(8, 60)))) for k in range(40)]
    items += [(100, items[0][1]), (101, ""), (102, None), (103, "too short")]
    docs = []
    for k in range(150):
        x = [r.choice(vocabulary) for _ in range(r.randint(0, 200))]
        if k % 3 == 0:
            y = r.choice(items[:40])[1].split()
            a = r.randint(0, max(0, len(y) - 14))
            x[len(x) // 2 : len(x) // 2] = y[a : a + r.choice([11, 12, 13, 40])]
        docs.append((k, " ".join(x)))
    docs += [(500, None), (501, ""), (502, "x " * 300_000 + items[3][1].upper()), (503, items[5][1].replace(" ", r"\emph ", 3)), (503, items[5][1])]
    return docs, items


def test_leaks_as_by_brute_force(spark):
    docs, items = data()
    corpus = spark.createDataFrame([(d, t, 1, 2.0) for d, t in docs], "doc_id long, text string, item_id int, similarity double")
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, id int")
    want = brute(docs, items)
    for block in (4_000_000, 700):
        got = [(r.id, r.item_id) for r in find_leaks(corpus, "doc_id", "text", asked, "item_id", "text", block_chars=block).where("exact").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert find_leaks(corpus.limit(0), "doc_id", "text", asked, "item_id", "text").count() == 0
    assert find_leaks(corpus, "doc_id", "text", asked.limit(0), "item_id", "text").count() == 0


@pytest.mark.parametrize("radius", [3, 5, 7])
def test_every_fingerprint_within_the_radius_is_found(radius):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"v{rng.integers(0, 9999)}" for _ in range(40)) for _ in range(30)]
    index = Index(np.arange(30), texts, 12, 2, radius)
    f = index.fingerprint
    queries, want = [], set()
    for k in range(0, len(f), 7):
        flips = rng.choice(64, radius, replace=False)
        queries.append(f[k] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)))
    queries = np.array(queries)
    for q, x in enumerate(queries):
        want |= {(q, int(i)) for i in np.flatnonzero(np.bitwise_count(f ^ x) <= radius)}
    got = {(int(a), int(b)) for x, y in index.candidates(queries) for a, b in zip(x, y)}
    assert got == want and len(want) >= len(queries)


def resembling(docs, items, n, least):
    """All pairs with windows of n words whose weighted 2-word shingles are so similar, by comparing all windows that share one."""
    weight = lambda g: sum(1 + (len(x) > 3) + (len(x) > 6) for x in g)
    shingles = lambda x: {g: weight(g) for g in zip(x, x[1:])}
    ix = {}
    for i, t in items:
        x = w(t)
        for k in range(len(x) - n + 1):
            s = shingles(x[k : k + n])
            for g in s:
                ix.setdefault(g, []).append((i, s))
    out = set()
    for d, t in docs:
        x = w(t)
        for k in range(len(x) - n + 1):
            s = shingles(x[k : k + n])
            for g in s:
                for i, o in ix.get(g, ()):
                    if (d, i) not in out:
                        common = sum(v for h, v in s.items() if h in o)
                        if common >= least * (sum(s.values()) + sum(o.values()) - common) - 1e-9:
                            out.add((d, i))
    return out


def test_edited_passages_against_all_windows(spark):
    r = random.Random(9)
    vocabulary = [f"term{k}" for k in range(400)] + "a of the in is to and".split() * 8
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(24, 70)))) for k in range(40)]
    docs = []
    for k in range(200):
        x = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        y = r.choice(items)[1].split()
        for _ in range(r.randint(0, len(y) // 12)):  # up to an edited word in twelve
            y[r.randrange(len(y))] = r.choice(vocabulary)
        docs.append((k, " ".join([*x, *y, *x[::-1]]) if k % 4 else " ".join(x)))
    corpus, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = resembling(docs, items, 24, 0.8)
    got = {(x.id, x.item_id): x for x in find_leaks(corpus, "doc_id", "text", asked, "item_id", "text", window=24, radius=5).collect()}
    assert set(got) <= want and len(got) >= 0.9 * len(want) and len(want) > 80
    assert {k for k, x in got.items() if x.exact} == brute(docs, items, 24) and any(not x.exact for x in got.values())
    assert all(x.similarity == 1.0 for x in got.values() if x.exact)


def test_simhash_and_weights():
    import pyarrow as pa

    raw, offsets = text_buffer(pa.array(["the quick brown foxes jumped over it the quick brown foxes jumped over it"]))
    h, _, length = words(raw, offsets)
    at = np.array([0, 7])
    a = simhashes(h, weights(length), at, 7)
    assert a[0] == a[1]
    s = window_shingles(h, weights(length), at, 7, 2)
    assert weighted_similarity((s[0][:1], s[1][:1]), (s[0][1:], s[1][1:]))[0] == 1.0
