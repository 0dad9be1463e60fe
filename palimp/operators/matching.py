"""Similarity and one-to-one matching within one comparison.

The sequential steps of a comparison - best-first matching, sequence alignment,
longest increasing subsequence - run on numpy arrays inside one grouped
function, so the n times m pairs of a comparison are never rows of a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS, _DIGITS = re.compile(r"\w+|[^\w\s]"), re.compile(r"\d")

#: Scores that are held at once when the vectors of a group are matched (32 MB).
BLOCK_SCORES = 1 << 22
#: Takes texts, gives one vector per text.
Embedder = Callable[[list[str]], np.ndarray]


@lru_cache(1 << 16)
def _word_grams(word: str) -> tuple[str, ...]:
    w = f" {word} "
    return tuple(w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1))


def ngram_vectors(texts: Iterable[str]) -> list[Counter]:
    """Counts of the 2- and 3-grams of each word with its boundaries, digits being alike."""
    out = []
    for t in texts:
        grams: Counter = Counter()
        for w in _WORDS.findall(_DIGITS.sub("0", (t or "").lower())):
            grams.update(_word_grams(w))
        out.append(grams)
    return out


def similarity(old: list[str], new: list[str], embed: Embedder | None = None) -> np.ndarray:
    """Cosine of each old with each new text; equal texts have 1, a zero vector has NaN (and never matches)."""
    if not old or not new:
        return np.zeros((len(old), len(new)))
    if embed is not None:
        a, b = np.asarray(embed(old), float), np.asarray(embed(new), float)
        with np.errstate(invalid="ignore", divide="ignore"):
            scores = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    else:
        scores = _count_cosines(ngram_vectors(old), ngram_vectors(new))
    places: dict[str, list[int]] = {}
    for j, t in enumerate(new):
        places.setdefault(t, []).append(j)
    for i, t in enumerate(old):
        for j in places.get(t, ()):
            if t:
                scores[i, j] = 1.0
    return scores


def _count_cosines(old: list[Counter], new: list[Counter]) -> np.ndarray:
    """Cosines of counts. Only grams of both sides add to a product; they are taken in blocks, so no array is wider than a block."""
    dots = np.zeros((len(old), len(new)))
    seen = {g for c in new for g in c}
    shared = {g: k for k, g in enumerate(dict.fromkeys(g for c in old for g in c if g in seen))}
    sides = []
    for side in (old, new):
        found = np.array([x for r, c in enumerate(side) for g, n in c.items() if g in shared for x in (shared[g], r, n)], float).reshape(-1, 3)
        sides.append(found[np.argsort(found[:, 0], kind="stable")])
    width = max(1, BLOCK_SCORES // (len(old) + len(new)))
    for lo in range(0, len(shared), width):
        parts = []
        for found, side in zip(sides, (old, new)):
            a, b = np.searchsorted(found[:, 0], (lo, lo + width))
            part = np.zeros((len(side), min(width, len(shared) - lo)))
            part[found[a:b, 1].astype(int), found[a:b, 0].astype(int) - lo] = found[a:b, 2]
            parts.append(part)
        dots += parts[0] @ parts[1].T
    norms = [np.sqrt([float(sum(n * n for n in c.values())) for c in side]) for side in (old, new)]
    with np.errstate(invalid="ignore", divide="ignore"):
        return dots / norms[0][:, None] / norms[1][None, :]


def greedy_match(scores: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Best-first one-to-one matches of at least the threshold, in descending score; ties by (row, column)."""
    with np.errstate(invalid="ignore"):
        i, j = np.nonzero(scores >= threshold)
    return _best_first(i, j, scores[i, j])


def _best_first(i: np.ndarray, j: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float]]:
    """The one-to-one matches among candidates, taken by descending score; ties by (row, column)."""
    used_i, used_j, out = set(), set(), []
    for k in np.lexsort((j, i, -scores)).tolist():
        a, b = int(i[k]), int(j[k])
        if a not in used_i and b not in used_j:
            used_i.add(a)
            used_j.add(b)
            out.append((a, b, float(scores[k])))
    return out


def longest_increasing(values: list[int]) -> set[int]:
    """Places of a longest strictly increasing subsequence, by piles, in n log n steps.

    A value goes on the first pile whose top is not less, so values fall within a
    pile and a pile's number is the length of the best run that ends in it. Of
    several runs, the one that ends first and steps back to the first possible
    place each time is taken.
    """
    piles: list[list[int]] = []
    tops: list[int] = []
    for place, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(piles):
            piles.append([])
            tops.append(v)
        piles[k].append(place)
        tops[k] = v
    kept: list[int] = []
    for pile in reversed(piles):
        less = bisect_right(pile, -values[kept[-1]], key=lambda place: -values[place]) if kept else 0
        kept.append(pile[less])
    return set(kept)


def match_vectors(old: DataFrame, new: DataFrame, group: str, threshold: float) -> DataFrame:
    """group, i, j, score and rank of the greedy matches of the vectors of each group.

    ``old`` and ``new`` have the group, an integer ``ord`` and ``vector``. A group
    is one comparison: its two sides and the pairs that reach the threshold must
    fit in a task, as a document does; the scores are made in blocks of rows.
    Zero and null vectors never match. Scores are rounded to nine decimals, so
    that ties don't depend on the order of summation.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.filter(pa.compute.is_valid(t["vector"])).sort_by("ord")
        a, b = (t.filter(pa.compute.equal(t["side"], k)) for k in (0, 1))
        found: list[tuple[int, int, float]] = []
        if a.num_rows and b.num_rows:
            x, y = (np.array(s["vector"].to_pylist(), float) for s in (a, b))
            with np.errstate(invalid="ignore", divide="ignore"):
                x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
                rows = max(1, BLOCK_SCORES // len(y))
                parts = []
                for lo in range(0, len(x), rows):
                    s = np.round(x[lo : lo + rows] @ y.T, 9)
                    i, j = np.nonzero(s >= threshold)
                    parts.append((i + lo, j, s[i, j]))
            found = _best_first(*map(np.concatenate, zip(*parts)))
        ia, ib = a["ord"].to_pylist(), b["ord"].to_pylist()
        n = len(found)
        return pa.table(
            {
                group: pa.array([key[0].as_py()] * n, key[0].type), "i": pa.array([ia[f[0]] for f in found], pa.int64()), "j": pa.array([ib[f[1]] for f in found], pa.int64()),
                "score": pa.array([f[2] for f in found], pa.float64()), "match_rank": pa.array(range(n), pa.int32()),
            }
        )

    kind = old.schema[group].dataType.simpleString()
    flagged = [d.select(group, "ord", "vector", F.lit(k).alias("side")) for k, d in enumerate((old, new))]
    return flagged[0].unionByName(flagged[1]).groupBy(group).applyInArrow(run, f"{group} {kind}, i long, j long, score double, match_rank int")
