"""Evaluation texts inside a training corpus, by SimHash windows and a multi-index.

Every window of ``window`` words of an article gets a 64-bit SimHash (a sum of
the weighted bits of its words). The window has the size of the passages that
are asked for: the shortest item, or the shortest part of one that counts. The
fingerprints of the items' windows are indexed once for each of ``radius`` + 1
blocks of their bits: two fingerprints within the radius agree in at least one
block, so the lookup finds every window within it, identical ones always among
them. Candidates are verified by the exact weighted similarity of their word
shingles; a stricter rule on the words can follow, for which ``exact`` tells
whether all words of a window are the item's.

The items are a stated query set: they are sent to the tasks in blocks of
bounded size, and the corpus is read once per block, without any shuffle of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.words import grams, mix, slices, text_buffer, words

BITS = 64
#: Characters outside ASCII whose lower-case form begins with an ASCII letter.
_LOWERED = {"K": "k", "İ": "i"}
#: Pairs and words that are held at once.
_PAIRS, _WORDS = 1 << 20, 1 << 16


def weights(length: np.ndarray) -> np.ndarray:
    """Longer words say more: 1 up to three characters, 2 up to six, else 3."""
    return (1 + (length > 3) + (length > 6)).astype(np.int16)


def simhashes(h: np.ndarray, weight: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The SimHash of the window of words that begins at each place ``at``."""
    out = np.zeros(len(at), np.uint64)
    if not len(at):
        return out
    sums = np.zeros(len(h) + 1, np.int16)  # differences are right modulo 2**16
    end = at + window
    for bit in range(BITS):
        signed = np.where((h >> np.uint64(bit)) & np.uint64(1), weight, -weight)
        np.cumsum(signed, out=sums[1:], dtype=np.int16)
        out |= ((sums[end] - sums[at]) > 0).astype(np.uint64) << np.uint64(bit)
    return out


class Index:
    """The windows of a block of items by each of radius + 1 blocks of their fingerprints' bits."""

    def __init__(self, items: np.ndarray, texts: list[str], window: int, shingle: int, radius: int) -> None:
        self.radius = radius
        cuts = [BITS * b // (radius + 1) for b in range(radius + 2)]
        self.blocks = [(lo, min(hi - lo, 16)) for lo, hi in zip(cuts, cuts[1:])]  # first bit and number of bits
        raw, offsets = text_buffer(pa.array(texts, pa.string()))
        h, text, length = words(raw, offsets, commands=True)
        gram, of, at = grams(h, text, window)
        # The same passage in several items is looked up once; ``owners`` has all its items.
        self.gram, first, group = np.unique(gram, return_index=True, return_inverse=True)
        weight = weights(length)
        self.fingerprint = simhashes(h, weight, at[first], window)
        pairs = np.unique(np.stack([group, of], 1), axis=0)
        self.owner_start = np.searchsorted(pairs[:, 0], np.arange(len(self.gram) + 1))
        self.owner = items[pairs[:, 1]]
        self.shingles = window_shingles(h, weight, at[first], window, shingle)
        self.order, self.start = [], []
        for b, (_, bits) in enumerate(self.blocks):
            key = self.block(self.fingerprint, b)
            self.order.append(np.argsort(key, kind="stable"))
            self.start.append(np.searchsorted(key[self.order[-1]], np.arange((1 << bits) + 1)))

    def block(self, fingerprint: np.ndarray, b: int) -> np.ndarray:
        first, bits = self.blocks[b]
        return ((fingerprint >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def candidates(self, fingerprint: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (window, item window) within the radius; a pair may come more than once."""
        for b in range(len(self.blocks)):
            key = self.block(fingerprint, b)
            start = self.start[b][key]
            count = self.start[b][key + 1] - start
            hit = np.flatnonzero(count)
            total = np.cumsum(count[hit])
            lo = 0
            while lo < len(hit):
                base = total[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(total, base + _PAIRS, "right")))
                w, c = hit[lo:hi], count[hit[lo:hi]]
                left = np.repeat(w, c)
                right = self.order[b][np.repeat(start[w] - (np.cumsum(c) - c), c) + np.arange(len(left))]
                near = np.bitwise_count(fingerprint[left] ^ self.fingerprint[right]) <= self.radius
                yield left[near], right[near]
                lo = hi


def window_shingles(h: np.ndarray, weight: np.ndarray, at: np.ndarray, window: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of each window and their weights, a row per window."""
    g = np.zeros(max(len(h) - shingle + 1, 0), np.uint64)
    w = np.zeros(len(g), np.int32)
    for k in range(shingle):
        g = mix(g + h[k : k + len(g)] + np.uint64(k + 1))
        w += weight[k : k + len(g)]
    places = at[:, None] + np.arange(window - shingle + 1)
    return g[places], w[places]


def weighted_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each pair of windows: the weight of their common shingles over that of all (repetitions count once)."""
    out = np.zeros(len(a[0]))
    for lo in range(0, len(out), 1 << 14):
        (x, wx), (y, wy) = ((s[lo : lo + (1 << 14)], w[lo : lo + (1 << 14)]) for s, w in (a, b))
        first = [~np.triu(s[:, None, :] == s[:, :, None], 1).any(1) for s in (x, y)]
        same = (x[:, :, None] == y[:, None, :]).any(2) & first[0]
        common, all_ = (wx * same).sum(1), (wx * first[0]).sum(1) + (wy * first[1]).sum(1)
        out[lo : lo + len(x)] = common / np.maximum(all_ - common, 1)
    return out


def _scan(index: Index, window: int, shingle: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch["text"])
            ids = batch["id"]
            for lo, hi in slices(offsets, 1 << 18):
                h, text, length = words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], commands=True)
                if len(h) < window:
                    continue
                weight = weights(length)
                found = []
                for begin in range(0, len(h) - window + 1, _WORDS):
                    stop = min(len(h), begin + _WORDS + window - 1)
                    hh, tt, ww = h[begin:stop], text[begin:stop], weight[begin:stop]
                    at = np.flatnonzero(tt[: len(tt) - window + 1] == tt[window - 1 :])
                    fingerprint = simhashes(hh, ww, at, window)
                    for w, i in index.candidates(fingerprint):
                        if not len(w):
                            continue
                        score = weighted_similarity(window_shingles(hh, ww, at[w], window, shingle), (index.shingles[0][i], index.shingles[1][i]))
                        ok = score >= least - 1e-9
                        w, i = w[ok], i[ok]
                        found.append((tt[at[w]] + lo, i, score[ok], _grams_at(hh, at[w], window) == index.gram[i]))
                if not found:
                    continue
                doc, win, score, exact = (np.concatenate([f[k] for f in found]) for k in range(4))
                n = index.owner_start[win + 1] - index.owner_start[win]
                doc, score, exact = np.repeat(doc, n), np.repeat(score, n), np.repeat(exact, n)
                owner = index.owner[np.repeat(index.owner_start[win] - (np.cumsum(n) - n), n) + np.arange(len(doc))]
                order = np.lexsort((~exact, -score, owner, doc))  # an exact window has the best score
                doc, owner, score, exact = doc[order], owner[order], score[order], exact[order]
                first = np.append(True, (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1])) if len(doc) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[first])), pa.array(owner[first]), pa.array(score[first]), pa.array(exact[first])], ["id", "item_id", "similarity", "exact"])

    return run


def _grams_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    g = np.zeros(len(at), np.uint64)
    for k in range(n):
        g = mix(g + h[at + k] + np.uint64(k + 1))
    return g


def find_leaks(corpus: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, window: int = 12, shingle: int = 2, radius: int = 3, least: float = 0.8, block_chars: int = 4_000_000) -> DataFrame:
    """id, item_id, similarity and exact of every corpus text with a window like one of an item.

    Windows have ``window`` words: runs of a-z and 0-9 of the lower-cased text in
    which a backslash with the letters after it is a blank. Windows within
    ``radius`` bits of an item's SimHash count whose weighted similarity over
    shingles of ``shingle`` words is at least ``least``; of several, the best is
    told, and whether its words are the item's, one by one (such windows are
    always found). Others are missed where an edit turns more bits than the radius.
    Null, empty and short texts (fewer words than a window) hold and are no leak;
    corpus rows of the same id give one row per item each has; items that share
    a passage are all reported. ``item_id`` must be a long. Items are taken in
    blocks of at most ``block_chars`` characters (one longer item alone), so what
    is sent to the tasks is bounded however many there are.
    """
    lowered = lambda c: F.translate(c.cast("string"), "".join(_LOWERED), "".join(_LOWERED.values()))
    rows = corpus.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), lowered(F.col(text_col)).alias("text"))
    asked = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), lowered(F.col(item_text)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item_id long, similarity double, exact boolean"
    out = None
    total = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // (block_chars // 2)))
    for b in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b) if n_blocks > 1 else asked
        block = block.collect()
        if not block:
            continue
        index = Index(np.array([r.item_id for r in block], np.int64), [r.text for r in block], window, shingle, radius)
        if not len(index.gram):
            continue
        found = rows.mapInArrow(_scan(index, window, shingle, least), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], schema)
    return out.groupBy("id", "item_id").agg(F.max("similarity").alias("similarity"), F.max("exact").alias("exact"))
