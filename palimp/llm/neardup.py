"""Near-duplicate records by tensored banding of minhashes.

Each record is the set of word shingles of its text fields. Equal sets are made
one first, under a fingerprint. A small collection A of ``a`` minhash tuples and
a further one of ``b`` are computed per set; a table's key is a pair of a tuple
of A with a later tuple of A or one of the other collection, so the many tables
cost only a + b tuples. A set is routed once per A tuple; partitions are sorted
by its key, and a task forms the pair keys of one A bucket after another, in the
order they stream in.

A bucket of more than ``hold`` rows is not held: its rows go on, one for each
pair key, to a second exchange. There each pair key's rows are counted, and
those of a key with more than ``hold`` are dealt to blocks; every two blocks of
a key are a tile of its own key, so the pairs of the hottest bucket spread over
all tasks and each is looked at once.

Rows also carry their set's size and the parities of its shingles in _BINS bins.
Two sets of which n shingles are in one only differ in n parities at most, so a
pair with more than the threshold allows is none, whatever its minhashes say.
Candidates further need a number of equal minhash bytes and are then verified
with the exact similarity of their shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.words import binary_buffer, grams, mix, slices, text_buffer, words
from palimp.runtime import checkpoint

#: Bits of a shingle's hash that are kept in a set.
_SET_BITS = 40
#: Records that are made into sets at once; their number stands above the hash's bits.
_SLICE_RECORDS = 1 << 20
#: Pairs that are compared at once.
_PAIRS = 1 << 18
#: Rows of an equal key from which on their pairs are compared as a matrix, in squares of _SQUARE rows.
_DENSE = 48
_SQUARE = 512
#: Candidates that a task holds before it passes them on.
_FOUND = 1 << 19
#: Parities of a set; they and its size, in the 16 bits that remain, are two longs.
_BINS = 112
#: The size from which on a set's own is not kept.
_LARGEST = (1 << 16) - 1


@dataclass(frozen=True)
class Banding:
    """Rows per tuple and the sizes of the two collections for a threshold."""

    rows: int
    a: int
    b: int
    least_equal: int

    @property
    def hashes(self) -> int:
        return self.rows * (self.a + self.b)

    @classmethod
    def of(cls, threshold: float, miss: float = 0.006) -> Banding:
        """Tuples so long that a pair at the threshold shares one with about 0.36, and
        so many that either collection misses such a pair with at most ``miss``.
        Candidates need so many equal minhash bytes that a pair at the threshold
        fails with about 0.001 (2.8 deviations below)."""
        rows = max(1, round(math.log(0.36) / math.log(threshold)))
        hit = threshold**rows
        a = b = math.ceil(math.log(miss) / math.log(1 - hit))
        n = rows * (a + b)
        assert a < 31
        return cls(rows, a, b, max(1, math.floor(n * threshold - 2.8 * math.sqrt(n * threshold * (1 - threshold)))))


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1000, 1000 + n, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(columns: list[pa.Array], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n records: n + 1 offsets, sorted distinct shingle hashes, words per record."""
    n = len(columns[0])
    keys, count = [], np.zeros(n, np.int64)
    for column in columns:
        raw, offsets = text_buffer(column)
        h, text, _ = words(raw, offsets)
        count += np.bincount(text, minlength=n)
        g, of, _ = grams(h, text, size)
        keys.append((of.astype(np.uint64) << np.uint64(_SET_BITS)) | (g >> np.uint64(64 - _SET_BITS)))
    key = np.sort(np.concatenate(keys))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    offsets = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(_SET_BITS))
    return offsets, key & np.uint64((1 << _SET_BITS) - 1), count


def _fingerprints(offsets: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty set; sets are sorted, so equal sets have equal hashes."""
    size = np.diff(offsets)
    total = np.add.reduceat(mix(shingles + np.uint64(1)), offsets[:-1])
    other = np.bitwise_xor.reduceat(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), offsets[:-1])
    return mix(total ^ mix(other) + size.astype(np.uint64))


def _sketch(offsets: np.ndarray, shingles: np.ndarray, banding: Banding) -> np.ndarray:
    """The minhashes of each non-empty set, one row per hash function."""
    x = mix(shingles)
    out = np.empty((banding.hashes, len(offsets) - 1), np.uint64)
    for k, m in enumerate(_multipliers(banding.hashes)):
        np.minimum.reduceat(x * m, offsets[:-1], out=out[k])
    return out


def _parities(offsets: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The parities of each non-empty set's shingles in _BINS bins, and above the last of them its size: two rows."""
    at = ((mix(shingles) >> np.uint64(32)) * np.uint64(_BINS)) >> np.uint64(32)
    bit = np.uint64(1) << (at & np.uint64(63))
    out = np.stack([np.bitwise_xor.reduceat(np.where(at >> np.uint64(6) == k, bit, np.uint64(0)), offsets[:-1]) for k in range(2)])
    out[1] |= np.minimum(np.diff(offsets), _LARGEST).astype(np.uint64) << np.uint64(48)
    return out


def _records(batches: Iterator[pa.RecordBatch], fields: list[str], size: int, least_words: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, set offsets and shingles of the records with enough words and a shingle."""
    for batch in batches:
        lengths = sum(np.diff(text_buffer(batch[f])[1]) for f in fields)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        for lo, hi in slices(ends):
            for at in range(lo, hi, _SLICE_RECORDS):
                part = batch.slice(at, min(hi, at + (_SLICE_RECORDS)) - at)
                offsets, shingles, count = shingle_sets([part[f] for f in fields], size)
                keep = np.flatnonzero((count >= least_words) & (np.diff(offsets) > 0))
                if not len(keep):
                    continue
                sizes = np.diff(offsets)[keep]
                if len(keep) < len(offsets) - 1:
                    kept = np.zeros(len(offsets) - 1, bool)
                    kept[keep] = True
                    shingles = shingles[np.repeat(kept, np.diff(offsets))]
                yield part["_id"].take(pa.array(keep)), np.concatenate([[0], np.cumsum(sizes)]), shingles


def _rows(offsets: np.ndarray, data: np.ndarray, width: int) -> pa.Array:
    """Binary values, each ``width`` bytes times its number of elements."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _packed(shingles: np.ndarray) -> np.ndarray:
    """The kept bits of each hash as bytes."""
    return np.ascontiguousarray(shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _SET_BITS // 8])


def _unpacked(data: np.ndarray) -> np.ndarray:
    six = data.reshape(-1, _SET_BITS // 8)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, : _SET_BITS // 8] = six
    return out.reshape(-1).view("<u8")


def _base(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    texts = [F.col(f).cast("string").alias(f"_t{k}") for k, f in enumerate(fields)]
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), *texts)


def _fields(fields: list[str]) -> list[str]:
    return [f"_t{k}" for k in range(len(fields))]


def shingled(df: DataFrame, id_col: str, fields: list[str], size: int, least_words: int) -> DataFrame:
    """fp long and set binary, one row for each different set. Copies are combined in every batch and in every task before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, offsets, shingles in _records(batches, _fields(fields), size, least_words):
            fp, offsets, shingles = _different(_fingerprints(offsets, shingles), offsets, shingles)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), _rows(offsets, _packed(shingles), _SET_BITS // 8)], ["fp", "set"])

    return _base(df, id_col, fields).mapInArrow(run, "fp long, set binary").groupBy("fp").agg(F.first("set").alias("set"))


def membership(df: DataFrame, id_col: str, fields: list[str], size: int, least_words: int) -> DataFrame:
    """fp long and id of every record that takes part, once each; spread by both, so no set of copies is one task's."""
    base = _base(df, id_col, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, offsets, shingles in _records(batches, _fields(fields), size, least_words):
            yield pa.RecordBatch.from_arrays([pa.array(_fingerprints(offsets, shingles).view(np.int64)), ids], ["fp", "id"])

    return base.mapInArrow(run, f"fp long, id {base.schema['_id'].dataType.simpleString()}").distinct()


def _different(fp: np.ndarray, offsets: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first of each group of equal sets."""
    _, first = np.unique(fp, return_index=True)
    if len(first) == len(fp):
        return fp, offsets, shingles
    keep = np.zeros(len(fp), bool)
    keep[first] = True
    sizes = np.diff(offsets)
    return fp[keep], np.concatenate([[0], np.cumsum(sizes[keep])]), shingles[np.repeat(keep, sizes)]


def _longs(banding: Banding) -> list[str]:
    """The columns that hold the minhash bytes, and the two of parities and size."""
    return [f"s{c}" for c in range(-(-banding.hashes // 8))] + ["p0", "p1"]


def _routed(df: DataFrame, id_col: str, fields: list[str], size: int, least_words: int, banding: Banding) -> DataFrame:
    """One row per A tuple of every different set: key, fp, and the minhash bytes, parities and size in longs.

    Equal sets have equal rows of keys and longs, which are made one; they are smaller than the sets.
    """
    longs, keys = _longs(banding), [f"k{i}" for i in range(banding.a)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, offsets, shingles in _records(batches, _fields(fields), size, least_words):
            fp, offsets, shingles = _different(_fingerprints(offsets, shingles), offsets, shingles)
            sketch = _sketch(offsets, shingles, banding)
            low = np.zeros((len(fp), 8 * (len(longs) - 2)), np.uint8)
            low[:, : banding.hashes] = (sketch >> np.uint64(40)).astype(np.uint8).T
            columns = [fp, *(a_keys(sketch, banding, i) for i in range(banding.a)), *low.view("<u8").T, *_parities(offsets, shingles)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], ["fp", *keys, *longs])

    sketched = _base(df, id_col, fields).mapInArrow(run, "fp long, " + ", ".join(f"{c} long" for c in [*keys, *longs])).distinct()
    return sketched.select(F.explode(F.array(*keys)).alias("key"), "fp", *longs)


#: The low bits of a key that say which tuple of A it is made of.
_OWN = np.uint64(31)


def a_keys(sketch: np.ndarray, banding: Banding, i: int) -> np.ndarray:
    """The key of tuple i of the first collection."""
    key = np.full(sketch.shape[1], i + 1, np.uint64)
    for r in range(banding.rows):
        key = mix(key + sketch[i * banding.rows + r])
    return (key & ~_OWN) | np.uint64(i)


def codes(low: np.ndarray, banding: Banding, j: int) -> np.ndarray:
    """Tuple j of both collections, from the minhash bytes."""
    code = np.full(len(low), j + 1, np.uint64)
    for r in range(banding.rows):
        code = (code << np.uint64(8)) | low[:, j * banding.rows + r].astype(np.uint64)
    return mix(code)


def run_pairs(key: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places with equal keys, a bounded number at a time."""
    k = key[order]
    bounds = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    end = np.repeat(np.append(bounds[1:], len(k)), np.diff(np.append(bounds, len(k))))
    more = end - np.arange(len(k)) - 1
    at = np.flatnonzero(more)
    total = np.cumsum(more[at])
    lo = 0
    while lo < len(at):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + _PAIRS, "right")))
        p, m = at[lo:hi], more[at[lo:hi]]
        left = np.repeat(p, m)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
        yield order[left], order[right]
        lo = hi


def buckets(batches: Iterator[pa.RecordBatch], hold: int, split: bool = True) -> Iterator[tuple[np.ndarray, list[np.ndarray], bool]]:
    """Buckets of rows sorted by key, many small ones at a time: keys, the other columns, and whether they are of buckets of more
    than ``hold`` rows, which come in parts. At most about ``hold`` rows and a batch are held. With ``split`` false all come whole."""
    held: list[list[np.ndarray]] = []
    n, hot = 0, None  # hot: the key of the bucket that is being passed on
    join = lambda parts: [np.concatenate(c) for c in zip(*parts)]
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if hot is not None:
            cut = int(np.searchsorted(columns[0], hot, "right"))
            if cut:
                yield columns[0][:cut], [c[:cut] for c in columns[1:]], True
            if cut == len(columns[0]):
                continue
            columns, hot = [c[cut:] for c in columns], None
        held.append(columns)
        n += len(columns[0])
        if n <= hold:
            continue
        columns = join(held)
        last = int(np.searchsorted(columns[0], columns[0][-1], "left"))  # where the last, unfinished bucket begins
        if last:
            yield from _by_heat(columns[0][:last], [c[:last] for c in columns[1:]], hold, split)
        rest = [c[last:] for c in columns]
        if split and len(rest[0]) > hold:
            hot = rest[0][0]
            yield rest[0], rest[1:], True
            held, n = [], 0
        else:
            held, n = [rest], len(rest[0])
    if n:
        columns = join(held)
        yield from _by_heat(columns[0], columns[1:], hold, split)


def _by_heat(key: np.ndarray, columns: list[np.ndarray], hold: int, split: bool) -> Iterator[tuple[np.ndarray, list[np.ndarray], bool]]:
    """Finished buckets, those of more than ``hold`` rows apart."""
    bounds = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(bounds, len(key)))
    is_hot = np.repeat((sizes > hold) & split, sizes)
    for heat in (False, True):
        of = np.flatnonzero(is_hot == heat)
        if len(of):
            yield key[of], [c[of] for c in columns], heat


def partners(own: np.ndarray, banding: Banding, j: int) -> np.ndarray:
    """The rows whose A tuple forms a table with tuple j: each two tuples of A do so once."""
    return np.flatnonzero(own < j) if j < banding.a else np.arange(len(own))


def _bucket_pairs(banding: Banding, hold: int, threshold: float):
    """Candidate pairs of the buckets of a sorted partition; of larger buckets, the rows under their pair keys.

    Rows: pair_key (null for a pair), fp_1, fp_2 (null for a row) and the minhash bytes, parities and size (of a row).
    A pair comes once from its bucket, under the first tuple it shares, and candidates are passed on as soon as there are many.
    """
    longs = _longs(banding)
    names = ["pair_key", "fp_1", "fp_2", *longs]

    def pairs(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for x, y in _unique_pairs(found):
            nulls = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([nulls, pa.array(x), pa.array(y), *[nulls] * len(longs)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        n = 0
        for key, (fp, *packed), hot in buckets(batches, hold):
            packed = np.stack(packed, 1).view(np.uint64)
            low, key = packed.view(np.uint8), key.view(np.uint64)
            own = (key & _OWN).astype(np.int64)
            sieve = None if hot else Sieve(fp, packed, banding, threshold)
            for j in range(banding.a + banding.b):
                of = partners(own, banding, j)
                pair_key = key[of] + codes(low[of], banding, j)
                if hot:
                    if len(of):
                        k = mix(pair_key + np.uint64(j))
                        columns = [k.view(np.int64), fp[of], *packed[of].view(np.int64).T]
                        arrays = [pa.array(np.ascontiguousarray(c)) for c in columns]
                        yield pa.RecordBatch.from_arrays([arrays[0], arrays[1], pa.nulls(len(of), pa.int64()), *arrays[2:]], names)
                else:
                    if not len(of):
                        continue
                    order = np.argsort(pair_key, kind="stable")
                    for x, y in sieve.pairs(pair_key[order], of[order]):
                        first = ~shared_before(low, own, x, y, banding, j)
                        found += _ordered(fp, x[first], y[first])
                        n += int(first.sum())
                        if n > _FOUND:
                            yield from pairs(found)
                            found, n = [], 0
        yield from pairs(found)

    return run


def shared_before(low: np.ndarray, own: np.ndarray, x: np.ndarray, y: np.ndarray, banding: Banding, j: int) -> np.ndarray:
    """Whether pairs of rows of a bucket also share a tuple before j that forms a table with the bucket's."""
    out = np.zeros(len(x), bool)
    for k in range(j):
        of = slice(k * banding.rows, (k + 1) * banding.rows)
        out |= (low[x, of] == low[y, of]).all(1) & ((k >= banding.a) | (own[x] < k))
    return out


class Sieve:
    """Keeps of pairs of rows those that can be as similar as the threshold and have enough equal minhash bytes."""

    def __init__(self, fp: np.ndarray, packed: np.ndarray, banding: Banding, threshold: float):
        self.fp, self.minhashes, self.parities = fp, packed[:, :-2], packed[:, -2:].T.copy()
        # Of equal bytes, those that are 0 in all rows are not of minhashes.
        self.least = banding.least_equal + 8 * self.minhashes.shape[1] - banding.hashes
        size = self.parities[1] >> np.uint64(48)
        # Sets of n and m shingles with more than (n + m)(1 - t) / (1 + t) in one only are less than t similar.
        self.room = np.where(size < _LARGEST, size * ((1 - threshold) / (1 + threshold)) + 1e-2, np.inf).astype(np.float32)
        self.parities[1] <<= np.uint64(16)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart, most = np.zeros(len(x), np.uint8), self.room[x] + self.room[y]
        for parity in self.parities:
            apart += np.bitwise_count(parity[x] ^ parity[y])
            ok = np.flatnonzero(apart <= most)
            x, y, apart, most = x[ok], y[ok], apart[ok], most[ok]
        return self._alike(x, y)

    def _alike(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (equal_bytes(self.minhashes[x], self.minhashes[y]) >= self.least) & (self.fp[x] != self.fp[y])
        return x[ok], y[ok]

    def _square(self, x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of all pairs of a row of x and one of y; of x and itself each pair once."""
        apart = np.zeros((len(x), len(y)), np.uint8)
        for parity in self.parities:
            apart += np.bitwise_count(parity[x][:, None] ^ parity[y])
        ok = apart <= self.room[x][:, None] + self.room[y]
        at = np.flatnonzero(np.triu(ok, 1) if same else ok)
        return self._alike(x[at // len(y)], y[at % len(y)])

    def pairs(self, k: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of rows with equal keys that are kept; ``k`` are the rows' keys, in order."""
        bounds = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        sizes = np.diff(np.append(bounds, len(k)))
        few = np.repeat((sizes > 1) & (sizes < _DENSE), sizes)
        some, at = rows[few], np.arange(int(few.sum()))
        for x, y in run_pairs(k[few], at):
            yield self(some[x], some[y])
        for g in np.flatnonzero(sizes >= _DENSE):
            parts = [rows[at : at + _SQUARE][: bounds[g] + sizes[g] - at] for at in range(bounds[g], bounds[g] + sizes[g], _SQUARE)]
            for n, x in enumerate(parts):
                for y in parts[n:]:
                    yield self._square(x, y, y is x)


def _ordered(fp: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Pairs of rows as pairs of fingerprints, the smaller first."""
    x, y = fp[x], fp[y]
    return [np.stack([np.minimum(x, y), np.maximum(x, y)], 1)] if len(x) else []


def _unique_pairs(found: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if found:
        pairs = np.unique(np.concatenate(found), axis=0)
        yield np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def _tile_pairs(banding: Banding, hold: int, threshold: float):
    """Candidate pairs within the tiles of a sorted partition; a tile of two blocks compares across them only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (fp, block, across, *packed), _ in buckets(batches, hold, split=False):
            sieve = Sieve(fp, np.stack(packed, 1).view(np.uint64), banding, threshold)
            found: list[np.ndarray] = []
            for x, y in sieve.pairs(key, np.arange(len(key))):
                apart = ~across[x].astype(bool) | (block[x] != block[y])
                found += _ordered(fp, x[apart], y[apart])
                if sum(map(len, found)) > _FOUND:
                    yield from (pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["fp_1", "fp_2"]) for a, b in _unique_pairs(found))
                    found = []
            yield from (pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["fp_1", "fp_2"]) for a, b in _unique_pairs(found))

    return run


def _tiled(rows: DataFrame, longs: list[str], hold: int) -> DataFrame:
    """Rows under pair keys, dealt to tiles: key, fp, block, across, and the minhash bytes, parities and size.

    A key of n rows has s = n / hold blocks by the row's fingerprint, and a row is
    in s tiles, one for each block its own is paired with.
    """
    counts = rows.groupBy("pair_key").agg(F.count("*").alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(hold)).cast("int")
    r = rows.join(counts, "pair_key").withColumn("_s", blocks).withColumn("block", F.pmod(F.xxhash64("fp_1"), F.col("_s")).cast("int"))
    r = r.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    key = F.xxhash64("pair_key", F.least("block", "_o"), F.greatest("block", "_o"))
    return r.select(key.alias("key"), F.col("fp_1").alias("fp"), "block", (F.col("block") != F.col("_o")).alias("across"), *longs)


def equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes of each row of longs are equal: a byte of the difference is 0 if no bit of it is set."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    x = a ^ b
    return np.bitwise_count(~(((x & low) + low) | x | low)).sum(1, dtype=np.int16)


def _similarity():
    """Jaccard similarity of the two sets of every row, a batch at once: a hash that comes twice under a row's number is in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [binary_buffer(batch[c]) for c in ("set_1", "set_2")]
            ends = sides[0][1] + sides[1][1]
            for lo, hi in slices(ends, 1 << 22):
                keys, sizes = [], []
                for raw, e in sides:
                    n = np.diff(e[lo : hi + 1]) // (_SET_BITS // 8)
                    sizes.append(n)
                    keys.append((np.repeat(np.arange(hi - lo, dtype=np.uint64), n) << np.uint64(_SET_BITS)) | _unpacked(raw[e[lo] : e[hi]]))
                key = np.sort(np.concatenate(keys))
                twice = key[1:][key[1:] == key[:-1]] >> np.uint64(_SET_BITS)
                both = np.bincount(twice.astype(np.int64), minlength=hi - lo)
                score = both / (sizes[0] + sizes[1] - both)
                yield pa.RecordBatch.from_arrays([batch["fp_1"].slice(lo, hi - lo), batch["fp_2"].slice(lo, hi - lo), pa.array(score)], ["fp_1", "fp_2", "similarity"])

    return run


def similar_sets(df: DataFrame, id_col: str, fields: list[str], threshold: float = 0.8, size: int = 5, least_words: int = 0, banding: Banding | None = None, hold: int = 1 << 17) -> tuple[DataFrame, DataFrame]:
    """Pairs of different shingle sets at least ``threshold`` similar, and the members of each set.

    Returns (pairs: fp_1, fp_2, similarity; members: fp, id). Texts are lower-cased
    in A-Z and cut into runs of a-z and 0-9; shingles are runs of ``size`` words
    within a field; the sets of all fields are united; similarity is Jaccard's.
    Records with a null id, fewer than ``least_words`` words or no shingle (null,
    empty or short texts) take no part. Repeated rows of an id count once. The
    input's other columns are ignored. Sets are told apart by 64-bit fingerprints
    and shingles by 40-bit hashes. A task holds ``hold`` rows of 80 bytes, a
    batch and _FOUND candidates; larger buckets are split, with the same pairs.
    """
    banding = banding or Banding.of(threshold)
    longs = _longs(banding)
    sets = shingled(df, id_col, fields, size, least_words)
    rows = _routed(df, id_col, fields, size, least_words, banding).repartition(partitions(df, banding), "key").sortWithinPartitions("key")
    schema = "pair_key long, fp_1 long, fp_2 long, " + ", ".join(f"{c} long" for c in longs)
    # Pairs and rows of large buckets come from one pass; what is checkpointed are mostly the pairs.
    passed = checkpoint(rows.mapInArrow(_bucket_pairs(banding, hold, threshold), schema))
    tiles = _tiled(passed.where(F.col("pair_key").isNotNull()).drop("fp_2"), longs, hold).repartition("key").sortWithinPartitions("key")
    candidates = passed.where(F.col("pair_key").isNull()).select("fp_1", "fp_2").unionByName(tiles.mapInArrow(_tile_pairs(banding, hold, threshold), "fp_1 long, fp_2 long")).distinct()
    with_sets = (
        candidates.join(sets.select(F.col("fp").alias("fp_1"), F.col("set").alias("set_1")), "fp_1")
        .join(sets.select(F.col("fp").alias("fp_2"), F.col("set").alias("set_2")), "fp_2")
        .select("fp_1", "fp_2", "set_1", "set_2")
    )
    pairs = with_sets.mapInArrow(_similarity(), "fp_1 long, fp_2 long, similarity double").where(F.col("similarity") >= threshold - 1e-9)
    return pairs, membership(df, id_col, fields, size, least_words)


def partitions(df: DataFrame, banding: Banding) -> int:
    """Partitions for the routed rows: as the session has it, or more, so that one holds about 16 MB by the plan's estimate of the input.

    A record of some 80 stored bytes is routed in rows of 32 bytes and its minhash bytes.
    Only the number of tasks depends on the estimate; one that is beyond reason (of data without statistics) is left aside.
    """
    spark = df.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    routed = estimate * banding.a * (32 + banding.hashes) // 80
    return usual if estimate > 1 << 50 else max(usual, min(routed >> 24, 1 << 17))


def near_duplicate_pairs(df: DataFrame, id_col: str, fields: list[str], threshold: float = 0.8, size: int = 5, least_words: int = 0, **options) -> DataFrame:
    """All pairs of ids (id_1 < id_2) whose records are at least ``threshold`` similar.

    Pairs of copies are included, so use :func:`near_duplicate_groups` where large
    groups of copies are expected. Other cases as in :func:`similar_sets`.
    """
    pairs, members = similar_sets(df, id_col, fields, threshold, size, least_words, **options)
    one = members.select(F.col("fp").alias("fp_1"), F.col("id").alias("x"))
    two = members.select(F.col("fp").alias("fp_2"), F.col("id").alias("y"))
    linked = pairs.join(one, "fp_1").join(two, "fp_2").select("x", "y")
    copies = one.join(two, F.col("fp_1") == F.col("fp_2")).where("x < y").select("x", "y")
    return linked.unionByName(copies).select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2"))


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node of the edges (a, b), by alternating stars.

    Each round links the neighbours of every node to the least of them; lineage is
    cut by a checkpoint, and only a count and a sum come to the driver. The number
    of rounds grows with the logarithm of the longest chain.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = checkpoint(e)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_b")).select(F.col("a"), F.least("a", "_b").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        e = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        e = checkpoint(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, fields: list[str], threshold: float = 0.8, size: int = 5, least_words: int = 0, **options) -> DataFrame:
    """id, class_id and links of every record that takes part, one row each.

    A class is a connected component of similar sets; ``class_id`` is the least id
    of its records, and ``links`` the number of other records that are
    at least ``threshold`` similar to the record itself, copies included. Copies
    are never expanded into pairs. Other cases as in :func:`similar_sets`.
    """
    pairs, members = similar_sets(df, id_col, fields, threshold, size, least_words, **options)
    pairs = checkpoint(pairs.select("fp_1", "fp_2"))
    sizes = members.groupBy("fp").agg(F.count("*").alias("_n"), F.min("id").alias("_least"))
    both = pairs.unionByName(pairs.select(F.col("fp_2").alias("fp_1"), F.col("fp_1").alias("fp_2")))
    linked = both.join(sizes.select(F.col("fp").alias("fp_2"), "_n"), "fp_2").groupBy(F.col("fp_1").alias("fp")).agg(F.sum("_n").alias("_others"))
    classes = components(pairs.select(F.col("fp_1").alias("a"), F.col("fp_2").alias("b")))
    # The class of a set is found once per set, not per copy.
    of_set = sizes.join(linked, "fp", "left").join(classes.select(F.col("node").alias("fp"), "component"), "fp", "left")
    of_set = of_set.select("fp", F.coalesce("component", "fp").alias("_class"), "_least", (F.col("_n") - 1 + F.coalesce("_others", F.lit(0))).alias("links"))
    named = of_set.groupBy("_class").agg(F.min("_least").alias("class_id"))
    of_set = of_set.join(named, "_class").select("fp", "class_id", "links")
    return members.join(of_set, "fp").select("id", "class_id", "links")
