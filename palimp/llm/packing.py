"""Filling containers of a fixed capacity by best-fit decreasing.

Only (id, number of tokens) is moved, never a text. Texts longer than the
capacity are cut into full pieces, which fill a container each, and a rest.
Items are spread over shards of bounded size by a hash, so a shard holds the
sizes of the whole collection in its mix; within a shard, items in descending
size go to the tightest open container, found by a segment tree over remaining
capacities in logarithmic time. A shard wastes at most a few containers more
than one pass over everything would, of the tens of thousands that it fills.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.runtime import checkpoint

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern by which this byte-level BPE cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of a shard, about.
SHARD_ITEMS = 100_000


@lru_cache(4)
def encoding(path: str):
    """The byte-level BPE whose ranks are in a file of base64 tokens; loaded once a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """id and n_tokens of every row; null texts have 0 tokens like empty ones. Whole texts are encoded."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            counts = [len(encode(str(t))) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(counts, pa.int64())], ["id", "n_tokens"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long")


class OpenBins:
    """Open containers by remaining capacity, with a segment tree over the capacities that occur."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << max(1, capacity.bit_length())
        self.some = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, remaining: int, b: int) -> None:
        self.bins[remaining].append(b)
        i = remaining + self.size
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The container with the least remaining capacity of at least ``least``, taken out; (container, remaining)."""
        some, i = self.some, least + self.size
        if not some[i]:
            while True:
                if i <= 1:
                    return None
                if not i & 1 and some[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.size:
                i = 2 * i if some[2 * i] else 2 * i + 1
        remaining = i - self.size
        b = self.bins[remaining].pop()
        if not self.bins[remaining]:
            while i and not (i < self.size and (some[2 * i] or some[2 * i + 1])):
                some[i] = 0
                i >>= 1
        return b, remaining


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (all at most ``capacity``); ties go by the items' order."""
    out = np.empty(len(sizes), np.int64)
    open_bins, n = OpenBins(capacity), 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        found = open_bins.take(size)
        if found is None:
            b, left = n, capacity
            n += 1
        else:
            b, left = found
        out[k] = b
        open_bins.add(left - size, b)
    return out


def pack(sizes: DataFrame, packs: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """pack_id, bin_id, id, piece, start_token and n_tokens: every item in one container of every capacity.

    ``sizes`` has id and n_tokens (null counts as 0), ``packs`` pack_id and
    capacity_tokens (a small table; rows with a capacity below 1 are left out).
    An item is split only if it exceeds the capacity: into full pieces with a
    container each, and a rest that is packed like an item. Empty items are
    assigned too. Repeated ids are packed as items of their own. ``bin_id`` is
    unique within a pack_id. An empty table gives no rows.
    """
    sizes = checkpoint(sizes.select("id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")))
    n_shards = max(1, -(-sizes.count() // shard_items))
    kind = sizes.schema["id"].dataType.simpleString()
    capacities = packs.where("capacity_tokens >= 1 and pack_id is not null").select("pack_id", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    out = None
    for p in capacities.orderBy("pack_id").collect():
        items = sizes.withColumn("full", F.when(F.col("n_tokens") > p.capacity, F.floor(F.col("n_tokens") / p.capacity)).otherwise(0))
        items = items.select(
            "id", "full", F.pmod(F.xxhash64("id", "n_tokens"), F.lit(n_shards)).cast("int").alias("shard"),
            (F.col("n_tokens") - F.col("full") * p.capacity).alias("rest"), F.when(F.col("full") > 0, F.col("n_tokens") % p.capacity > 0).otherwise(True).alias("has_rest"),
        )
        part = items.groupBy("shard").applyInArrow(_packer(p.pack_id, p.capacity), f"pack_id int, bin_id long, id {kind}, piece int, start_token long, n_tokens long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return sizes.sparkSession.createDataFrame([], f"pack_id int, bin_id long, id {kind}, piece int, start_token long, n_tokens long")
    return out


def _packer(pack_id: int, capacity: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        # The order of a shuffle's rows is chance; that of ids is not.
        t = t.sort_by([("id", "ascending"), ("rest", "ascending")])
        full, rest, has_rest = (t[c].to_numpy() for c in ("full", "rest", "has_rest"))
        rests = np.flatnonzero(has_rest)
        bins = best_fit_decreasing(rest[rests], capacity)
        first = int(bins.max()) + 1 if len(bins) else 0
        whole = np.repeat(np.arange(len(full)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        of = np.concatenate([whole, rests])
        pieces = np.concatenate([piece, full[rests]])
        tokens = np.concatenate([np.full(len(whole), capacity), rest[rests]])
        bin_id = np.concatenate([first + np.arange(len(whole)), bins]) + (int(key[0].as_py()) << 40)
        return pa.table(
            {
                "pack_id": pa.array(np.full(len(of), pack_id, np.int32)), "bin_id": pa.array(bin_id), "id": t["id"].take(pa.array(of)),
                "piece": pa.array(pieces.astype(np.int32)), "start_token": pa.array((pieces * capacity).astype(np.int64)), "n_tokens": pa.array(tokens.astype(np.int64)),
            }
        )

    return run


def fill(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_id, containers, tokens and the share of the capacity that is used."""
    return (
        packed.groupBy("pack_id", "bin_id").agg(F.sum("n_tokens").alias("n"))
        .groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
        .join(F.broadcast(packs.select("pack_id", "capacity_tokens").distinct()), "pack_id")
        .select("pack_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("used"))
    )


def faults(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_id, items, and how many containers hold more than their capacity, items are not whole, and items are split without need.

    An item is whole if its pieces are numbered from 0 and each begins where the one before ends.
    """
    capacity = F.broadcast(packs.select("pack_id", "capacity_tokens").distinct())
    bins = packed.groupBy("pack_id", "bin_id").agg(F.sum("n_tokens").alias("n")).join(capacity, "pack_id")
    over = bins.groupBy("pack_id").agg(F.count(F.when(F.col("n") > F.col("capacity_tokens"), 1)).alias("overfull"))
    items = packed.groupBy("pack_id", "id").agg(
        F.count("*").alias("k"), F.max("piece").alias("last"), F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count_distinct("start_token").alias("starts"), F.min("start_token").alias("first")
    ).join(capacity, "pack_id")
    whole = (F.col("last") == F.col("k") - 1) & (F.col("n") == F.col("end")) & (F.col("starts") == F.col("k")) & (F.col("first") == 0)
    of = items.groupBy("pack_id").agg(F.count("*").alias("items"), F.count(F.when(~whole, 1)).alias("broken"), F.count(F.when((F.col("k") > 1) & (F.col("n") <= F.col("capacity_tokens")), 1)).alias("needless"))
    return of.join(over, "pack_id").select("pack_id", "items", "overfull", "broken", "needless")
