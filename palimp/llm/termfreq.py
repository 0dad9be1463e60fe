"""Frequency of every distinct value or term, in a vertical layout.

Records get dense numbers within the partition that holds them. For each
(field, term) the record numbers are kept in containers of 65,536 positions, in
the smallest of three forms: a sorted array of 16-bit positions, runs, or a
bitmap. An occurrence counter stands beside each. Containers of a term and range
are merged by union, and the document frequency is the sum of cardinalities. A
term that occurs once costs two bytes beside its key.

A task makes the containers of a bounded number of rows at once, and the union
holds the containers of one range: neither a frequent term nor a large
vocabulary needs memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.runtime import checkpoint

#: Positions of a container, and the rows whose containers are made at once.
RANGE_BITS, _ROWS = 16, 1 << 19
#: The first byte of a container: its form.
ARRAY, RUNS, BITMAP = b"\0", b"\1", b"\2"


def packed(positions: np.ndarray) -> bytes:
    """The smallest container of sorted distinct positions below 65,536."""
    cut = np.flatnonzero(np.diff(positions) != 1) + 1
    sizes = {ARRAY: 2 * len(positions), RUNS: 4 * (len(cut) + 1), BITMAP: 1 << (RANGE_BITS - 3)}
    form = min(sizes, key=sizes.get)
    if form == ARRAY:
        return form + positions.astype("<u2").tobytes()
    if form == RUNS:
        first, last = positions[np.append(0, cut)], positions[np.append(cut, len(positions)) - 1]
        return form + np.stack([first, last], 1).astype("<u2").tobytes()
    bits = np.zeros(1 << RANGE_BITS, bool)
    bits[positions] = True
    return form + np.packbits(bits).tobytes()


def unpacked(container: bytes) -> np.ndarray:
    """The positions of a container, in order."""
    form, body = container[:1], container[1:]
    if form == ARRAY:
        return np.frombuffer(body, "<u2").astype(np.int64)
    if form == RUNS:
        runs = np.frombuffer(body, "<u2").astype(np.int64).reshape(-1, 2)
        return np.concatenate([np.arange(a, b + 1) for a, b in runs])
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8)))


def union(containers: list[bytes]) -> np.ndarray:
    """The positions that any of the containers has."""
    if len(containers) == 1:
        return unpacked(containers[0])
    bits = np.zeros(1 << RANGE_BITS, bool)
    for c in containers:
        bits[unpacked(c)] = True
    return np.flatnonzero(bits)


def numbered_records(df: DataFrame, id_col: str, inputs: list[str]) -> DataFrame:
    """One row per record (distinct id) with its different rows ``_vs`` of the input columns, and its number ``_n``.

    Rows delivered again (equal in the inputs) count once; if deliveries of an id
    differ, the record has the terms of each of them. Ids are told apart by two
    64-bit hashes, which also is what travels. Numbers are dense within a
    partition. They may come out otherwise if a task is run again, but a task's
    containers only ever hold numbers it gave itself, so cardinalities stay.
    """
    key = [F.xxhash64(id_col).alias("_a"), F.xxhash64(F.lit(1), F.reverse(F.col(id_col).cast("string"))).alias("_b")]
    rows = df.where(F.col(id_col).isNotNull()).select(*key, F.struct(*inputs).alias("_v"))
    return rows.groupBy("_a", "_b").agg(F.collect_set("_v").alias("_vs")).select("_vs", F.monotonically_increasing_id().alias("_n"))


def term_containers(df: DataFrame, id_col: str, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """field, term, range, container and occurrences, of the rows of a task that are made at once.

    ``columns`` maps a field to an input column and a function from its value (a
    Column) to an array of terms. A null term of a field stands for each record
    whose value is not null, so totals come from the same pass.
    """
    records = numbered_records(df, id_col, sorted({c for c, _ in columns.values()}))
    fields = list(columns)

    def of(k: int, field: str) -> Column:
        source, cut = columns[field]
        values = F.flatten(F.transform("_vs", lambda v: F.coalesce(F.concat(F.array(F.when(v[source].isNotNull(), "")), F.transform(cut(v[source]), lambda t: F.concat(F.lit("="), t))), F.array().cast("array<string>"))))
        return F.transform(F.filter(values, lambda t: t.isNotNull()), lambda t: F.struct(F.lit(k).alias("field"), t.alias("term")))

    long = records.select("_n", F.explode(F.flatten(F.array(*[of(k, f) for k, f in enumerate(fields)]))).alias("_t")).select("_n", "_t.field", "_t.term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= _ROWS:
                yield _containers(pa.Table.from_batches(held))
                held = []
        if held and sum(x.num_rows for x in held):
            yield _containers(pa.Table.from_batches(held))

    return long.mapInArrow(run, "field int, term string, range long, container binary, occurrences long")


def _containers(t: pa.Table) -> pa.RecordBatch:
    """The containers of the rows (_n, field, term), each group's sorted record numbers in its smallest form."""
    coded = t["term"].combine_chunks().dictionary_encode()
    n, field, term = t["_n"].to_numpy(), t["field"].to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64)
    order = np.lexsort((n, n >> RANGE_BITS, term, field))
    n, field, term = n[order], field[order], term[order]
    range_ = n >> RANGE_BITS
    new = np.append(True, (range_[1:] != range_[:-1]) | (term[1:] != term[:-1]) | (field[1:] != field[:-1]))
    start = np.flatnonzero(new)
    distinct = new | np.append(True, n[1:] != n[:-1])
    occurrences = np.diff(np.append(start, len(n)))
    kept, at = n[distinct] & ((1 << RANGE_BITS) - 1), np.cumsum(distinct) - 1
    ends = np.append(at[start][1:], len(kept))
    out = [packed(kept[a:b]) for a, b in zip(at[start].tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(field[start].astype(np.int32)), coded.dictionary.take(pa.array(term[start])), pa.array(range_[start]), pa.array(out, pa.binary()), pa.array(occurrences)], ["field", "term", "range", "container", "occurrences"]
    )


def merged(containers: DataFrame) -> DataFrame:
    """field, term, records and occurrences of every range of every term: the union of its containers."""
    keys = ["field", "term", "range"]
    schema = "field int, term string, records long, occurrences long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, count = None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            field, range_ = b["field"].to_numpy(), b["range"].to_numpy()
            term = b["term"]
            same = pc.equal(term.slice(1), term.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False).astype(bool)
            new = np.append(True, ~same | (field[1:] != field[:-1]) | (range_[1:] != range_[:-1]))
            starts = np.flatnonzero(new).tolist()
            occurrences = b["occurrences"].to_numpy()
            out = []
            for s, e in zip(starts, [*starts[1:], b.num_rows]):
                k = (int(field[s]), term[s].as_py(), int(range_[s]))
                if k != key:
                    if parts:
                        out.append((*key[:2], len(union(parts)), count))
                    key, parts, count = k, [], 0
                parts += b["container"].slice(s, e - s).to_pylist()
                if len(parts) > 64:
                    parts = [packed(union(parts))]
                count += int(occurrences[s:e].sum())
            if out:
                yield _batch(out)
        if parts:
            yield _batch([(*key[:2], len(union(parts)), count)])

    return containers.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["field", "term", "records", "occurrences"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names)


def term_frequencies(df: DataFrame, id_col: str, columns: dict[str, tuple[str, object]], rare_most: int = 2, common_share: float = 0.1) -> DataFrame:
    """field, term, occurrences, records (document frequency), share and mark of every term.

    ``mark`` is ``rare`` for at most ``rare_most`` records, else ``common`` for
    more than ``common_share`` of the records whose field is not null, else null.
    Null terms are left out; the empty string is a term. An empty table gives no
    rows. Other columns of the input are ignored.
    """
    counts = merged(term_containers(df, id_col, columns)).groupBy("field", "term").agg(F.sum("records").alias("records"), F.sum("occurrences").alias("occurrences"))
    # The counts are used twice; what is kept has the size of the result.
    counts = checkpoint(counts.select(F.element_at(F.array(*map(F.lit, columns)), F.col("field") + 1).alias("field"), "term", "records", "occurrences"))
    totals = counts.where("term = ''").select("field", F.col("records").alias("_all"))  # one row per field, however large the table
    return (
        counts.where("term <> ''")
        .join(F.broadcast(totals), "field")
        .select(
            "field", F.substring("term", 2, 0x7FFFFFFF).alias("term"), "occurrences", "records", (F.col("records") / F.col("_all")).alias("share"),
            F.when(F.col("records") <= rare_most, "rare").when(F.col("records") > F.lit(common_share) * F.col("_all"), "common").alias("mark"),
        )
    )


def single(c: Column) -> Column:
    """The terms of a field that holds one value; null stays null."""
    return F.when(c.isNotNull(), F.array(c.cast("string")))


def pieces(c: Column) -> Column:
    """The non-empty pieces of a text cut at blanks (U+0020)."""
    return F.filter(F.split(c, " "), lambda x: x != "")
