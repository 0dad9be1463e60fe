"""The alignment of the two documents of each comparison, in one grouped pass.

Everything sequential is done here: section matching, paragraph alignment,
moves and tables. The rows that come out carry what the later, declarative
stages need, so those need no join.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.operators.matching import Embedder, greedy_match, longest_increasing, similarity
from palimp.operators.tables import structure_changes

SECTION_THRESHOLD, MOVE_THRESHOLD = 0.6, 0.85

_SIDE = ["seq", "section_idx", "heading", "synthetic", "is_body", "text", "page", "from_table", "table_id", "row", "col", "row_span", "col_span"]
_COORDINATE = pa.struct([("table_id", pa.int32()), ("row", pa.int32()), ("col", pa.int32())])
_FIELDS = [
    ("kind", pa.string(), "string"), ("ord", pa.int64(), "long"), ("sub", pa.int64(), "long"), ("old_idx", pa.int32(), "int"), ("new_idx", pa.int32(), "int"), ("score", pa.float64(), "double"),
    ("old_heading", pa.string(), "string"), ("new_heading", pa.string(), "string"), ("kept", pa.bool_(), "boolean"), ("similarity", pa.float64(), "double"), ("old_seq", pa.int32(), "int"),
    ("new_seq", pa.int32(), "int"), ("old_text", pa.string(), "string"), ("new_text", pa.string(), "string"), ("old_page", pa.int32(), "int"), ("new_page", pa.int32(), "int"),
    ("from_table", pa.bool_(), "boolean"), ("n_body", pa.int32(), "int"), ("n_tables", pa.int32(), "int"), ("n_all", pa.int32(), "int"), ("change_type", pa.string(), "string"), ("reason", pa.string(), "string"),
    ("old_table_position", _COORDINATE, "struct<table_id:int,row:int,col:int>"), ("new_table_position", _COORDINATE, "struct<table_id:int,row:int,col:int>"),
]
SCHEMA = "comparison_id string, " + ", ".join(f"{n} {s}" for n, _, s in _FIELDS)


def opcodes(old: list[str], new: list[str]) -> list[tuple[str, int, int, int, int]]:
    """The edit operations between two sequences of texts: equal, replace, delete, insert."""
    return SequenceMatcher(None, old, new).get_opcodes()


def _at(p: dict) -> dict | None:
    return {k: p[k] for k in ("table_id", "row", "col")} if p["table_id"] is not None else None


def _sections(rows: list[dict]) -> list[dict]:
    out: list[dict] = []
    for r in rows:
        while len(out) <= r["section_idx"]:
            out.append({"heading": r["heading"], "synthetic": r["synthetic"], "body": []})
        if r["is_body"]:
            out[r["section_idx"]]["body"].append(r)
    return out


def align_documents(old_rows: list[dict], new_rows: list[dict], embed: Embedder | None = None, section_threshold: float = SECTION_THRESHOLD, move_threshold: float = MOVE_THRESHOLD) -> list[dict]:
    """The rows of one comparison: match, inserted, deleted, pair, move, removed, added, table."""
    out: list[dict] = []
    old, new = _sections(old_rows), _sections(new_rows)
    text = lambda s: " ".join([s["heading"], *(p["text"] for p in s["body"])]).strip()
    matches = greedy_match(similarity([text(s) for s in old], [text(s) for s in new], embed), section_threshold)
    by_old = sorted(range(len(matches)), key=lambda k: matches[k][0])
    kept = {by_old[p] for p in longest_increasing([matches[k][1] for k in by_old])}
    gone_rows: list[tuple[dict, str]] = []
    come_rows: list[tuple[dict, str]] = []
    for rank, (i, j, score) in enumerate(matches):
        a, b = old[i], new[j]
        pair_similarity = None
        if a["heading"] != b["heading"]:
            bare = [" ".join(h.split()) for h in (a["heading"], b["heading"])]
            bare = [h.split(" ", 1)[1] if " " in h and h.split(" ", 1)[0].replace(".", "").isdigit() else h for h in bare]
            s = similarity(bare[:1], bare[1:], embed)[0, 0]
            pair_similarity = 1.0 if bare[0] == bare[1] else float(s) if s == s else 0.0
        out.append({"kind": "match", "ord": rank, "old_idx": i, "new_idx": j, "score": score, "old_heading": a["heading"], "new_heading": b["heading"], "kept": rank in kept, "similarity": pair_similarity})
        n = 0
        for tag, a0, a1, b0, b1 in opcodes([p["text"] for p in a["body"]], [p["text"] for p in b["body"]]):
            if tag == "equal":
                continue
            paired = min(a1 - a0, b1 - b0)
            for k in range(paired):
                p, q = a["body"][a0 + k], b["body"][b0 + k]
                out.append(_pair("pair", rank, n, p, q, a["heading"], a["heading"]))
                n += 1
            gone_rows += [(p, a["heading"]) for p in a["body"][a0 + paired : a1]]
            come_rows += [(p, b["heading"]) for p in b["body"][b0 + paired : b1]]
    unmatched = [sorted(set(range(len(s))) - {m[k] for m in matches}) for k, s in enumerate((old, new))]
    whole: list[set[int]] = [set(), set()]
    for k, (side, rows) in enumerate(((old, gone_rows), (new, come_rows))):
        for i in unmatched[k]:
            rows += [(p, side[i]["heading"]) for p in side[i]["body"]]
            if not side[i]["synthetic"]:
                whole[k] |= {p["seq"] for p in side[i]["body"]}
    moves = greedy_match(similarity([p["text"] for p, _ in gone_rows], [p["text"] for p, _ in come_rows], embed), move_threshold)
    moved = [{gone_rows[i][0]["seq"] for i, _, _ in moves}, {come_rows[j][0]["seq"] for _, j, _ in moves}]
    for rank, (i, j, score) in enumerate(moves):
        (p, was), (q, now) = gone_rows[i], come_rows[j]
        out.append(_pair("move", rank, 0, p, q, was, now) | {"score": score})
    for k, (kind, side) in enumerate((("deleted", old), ("inserted", new))):
        for i in unmatched[k]:
            s = side[i]
            rest = [p for p in s["body"] if p["seq"] not in moved[k]]
            content = "\n".join([s["heading"], *(p["text"] for p in rest)])
            out.append(
                {
                    "kind": kind, "ord": i, "old_idx": None if k else i, "new_idx": i if k else None, "old_heading": None if k else s["heading"], "new_heading": s["heading"] if k else None,
                    "old_text": "" if k else content, "new_text": content if k else "", "old_page": None if k or not rest else rest[0]["page"], "new_page": rest[0]["page"] if k and rest else None,
                    "from_table": any(p["from_table"] for p in rest), "n_body": sum(not p["from_table"] for p in rest),
                    "n_tables": len({p["table_id"] for p in rest if p["from_table"] and p["table_id"] is not None}), "n_all": len(s["body"]), "kept": s["synthetic"],
                }
            )
    changes, gone_cells, come_cells = structure_changes(old_rows, new_rows, embed)
    for n, c in enumerate(changes):
        position = lambda p: dict(zip(("table_id", "row", "col"), p)) if p else None
        out.append(
            {
                "kind": "table", "ord": n, "change_type": c["change_type"], "old_heading": c["section"], "reason": c["reason"], "old_text": c["old_text"], "new_text": c["new_text"], "from_table": True,
                "old_table_position": position(c["old_position"]), "new_table_position": position(c["new_position"]),
            }
        )
    for k, (kind, rows, cells) in enumerate((("removed", gone_rows, gone_cells), ("added", come_rows, come_cells))):
        for n, (p, heading) in enumerate(rows):
            if p["seq"] in moved[k] or p["seq"] in whole[k] or p["seq"] in cells:
                continue
            side = "new" if k else "old"
            out.append({"kind": kind, "ord": n, "old_heading": heading, f"{side}_seq": p["seq"], "old_text": "", "new_text": "", f"{side}_page": p["page"], "from_table": p["from_table"], f"{side}_table_position": _at(p)} | {f"{side}_text": p["text"]})
    return out


def _pair(kind: str, ord_: int, sub: int, p: dict, q: dict, was: str, now: str) -> dict:
    return {
        "kind": kind, "ord": ord_, "sub": sub, "old_heading": was, "new_heading": now, "old_seq": p["seq"], "new_seq": q["seq"], "old_text": p["text"], "new_text": q["text"],
        "old_page": p["page"], "new_page": q["page"], "from_table": p["from_table"] or q["from_table"], "old_table_position": _at(p), "new_table_position": _at(q),
    }


def side(sectioned: DataFrame, pairs: DataFrame, document: str) -> DataFrame:
    """The sectioned paragraphs of one side of each comparison, flat."""
    p = sectioned.withColumns({"from_table": F.coalesce("from_table", F.lit(False)), "text": F.coalesce("text", F.lit(""))})
    flat = p.select(
        F.col("document_id").alias(document), "seq", "section_idx", "heading", "synthetic", "is_body", "text", "page", "from_table", "table_position.table_id", "table_position.row", "table_position.col",
        F.coalesce("table_position.row_span", F.lit(1)).alias("row_span"), F.coalesce("table_position.col_span", F.lit(1)).alias("col_span"),
    )
    return pairs.select("comparison_id", document).join(flat, document).drop(document)


def align(pairs: DataFrame, sectioned: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """The alignment rows of every comparison (see SCHEMA). A side without paragraphs aligns as an empty document."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        sides = [t.filter(pa.compute.equal(t["side"], k)).sort_by("seq").select(_SIDE).to_pylist() for k in (0, 1)]
        rows = align_documents(*sides, embed)
        return pa.table({"comparison_id": pa.array([key[0].as_py()] * len(rows), pa.string())} | {n: pa.array([r.get(n) for r in rows], t) for n, t, _ in _FIELDS})

    old, new = side(sectioned, pairs, "old_document_id"), side(sectioned, pairs, "new_document_id")
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    # The work is in the grouped function, not in the bytes: a number of partitions that is
    # given is not merged into fewer for being small, and the grouping needs no other exchange.
    # Twice the usual number: an exchange into the usual one may be left out as redundant.
    spark = both.sparkSession
    n = 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return both.repartition(n, "comparison_id").groupBy("comparison_id").applyInArrow(run, SCHEMA)
