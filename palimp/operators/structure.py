"""Changes of sections: renumbered, renamed, moved, added, deleted. All declarative over alignment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp.functions.text import collapsed, heading_number, heading_rest, is_label, is_synthetic, top_level_numbered
from palimp.functions.views import two_decimals

REWRITE_THRESHOLD = 0.80


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def content_summary(n_body: Column, n_tables: Column, n_all: Column) -> Column:
    """What a section holds, in words."""
    parts = F.concat_ws(", ", F.when(n_body > 0, _plural(n_body, "paragraph")), F.when(n_tables > 0, _plural(n_tables, "table")))
    return F.when(parts != "", F.concat(parts, F.lit("."))).when(n_all > 0, "All content moved; see the related move entries.").otherwise("No content.")


def shifts(sections: DataFrame, group: str = "comparison_id") -> DataFrame:
    """Match rows with how many numbered sections were inserted above and deleted above.

    ``sections`` has kind (match, inserted, deleted), old_idx, new_idx and both
    headings. Running sums over each side's order replace a range join: on the
    old side deleted sections are counted, on the new side inserted ones.
    """
    count = lambda kind, h: F.when((F.col("kind") == kind) & top_level_numbered(F.col(h)), 1).otherwise(0)
    before = lambda c: Window.partitionBy(group).orderBy(F.col(c).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    s = sections.where(F.col("kind").isin("match", "inserted", "deleted"))
    s = s.withColumn("_ins", F.coalesce(F.sum(count("inserted", "new_heading")).over(before("new_idx")), F.lit(0)))
    s = s.withColumn("_del", F.coalesce(F.sum(count("deleted", "old_heading")).over(before("old_idx")), F.lit(0)))
    return s.where(F.col("kind") == "match").withColumn("shift", (F.col("_ins") - F.col("_del")).cast("int")).drop("_ins", "_del")


def renumbered(sections: DataFrame, group: str = "comparison_id") -> DataFrame:
    """change_type and reason of the matches whose number changed; a cascade where insertions and deletions above explain it."""
    s = shifts(sections, group).withColumns({"_a": heading_number(F.col("old_heading")), "_b": heading_number(F.col("new_heading"))})
    s = s.where(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b")))
    first = lambda c: F.split_part(F.col(c), F.lit("."), F.lit(1)).try_cast("long")
    pushed = (F.col("shift") != 0) & F.coalesce(first("_b") - first("_a") == F.col("shift"), F.lit(False))
    n = F.abs("shift")
    base = F.concat(F.lit("Section renumbered from '"), F.col("_a"), F.lit("' to '"), F.col("_b"), F.lit("'"))
    same = heading_rest(F.col("old_heading")) == heading_rest(F.col("new_heading"))
    because = F.concat(base, F.lit(" as a side effect of "), _plural(n, "section"), F.when(F.col("shift") > 0, " added above it").otherwise(" removed above it"), F.when(same, "; wording unchanged.").otherwise("."))
    return s.withColumns({"change_type": F.when(pushed, "section_renumbered_cascade").otherwise("section_renumbered"), "reason": F.when(pushed, because).otherwise(F.concat(base, F.lit(".")))}).drop("_a", "_b", "shift")


def heading_changed(matches: DataFrame, threshold: float = REWRITE_THRESHOLD) -> DataFrame:
    """change_type and reason of the matches whose wording of the heading changed; labels the reader made don't count."""
    a, b = F.col("old_heading"), F.col("new_heading")
    numbered = heading_number(a).isNotNull() & heading_number(b).isNotNull()
    real = (collapsed(a) != collapsed(b)) & ~is_synthetic(a) & ~is_synthetic(b) & ~is_label(a) & ~is_label(b) & ~(numbered & (heading_rest(a) == heading_rest(b)))
    far = F.when(F.col("similarity") < threshold, F.concat(F.lit(" Headings differ substantially (similarity "), two_decimals(F.col("similarity")), F.lit("); sections matched on content."))).otherwise("")
    reason = F.concat(F.lit("Section heading changed from '"), a, F.lit("' to '"), b, F.lit("'."), far)
    return matches.where(F.col("kind") == "match").where(real).withColumns({"change_type": F.lit("section_heading_changed"), "reason": reason})


def reordered(matches: DataFrame) -> DataFrame:
    """change_type and reason of the matches outside the longest run that kept its order (``kept`` is false)."""
    real = ~F.col("kept") & ~is_synthetic(F.col("old_heading")) & ~is_synthetic(F.col("new_heading"))
    reason = F.format_string("Section moved from position %d to position %d in the document.", F.col("old_idx") + 1, F.col("new_idx") + 1)
    return matches.where(F.col("kind") == "match").where(real).withColumns({"change_type": F.lit("section_reordered"), "reason": reason})


def added_or_deleted(sections: DataFrame) -> DataFrame:
    """change_type and reason of unmatched sections with a heading of their own."""
    added = F.col("kind") == "inserted"
    heading = F.coalesce("new_heading", "old_heading")
    words = F.when(added, "New section added: '").otherwise("Section deleted: '")
    reason = F.concat(words, heading, F.lit("'. "), content_summary(F.col("n_body"), F.col("n_tables"), F.col("n_all")))
    return sections.where(F.col("kind").isin("inserted", "deleted") & ~is_synthetic(heading)).withColumns({"change_type": F.when(added, "section_added").otherwise("section_deleted"), "reason": reason})
