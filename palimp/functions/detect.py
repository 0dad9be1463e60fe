"""Detection of changed numbers, units and dates in a pair of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of numbers, units after a number, and dates.
NUMBER = r"-?\d+(?:\.\d+)?"
UNIT = r"\d+\.?\d*\s*(%|°C|°F|mL|L|mg|kg|g|min|hr|h|RH)"
DATE = r"(?i)\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}\b"


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))


def units(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(UNIT), F.lit(1))


def dates(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(DATE), F.lit(0))


def _listed(values: Column) -> Column:
    return F.array_join(values, ", ")


def _bracketed(values: Column) -> Column:
    quoted = F.transform(values, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def detections(old: Column, new: Column) -> Column:
    """The fired detections in the order date, unit, number: array of (change_type, reason, confidence, old_values, new_values).

    Null texts count as empty.
    """
    old, new = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))

    def one(kind: str, tokens, reason) -> Column:
        a, b = tokens(old), tokens(new)
        fired = F.struct(F.lit(kind).alias("change_type"), reason(a, b).alias("reason"), F.lit(1.0).alias("confidence"), a.alias("old_values"), b.alias("new_values"))
        return F.when(a != b, fired)

    every = F.array(
        one("date_change", dates, lambda a, b: F.concat(F.lit("Date changed from "), _listed(a), F.lit(" to "), _listed(b), F.lit("."))),
        one("unit_change", units, lambda a, b: F.concat(F.lit("Unit changed from "), _bracketed(a), F.lit(" to "), _bracketed(b), F.lit("."))),
        one("numeric_change", numbers, lambda a, b: F.concat(F.lit("Numeric value(s) changed from "), _listed(a), F.lit(" to "), _listed(b), F.lit("."))),
    )
    return F.filter(every, lambda d: d.isNotNull())


def first_detection(old: Column, new: Column) -> Column:
    """The first detection that fires, or null."""
    return F.get(detections(old, new), F.lit(0))


def spans(c: Column, pattern: str, group: int = 0) -> Column:
    """Start and end of each match (or of its group 1), as an array of structs.

    The text between matches gives the places: it is split by the same pattern,
    and the lengths of pieces and matches are summed up.
    """
    whole = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    pieces = F.split(c, pattern, -1)
    ends = F.aggregate(
        F.arrays_zip(whole.alias("w"), inner.alias("i"), F.slice(pieces, 1, F.size(whole)).alias("p")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["p"]) + F.length(x["w"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.struct((acc["at"] + F.length(x["p"]) + F.length(x["w"]) - F.length(x["i"])).alias("s"), (acc["at"] + F.length(x["p"]) + F.length(x["w"])).alias("e"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(whole) > 0, ends).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def without_spans(c: Column, marked: Column) -> Column:
    """The text with the spans cut out from the last to the first, each by its place in the text as it then is."""
    return F.aggregate(F.sort_array(marked, False), c, lambda t, x: F.concat(F.substring(t, F.lit(1), x["s"]), F.substring(t, x["e"] + 1, F.length(t))))


def residual(text: Column, fired: Column) -> Column:
    """The text without the values of the fired detections (a column as of :func:`detections`)."""
    text = F.coalesce(text, F.lit(""))
    has = lambda kind: F.exists(fired, lambda d: d["change_type"] == kind)
    none = F.array().cast("array<struct<s:int,e:int>>")
    marked = F.concat(
        F.when(has("date_change"), spans(text, DATE)).otherwise(none),
        F.when(has("unit_change"), spans(text, UNIT, 1)).otherwise(none),
        F.when(has("numeric_change"), spans(text, NUMBER)).otherwise(none),
    )
    return without_spans(text, marked)
