"""Column expressions over headings and texts; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that Python's str.strip and str.split know, as a character class of a pattern.
BLANK = r"[\t\n\x0B\f\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# The zeros of all scripts, as a character class of a pattern.
ZERO = (
    r"[\x{30}\x{660}\x{6F0}\x{7C0}\x{966}\x{9E6}\x{A66}\x{AE6}\x{B66}\x{BE6}\x{C66}\x{CE6}\x{D66}\x{DE6}\x{E50}\x{ED0}\x{F20}\x{1040}\x{1090}\x{17E0}\x{1810}"
    r"\x{1946}\x{19D0}\x{1A80}\x{1A90}\x{1B50}\x{1BB0}\x{1C40}\x{1C50}\x{A620}\x{A8D0}\x{A900}\x{A9D0}\x{A9F0}\x{AA50}\x{ABF0}\x{FF10}\x{104A0}\x{10D30}"
    r"\x{11066}\x{110F0}\x{11136}\x{111D0}\x{112F0}\x{11450}\x{114D0}\x{11650}\x{116C0}\x{11730}\x{118E0}\x{11950}\x{11C50}\x{11D50}\x{11DA0}\x{11F50}"
    r"\x{16A60}\x{16AC0}\x{16B50}\x{1D7CE}\x{1D7D8}\x{1D7E2}\x{1D7EC}\x{1D7F6}\x{1E140}\x{1E2F0}\x{1E4F0}\x{1E950}\x{1FBF0}]"
)
# Limits of a heading's shape, and the patterns of headings.
MAX_HEADING_LENGTH, MAX_HEADING_WORDS = 120, 12
NUMBERED_HEADING = r"(?Ud)^\s*\d+(\.\d+)+\s+\S.*$"
HEADING_NUMBER = r"(?Ud)^(\d+(?:\.\d+)*)\s+(.*)$"
SYNTHETIC = r"(?Ud)^Paragraph \d+$"
HEADER_FOOTER = r"(?Ud)^Page (Header|Footer)(\s\(.+\))?$"
TEXT_BOX = r"(?Ud)^Text Box \d+(\s\(.+\))?$"
FOOTNOTE = r"(?Ud)^Footnote \d+(\s\(.+\))?$"


def strip(c: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def collapsed(c: Column) -> Column:
    """The text with every run of white space as one blank, and none at its ends."""
    return F.btrim(F.regexp_replace(c, f"{BLANK}+", " "))


def universal_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def heading_shape(c: Column) -> Column:
    """Short enough for a heading, and not ending like a sentence."""
    words = F.when(strip(c) == "", F.lit(0)).otherwise(F.size(F.split(strip(c), f"{BLANK}+")))
    return (F.length(c) <= MAX_HEADING_LENGTH) & (words <= MAX_HEADING_WORDS) & ~F.regexp_replace(c, f"{BLANK}+$", "").rlike(r"[.,;]$")


def numbered_heading(c: Column) -> Column:
    return c.rlike(NUMBERED_HEADING) & heading_shape(c)


def all_caps_heading(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c) & heading_shape(c)


def heading_boundary(text: Column, is_heading: Column, allow_pattern: Column) -> Column:
    """Whether a paragraph begins a section."""
    by_text = F.coalesce(allow_pattern, F.lit(True)) & (numbered_heading(text) | all_caps_heading(text))
    return F.coalesce(is_heading, F.lit(False)) | F.coalesce(by_text, F.lit(False))


def is_synthetic(heading: Column) -> Column:
    return (heading == "Preamble") | heading.rlike(SYNTHETIC)


def is_label(heading: Column) -> Column:
    """Page headers and footers, text boxes and footnotes, whose labels the reader made."""
    return heading.rlike(HEADER_FOOTER) | heading.rlike(TEXT_BOX) | heading.rlike(FOOTNOTE)


def heading_number(heading: Column) -> Column:
    """The number a heading begins with, or null."""
    return F.nullif(F.regexp_extract(heading, HEADING_NUMBER, 1), F.lit(""))


def heading_rest(heading: Column) -> Column:
    """The heading without its number, white space collapsed."""
    return collapsed(F.when(heading_number(heading).isNotNull(), F.regexp_extract(heading, HEADING_NUMBER, 2)).otherwise(heading))


def top_level_numbered(heading: Column) -> Column:
    """Numbered, with nothing but zeros after the first component."""
    return F.coalesce(heading_number(heading).rlike(rf"(?Ud)^\d+(\.{ZERO}+)*$"), F.lit(False))
