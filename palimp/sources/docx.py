"""Word documents as paragraphs, with the standard library's ZIP and XML readers.

A file is parsed by one task into events: paragraphs with the part of the file
and the place they stand in. Sections, anchors, numbers and the final order come
from windows over the events. The order of the rows is: body with its tables,
headers, footers, text boxes, footnotes. Generated headings name the last four,
so they become sections.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimp.functions.text import heading_boundary
from palimp.schemas import TABLE_POSITION

# Names of the document format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
FOOTNOTES = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/footnotes"
HEADING_STYLES = ("Heading", "Title")
BODY_SIZE, SIZE_DELTA = 11.0, 2.0
SEPARATORS = {"separator", "continuationSeparator"}
_VARIANTS = {"default": "", "first": "First Page", "even": "Even Page"}

#: The parts of a file in the order of their paragraphs.
BODY, AROUND, BOX, NOTE = range(4)
EVENTS = (
    "document_id string, part int, unit int, ord int, at int, label string, text string, is_heading boolean, by_text boolean, "
    "table_position struct<table_id:int,row:int,col:int,row_span:int,col_span:int>, error string"
)


def _shaped(text: str) -> bool:
    return len(text) <= 120 and len(text.split()) <= 12 and not text.rstrip().endswith((".", ",", ";"))


@dataclass
class Word:
    """The parts of one file."""

    data: zipfile.ZipFile
    rels: dict[str, tuple[str, str]] = field(default_factory=dict)
    styles: dict[str, tuple[str, float | None]] = field(default_factory=dict)
    default_style: str | None = None
    baseline: float = BODY_SIZE
    tables: int = 0

    @classmethod
    def of(cls, content: bytes) -> tuple[Word, ET.Element]:
        w = cls(zipfile.ZipFile(io.BytesIO(content)))
        if (rels := w.part("word/_rels/document.xml.rels")) is not None:
            w.rels = {r.get("Id"): (r.get("Type"), posixpath.normpath(posixpath.join("word", r.get("Target"))).lstrip("/")) for r in rels}
        if (styles := w.part("word/styles.xml")) is not None:
            for s in styles.iter(f"{W}style"):
                name = s.find(f"{W}name")
                w.styles[s.get(f"{W}styleId")] = ("" if name is None else _style_name(name.get(f"{W}val", "")), _size(s.find(f"{W}rPr")))
                if s.get(f"{W}type") == "paragraph" and s.get(f"{W}default") in ("1", "true"):
                    w.default_style = s.get(f"{W}styleId")
            normal = next((size for name, size in w.styles.values() if name == "Normal"), None)
            w.baseline = BODY_SIZE if normal is None else normal
        return w, w.part("word/document.xml")

    def part(self, name: str) -> ET.Element | None:
        try:
            return ET.fromstring(self.data.read(name))
        except KeyError:
            return None

    def style(self, p: ET.Element) -> tuple[str, float | None]:
        s = p.find(f"{W}pPr/{W}pStyle")
        return self.styles.get(self.default_style if s is None else s.get(f"{W}val"), ("", None))


def _style_name(name: str) -> str:
    """Built-in names are stored in lower case."""
    return name[:1].upper() + name[1:] if name.lower().startswith(("heading", "title", "normal")) else name


def _size(rpr: ET.Element | None) -> float | None:
    sz = None if rpr is None else rpr.find(f"{W}sz")
    return None if sz is None else float(sz.get(f"{W}val")) / 2


def paragraph_text(p: ET.Element) -> str:
    """The text of a paragraph's own runs and links; what floats in it is not its text."""
    out = []
    for child in p:
        for run in [child] if child.tag == f"{W}r" else child.findall(f"{W}r") if child.tag == f"{W}hyperlink" else []:
            for x in run:
                out.append({f"{W}t": x.text or "", f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}.get(x.tag, ""))
    return "".join(out)


def _without_fallback(root: ET.Element, tag: str) -> Iterator[ET.Element]:
    """The elements of a tag in document order, not those under a fallback copy."""
    for child in root:
        if child.tag == f"{MC}Fallback":
            continue
        if child.tag == tag:
            yield child
        yield from _without_fallback(child, tag)


def _cells(table: ET.Element) -> list[tuple[ET.Element, int, int, int, int]]:
    """Each cell once, at its first place: (cell, row, col, row_span, col_span), in reading order."""
    placed: list[list] = []
    above: dict[int, list] = {}
    for r, tr in enumerate(table.findall(f"{W}tr")):
        before = tr.find(f"{W}trPr/{W}gridBefore")
        col = 0 if before is None else int(before.get(f"{W}val"))
        now: dict[int, list] = {}
        for tc in tr.findall(f"{W}tc"):
            pr = tc.find(f"{W}tcPr")
            span = None if pr is None else pr.find(f"{W}gridSpan")
            width = 1 if span is None else int(span.get(f"{W}val"))
            merge = None if pr is None else pr.find(f"{W}vMerge")
            if merge is not None and merge.get(f"{W}val", "continue") == "continue" and col in above:
                cell = above[col]
                cell[3] = r - cell[1] + 1
            else:
                cell = [tc, r, col, 1, width]
                placed.append(cell)
            for c in range(col, col + width):
                now[c] = cell
            col += width
        above = now
    return [tuple(c) for c in placed]


def walk(word: Word, content: ET.Element, by_text: bool = True, position: dict | None = None) -> Iterator[tuple[ET.Element, bool, dict | None]]:
    """Paragraphs of a container and of its tables, in order, with their cell; table numbers count up in the same order."""
    for x in content:
        if x.tag == f"{W}p":
            yield x, by_text, position
        elif x.tag == f"{W}tbl":
            table_id, word.tables = word.tables, word.tables + 1
            for tc, row, col, row_span, col_span in _cells(x):
                yield from walk(word, tc, False, {"table_id": table_id, "row": row, "col": col, "row_span": row_span, "col_span": col_span})


def header_footer_label(kind: str, section: int, variant: str, several: bool) -> str:
    parts = [f"Section {section + 1}"] * several + [variant] * bool(variant)
    return f"Page {kind.title()}" + (f" ({', '.join(parts)})" if parts else "")


def _headers_and_footers(word: Word, document: ET.Element) -> list[tuple[str, ET.Element]]:
    """Label and content of all headers, then of all footers."""
    sections = list(document.iter(f"{W}sectPr"))
    settings = word.part("word/settings.xml")
    even = settings is not None and _on(settings.find(f"{W}evenAndOddHeaders"))
    out: dict[str, list] = {"header": [], "footer": []}
    for n, s in enumerate(sections):
        for variant in ["default", *["first"] * _on(s.find(f"{W}titlePg")), *["even"] * even]:
            for kind in out:
                ref = next((x for x in s.findall(f"{W}{kind}Reference") if x.get(f"{W}type", "default") == variant), None)
                part = None if ref is None else word.part(word.rels.get(ref.get(f"{R}id"), ("", ""))[1])
                if part is not None:
                    out[kind].append((header_footer_label(kind, n, _VARIANTS[variant], len(sections) > 1), part))
    return out["header"] + out["footer"]


def _on(x: ET.Element | None) -> bool:
    return x is not None and x.get(f"{W}val", "1") not in ("0", "false", "off")


def file_events(content: bytes) -> Iterator[dict]:
    """What a file holds, in no order that matters: paragraphs with their part, unit and place.

    Body paragraphs, blank ones too, are unit 0 of their part. A header or footer,
    a text box and a footnote is a unit with a number of its own; a box and a note
    also say ``at`` which body paragraph they hang, and a header, a footer and
    what hangs in one have their label. Only paragraphs with text are given of units.
    """
    word, document = Word.of(content)
    if document is None:
        raise ValueError("not a Word document: it has no word/document.xml")
    body = document.find(f"{W}body")

    def event(part: int, unit: int, ord_: int, p: ET.Element, by_text: bool, position: dict | None, **more) -> dict:
        return {"part": part, "unit": unit, "ord": ord_, "by_text": by_text, "table_position": position} | _looks(word, p) | more

    def unit(part: int, number: int, content: ET.Element, tables: bool, **more) -> Iterator[dict]:
        for n, (p, _, position) in enumerate(walk(word, content, False)):
            e = event(part, number, n, p, False, position if tables else None, **more)
            if e["text"]:
                yield e

    hangs: dict[ET.Element, int] = {}
    noted: dict[str, int] = {}
    for n, (p, by_text, position) in enumerate(walk(word, body)):
        hangs |= {box: n for box in _without_fallback(p, f"{W}txbxContent")}
        for ref in _without_fallback(p, f"{W}footnoteReference"):
            noted.setdefault(ref.get(f"{W}id"), n)
        yield event(BODY, 0, n, p, by_text, position)
    around = _headers_and_footers(word, document)
    for n, (label, part) in enumerate(around):
        yield from unit(AROUND, n, part, True, label=label)
    boxes = [(label, box) for label, root in [(None, body), *around] for box in _without_fallback(root, f"{W}txbxContent")]
    for n, (label, box) in enumerate(boxes):
        yield from unit(BOX, n, box, False, label=label, at=hangs.get(box))
    target = next((target for kind, target in word.rels.values() if kind == FOOTNOTES), None)
    notes = None if target is None else word.part(target)
    for note in () if notes is None else notes.findall(f"{W}footnote"):
        key = note.get(f"{W}id")
        if key in noted and note.get(f"{W}type") not in SEPARATORS:
            yield from unit(NOTE, list(noted).index(key), note, False, at=noted[key])


def _looks(word: Word, p: ET.Element) -> dict:
    """Text of a paragraph and whether it is a heading by its style or size."""
    text = paragraph_text(p).strip()
    name, of_style = word.style(p)
    run = p.find(f"{W}r")
    own = _size(None if run is None else run.find(f"{W}rPr"))
    size = of_style if own is None else own
    return {"text": text, "is_heading": bool(text) and (name.startswith(HEADING_STYLES) or size is not None and size >= word.baseline + SIZE_DELTA and _shaped(text))}


def located(events: DataFrame) -> DataFrame:
    """The events with ``opens`` (a body paragraph that begins a section) and ``anchor``, where in the body an event is.

    What hangs from a body paragraph is sorted right behind it, so the heading
    last seen and the paragraphs counted since it are running values.
    """
    hung = (F.col("part") != BODY) & F.col("at").isNotNull()
    place = F.when(F.col("part") == BODY, F.col("ord")).when(hung, F.col("at"))
    order = [F.asc_nulls_last("_place"), F.col("part"), F.col("unit"), F.col("ord")]
    so_far = Window.partitionBy("document_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy("document_id", "_section").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    real = (F.col("part") == BODY) & (F.coalesce("text", F.lit("")) != "")
    e = events.withColumns({"_place": place, "opens": real & F.coalesce(heading_boundary(F.col("text"), F.col("is_heading"), F.col("by_text")), F.lit(False))})
    e = e.withColumns({
        "_section": F.sum(F.col("opens").cast("int")).over(so_far), "_heading": F.coalesce(F.last(F.when(F.col("opens"), F.col("text")), True).over(so_far), F.lit("Preamble")),
        "_inside": F.last(F.when(F.col("part") == BODY, real & ~F.col("opens")), True).over(so_far),
    })
    e = e.withColumn("_n", F.sum((real & ~F.col("opens")).cast("int")).over(since))
    anchor = F.when(F.col("part").eqNullSafe(BODY) | hung, anchor_label(F.col("_heading"), F.col("_n"), F.col("_inside")))
    return e.withColumn("anchor", anchor).drop("_place", "_section", "_heading", "_inside", "_n")


def anchor_label(heading: Column, count: Column, inside: Column) -> Column:
    """Where something hangs: in the paragraph counted last in a section, at its start, or after a paragraph."""
    number = count.cast("string")
    return F.concat(heading, F.when(inside, F.concat(F.lit(", paragraph "), number)).when(count > 0, F.concat(F.lit(", after paragraph "), number)).otherwise(", at start"))


def paragraphs_of_events(events: DataFrame) -> DataFrame:
    """Paragraph rows of the events of files: body, headers and footers, text boxes, footnotes, each unit under its label."""
    e = located(events).where("text <> ''")
    counted = Window.partitionBy("document_id", "part").orderBy("unit")
    number = F.dense_rank().over(counted).cast("string")
    hanging = lambda word, of: F.concat(F.lit(f"{word} "), number, F.coalesce(F.concat(F.lit(" ("), of, F.lit(")")), F.lit("")))
    name = F.when(F.col("part") == AROUND, F.col("label")).when(F.col("part") == BOX, hanging("Text Box", F.coalesce("anchor", "label"))).when(F.col("part") == NOTE, hanging("Footnote", F.col("anchor")))
    first = F.row_number().over(Window.partitionBy("document_id", "part", "unit").orderBy("ord")) == 1
    own = F.struct(F.lit(1).alias("k"), "text", F.coalesce("is_heading", F.lit(False)).alias("is_heading"), F.col("by_text").alias("allow_text_pattern_heading"), F.col("table_position").isNotNull().alias("from_table"), "table_position")
    title = F.struct(F.lit(0).alias("k"), name.alias("text"), F.lit(True).alias("is_heading"), F.lit(True).alias("allow_text_pattern_heading"), F.lit(False).alias("from_table"), F.lit(None).cast(TABLE_POSITION).alias("table_position"))
    rows = e.select("document_id", "part", "unit", "ord", F.when(first & (F.col("part") != BODY), F.array(title, own)).otherwise(F.array(own)).alias("_r")).select("document_id", "part", "unit", "ord", F.inline("_r"))
    seq = (F.row_number().over(Window.partitionBy("document_id").orderBy("part", "unit", "ord", "k")) - 1).cast("int")
    return rows.select("document_id", seq.alias("seq"), "text", F.lit(None).cast("int").alias("page"), seq.alias("paragraph_index"), "is_heading", "allow_text_pattern_heading", "from_table", "table_position")


def events_of_files(files: DataFrame) -> DataFrame:
    """Events of a table of files (path, content), one task a file; a file that cannot be read is one row with its ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"]):
                try:
                    rows = [{"document_id": path} | e for e in file_events(content.as_py())]
                except (ValueError, TypeError, AttributeError, KeyError, zipfile.BadZipFile, ET.ParseError) as e:
                    rows = [{"document_id": path, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.select("path", "content").mapInArrow(run, EVENTS)


def parse_files(files: DataFrame) -> DataFrame:
    """Paragraph rows of a table of files (path, content). Damaged files have none; :func:`damaged_files` tells which they are."""
    return paragraphs_of_events(events_of_files(files).where(F.col("error").isNull()))


def damaged_files(files: DataFrame) -> DataFrame:
    """document_id and error of the files that cannot be read."""
    return events_of_files(files).where(F.col("error").isNotNull()).select("document_id", "error")


_ARROW = pa.schema(
    [
        ("document_id", pa.string()), ("part", pa.int32()), ("unit", pa.int32()), ("ord", pa.int32()), ("at", pa.int32()), ("label", pa.string()), ("text", pa.string()), ("is_heading", pa.bool_()), ("by_text", pa.bool_()),
        ("table_position", pa.struct([(c, pa.int32()) for c in ("table_id", "row", "col", "row_span", "col_span")])), ("error", pa.string()),
    ]
)


def _files(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select(F.col("_metadata.file_path").alias("path"), "content")


def read_docx(spark: SparkSession, *paths: str) -> DataFrame:
    """Paragraph rows of Word files; the document is the file's path."""
    return parse_files(_files(spark, paths))
