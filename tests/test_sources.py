import io
import zipfile

import pytest

from palimp.operators.review import apply_reviews, latest_delivery, read_back
from palimp.operators.sections import one_per_seq, section_texts, split_into_sections
from palimp.operators.structure import shifts
from palimp.schemas import PARAGRAPHS
from palimp.sources import docx
from palimp.sources.blocks import LINES, paragraphs_of_blocks
from palimp.sources.registry import read
from palimp.streaming.ingest import text_stream, write_paragraphs

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def p(text, style="", size="", extra=""):
    s = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    z = f'<w:rPr><w:sz w:val="{size}"/></w:rPr>' if size else ""
    return f"<w:p>{s}<w:r>{z}<w:t>{text}</w:t></w:r>{extra}</w:p>"


def tc(content, pr=""):
    return f"<w:tc><w:tcPr>{pr}</w:tcPr>{content}</w:tc>"


def word(body, header=p("Site manual"), notes=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {NS}><w:body>{body}<w:sectPr><w:headerReference w:type="default" r:id="h1"/></w:sectPr></w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/><w:rPr><w:sz w:val="20"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/header1.xml", f"<w:hdr {NS}>{header}</w:hdr>")
        z.writestr("word/footnotes.xml", f'<w:footnotes {NS}><w:footnote w:type="separator" w:id="0">{p("-")}</w:footnote><w:footnote w:id="7">{p("A note.")}</w:footnote></w:footnotes>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("word/_rels/document.xml.rels", f'<Relationships><Relationship Id="h1" Type="{rel}/header" Target="header1.xml"/><Relationship Id="f" Type="{rel}/footnotes" Target="footnotes.xml"/></Relationships>')
    return out.getvalue()


BOX = f"<w:r><mc:AlternateContent><mc:Choice><w:txbxContent>{p('In a box')}</w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent>{p('In a box')}</w:txbxContent></mc:Fallback></mc:AlternateContent></w:r>"
TABLE = (
    "<w:tbl><w:tr>" + tc(p("A"), '<w:gridSpan w:val="2"/>') + tc(p("B"), '<w:vMerge w:val="restart"/>') + "</w:tr><w:tr>" + tc(p("HPLC")) + tc(p("d") + "<w:tbl><w:tr>" + tc(p("nested")) + "</w:tr></w:tbl>" + p(""))
    + tc(p(""), "<w:vMerge/>") + "</w:tr></w:tbl>"
)


def parsed(spark, content):
    return [r.asDict(True) for r in docx.parse_files(spark.createDataFrame([("f", bytearray(content))], "path string, content binary")).orderBy("seq").collect()]


def test_docx(spark):
    body = p("1 Scope", "H1") + p("First.") + p("", extra=BOX) + p("Second", extra='<w:r><w:footnoteReference w:id="7"/></w:r>') + p("LARGE HEADING", size="26") + TABLE
    rows = parsed(spark, word(body))
    assert [r["text"] for r in rows] == ["1 Scope", "First.", "Second", "LARGE HEADING", "A", "B", "HPLC", "d", "nested", "Page Header", "Site manual", "Text Box 1 (1 Scope, after paragraph 1)", "In a box", "Footnote 1 (1 Scope, paragraph 2)", "A note."]
    assert [r["text"] for r in rows if r["is_heading"]] == ["1 Scope", "LARGE HEADING", "Page Header", "Text Box 1 (1 Scope, after paragraph 1)", "Footnote 1 (1 Scope, paragraph 2)"]
    at = {r["text"]: tuple(r["table_position"].values()) for r in rows if r["table_position"]}
    assert at == {"A": (0, 0, 0, 1, 2), "B": (0, 0, 2, 2, 1), "HPLC": (0, 1, 0, 1, 1), "d": (0, 1, 1, 1, 1), "nested": (1, 0, 0, 1, 1)}
    assert not any(r["allow_text_pattern_heading"] for r in rows if r["from_table"])
    assert [r["paragraph_index"] for r in rows] == list(range(len(rows)))
    assert "Page Header" not in [r["text"] for r in parsed(spark, word(p("x"), header=p(" ")))]
    assert docx.header_footer_label("footer", 1, "First Page", True) == "Page Footer (Section 2, First Page)"
    inner = p("x") + p("", extra=BOX) + p("1.0 Two", "H1", extra=BOX.replace("In a box", " ")) + p("", extra=BOX) + p("y", extra='<w:r><w:footnoteReference w:id="9"/></w:r><w:r><w:footnoteReference w:id="7"/></w:r>') + p("z", extra='<w:r><w:footnoteReference w:id="7"/></w:r>')
    boxed = parsed(spark, word(inner, header=p("Top", extra=BOX)))
    assert [r["text"] for r in boxed if r["is_heading"]] == ["1.0 Two", "Page Header", "Text Box 1 (Preamble, after paragraph 1)", "Text Box 2 (1.0 Two, at start)", "Text Box 3 (Page Header)", "Footnote 1 (1.0 Two, paragraph 1)"]


def test_damaged_files(spark):
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    files = spark.createDataFrame([("good", bytearray(word(p("x")))), ("bad", bytearray(b"no archive")), ("hollow", bytearray(empty.getvalue()))], "path string, content binary")
    assert {r.document_id for r in docx.parse_files(files).collect()} == {"good"}
    assert {r.document_id: r.error.split(":")[0] for r in docx.damaged_files(files).collect()} == {"bad": "BadZipFile", "hollow": "ValueError"}
    assert docx.parse_files(files.limit(0)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word(p("1 Scope", "H1") + p("Text")))
    (tmp_path / "b.txt").write_text("SCOPE\r\n\r\n one\n\n\n\n \n\ntwo ", newline="")
    assert [r.text for r in read(spark, "docx", str(tmp_path / "a.docx")).orderBy("seq").collect()] == ["1 Scope", "Text", "Page Header", "Site manual"]
    rows = read(spark, "txt", str(tmp_path / "b.txt")).orderBy("seq").collect()
    assert [(r.text, r.paragraph_index) for r in rows] == [("SCOPE", 0), ("one", 1), ("two", 4)]
    with pytest.raises(ValueError):
        read(spark, "odt", "x")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\n\ntwo")
    for n in (2, 3):
        write_paragraphs(text_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (tmp_path / "in/b.txt").write_text("three")


def test_blocks(spark):
    rows = [("d", 0, 1, [[("Big ", 14.0), ("Title", 14.0)]]), ("d", 1, 1, [[("body", 10.0)], [("text", 10.0)]]), ("d", 2, 1, [[], [("more", 10.0)]]), ("d", 3, 2, [[("Chapter", 10.0)]]), ("d", 4, 2, [[(" ", 10.0)]]), ("e", 0, 1, [])]
    blocks = spark.createDataFrame(rows, f"document_id string, seq int, page int, lines {LINES}")
    toc = spark.createDataFrame([("d", 2, "Chapter "), ("d", 1, "more x")], "document_id string, page int, title string")
    got = {(r.text, r.is_heading) for r in paragraphs_of_blocks(blocks, toc).collect()}
    assert got == {("Big Title", True), ("body text", False), ("more", False), ("Chapter", True)}


def paragraphs(spark, *docs):
    rows = [(d, i, t, None, i, h, True, False, None) for d, items in docs for i, (t, h) in enumerate(items)]
    return spark.createDataFrame(rows, PARAGRAPHS)


def test_sections(spark):
    df = paragraphs(spark, ("a", [("lead", False), ("1.0 X", True), ("b", False), ("SECOND", False), ("2.0 Z", True)]), ("none", [("p", False), ("q", False)]))
    got = {(r.document_id, r.section_idx): (r.heading, r.text) for r in section_texts(split_into_sections(one_per_seq(df.unionByName(df)))).collect()}
    assert got == {("a", 0): ("Preamble", "Preamble lead"), ("a", 1): ("1.0 X", "1.0 X b"), ("a", 2): ("SECOND", "SECOND"), ("a", 3): ("2.0 Z", "2.0 Z"), ("none", 0): ("Paragraph 1", "Paragraph 1 p"), ("none", 1): ("Paragraph 2", "Paragraph 2 q")}
    assert split_into_sections(df.limit(0)).count() == 0


def test_shifts_as_by_counting(spark):
    rows = [("c", "match", 0, 0, "1 A", "1 A"), ("c", "inserted", None, 1, None, "2 N"), ("c", "inserted", None, 2, None, "2.1 N"), ("c", "match", 2, 3, "3 B", "3 B"), ("c", "deleted", 1, None, "2 D", None), ("c", "match", 3, 4, "4 C", "4 C")]
    df = spark.createDataFrame(rows, "comparison_id string, kind string, old_idx int, new_idx int, old_heading string, new_heading string")
    assert {r.old_idx: r["shift"] for r in shifts(df).collect()} == {0: 0, 2: 0, 3: 0}
    assert {r.old_idx: r["shift"] for r in shifts(df.where("kind <> 'deleted'")).collect()} == {0: 0, 2: 1, 3: 1}


def test_reviews(spark):
    changes = spark.createDataFrame([("a", "Low", None, False), ("b", None, "keep", True)], "id string, reviewer_risk_level string, reviewer_comment string, accepted boolean")
    patches = spark.createDataFrame([("a", None, "x", None, 1), ("a", "High", None, True, 2), ("a", None, "y", None, 2), ("zz", "Low", None, None, 1), ("b", None, None, None, 3), (None, "Low", None, None, 1)], "change_id string, reviewer_risk_level string, reviewer_comment string, accepted boolean, submitted_at int")
    got = {r.id: tuple(r)[1:] for r in apply_reviews(changes, patches).collect()}
    assert got == {"a": ("High", "y", True), "b": (None, "keep", True)}
    assert apply_reviews(changes.limit(0), patches).count() == 0


def test_latest_and_read_back(spark):
    d = spark.createDataFrame([("1", "f", 1), ("1", "f", 3), ("1", "g", 2), (None, "x", 1)], "id string, filename string, loaded_at int")
    assert [tuple(r) for r in latest_delivery(d).collect()] == [("1", "f", 3)]
    c = spark.createDataFrame([("c", "1", "none")], "comparison_id string, old_document_id string, new_document_id string")
    assert [tuple(r)[3:] for r in read_back(c, latest_delivery(d)).collect()] == [("f", "")]
