"""Queries over the domain tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.functions import detect, text, views
from palimp.operators import classify, export, grids, matching, review, structure, summary
from palimp.operators.align import align
from palimp.operators.sections import one_per_seq, section_texts, split_into_sections
from palimp.plans.compare import changes_of, compare
from palimp.runtime import table
from palimp.sources import blocks, docx, txt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- inputs
def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.decoded(review.latest_delivery(table(spark, sf_dir, "changes")))


_CH = """ch AS (SELECT * REPLACE (coalesce(source, 'Body') AS source, coalesce(accepted, false) AS accepted) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS _r FROM changes WHERE id IS NOT NULL) WHERE _r = 1)"""
_EFFECTIVE = "coalesce(nullif(reviewer_risk_level, ''), ai_risk_level)"
_ORDERED = "list_position(['High', 'Medium', 'Low', 'Informational'], {})"


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_seq(table(spark, sf_dir, "paragraphs"))


def _sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_into_sections(_paragraphs(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = review.latest_delivery(table(spark, sf_dir, "comparisons"))
    return c.select(F.col("id").alias("comparison_id"), "old_document_id", "new_document_id")


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8201) || chr(8195) || chr(8239) || chr(8194) || chr(8199)"
_PARA = "para AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, seq ORDER BY text) AS _r FROM paragraphs) WHERE _r = 1)"
_FLAGS = f"""{_PARA}, flag AS (
  SELECT *, regexp_matches(text, '^\\s*\\d+(\\.\\d+)+\\s+\\S.*$') AND shape AS numbered, upper(text) = text AND lower(text) <> text AND shape AS caps FROM (
    SELECT *, length(text) <= 120 AND len(string_split_regex(trim(text, {_BLANKS}), '\\s+')) <= 12 AND NOT regexp_matches(text, '[.,;]\\s*$') AS shape FROM para)),
bound AS (SELECT *, is_heading OR (allow_text_pattern_heading AND (numbered OR caps)) AS h FROM flag)"""
_SECTIONS = f"""{_FLAGS}, run AS (
  SELECT *, sum(h::int) OVER w AS n, row_number() OVER w AS pos, max(h::int) OVER (PARTITION BY document_id) AS has,
    first_value(NOT h) OVER w AS lead, last_value(CASE WHEN h THEN text END IGNORE NULLS) OVER w AS named
  FROM bound WINDOW w AS (PARTITION BY document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sec AS (SELECT document_id, seq, text, page, from_table, table_position,
  (CASE WHEN has = 0 THEN pos - 1 ELSE n - 1 + lead::int END)::int AS section_idx,
  CASE WHEN has = 0 THEN 'Paragraph ' || pos WHEN n = 0 THEN 'Preamble' ELSE named END AS heading, NOT h AS is_body FROM run)"""
_COMP = "comp AS (SELECT id AS comparison_id, old_document_id, new_document_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS _r FROM comparisons WHERE id IS NOT NULL) WHERE _r = 1)"


# ---------------------------------------------------------------- sources
@query(f"""
SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1)::int AS seq, (idx - 1)::int AS paragraph_index, text FROM (
  SELECT doc_id, idx, trim(piece, {_BLANKS}) AS text FROM (
    SELECT doc_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10) || chr(10))) AS piece, unnest(range(1, len(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10) || chr(10))) + 1)) AS idx FROM documents))
WHERE text <> ''""")
def q_txt_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txt.split_texts(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").select("document_id", "seq", "paragraph_index", "text")


@query(f"""
WITH {_FLAGS}, sized AS (SELECT *, CASE WHEN is_heading THEN 14.5 ELSE 11.0 END AS size FROM flag),
base AS (SELECT document_id, size AS baseline FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, s) AS _r FROM (SELECT document_id, size, count(*) AS n, min(seq) AS s FROM sized GROUP BY document_id, size)) WHERE _r = 1)
SELECT document_id, seq, text, page, size >= baseline + 2 AND shape AS is_heading FROM sized JOIN base USING (document_id) WHERE text <> ''""")
def q_block_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks with sizes: headings are larger."""
    size = F.when(F.col("is_heading"), 14.5).otherwise(11.0)
    lines = F.array(F.array(F.struct("text", size.alias("size")))).cast(blocks.LINES)
    return blocks.paragraphs_of_blocks(_paragraphs(spark, sf_dir).select("document_id", "seq", "page", lines.alias("lines"))).select("document_id", "seq", "text", "page", "is_heading")


@query("SELECT c.id, c.comparison_id, c.change_type FROM (SELECT DISTINCT id, comparison_id, change_type FROM changes) c WHERE comparison_id = (SELECT min(comparison_id) FROM changes)")
def q_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of one comparison: the filter is pushed to the scan."""
    changes = table(spark, sf_dir, "changes", "id", "comparison_id", "change_type")
    return review.lookup(changes, "comparison_id", changes.agg(F.min("comparison_id")).scalar()).distinct()


@query(f"""
WITH {_COMP}, doc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS _r FROM document_files) WHERE _r = 1)
SELECT comparison_id, c.old_document_id, c.new_document_id, coalesce(o.filename, '') AS old_document, coalesce(n.filename, '') AS new_document
FROM comp c LEFT JOIN doc o ON o.id = c.old_document_id LEFT JOIN doc n ON n.id = c.new_document_id""")
def q_comparison_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.read_back(_pairs(spark, sf_dir), review.latest_delivery(table(spark, sf_dir, "document_files")))


# ---------------------------------------------------------------- headings and sections
@query(f"WITH {_FLAGS} SELECT document_id, seq, shape, numbered, caps, h AS boundary FROM bound")
def q_heading_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _paragraphs(spark, sf_dir).select(
        "document_id", "seq", text.heading_shape(t).alias("shape"), text.numbered_heading(t).alias("numbered"), text.all_caps_heading(t).alias("caps"),
        text.heading_boundary(t, F.col("is_heading"), F.col("allow_text_pattern_heading")).alias("boundary"),
    )


@query(f"WITH {_SECTIONS} SELECT document_id, seq, section_idx, heading, is_body, heading = 'Preamble' OR regexp_matches(heading, '^Paragraph \\d+$') AS synthetic FROM sec")
def q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sectioned(spark, sf_dir).select("document_id", "seq", "section_idx", "heading", "is_body", "synthetic")


@query(f"""WITH {_SECTIONS} SELECT document_id, section_idx, heading, count(*) FILTER (is_body) AS n_paragraphs,
  trim(heading || ' ' || coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (is_body), ''), {_BLANKS}) AS text FROM sec GROUP BY document_id, section_idx, heading""")
def q_section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_texts(_sectioned(spark, sf_dir))


_SP, _NOSP = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]", "^(\\p{Nd}+(?:\\.\\p{Nd}+)*)[\\s\\x{0B}\\x{85}\\p{Z}]+(.*)$"
_NUM = f"nullif(regexp_extract(heading, '{_NOSP}', 1), '')"
_REST = f"regexp_replace(regexp_replace(CASE WHEN regexp_matches(heading, '{_NOSP}') THEN regexp_extract(heading, '{_NOSP}', 2) ELSE heading END, '^{_SP}+|{_SP}+$', '', 'g'), '{_SP}+', ' ', 'g')"
_LABEL_SHAPE = f"^(Page (Header|Footer)|Text Box \\p{{Nd}}+|Footnote \\p{{Nd}}+)({_SP}\\(.+\\))?$"


@query(f"""SELECT section AS heading, {_NUM.replace('heading', 'section')} AS number, {_REST.replace('heading', 'section')} AS rest,
  coalesce(regexp_matches({_NUM.replace('heading', 'section')}, '^\\p{{Nd}}+(\\.{text.ZERO}+)*$'), false) AS top_level, regexp_matches(section, '{_LABEL_SHAPE}') AS label
  FROM (SELECT DISTINCT section FROM changes WHERE section IS NOT NULL)""")
def q_heading_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, rests and labels of all headings."""
    h = F.col("section")
    s = table(spark, sf_dir, "changes", "section").where(h.isNotNull()).distinct()
    return s.select(h.alias("heading"), text.heading_number(h).alias("number"), text.heading_rest(h).alias("rest"), text.top_level_numbered(h).alias("top_level"), text.is_label(h).alias("label"))


# ---------------------------------------------------------------- sections of pairs, matched by similarity
def _grams(source: str, prefix: str) -> str:
    """SQL of the 2- and 3-grams of texts (k, t), their counts and each text's norm."""
    words = f"SELECT k, ' ' || unnest(regexp_extract_all(regexp_replace(lower(t), '\\p{{Nd}}', '0', 'g'), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}]')) || ' ' AS w FROM {source}"
    cut = " UNION ALL ".join(f"SELECT k, unnest(list_transform(range(1, length(w) - {n - 2}), lambda i: substring(w, i, {n}))) AS g FROM {prefix}_word" for n in (2, 3))
    return f"{prefix}_word AS ({words}), {prefix}_gram AS (SELECT k, g, count(*) AS n FROM ({cut}) GROUP BY ALL), {prefix}_norm AS (SELECT k, sqrt(sum(n * n)::double) AS norm FROM {prefix}_gram GROUP BY k)"


# Sections of both sides, their cosines, the best-first matches by recursion, and the longest run that kept its order among all runs.
_MATCHED = f"""{_SECTIONS}, {_COMP}, body AS (
  SELECT document_id, section_idx, heading, trim(heading || ' ' || coalesce(string_agg(coalesce(text, ''), ' ' ORDER BY seq) FILTER (is_body), ''), {_BLANKS}) AS t FROM sec GROUP BY document_id, section_idx, heading),
text AS (SELECT row_number() OVER () AS k, t FROM (SELECT DISTINCT t FROM body)), {_grams("text", "t")},
side AS (SELECT document_id, section_idx, heading, body.t, k, norm FROM body JOIN text USING (t) LEFT JOIN t_norm USING (k)),
o AS (SELECT comparison_id, section_idx AS i, heading, t, k, norm FROM comp JOIN side ON document_id = old_document_id), n AS (SELECT comparison_id, section_idx AS j, heading, t, k, norm FROM comp JOIN side ON document_id = new_document_id),
dot AS (SELECT a.k AS ka, b.k AS kb, sum(a.n * b.n)::double AS d FROM (SELECT DISTINCT o.k AS x, n.k AS y FROM o JOIN n USING (comparison_id)) JOIN t_gram a ON a.k = x JOIN t_gram b ON b.k = y AND b.g = a.g GROUP BY ALL),
cand AS (SELECT comparison_id AS c, i, j, CASE WHEN o.t = n.t THEN 1.0 ELSE d / o.norm / n.norm END AS score FROM o JOIN n USING (comparison_id) JOIN dot ON ka = o.k AND kb = n.k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, i, j) AS r FROM cand WHERE score >= 0.6),
walk AS (
  SELECT c, 0::bigint AS r, []::int[] AS ui, []::int[] AS uj, NULL::int AS i, NULL::int AS j, NULL::double AS score, false AS ok FROM (SELECT DISTINCT c FROM ranked)
  UNION ALL SELECT w.c, x.r, CASE WHEN list_contains(w.ui, x.i) OR list_contains(w.uj, x.j) THEN w.ui ELSE list_append(w.ui, x.i) END, CASE WHEN list_contains(w.ui, x.i) OR list_contains(w.uj, x.j) THEN w.uj ELSE list_append(w.uj, x.j) END,
    x.i, x.j, x.score, NOT (list_contains(w.ui, x.i) OR list_contains(w.uj, x.j)) FROM walk w JOIN ranked x ON x.c = w.c AND x.r = w.r + 1),
pair AS (SELECT c, i, j, score, row_number() OVER (PARTITION BY c ORDER BY i) AS p FROM walk WHERE ok),
rising AS (SELECT c, p, j, [p] AS places FROM pair UNION ALL SELECT r.c, x.p, x.j, list_append(r.places, x.p) FROM rising r JOIN pair x ON x.c = r.c AND x.p > r.p AND x.j > r.j),
longest AS (SELECT c, places FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY len(places) DESC, list_reverse(places)) AS _r FROM rising) WHERE _r = 1),
m AS (
  SELECT pair.c AS comparison_id, 'match' AS kind, pair.i AS old_idx, pair.j AS new_idx, score, list_contains(places, p) AS kept, o.heading AS old_heading, n.heading AS new_heading
  FROM pair JOIN longest USING (c) JOIN o ON o.comparison_id = pair.c AND o.i = pair.i JOIN n ON n.comparison_id = pair.c AND n.j = pair.j
  UNION ALL SELECT comparison_id, 'deleted', i, NULL, NULL, heading = 'Preamble' OR regexp_matches(heading, '^Paragraph \\d+$'), heading, NULL FROM o WHERE NOT EXISTS (SELECT 1 FROM pair WHERE c = comparison_id AND pair.i = o.i)
  UNION ALL SELECT comparison_id, 'inserted', NULL, j, NULL, heading = 'Preamble' OR regexp_matches(heading, '^Paragraph \\d+$'), NULL, heading FROM n WHERE NOT EXISTS (SELECT 1 FROM pair WHERE c = comparison_id AND pair.j = n.j))"""


def _section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the pairs as the comparison matches them, by similarity."""
    return _aligned(spark, sf_dir).where(F.col("kind").isin("match", "inserted", "deleted"))


_TOP = "coalesce(regexp_matches(regexp_extract({0}, '^(\\d+(?:\\.\\d+)*)\\s+(.*)$', 1), '^\\d+(\\.0+)*$'), false)"


_SPLIT = "regexp_extract({0}, '^(\\d+(?:\\.\\d+)*)\\s+(.*)$', {1})"


@query(f"""WITH RECURSIVE {_MATCHED}, num AS (SELECT *, nullif({_SPLIT.format('old_heading', 1)}, '') AS a, nullif({_SPLIT.format('new_heading', 1)}, '') AS b, {_REST.replace('heading', 'old_heading')} = {_REST.replace('heading', 'new_heading')} AS same FROM m WHERE kind = 'match'),
shifted AS (SELECT num.*, (SELECT count(*) FROM m x WHERE x.comparison_id = num.comparison_id AND x.kind = 'inserted' AND x.new_idx < num.new_idx AND {_TOP.format('x.new_heading')})
  - (SELECT count(*) FROM m x WHERE x.comparison_id = num.comparison_id AND x.kind = 'deleted' AND x.old_idx < num.old_idx AND {_TOP.format('x.old_heading')}) AS s FROM num WHERE a <> b),
judged AS (SELECT *, s <> 0 AND split_part(b, '.', 1)::long - split_part(a, '.', 1)::long = s AS pushed FROM shifted)
SELECT comparison_id, old_idx, new_idx, CASE WHEN pushed THEN 'section_renumbered_cascade' ELSE 'section_renumbered' END AS change_type,
  'Section renumbered from \'\'' || a || '\'\' to \'\'' || b || '\'\'' || CASE WHEN pushed THEN ' as a side effect of ' || abs(s) || ' section' || CASE WHEN abs(s) = 1 THEN '' ELSE 's' END || CASE WHEN s > 0 THEN ' added' ELSE ' removed' END || ' above it' || CASE WHEN same THEN '; wording unchanged.' ELSE '.' END ELSE '.' END AS reason FROM judged""")
def q_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.renumbered(_section_rows(spark, sf_dir)).select("comparison_id", "old_idx", "new_idx", "change_type", "reason")


@query()
def q_sections_added_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.added_or_deleted(_section_rows(spark, sf_dir)).select("comparison_id", "old_idx", "new_idx", "change_type", "reason")


_BARE = "regexp_replace(trim({0}), '\\s+', ' ', 'g')"
_UNNUMBERED = "CASE WHEN contains({0}, ' ') AND regexp_matches(replace(split_part({0}, ' ', 1), '.', ''), '^\\p{{Nd}}+$') THEN substring({0}, strpos({0}, ' ') + 1) ELSE {0} END"


@query(f"""WITH RECURSIVE {_MATCHED}, h AS (SELECT *, {_BARE.format('old_heading')} AS a, {_BARE.format('new_heading')} AS b FROM m WHERE kind = 'match' AND old_heading <> new_heading),
u AS (SELECT *, {_UNNUMBERED.format('a')} AS ua, {_UNNUMBERED.format('b')} AS ub FROM h), title AS (SELECT row_number() OVER () AS k, t FROM (SELECT ua AS t FROM u UNION SELECT ub FROM u)), {_grams("title", "h")},
near AS (SELECT x.t AS ua, y.t AS ub, sum(a.n * b.n)::double / any_value(na.norm) / any_value(nb.norm) AS s FROM (SELECT DISTINCT ua, ub FROM u) JOIN title x ON x.t = ua JOIN title y ON y.t = ub JOIN h_gram a ON a.k = x.k JOIN h_gram b ON b.k = y.k AND b.g = a.g JOIN h_norm na ON na.k = x.k JOIN h_norm nb ON nb.k = y.k GROUP BY ALL),
x AS (SELECT u.*, CASE WHEN u.ua = u.ub THEN 1.0 ELSE coalesce(s, 0.0) END AS similarity, {_SPLIT.format('old_heading', 1)} <> '' AND {_SPLIT.format('new_heading', 1)} <> '' AND {_REST.replace('heading', 'old_heading')} = {_REST.replace('heading', 'new_heading')} AS renumbered FROM u LEFT JOIN near ON near.ua = u.ua AND near.ub = u.ub)
SELECT comparison_id, old_idx, 'section_heading_changed' AS change_type, 'Section heading changed from \'\'' || old_heading || '\'\' to \'\'' || new_heading || '\'\'.' ||
  CASE WHEN similarity < {structure.REWRITE_THRESHOLD} THEN ' Headings differ substantially (similarity ' || printf('%.2f', similarity) || '); sections matched on content.' ELSE '' END AS reason FROM x
WHERE a <> b AND NOT renumbered AND NOT (old_heading = 'Preamble' OR new_heading = 'Preamble' OR regexp_matches(old_heading, '^Paragraph \\d+$') OR regexp_matches(new_heading, '^Paragraph \\d+$'))
  AND NOT regexp_matches(old_heading, '^(Page (Header|Footer)|Text Box \\d+|Footnote \\d+)(\\s\\(.+\\))?$') AND NOT regexp_matches(new_heading, '^(Page (Header|Footer)|Text Box \\d+|Footnote \\d+)(\\s\\(.+\\))?$')""")
def q_heading_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_changed(_section_rows(spark, sf_dir)).select("comparison_id", "old_idx", "change_type", "reason")


# ---------------------------------------------------------------- tables
_CELLS = f"{_PARA}, cell AS (SELECT document_id, table_position.table_id AS table_id, table_position.row AS row, table_position.col AS col, string_agg(text, ' ' ORDER BY seq) AS text, arg_min(table_position.row_span, seq) AS row_span, arg_min(table_position.col_span, seq) AS col_span FROM para WHERE table_position.table_id IS NOT NULL GROUP BY ALL)"
_DENSE = f"{_CELLS}, dense AS (SELECT r.document_id, r.table_id, r.row, c.col, coalesce(x.text, '') AS text FROM (SELECT DISTINCT document_id, table_id, row FROM cell) r JOIN (SELECT DISTINCT document_id, table_id, col FROM cell) c USING (document_id, table_id) LEFT JOIN cell x ON x.document_id = r.document_id AND x.table_id = r.table_id AND x.row = r.row AND x.col = c.col), lines AS (SELECT document_id, table_id, row, string_agg(text, ' | ' ORDER BY col) AS text FROM dense GROUP BY ALL)"


@query(f"WITH {_CELLS} SELECT * FROM cell")
def q_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.cells(_paragraphs(spark, sf_dir))


@query(f"WITH {_DENSE} SELECT * FROM lines")
def q_row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.row_texts(grids.cells(_paragraphs(spark, sf_dir)))


@query(f"WITH {_DENSE} SELECT document_id, table_id, col, string_agg(text, ' | ' ORDER BY row) AS text FROM dense GROUP BY ALL")
def q_col_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.col_texts(grids.cells(_paragraphs(spark, sf_dir)))


@query(f"WITH {_DENSE} SELECT document_id, table_id, string_agg(text, ' | ' ORDER BY row) AS text FROM lines GROUP BY ALL")
def q_flat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.flat_texts(grids.cells(_paragraphs(spark, sf_dir)))


_REAL = "text IS NOT NULL AND trim(text, " + _BLANKS + ") <> ''"


@query(f"""WITH {_FLAGS}, b AS (SELECT *, {_REAL} AS written FROM bound), run AS (
  SELECT *, sum((h AND written)::int) OVER w AS part, coalesce(last_value(CASE WHEN h AND written THEN text END IGNORE NULLS) OVER w, 'Preamble') AS heading FROM b WINDOW w AS (PARTITION BY document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
counted AS (SELECT *, sum((written AND NOT h)::int) OVER (PARTITION BY document_id, part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM run)
SELECT document_id, seq, h AND written AS opens, heading || CASE WHEN written AND NOT h THEN ', paragraph ' || n WHEN n > 0 THEN ', after paragraph ' || n ELSE ', at start' END AS anchor FROM counted""")
def q_anchor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where something that hangs from a paragraph of a document is: its section and its place in it."""
    rows = _paragraphs(spark, sf_dir).select(
        "document_id", F.lit(docx.BODY).alias("part"), F.lit(0).alias("unit"), F.col("seq").alias("ord"), F.lit(None).cast("int").alias("at"), text.strip(F.col("text")).alias("stripped"), "text",
        "is_heading", F.col("allow_text_pattern_heading").alias("by_text"),
    )
    written = rows.withColumn("text", F.when(F.col("stripped") != "", F.col("text")).otherwise("")).drop("stripped")
    return docx.located(written).select("document_id", F.col("ord").alias("seq"), "opens", "anchor")


# ---------------------------------------------------------------- detection
_RE = {"numbers": ("'-?\\d+(?:\\.\\d+)?'", 0), "units": ("'\\d+\\.?\\d*\\s*(%|°C|°F|mL|L|mg|kg|g|min|hr|h|RH)'", 1), "dates": ("'(?i)\\b\\d{1,2}\\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+\\d{4}\\b'", 0)}
_TOKENS = f"{_CH}, tok AS (SELECT id, " + ", ".join(f"regexp_extract_all(coalesce({s}_text, ''), {p}, {g}) AS {s}_{k}" for k, (p, g) in _RE.items() for s in ("old", "new")) + " FROM ch)"


@query(f"WITH {_TOKENS} SELECT id, " + ", ".join(f"array_to_string({s}_{k}, ';') AS {s}_{k}" for k in _RE for s in ("old", "new")) + " FROM tok")
def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = {"numbers": detect.numbers, "units": detect.units, "dates": detect.dates}
    c = _changes(spark, sf_dir)
    return c.select("id", *[F.array_join(f[k](F.coalesce(f"{s}_text", F.lit(""))), ";").alias(f"{s}_{k}") for k in f for s in ("old", "new")])


def _listed(side: str, k: str) -> str:
    return f"'[' || array_to_string(list_transform({side}_{k}, lambda x: '''' || x || ''''), ', ') || ']'" if k == "units" else f"array_to_string({side}_{k}, ', ')"


_REGEX_CHANGES = f"WITH {_TOKENS} " + " UNION ALL ".join(
    f"SELECT id, '{kind}' AS change_type, '{words} changed from ' || {_listed('old', k)} || ' to ' || {_listed('new', k)} || '.' AS reason, 1.0::double AS confidence FROM tok WHERE old_{k} <> new_{k}"
    for k, kind, words in (("dates", "date_change", "Date"), ("units", "unit_change", "Unit"), ("numbers", "numeric_change", "Numeric value(s)"))
)


@query(_REGEX_CHANGES)
def q_regex_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detections of every change: dates, units, numbers."""
    c = _changes(spark, sf_dir).select("id", F.explode(detect.detections(F.col("old_text"), F.col("new_text"))).alias("_d"))
    return c.select("id", "_d.change_type", "_d.reason", "_d.confidence")


@query(f"WITH x AS ({_REGEX_CHANGES}) SELECT id, change_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY list_position(['date_change', 'unit_change', 'numeric_change'], change_type)) AS _r FROM x) WHERE _r = 1")
def q_first_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _changes(spark, sf_dir).withColumn("_d", detect.first_detection(F.col("old_text"), F.col("new_text")))
    return c.where(F.col("_d").isNotNull()).select("id", "_d.change_type")


def _marks(k: str, side: str, group: int, pattern: str) -> str:
    """SQL of the places of a detection's values in one text, where it fired: the end of a match is the length of all pieces and matches so far."""
    t = f"coalesce({side}_text, '')"
    so_far = "list_sum(list_transform({0}[1:i], lambda x: length(x)))::bigint"
    ends = f"unnest(list_transform(range(1, len(w) + 1), lambda i: {{'e': {so_far.format('p')} + {so_far.format('w')}, 'n': length(v[i])}}))"
    texts = f"SELECT id, string_split_regex({t}, {pattern}) AS p, regexp_extract_all({t}, {pattern}, 0) AS w, regexp_extract_all({t}, {pattern}, {group}) AS v FROM ch JOIN tok USING (id) WHERE old_{k} <> new_{k}"
    return f"SELECT id, '{side}' AS side, m.e - m.n AS s, m.e AS e FROM (SELECT id, {ends} AS m FROM ({texts}))"


@query(f"""WITH RECURSIVE {_TOKENS}, mark AS ({" UNION ALL ".join(_marks(k, side, g, p) for k, (p, g) in _RE.items() for side in ("old", "new"))}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id, side ORDER BY s DESC, e DESC) AS r FROM mark),
cut AS (SELECT id, 'old' AS side, 0::bigint AS r, coalesce(old_text, '') AS t FROM ch UNION ALL SELECT id, 'new', 0, coalesce(new_text, '') FROM ch
  UNION ALL SELECT c.id, c.side, x.r, substring(c.t, 1, x.s) || substring(c.t, x.e + 1) FROM cut c JOIN ranked x ON x.id = c.id AND x.side = c.side AND x.r = c.r + 1),
rest AS (SELECT id, side, arg_max(t, r) AS t FROM cut GROUP BY ALL)
SELECT o.id, o.t AS old_residual, n.t AS new_residual, o.t <> n.t AS differs FROM rest o JOIN rest n USING (id) WHERE o.side = 'old' AND n.side = 'new'""")
def q_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of both texts without the detected values, and whether it still differs."""
    c = _changes(spark, sf_dir).withColumn("_d", detect.detections(F.col("old_text"), F.col("new_text")))
    c = c.select("id", detect.residual(F.col("old_text"), F.col("_d")).alias("old_residual"), detect.residual(F.col("new_text"), F.col("_d")).alias("new_residual"))
    return c.withColumn("differs", F.col("old_residual") != F.col("new_residual"))


# ---------------------------------------------------------------- views of changes
_RISK = "CASE change_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in views.RISKS.items()) + f" ELSE '{views.DEFAULT_RISK}' END"


@query(f"WITH {_CH} SELECT id, change_type, {_RISK} AS risk, {_EFFECTIVE} AS effective FROM ch")
def q_risk_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("id", "change_type", views.risk_of(F.col("change_type")).alias("risk"), views.effective_risk(F.col("reviewer_risk_level"), F.col("ai_risk_level")).alias("effective"))


_FILTERS = [{"risk": "High"}, {"change_type": "numeric_change"}, {"section": "Recorded Values"}, {"risk": "Low", "change_type": "wording_change"}, {"risk": "Medium", "section": "1.0 Purpose", "change_type": "date_change"}, {}]


def _filter_sql(n: int, f: dict) -> str:
    columns = {"risk": _EFFECTIVE, "section": "section", "change_type": "change_type"}
    return f"SELECT {n} AS filter, id, section FROM ch WHERE " + " AND ".join(["true", *(f"{columns[k]} = '{v}'" for k, v in f.items())])


@query(f"WITH {_CH} " + " UNION ALL ".join(_filter_sql(n, f) for n, f in enumerate(_FILTERS)))
def q_filter_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that pass a filter over risk, section and type; each of the filters is left open in some."""
    c = _changes(spark, sf_dir)
    parts = [review.filter_changes(c, **f).select(F.lit(n).alias("filter"), "id", "section") for n, f in enumerate(_FILTERS)]
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH {_CH}, {_COMP} SELECT comparison_id, " + ", ".join([f"coalesce({c}, 0) AS {c}" for c in ["total_changes", *summary._RISKS, *summary._TYPES]]) + " FROM (SELECT DISTINCT comparison_id FROM comp) LEFT JOIN (SELECT comparison_id, count(*) AS total_changes, " + ", ".join([f"count(*) FILTER (ai_risk_level = '{v}') AS {k}" for k, v in summary._RISKS.items()] + [f"count(*) FILTER (change_type = '{v}') AS {k}" for k, v in summary._TYPES.items()]) + " FROM ch GROUP BY ALL) USING (comparison_id)")
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summarize(_changes(spark, sf_dir), _pairs(spark, sf_dir))


@query(f"WITH {_CH} SELECT comparison_id, {_EFFECTIVE} AS risk, count(*) AS n_changes, {_ORDERED.format(_EFFECTIVE)} AS severity FROM ch WHERE {_ORDERED.format(_EFFECTIVE)} > 0 GROUP BY ALL")
def q_risk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.risk_counts(_changes(spark, sf_dir), "comparison_id")


_CATEGORY = "CASE WHEN source = 'Table' AND NOT coalesce(change_type IN ('section_added', 'section_deleted'), false) THEN 'Tables' WHEN starts_with(section, 'Page Header') THEN 'Headers' WHEN starts_with(section, 'Page Footer') THEN 'Footers' ELSE 'Body' END"


@query(f"WITH {_CH} SELECT comparison_id, {_CATEGORY} AS category, section, count(*) AS n_changes, min(id) AS first_id FROM ch GROUP BY ALL")
def q_group_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _changes(spark, sf_dir).withColumn("category", views.category(F.col("section"), F.col("source"), F.col("change_type")))
    return c.groupBy("comparison_id", "category", "section").agg(F.count("*").alias("n_changes"), F.min("id").alias("first_id"))


_N = lambda x: f"count(*) FILTER ({_EFFECTIVE} = '{x}')"
_LABEL = "CASE " + " ".join(f"WHEN {_N(x)} > 0 THEN '{s}'" for x, s in views.SIGNS.items()) + " END"
_BREAKDOWN = "concat_ws(', ', " + ", ".join(f"CASE WHEN {_N(x)} > 0 THEN {_N(x)} || ' {x}' END" for x in views.SEVERITY) + ")"


@query(f"WITH {_CH} SELECT comparison_id, section, count(*) AS n_changes, {_N('High')} > 0 AS has_high_risk, CASE WHEN {_LABEL} IS NULL THEN coalesce(section, '') || ' — 0 changes' ELSE {_LABEL} || ' ' || coalesce(section, '') || ' — ' || count(*) || CASE WHEN count(*) = 1 THEN ' change (' ELSE ' changes (' END || {_BREAKDOWN} || ')' END AS label FROM ch GROUP BY comparison_id, section")
def q_group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.group_labels(_changes(spark, sf_dir), "section", "comparison_id", "section")


@query(f"WITH {_CH} SELECT comparison_id, array_to_string(list_sort(list(DISTINCT section)), ';') AS sections, array_to_string(list_sort(list(DISTINCT change_type)), ';') AS change_types FROM ch GROUP BY ALL")
def q_distinct_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choices of a filter: distinct sections and types of a comparison, sorted."""
    of = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    return _changes(spark, sf_dir).groupBy("comparison_id").agg(of("section").alias("sections"), of("change_type").alias("change_types"))


@query(f"WITH {_CH} SELECT id, CASE WHEN change_type IN ({', '.join(repr(x) for x in views.MATCH_DERIVED)}) AND confidence IS NOT NULL THEN printf('%.2f', confidence) ELSE '' END AS match_confidence FROM ch")
def q_match_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("id", views.match_confidence(F.col("change_type"), F.col("confidence")).alias("match_confidence"))


_A, _B = ("'Table ' || {0}_table_id || ', Row ' || {0}_table_row || ', Col ' || {0}_table_col".format(s) for s in ("old", "new"))
_CELL = f"CASE WHEN old_table_id IS NULL AND new_table_id IS NULL THEN '' WHEN old_table_id IS NULL THEN {_B} WHEN new_table_id IS NULL OR {_A} = {_B} THEN {_A} ELSE {_A} || ' -> ' || {_B} END"


def _coordinate_sql(k: str) -> str:
    return f"CASE WHEN old_table_id IS NULL AND new_table_id IS NULL THEN '' WHEN old_table_id IS NOT NULL AND new_table_id IS NOT NULL AND old_table_{k} <> new_table_{k} THEN (old_table_{k} + 1) || ' → ' || (new_table_{k} + 1) WHEN new_table_id IS NOT NULL THEN (new_table_{k} + 1)::varchar ELSE (old_table_{k} + 1)::varchar END"


@query(f"WITH {_CH} SELECT id, {_CELL} AS table_cell, {_coordinate_sql('row')} AS row_text, {_coordinate_sql('col')} AS col_text, coalesce(new_table_id, old_table_id, -1) AS table_key FROM ch")
def q_table_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("old_table_position"), F.col("new_table_position")
    return _changes(spark, sf_dir).select("id", views.table_cell(a, b).alias("table_cell"), views.coordinate(a, b, "row").alias("row_text"), views.coordinate(a, b, "col").alias("col_text"), views.table_key(a, b).alias("table_key"))


@query(f"WITH {_CH}, k AS (SELECT DISTINCT comparison_id, coalesce(new_table_id, old_table_id) AS table_key FROM ch WHERE source = 'Table') SELECT comparison_id, table_key, table_key + 1 AS shown_as, row_number() OVER (PARTITION BY comparison_id ORDER BY table_key) AS place FROM k WHERE table_key >= 0")
def q_table_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of each comparison in the order they are shown in."""
    return summary.table_order(_changes(spark, sf_dir).where("source = 'Table'"), "comparison_id")


_LAST = "(SELECT change_id, {0} AS v FROM (SELECT change_id, {0}, row_number() OVER (PARTITION BY change_id ORDER BY submitted_at DESC, {0} DESC) AS _r FROM review_patches WHERE {0} IS NOT NULL AND change_id IS NOT NULL) WHERE _r = 1)"


@query(f"""WITH {_CH} SELECT c.id, coalesce(a.v, c.reviewer_risk_level) AS reviewer_risk_level, coalesce(b.v, c.reviewer_comment) AS reviewer_comment, coalesce(d.v, c.accepted) AS accepted
FROM ch c LEFT JOIN {_LAST.format('reviewer_risk_level')} a ON a.change_id = c.id LEFT JOIN {_LAST.format('reviewer_comment')} b ON b.change_id = c.id LEFT JOIN {_LAST.format('accepted')} d ON d.change_id = c.id""")
def q_review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.apply_reviews(_changes(spark, sf_dir), table(spark, sf_dir, "review_patches")).select("id", *review.REVIEW_FIELDS)


@query(f"""WITH {_CH}, p AS (SELECT change_id, max(submitted_at) AS t FROM review_patches GROUP BY ALL)
SELECT c.id, concat_ws(',', CASE WHEN r.reviewer_risk_level IS DISTINCT FROM c.reviewer_risk_level THEN 'reviewer_risk_level' END, CASE WHEN r.reviewer_comment IS DISTINCT FROM c.reviewer_comment THEN 'reviewer_comment' END, CASE WHEN r.accepted IS DISTINCT FROM c.accepted THEN 'accepted' END) AS changed
FROM (SELECT DISTINCT change_id, reviewer_risk_level, reviewer_comment, accepted FROM review_patches) r JOIN ch c ON c.id = r.change_id""")
def q_edited_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fields an edit changes against the stored row."""
    p = table(spark, sf_dir, "review_patches", "change_id", *review.REVIEW_FIELDS).distinct().select(F.col("change_id").alias("id"), *[F.col(c).alias(f"e_{c}") for c in review.REVIEW_FIELDS])
    j = _changes(spark, sf_dir).join(p, "id")
    return j.select("id", F.array_join(views.changed_fields({c: F.col(c) for c in review.REVIEW_FIELDS}, {c: F.col(f"e_{c}") for c in review.REVIEW_FIELDS}), ",").alias("changed"))


@query(f"WITH {_CH} SELECT id AS change_id, section, change_type, source, old_text, new_text, {_EFFECTIVE} AS risk_level, reason, old_page, new_page, confidence, coalesce(reviewer_comment, '') AS reviewer_comment, CASE WHEN accepted THEN 'True' ELSE 'False' END AS accepted, {_CELL} AS table_cell FROM ch")
def q_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.csv_rows(_changes(spark, sf_dir).withColumnRenamed("id", "change_id"))


_POSITION = "CASE WHEN {0}_table_id IS NOT NULL THEN {{'table_id': {0}_table_id, 'row': {0}_table_row, 'col': {0}_table_col}} END"


@query(f"""WITH {_CH} SELECT comparison_id, to_json({{'change_id': id, 'section': section, 'change_type': change_type, 'source': source, 'old_text': old_text, 'new_text': new_text, 'risk_level': {_EFFECTIVE}, 'ai_risk_level': ai_risk_level,
  'reviewer_risk_level': reviewer_risk_level, 'reason': reason, 'old_page': old_page, 'new_page': new_page, 'confidence': confidence, 'reviewer_comment': reviewer_comment, 'accepted': accepted,
  'old_table_position': {_POSITION.format('old')}, 'new_table_position': {_POSITION.format('new')}}})::varchar AS change FROM ch""")
def q_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change as the JSON object of the export."""
    return export.json_rows(_changes(spark, sf_dir).withColumns({"change_id": F.col("id"), "change_ord": F.xxhash64("id")})).drop("change_ord")


@query(f"WITH {_CH} SELECT id, comparison_id, source, accepted, old_table_id, old_table_row, old_table_col, new_table_id, new_table_row, new_table_col FROM (SELECT * REPLACE (CASE WHEN old_table_id IS NOT NULL THEN old_table_row END AS old_table_row, CASE WHEN old_table_id IS NOT NULL THEN old_table_col END AS old_table_col, CASE WHEN new_table_id IS NOT NULL THEN new_table_row END AS new_table_row, CASE WHEN new_table_id IS NOT NULL THEN new_table_col END AS new_table_col) FROM ch)")
def q_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change rows decoded and encoded again."""
    flat = [f"{s}_table_{k}" for s in ("old", "new") for k in ("id", "row", "col")]
    return review.encoded(_changes(spark, sf_dir)).select("id", "comparison_id", "source", "accepted", *flat)


# ---------------------------------------------------------------- classification
@query(f"""WITH {_CH} SELECT id AS change_id, CASE WHEN change_type IN ({', '.join(repr(x) for x in classify.SEMANTIC_TYPES)}) THEN change_type ELSE 'unclassified' END AS change_type,
  CASE WHEN change_type IS NULL THEN '{classify.UNAVAILABLE}' ELSE coalesce(reason, '') END AS reason, CASE WHEN change_type IS NULL THEN 0.0 ELSE coalesce(confidence, 0.0) END AS confidence FROM ch""")
def q_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a classifier parsed and merged; a change without a type has none."""
    c = _changes(spark, sf_dir).withColumnRenamed("id", "change_id")
    raw = c.where(F.col("change_type").isNotNull()).select(F.to_json(F.array(F.struct("change_id", "change_type", "reason", "confidence"))).alias("raw"))
    pending = c.select("change_id", F.lit("pending_llm_classification").alias("change_type"), F.lit("").alias("reason"), F.lit(0.0).alias("confidence"))
    return classify.resolved(pending, classify.parse_answers(raw))


# ---------------------------------------------------------------- matching
def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even and odd vectors, as the two sides of comparisons; the vectors of a label are a comparison."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("grp"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    return v.where("ord % 2 = 0"), v.where("ord % 2 = 1")


_COS = "cand AS (SELECT o.label::bigint AS grp, o.vec_id AS i, n.vec_id AS j, round(list_cosine_similarity(o.embedding::double[], n.embedding::double[]), 9) AS score FROM embeddings o JOIN embeddings n ON o.label = n.label WHERE o.vec_id % 2 = 0 AND n.vec_id % 2 = 1), ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, i, j) AS r FROM cand WHERE score >= 0.25)"
_GREEDY = f"""WITH RECURSIVE {_COS}, walk AS (
  SELECT grp, 0::bigint AS r, []::bigint[] AS ui, []::bigint[] AS uj, NULL::bigint AS i, NULL::bigint AS j, NULL::double AS score, false AS ok FROM (SELECT DISTINCT grp FROM ranked)
  UNION ALL SELECT w.grp, k.r, CASE WHEN list_contains(w.ui, k.i) OR list_contains(w.uj, k.j) THEN w.ui ELSE list_append(w.ui, k.i) END, CASE WHEN list_contains(w.ui, k.i) OR list_contains(w.uj, k.j) THEN w.uj ELSE list_append(w.uj, k.j) END,
    k.i, k.j, k.score, NOT (list_contains(w.ui, k.i) OR list_contains(w.uj, k.j)) FROM walk w JOIN ranked k ON k.grp = w.grp AND k.r = w.r + 1)
SELECT grp, i, j FROM walk WHERE ok"""


@query(f"WITH {_COS} SELECT grp, i, j, round(score, 5) AS score FROM cand WHERE score >= 0.25")
def q_cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of at least 0.25 between the two sides of a group, as expressions: all pairs of a label."""
    old, new = _vectors(spark, sf_dir)
    a = old.select("grp", F.col("ord").alias("i"), F.col("vector").cast("array<double>").alias("a"))
    b = new.select("grp", F.col("ord").alias("j"), F.col("vector").cast("array<double>").alias("b"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = a.withColumn("na", norm(F.col("a"))).join(b.withColumn("nb", norm(F.col("b"))), "grp").withColumn("score", F.round(dot / F.nullif(F.col("na") * F.col("nb"), F.lit(0.0)), 9))
    return scored.where("score >= 0.25").select("grp", "i", "j", F.round("score", 5).alias("score"))


@query(_GREEDY)
def q_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-first one-to-one matches of vectors within their label."""
    return matching.match_vectors(*_vectors(spark, sf_dir), "grp", 0.25).select("grp", "i", "j")


@query(f"WITH g AS ({_GREEDY}) SELECT label::bigint AS grp, vec_id AS ord, CASE WHEN vec_id % 2 = 0 THEN 'deleted' ELSE 'inserted' END AS kind FROM embeddings WHERE vec_id NOT IN (SELECT i FROM g) AND vec_id NOT IN (SELECT j FROM g)")
def q_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of either side without a match within their label."""
    old, new = _vectors(spark, sf_dir)
    m = matching.match_vectors(old, new, "grp", 0.25)
    left = old.join(m.select("grp", F.col("i").alias("ord")), ["grp", "ord"], "left_anti").select("grp", "ord", F.lit("deleted").alias("kind"))
    return left.unionByName(new.join(m.select("grp", F.col("j").alias("ord")), ["grp", "ord"], "left_anti").select("grp", "ord", F.lit("inserted").alias("kind")))


# ---------------------------------------------------------------- the pipeline
def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_pairs(spark, sf_dir), _sectioned(spark, sf_dir))


@query(f"WITH RECURSIVE {_MATCHED} SELECT comparison_id, kind, old_idx, new_idx, score, kept, old_heading, new_heading FROM m")
def q_section_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections matched by similarity, and those without a match."""
    return _aligned(spark, sf_dir).where(F.col("kind").isin("match", "inserted", "deleted")).select("comparison_id", "kind", "old_idx", "new_idx", "score", "kept", "old_heading", "new_heading")


@query()
def q_paragraph_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that the sequence alignment replaces by one another."""
    return _aligned(spark, sf_dir).where("kind = 'pair'").select("comparison_id", "ord", "sub", "old_seq", "new_seq", "old_text", "new_text")


@query()
def q_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs found again elsewhere."""
    return _aligned(spark, sf_dir).where("kind = 'move'").select("comparison_id", "old_seq", "new_seq", "score", F.col("old_heading").alias("old_section"), F.col("new_heading").alias("new_section"))


@query()
def q_table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, columns and merged cells that changed."""
    return _aligned(spark, sf_dir).where("kind = 'table'").select("comparison_id", "ord", F.col("old_heading").alias("section"), "change_type", "reason", "old_text", "new_text")


@query()
def q_llm_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a classifier is asked: wording changes that no detector explains."""
    pending = changes_of(_aligned(spark, sf_dir)).where("change_type = 'pending_llm_classification'")
    return classify.request_items(pending.withColumn("change_id", F.sha2(F.concat_ws("|", "comparison_id", F.to_json("_ord")), 256)))


@query()
def q_compare_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All change rows of all comparisons."""
    flat = [F.col(f"{s}_table_position.{k}").alias(f"{s}_table_{k.removeprefix('table_')}") for s in ("old", "new") for k in ("table_id", "row", "col")]
    return compare(_pairs(spark, sf_dir), table(spark, sf_dir, "paragraphs")).select("*", *flat).drop("old_table_position", "new_table_position")


@query()
def q_compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of every comparison."""
    pairs = _pairs(spark, sf_dir)
    return summary.summarize(compare(pairs, table(spark, sf_dir, "paragraphs")), pairs)
