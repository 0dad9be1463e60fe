"""Queries of the text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.llm import confusables, leakage, mojibake, neardup, packing, pii, sentences, termfreq
from palimp.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of changes whose passages share 0.6 of their word triples."""
    changes = table(spark, sf_dir, "changes", "id", "old_text", "new_text")
    pairs = neardup.near_duplicate_pairs(changes, "id", ["old_text", "new_text"], threshold=0.6, size=3, least_words=20)
    return pairs.select(F.col("id_1").alias("change_id_1"), F.col("id_2").alias("change_id_2"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every change with enough words: groups of nearly the same passages."""
    changes = table(spark, sf_dir, "changes", "id", "old_text", "new_text")
    groups = neardup.near_duplicate_groups(changes, "id", ["old_text", "new_text"], threshold=0.6, size=3, least_words=20)
    return groups.withColumnRenamed("id", "change_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of changes that were read with another encoding than they were written in."""
    return p2_restored(spark, sf_dir).select("change_id", "field").distinct()


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those fields with their text as it was written, where it can be had back."""
    changes = table(spark, sf_dir, "changes", "id", "old_text", "new_text")
    found = mojibake.find_garbled(changes, "id", ["old_text", "new_text"])
    return found.select(F.col("id").alias("change_id"), "field", F.col("restored").alias("text"), "whole")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of changes that look ordinary but hold other characters."""
    changes = table(spark, sf_dir, "changes", "id", "old_text", "new_text")
    found = confusables.find_lookalikes(changes, "id", ["old_text", "new_text"]).where(F.arrays_overlap("kinds", F.array(*map(F.lit, ("form", "mark", "invisible", "blank", "mixed")))))
    return found.select(F.col("id").alias("change_id"), "field").distinct()


def p3_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consistent form of the texts of all changes."""
    changes = table(spark, sf_dir, "changes", "id", "old_text", "new_text")
    return confusables.normalize_fields(changes, "id", ["old_text", "new_text"]).select(F.col("id").alias("change_id"), "field", "text")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every value and section word of the changes, with marks."""
    changes = table(spark, sf_dir, "changes", "id", "change_type", "section", "ai_risk_level")
    columns = {k: (k, termfreq.single) for k in ("change_type", "section", "ai_risk_level")} | {"section_word": ("section", termfreq.pieces)}
    return termfreq.term_frequencies(changes, "id", columns).withColumnRenamed("term", "value")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that are too rare or too common."""
    return p4_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("field", "value", "mark")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of personal information in each text field of the changes."""
    changes = table(spark, sf_dir, "changes", "id", "reviewer_comment", "old_text", "new_text")
    found = pii.find_personal(changes, "id", ["reviewer_comment", "old_text", "new_text"], redact=False)
    return found.select(F.col("id").alias("change_id"), "field", F.explode("kinds").alias("kind")).distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those fields with a typed placeholder in each such place."""
    changes = table(spark, sf_dir, "changes", "id", "reviewer_comment", "old_text", "new_text")
    found = pii.find_personal(changes, "id", ["reviewer_comment", "old_text", "new_text"])
    return found.select(F.col("id").alias("change_id"), "field", "kinds", "text").distinct()


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assignment of all articles to containers of each capacity."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    packed = packing.pack(packing.token_counts(documents, "doc_id", "text"), table(spark, sf_dir, "pack_sizes"))
    return packed.withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers of each capacity are used."""
    return packing.fill(p7_packing(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the assignment: nothing, for every article and every capacity."""
    return packing.faults(p7_packing(spark, sf_dir).withColumnRenamed("doc_id", "id"), table(spark, sf_dir, "pack_sizes"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with the test items it has 12 consecutive words of: of the similar passages of 12 words, those with the item's words."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    items = table(spark, sf_dir, "eval_items", "item_id", "text")
    return leakage.find_leaks(documents, "doc_id", "text", items, "item_id", "text").where("exact").select(F.col("id").alias("doc_id"), "item_id")


def p8_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with the test items that a passage of it resembles, in the size of the shortest item, edited or not."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    items = table(spark, sf_dir, "eval_items", "item_id", "text")
    return leakage.find_leaks(documents, "doc_id", "text", items, "item_id", "text", window=24, radius=5).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sentence of the running text of every article begins."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return sentences.split_sentences(documents, "doc_id", "text", with_text=False).select(F.col("id").alias("doc_id"), "start_pos")


def p9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every article."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return sentences.split_sentences(documents, "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_restored, p3_found, p3_normalized, p4_terms, p4_found, p5_found, p5_redacted, p7_packing, p7_fill, p7_faults, p8_found, p8_edited, p9_found, p9_sentences)}

_TERMS = """
WITH one AS (SELECT DISTINCT id, change_type, section, ai_risk_level FROM changes WHERE id IS NOT NULL),
term AS (
  SELECT 'change_type' AS field, id, change_type AS value FROM one UNION ALL SELECT 'section', id, section FROM one
  UNION ALL SELECT 'ai_risk_level', id, ai_risk_level FROM one
  UNION ALL SELECT 'section_word', id, unnest(list_filter(string_split(section, ' '), lambda x: x <> '')) FROM one),
total AS (
  SELECT 'change_type' AS field, count(DISTINCT id) AS n FROM one WHERE change_type IS NOT NULL UNION ALL SELECT 'section', count(DISTINCT id) FROM one WHERE section IS NOT NULL
  UNION ALL SELECT 'ai_risk_level', count(DISTINCT id) FROM one WHERE ai_risk_level IS NOT NULL UNION ALL SELECT 'section_word', count(DISTINCT id) FROM one WHERE section IS NOT NULL),
counted AS (SELECT field, value, count(*) AS occurrences, count(DISTINCT id) AS records FROM term WHERE value IS NOT NULL GROUP BY ALL)
SELECT field, value, occurrences, records, records / n AS share,
  CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.1 * n THEN 'common' END AS mark FROM counted JOIN total USING (field)
"""
# Of all pairs with a triple in common: the exact similarity.
_PAIRS = """one AS (SELECT DISTINCT id, coalesce(old_text, '') AS a, coalesce(new_text, '') AS b FROM changes WHERE id IS NOT NULL),
words AS (SELECT id, regexp_extract_all(translate(a, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS a,
  regexp_extract_all(translate(b, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS b FROM one),
able AS (SELECT * FROM words WHERE len(a) + len(b) >= 20),
triple AS (SELECT DISTINCT id, g FROM (
  SELECT id, unnest(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) AS g FROM able
  UNION ALL SELECT id, unnest(list_transform(range(1, len(b) - 1), lambda i: b[i] || ' ' || b[i + 1] || ' ' || b[i + 2])) FROM able)),
size AS (SELECT id, count(*) AS n FROM triple GROUP BY id),
pair AS (SELECT x.id AS i, y.id AS j, count(*) AS c FROM triple x JOIN triple y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
found AS (SELECT i AS change_id_1, j AS change_id_2 FROM pair JOIN size s ON s.id = i JOIN size t ON t.id = j WHERE c >= 0.6 * (s.n + t.n - c) - 1e-9)
"""
_P1 = f"WITH {_PAIRS} SELECT * FROM found"
# Whatever is reached over pairs, by recursion; a class is named by the least change of it.
_P1_GROUPS = f"""
WITH RECURSIVE {_PAIRS}, link AS (SELECT change_id_1 AS a, change_id_2 AS b FROM found UNION ALL SELECT change_id_2, change_id_1 FROM found),
reach AS (SELECT id AS a, id AS b FROM size UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT a AS change_id, min(b) AS class_id, (SELECT count(*) FROM link WHERE link.a = reach.a) AS links FROM reach GROUP BY a
"""
_FORMS = "[！-～ﬀ-ﬆﬓ-ﬗĲĳℂℇℊ-ℓℕℙ-ℝℤℨℬℭℯ-ℱℳ-ℴℼ-ℿⅅ-ⅉ\\x{1D400}-\\x{1D7FF}]"
_MIXED = "|".join(f"\\p{{{s}}}\\p{{L}}*[{''.join(f'\\p{{{o}}}' for o in ('Latin', 'Greek', 'Cyrillic', 'Armenian') if o != s)}]" for s in ("Latin", "Greek", "Cyrillic", "Armenian"))
_P3 = f"""
WITH field AS (SELECT DISTINCT id AS change_id, 'old_text' AS field, old_text AS t FROM changes UNION SELECT id, 'new_text', new_text FROM changes)
SELECT DISTINCT change_id, field FROM field WHERE change_id IS NOT NULL AND (regexp_matches(t, '{_FORMS}') OR regexp_matches(t, '\\p{{M}}|\\p{{Cf}}')
  OR regexp_matches(replace(t, ' ', ''), '\\p{{Zs}}') OR regexp_matches(t, '{_MIXED}'))
"""
_P8 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '\\\\[A-Za-z]+', ' ', 'g')), '[a-z0-9]+') AS x FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '\\\\[A-Za-z]+', ' ', 'g')), '[a-z0-9]+') AS x FROM eval_items),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(x) - 10), lambda i: array_to_string(x[i:i + 11], ' '))) AS g FROM d),
ew AS (SELECT item_id, unnest(list_transform(range(1, len(x) - 10), lambda i: array_to_string(x[i:i + 11], ' '))) AS g FROM e)
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (g)
"""
ORACLES: dict[str, str] = {
    "p1_found": _P1,
    "p1_groups": _P1_GROUPS,
    "p3_found": _P3,
    "p7_faults": "SELECT pack_id, (SELECT count(*) FROM documents) AS items, 0::bigint AS overfull, 0::bigint AS broken, 0::bigint AS needless FROM pack_sizes",
    "p8_found": _P8,
    "p4_terms": _TERMS,
    "p4_found": f"SELECT field, value, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
}
