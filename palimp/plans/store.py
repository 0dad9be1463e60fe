"""A folder of tables as the engine's store: documents, paragraphs, comparisons, changes, reviews.

What a service would do per request is done per batch here: ingest files, compare
pairs, load, review and export. Writes append; change rows are laid out by
comparison, so loading one comparison reads only its files. Reviews are kept as
patches and merged on reading, so no file is rewritten and a lost executor costs
no more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.operators import export, review, summary
from palimp.operators.classify import Classifier
from palimp.operators.matching import Embedder
from palimp.plans.compare import compare
from palimp.schemas import CHANGES, PARAGRAPHS
from palimp.sources.registry import READERS, read

_DOCUMENTS = "id string, filename string, file_type string, storage_path string, uploaded_at timestamp"
_COMPARISONS = "comparison_id string, old_document_id string, new_document_id string, created_at timestamp"
_PATCHES = "change_id string, reviewer_risk_level string, reviewer_comment string, accepted boolean, submitted_at timestamp"
_BUCKET = "bucket"


class Store:
    """The tables under a path. Documents are known by the hash of their path and comparisons by that of their documents."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _read(self, name: str, schema) -> DataFrame:
        """The table, with the columns of the schema; columns that older files lack are null. Empty before the first write."""
        try:
            stored = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}")
            names = stored.columns
        except Exception as e:  # nothing is written yet, or nothing but empty tables
            if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                raise
            return self.spark.createDataFrame([], schema)
        want = self.spark.createDataFrame([], schema).schema
        return stored.select(*[(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in want], *[c for c in names if c == _BUCKET])

    def _bucket(self, c: str):
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int").alias(_BUCKET)

    def ingest(self, file_type: str, *paths: str) -> DataFrame:
        """Reads files, registers them as documents and keeps their paragraphs; returns the documents."""
        if file_type not in READERS:
            raise ValueError(f"unsupported file type: {file_type}")
        paragraphs = read(self.spark, file_type, *paths).withColumn("storage_path", F.col("document_id")).withColumn("document_id", F.sha2("storage_path", 256))
        kept = paragraphs.select(*[f.name for f in PARAGRAPHS], self._bucket("document_id"))
        kept.write.mode("append").partitionBy(_BUCKET).parquet(f"{self.path}/paragraphs")
        files = self.spark.read.format("binaryFile").load(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("modificationTime").alias("uploaded_at"))
        documents = files.select(F.sha2("path", 256).alias("id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(file_type).alias("file_type"), F.col("path").alias("storage_path"), "uploaded_at")
        documents.write.mode("append").parquet(f"{self.path}/documents")
        return documents

    def documents(self) -> DataFrame:
        return review.latest_delivery(self._read("documents", _DOCUMENTS), "id", "uploaded_at")

    def compare(self, pairs: DataFrame, embed: Embedder | None = None, classifier: Classifier | None = None) -> DataFrame:
        """Compares pairs (old_document_id, new_document_id), keeps what comes out and returns the comparisons.

        Pairs with an unknown document are left out.
        """
        known = self.documents().select("id")
        pairs = pairs.select("old_document_id", "new_document_id").distinct()
        for side in ("old_document_id", "new_document_id"):
            pairs = pairs.join(known.withColumnRenamed("id", side), side, "left_semi")
        pairs = pairs.select(F.sha2(F.concat_ws("|", "old_document_id", "new_document_id"), 256).alias("comparison_id"), "old_document_id", "new_document_id")
        changes = compare(pairs, self._read("paragraphs", PARAGRAPHS).drop(_BUCKET), embed, classifier)
        changes.withColumn(_BUCKET, self._bucket("comparison_id")).write.mode("append").partitionBy(_BUCKET).parquet(f"{self.path}/changes")
        comparisons = pairs.withColumn("created_at", F.current_timestamp())
        comparisons.write.mode("append").parquet(f"{self.path}/comparisons")
        return comparisons

    def review(self, patches: DataFrame) -> None:
        """Keeps reviewers' partial updates (change_id and any of the reviewed fields)."""
        have = patches.columns
        p = patches.select("change_id", *[(F.col(c) if c in have else F.lit(None)).alias(c) for c in review.REVIEW_FIELDS], (F.col("submitted_at") if "submitted_at" in have else F.current_timestamp()).alias("submitted_at"))
        names = [c.split()[0] for c in _PATCHES.split(", ")]
        kinds = dict(c.split() for c in _PATCHES.split(", "))
        p.select(*[F.col(c).cast(kinds[c]).alias(c) for c in names]).write.mode("append").parquet(f"{self.path}/reviews")

    def changes(self, comparison_id: str | None = None) -> DataFrame:
        """Reviewed change rows, of one comparison or of all; a comparison made again has its rows once."""
        rows = self._read("changes", CHANGES)
        if comparison_id is not None:
            rows = rows.where(F.col("comparison_id") == comparison_id)
            if _BUCKET in rows.columns:  # only that comparison's files are read
                rows = rows.where(F.col(_BUCKET) == F.pmod(F.xxhash64(F.lit(comparison_id)), F.lit(self.buckets)).cast("int"))
        return review.apply_reviews(rows.drop(_BUCKET).dropDuplicates(["change_id"]), self._read("reviews", _PATCHES), "change_id")

    def load(self, comparison_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The comparison with its documents' names, its summary and its changes."""
        comparisons = review.lookup(self._read("comparisons", _COMPARISONS), "comparison_id", comparison_id)
        one = comparisons.groupBy("comparison_id", "old_document_id", "new_document_id").agg(F.min("created_at").alias("created_at"))
        changes = self.changes(comparison_id)
        return review.read_back(one, self.documents()), summary.summarize(changes, one), changes

    def export(self, comparison_id: str, file_format: str = "json") -> DataFrame:
        """The CSV rows of a comparison in the report's order, or (any other format) its one JSON text."""
        comparison, counts, changes = self.load(comparison_id)
        if file_format == "csv":
            return export.csv_rows(changes.orderBy("change_ord"))
        return export.json_documents(comparison, counts, changes)
