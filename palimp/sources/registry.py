"""Readers by file type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimp.sources.docx import read_docx
from palimp.sources.pdf import read_pdf
from palimp.sources.txt import read_txt

READERS = {"txt": read_txt, "docx": read_docx, "pdf": read_pdf}


def register(file_type: str, reader) -> None:
    """Adds a reader (spark, *paths) -> paragraph rows, such as one for page layouts by another parser."""
    READERS[file_type] = reader


def read(spark: SparkSession, file_type: str, *paths: str) -> DataFrame:
    """Paragraph rows of files of one type; unknown types are an error."""
    if file_type not in READERS:
        raise ValueError(f"unsupported file type: {file_type}")
    return READERS[file_type](spark, *paths)
