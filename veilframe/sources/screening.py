"""Admission of input files by extension and size, from the listing alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted workbook extensions and the size cap in bytes.
EXTENSIONS = (".xlsx", ".xls", ".ods")
MAX_BYTES = 5 * 1024 * 1024

BAD_EXTENSION = "unsupported file type"
TOO_LARGE = "file too large"


def list_inputs(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modificationTime`` of the files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime")


def screen(listing: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``accepted`` and ``reason``. The extension is the last dot's suffix, any letter case."""
    extension = F.lower(F.regexp_extract("path", r"[^/.](\.[^./]*)\z", 1))
    reason = F.when(~extension.isin(*extensions), BAD_EXTENSION).when(F.col("length") > max_bytes, TOO_LARGE)
    return listing.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
