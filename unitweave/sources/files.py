"""Reading labelled files; writing and reading what a module stores."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _texts(spark: SparkSession, paths: Sequence[str], label: str | None, recursive: bool) -> DataFrame:
    read = spark.read.option("recursiveFileLookup", recursive).text(list(paths), wholetext=True)
    return read.select(
        F.col("_metadata.file_path").alias("sample_id"),
        F.coalesce(F.lit(label), F.lit("?")).alias("label"),
        F.col("value").alias("payload"),
        F.col("_metadata.file_size").alias("size_bytes"),
    )


def read_labelled_dirs(
    spark: SparkSession,
    dirs: Sequence[str],
    labels: Sequence[str] | None = None,
    files: Sequence[str] | None = None,
    file_labels: Sequence[str] | None = None,
    recursive: bool = False,
) -> DataFrame:
    """Samples from the files of directories (a label for each) and from single files (a label for each); '?' without.

    The key is the full path. Directories and files of one label are read together.
    """
    by_label: dict[str, list[str]] = {}
    for paths, given in ((dirs, labels), (files or [], file_labels)):
        for path, label in zip(paths, given or ["?"] * len(paths), strict=True):
            by_label.setdefault(label, []).append(path)
    if not by_label:
        return spark.createDataFrame([], "sample_id string, label string, payload string, size_bytes long")
    return reduce(DataFrame.unionByName, [_texts(spark, paths, label, recursive) for label, paths in by_label.items()])


def read_file_list(spark: SparkSession, list_path: str, label: str, base: str | None = None) -> DataFrame:
    """Samples from a text file with one path a line, all of one label.

    With base, a folder above all files of the list, the list may be of any length: files below base are joined with
    it. Without, the driver reads the list.
    """
    if base:
        plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  local files have several spellings
        listed = spark.read.text(list_path).where(F.length("value") > 0).select(plain("value").alias("_listed"))
        return _texts(spark, [base], label, True).join(listed, plain("sample_id") == F.col("_listed"), "left_semi")
    paths = [r["value"] for r in spark.read.text(list_path).where(F.length("value") > 0).collect()]
    return read_labelled_dirs(spark, [], files=paths, file_labels=[label] * len(paths))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one where that is unset, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/unitweave/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again, so that it is computed once."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_artifact(df: DataFrame, base: str, level: str, features: str, kind: str) -> str:
    """Store a table of one module (document frequencies, contingency, vocabulary or vectors); returns its path."""
    path = f"{base}/{kind}/level={level}/features={features}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_artifact(spark: SparkSession, base: str, level: str, features: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{kind}/level={level}/features={features}")
