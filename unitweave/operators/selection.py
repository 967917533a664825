"""Document frequencies, contingency, chi-square selection and feature vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitweave.functions.columns import chi2_critical, chi2_statistic

#: Characters of a feature that part the vocabulary for ranking.
PREFIX = 6


def document_frequency(sample_features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Samples of each label that have the feature. Rows are distinct per sample already, so this is a plain count.

    Here and below, `by` are the keys of several tables in one, such as level and features of modules.
    """
    return sample_features.groupBy(*by, "label", "feature").agg(F.count(F.lit(1)).alias("df"))


def merge_document_frequency(old: DataFrame, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stored plus new counts; the same data twice counts twice."""
    return old.unionByName(new).groupBy(*by, "label", "feature").agg(F.sum("df").alias("df"))


def popular_features(doc_freq: DataFrame, min_df: int = 10) -> DataFrame:
    """Features in strictly more than min_df samples of a label."""
    return doc_freq.where(F.col("df") > min_df)


def candidate_features(doc_freq: DataFrame, min_df: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Features popular in either class."""
    return popular_features(doc_freq, min_df).where(F.col("label").isin("benign", "malicious")).select(*by, "feature").distinct()


def most_used_features(doc_freq: DataFrame, k: int) -> DataFrame:
    return doc_freq.orderBy(F.desc("df"), "feature", "label").limit(k)


def least_used_features(doc_freq: DataFrame, k: int) -> DataFrame:
    return doc_freq.orderBy("df", "feature", "label").limit(k)


def contingency(candidates: DataFrame, sample_features: DataFrame, samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per candidate: usable samples of each class with and without it. samples: one row per usable sample.

    Presence is counted; absence is the class total minus presence, so rows are presences only. Samples of other
    labels are left out. The totals are one row, or one for each combination of `by`.
    """
    of = lambda label: F.sum(F.when(F.col("label") == label, 1).otherwise(0)).cast("long")
    totals = samples.groupBy(*by).agg(F.coalesce(of("benign"), F.lit(0)).alias("ben"), F.coalesce(of("malicious"), F.lit(0)).alias("mal"))
    present = sample_features.where(F.col("label").isin("benign", "malicious")).groupBy(*by, "feature").agg(
        of("benign").alias("b"), of("malicious").alias("m")
    )
    joined = candidates.join(present, [*by, "feature"], "left")
    joined = joined.join(totals, list(by), "left") if by else joined.crossJoin(F.broadcast(totals))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    ben, mal, all_ben, all_mal = map(zero, ("b", "m", "ben", "mal"))
    return joined.select(
        *by,
        "feature",
        ben.alias("ben_with"),
        (all_ben - ben).alias("ben_wo"),
        mal.alias("mal_with"),
        (all_mal - mal).alias("mal_wo"),
    )


def scored_features(table: DataFrame) -> DataFrame:
    return table.withColumn("chi2", chi2_statistic(*map(F.col, ("ben_with", "ben_wo", "mal_with", "mal_wo"))))


def select_features(table: DataFrame, confidence: float = 99, by: Sequence[str] = ()) -> DataFrame:
    """The vocabulary: features whose chi-square reaches the critical value, with positions 0.. by feature (within `by`).

    Features are ranked inside their beginning (its first PREFIX characters); only the number of features of each
    beginning is summed up in one task.
    """
    kept = scored_features(table).where(F.col("chi2") >= chi2_critical(confidence)).select(
        *by, "feature", F.substring("feature", 1, PREFIX).alias("_begin")
    )
    counts = kept.groupBy(*by, "_begin").agg(F.count(F.lit(1)).alias("_n"))
    through = Window.partitionBy(*by).orderBy("_begin") if by else Window.orderBy("_begin")
    before = F.coalesce(F.sum("_n").over(through.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_begin").orderBy("feature")) - 1)
    return ranked.join(counts.select(*by, "_begin", before.alias("_before")), [*by, "_begin"]).select(
        *by, "feature", (F.col("_before") + F.col("_rank")).cast("int").alias("pos")
    )


def lookup_features(sample_features: DataFrame, vocabulary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positions of known features; others vanish. Spark broadcasts the vocabulary if its size allows."""
    return sample_features.join(vocabulary, [*by, "feature"])


def lookup_positions(vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Features of positions."""
    return vectors.join(vocabulary, "pos")


def feature_vectors(sample_features: DataFrame, vocabulary: DataFrame, by: Sequence[str] = (), samples: DataFrame | None = None) -> DataFrame:
    """sample_id, label, pos, weight: count over all of a sample's features; weight 1 past the end if none is known.

    samples: those of sample_features, once each, if the caller knows them without their features.
    """
    known = lookup_features(sample_features, vocabulary, by).select(
        *by, "sample_id", "label", "pos", (F.col("cnt") / F.col("total")).alias("weight")
    )
    size = vocabulary.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("pos"))
    samples = sample_features.select(*by, "sample_id", "label").distinct() if samples is None else samples
    without = samples.join(
        known.select(*by, "sample_id").distinct(), [*by, "sample_id"], "left_anti"
    )
    placed = without.join(size, list(by), "left") if by else without.crossJoin(F.broadcast(size))
    ends = placed.select(*by, "sample_id", "label", F.coalesce("pos", F.lit(0)).alias("pos"), F.lit(1.0).alias("weight"))
    return known.unionByName(ends)


def to_ml_vectors(vectors: DataFrame, size: int) -> DataFrame:
    """One sparse ML vector of size + 1 per sample. The vectors' fields are laid out as Arrow columns, batch by batch."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    grouped = vectors.groupBy("sample_id", "label").agg(F.sort_array(F.collect_list(F.struct("pos", "weight"))).alias("items"))
    grouped = grouped.select(
        "sample_id",
        "label",
        F.transform("items", lambda x: x["pos"]).alias("indices"),
        F.transform("items", lambda x: x["weight"]).alias("values"),
    )

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            fields = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size + 1, np.int32)), batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.StructArray.from_arrays(fields, ["type", "size", "indices", "values"]),
                ],
                ["sample_id", "label", "features"],
            )

    return grouped.mapInArrow(lay_out, StructType([*grouped.schema.fields[:2], StructField("features", VectorUDT())]))
