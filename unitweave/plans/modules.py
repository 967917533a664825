"""The chain from units to a classifier, for one module or many."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, _parse_datatype_string

from unitweave.functions.columns import LEXER
from unitweave.functions.walks import read_tree, tree_modules
from unitweave.operators.selection import candidate_features, contingency, document_frequency, feature_vectors, select_features, to_ml_vectors
from unitweave.operators.trees import handed_on, in_lists, listed
from unitweave.operators.units import count_ngrams, count_values
from unitweave.operators.evaluation import predict_with_threshold, vote_modules
from unitweave.plans.model import probabilities, train_forest
from unitweave.sources.files import shared_folder, store


def sample_features(units: DataFrame, features: str, n: int = 4) -> DataFrame:
    """Feature counts of samples; features: ngrams (of units) or value (of unit and value structs)."""
    return count_ngrams(units, n) if features == "ngrams" else count_values(units)


def learn_vocabulary(train: DataFrame, validation: DataFrame, min_df: int = 10, confidence: float = 99) -> DataFrame:
    """Vocabulary from feature counts: candidates from training samples, tested on validation samples."""
    candidates = candidate_features(document_frequency(train), min_df)
    return select_features(contingency(candidates, validation, validation.select("sample_id", "label").distinct()), confidence)


def train_module(
    train: DataFrame,
    validation: DataFrame,
    features: str = "ngrams",
    n: int = 4,
    min_df: int = 10,
    confidence: float = 99,
    trees: int = 500,
) -> tuple[RandomForestClassificationModel, DataFrame]:
    """Model and vocabulary of one module from unit arrays of training and validation samples, counted once each."""
    return train_on_counts(
        store(sample_features(train, features, n), "train"),
        store(sample_features(validation, features, n), "validation"),
        min_df,
        confidence,
        trees,
    )


def train_on_counts(
    train: DataFrame, validation: DataFrame, min_df: int = 10, confidence: float = 99, trees: int = 500
) -> tuple[RandomForestClassificationModel, DataFrame]:
    """Model and vocabulary of one module from feature counts. The vocabulary and the vectors are written once."""
    vocabulary = store(learn_vocabulary(train, validation, min_df, confidence), "vocabulary")
    return train_forest(store(to_ml_vectors(feature_vectors(train, vocabulary), vocabulary.count()), "vectors"), trees), vocabulary


def classify_module(
    samples: DataFrame,
    model: RandomForestClassificationModel,
    vocabulary: DataFrame,
    features: str = "ngrams",
    n: int = 4,
    threshold: float = 0.5,
) -> DataFrame:
    """sample_id, label, p_malicious, predicted for unit arrays of samples, with a stored model and vocabulary."""
    vectors = feature_vectors(sample_features(samples, features, n), vocabulary)
    return predict_with_threshold(probabilities(to_ml_vectors(vectors, model.numFeatures - 1), model), threshold)


#: Keys of a table that holds several modules.
MODULE = ("level", "features")
#: Forests fitted at a time.
FITS = 3


def run_modules(samples: dict[tuple[str, str], DataFrame], n: int = 4) -> DataFrame:
    """Feature counts of many modules in one table keyed by level and features, so that counting and selection run once.

    samples: (level, features) -> unit arrays (ngrams) or unit and value structs (value).
    """
    return reduce(DataFrame.unionByName, [sample_features(units, f, n).select(F.lit(level).alias("level"), F.lit(f).alias("features"), "*") for (level, f), units in samples.items()])


def run_tree_modules(programs: DataFrame, n: int = 4) -> DataFrame:
    """Feature counts of all ten modules of programs (sample_id, label, tree in JSON): one row for each program and module,
    with its features, their counts and the total. `counts_in_rows` makes rows of `run_modules` of it.

    A program is lexed, read, linked and walked once, in one task; its units are counted there and never in rows.
    """
    lexed = programs.select(F.col("sample_id").cast("long"), "label", "tree", F.regexp_extract_all("tree", F.lit(LEXER), F.lit(0)).alias("lexed"))
    schema = "sample_id long, label string, level string, features string, feature array<string>, cnt array<long>, total long"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, int] = {}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for *key, text, units in zip(batch.column(0).to_pylist(), *map(listed, batch.columns[1:3]), in_lists(batch.column(3)), strict=True):
                    for row in tree_modules(read_tree(text), units, n, classes):
                        yield *key, *row

        return handed_on(rows(), arrow)

    return lexed.mapInArrow(counted, schema)


def counts_in_rows(counts: DataFrame) -> DataFrame:
    """level, features, sample_id, label, feature, cnt, total from the rows of `run_tree_modules`."""
    each = counts.select(*MODULE, "sample_id", "label", F.explode(F.arrays_zip("feature", "cnt")).alias("x"), "total")
    return each.select(*MODULE, "sample_id", "label", "x.feature", "x.cnt", "total")


def _rows(counts: DataFrame) -> DataFrame:
    """Feature counts in rows, be they given so or by sample and module."""
    return counts_in_rows(counts) if isinstance(counts.schema["feature"].dataType, ArrayType) else counts


def _samples(counts: DataFrame) -> DataFrame:
    """Samples of each module that have features."""
    return counts.select(*MODULE, "sample_id", "label").distinct()


def learn_vocabularies(train: DataFrame, validation: DataFrame, min_df: int = 10, confidence: float = 99) -> DataFrame:
    """level, features, feature, pos: the vocabularies of all modules at once, from their feature counts, given by
    `run_modules` or, here and below, by `run_tree_modules`.

    One count of frequencies, one contingency table, one ranking, whatever the number of modules.
    """
    candidates = candidate_features(document_frequency(_rows(train), MODULE), min_df, MODULE)
    return select_features(contingency(candidates, _rows(validation), _samples(validation), MODULE), confidence, MODULE)


def fit_modules(vectors: DataFrame, vocabularies: DataFrame, trees: int = 500) -> dict[tuple[str, str], RandomForestClassificationModel]:
    """One forest for each module, fitted on its part of the stored keyed vectors. Modules without vocabulary have none.

    A fit is a chain of short jobs, so several go at a time; they share nothing, and each has the same seed as alone.
    """
    base = f"{shared_folder(vectors.sparkSession)}/module_vectors"
    vectors.write.partitionBy(*MODULE).parquet(base)
    stored = vectors.sparkSession.read.parquet(base)
    sizes = {(r["level"], r["features"]): r["size"] for r in vocabularies.groupBy(*MODULE).agg(F.count(F.lit(1)).alias("size")).collect()}
    of = lambda level, features: stored.where((F.col("level") == level) & (F.col("features") == features)).drop(*MODULE)
    fit = inheritable_thread_target(vectors.sparkSession)(lambda key: train_forest(store(to_ml_vectors(of(*key), sizes[key]), "fit"), trees))
    with ThreadPool(FITS) as pool:
        return dict(zip(sorted(sizes), pool.map(fit, sorted(sizes), 1), strict=True))


def classify_modules(
    sample_features: DataFrame,
    models: dict[tuple[str, str], RandomForestClassificationModel],
    vocabularies: DataFrame,
    threshold: float = 0.5,
) -> DataFrame:
    """level, features, module (both in one), sample_id, label, p_malicious, predicted of each sample by each module."""
    vectors = store(feature_vectors(_rows(sample_features), vocabularies, MODULE, _samples(sample_features)), "module_vectors")
    judged = []
    for (level, features), model in models.items():
        own = vectors.where((F.col("level") == level) & (F.col("features") == features)).drop(*MODULE)
        found = predict_with_threshold(probabilities(to_ml_vectors(own, model.numFeatures - 1), model), threshold)
        judged.append(found.select(F.lit(level).alias("level"), F.lit(features).alias("features"), F.lit(f"{level} {features}").alias("module"), "*"))
    return reduce(DataFrame.unionByName, judged)


def modular_verdicts(
    train: DataFrame,
    validation: DataFrame,
    samples: DataFrame,
    first_layer: list[str],
    second_layer: list[str],
    min_df: int = 10,
    confidence: float = 99,
    trees: int = 500,
) -> tuple[DataFrame, DataFrame]:
    """All modules from feature counts to a vote: predictions of each module for `samples`, and the layered vote on them.

    The tables of counts are keyed by level and features. A module is named "level features" in the layers.
    """
    vocabularies = store(learn_vocabularies(train, validation, min_df, confidence), "vocabularies")
    models = fit_modules(feature_vectors(_rows(train), vocabularies, MODULE, _samples(train)), vocabularies, trees)
    judged = store(classify_modules(samples, models, vocabularies), "judged")
    return judged, vote_modules(judged, first_layer, second_layer)
