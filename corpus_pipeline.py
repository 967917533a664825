"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing and packing, each over all that the last one kept.

Every stage takes and returns the columns of documents (but for the last), whatever other columns and names there are.
An empty table gives an empty table of the same columns. Texts are handled whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from unitweave.llm.common import documents, write_shared
from unitweave.llm.mixing import emit_copies, mix_sources
from unitweave.llm.near_dup import drop_near_duplicates
from unitweave.llm.packing import pack_documents
from unitweave.llm.queries import TOXIC_FROM, training_labels
from unitweave.llm.secrets import redact_secrets
from unitweave.llm.toxicity import learn_lexicon, reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold. The lexicon is learned as in the query.

    Null and empty texts have no hits and stay; null ids and repeated rows are judged like others.
    """
    return reject_toxic(docs, learn_lexicon(docs, training_labels(spark, sf_dir)), TOXIC_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of least id.

    Null, empty and blank texts are no duplicates of each other. Without id, one document of each text stays, if no
    document with id has the same words. Of repeated rows one stays.
    """
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; null texts stay null, and repeated rows stay."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null and empty texts have size 0; a null source is a source of its own."""
    return emit_copies(mix_sources(docs, carry=docs.columns), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences. Null text: the end token alone. Columns as in op 9."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("packing", packing),
]

#: The stages tokenise, align and learn, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
