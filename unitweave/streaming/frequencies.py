"""Document frequencies kept up as samples arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from unitweave.functions.columns import ngrams


def streamed_document_frequency(units: DataFrame, n: int = 4) -> DataFrame:
    """Running document frequencies over a stream of samples (label, units): each sample counts a feature once."""
    each = units.select(
        "label", F.explode_outer(F.array_distinct(ngrams(F.col("units"), n))).alias("feature")
    ).where("feature is not null")
    return each.groupBy("label", "feature").agg(F.count(F.lit(1)).alias("df"))


def start_frequencies(units: DataFrame, path: str, checkpoint: str, n: int = 4) -> StreamingQuery:
    """Keep the frequencies as a table at path, from all that is there now, and then end.

    Each batch writes the features whose frequency it raised to a folder of its own, so a batch that is run again
    replaces what it wrote, and nothing passes the driver.
    """

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return streamed_document_frequency(units, n).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """label, feature, df after the last batch: frequencies only rise, so the highest of each feature."""
    return spark.read.parquet(path).groupBy("label", "feature").agg(F.max("df").alias("df"))
