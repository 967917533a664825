"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than blank and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset, a temporary one in local
    mode only: a cluster's machines do not see each other's temporary folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{_own(spark)}/{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/unitweave/{spark.sparkContext.applicationId}"


def clear_shared(spark: SparkSession) -> None:
    """Delete all tables that this application wrote with `write_shared`, when no DataFrame over them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def prefix_sums(lengths: Column, chunk: int = 256) -> Column:
    """Sums of the elements before each element of an array of numbers, as an array of long; in chunks, so that the
    growing arrays are short and long inputs stay cheap."""
    fold = lambda items, value: F.aggregate(
        items, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("found")),
        lambda s, v: F.struct((s["at"] + value(v)).alias("at"), F.concat(s["found"], F.array(s["at"])).alias("found")),
    )
    pieces = lambda x: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / chunk), F.lit(0)).cast("int")),
        lambda c: fold(F.slice(x, c * chunk + 1, F.lit(chunk)), lambda v: v.cast("long")),
    )
    joined = lambda inner: F.flatten(
        F.zip_with(
            inner, fold(inner, lambda v: v["at"])["found"], lambda a, b: F.transform(a["found"], lambda y: y + b)
        )
    )
    bound = F.transform(F.array(lengths), lambda x: F.transform(F.array(pieces(x)), joined)[0])  # lambda variables hold arrays, made once
    return F.when(F.size(lengths) > 0, bound[0]).otherwise(F.array().cast("array<bigint>"))


def slice_of(columns: Sequence[Column], slices: int) -> Column:
    """A number from 0 to slices - 1 that depends on the row's values alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(slices)).cast("int")


def ranked_in_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: int, rank: str
) -> tuple[DataFrame, DataFrame]:
    """Add `rank`, the 0-based rank of each row within `keys`, without bringing the rows of a key together.

    Rows of a key are dealt to hash slices; ranks run through slice 0, then slice 1 and so on, by `order` inside a
    slice. Slice sizes are counted first (with partial aggregation), their prefix sums are the ranks at which the
    slices begin. The keys must not be null. Returns the ranked rows and one row per key with its count `n_rows`.
    """
    sliced = df.withColumn("_uw_slice", slice_of(order, slices))
    by_slice = [*keys, "_uw_slice"]
    counts = sliced.groupBy(*by_slice).agg(F.count(F.lit(1)).alias("_uw_n"))
    before = Window.partitionBy(*keys).orderBy("_uw_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_uw_start", F.coalesce(F.sum("_uw_n").over(before), F.lit(0))).drop("_uw_n")
    inside = Window.partitionBy(*by_slice).orderBy(*order)
    ranked = sliced.withColumn("_uw_row", F.row_number().over(inside) - 1).join(starts, by_slice)
    totals = counts.groupBy(*keys).agg(F.sum("_uw_n").alias("n_rows"))
    return ranked.withColumn(
        rank, (F.col("_uw_start") + F.col("_uw_row")).cast("long")
    ).drop("_uw_slice", "_uw_start", "_uw_row"), totals
