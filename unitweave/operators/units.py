"""Units of samples: lexing, coding, filters, n-grams and counts per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from unitweave.functions.columns import BITS, LEXER, PAD, ngrams, packable, packed_ngrams, unit_class, unpacked_key, value_key
from unitweave.functions.tables import LEXICAL_CODES


def size_filter(samples: DataFrame, limit: int = 10_000_000, size_col: str | None = None) -> DataFrame:
    """Samples of strictly fewer bytes than the limit."""
    return samples.where((F.col(size_col) if size_col else F.octet_length("payload")) < limit)


def lex_units(samples: DataFrame, text_col: str = "payload", with_value: bool = False) -> DataFrame:
    """Add `units`: codes of the lexical units of a text in order; structs of unit and value if wanted."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(LEXER), F.lit(0))
    one = (lambda u: F.struct(unit_class(u).alias("unit"), F.regexp_replace(u, "\n", "").alias("value"))) if with_value else unit_class
    return samples.withColumn("units", F.transform(found, one)).drop(text_col)


def _code_map(codes: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])


def encode_units(units: DataFrame, codes: dict[str, int] = LEXICAL_CODES) -> DataFrame:
    """Unit names to codes; unknown names become null, which `split_usable` finds."""
    return units.withColumn("units", F.transform("units", lambda u: F.element_at(_code_map(codes), u)))


def split_usable(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples with units that are all known, and the rest with the reason. One expression, two filters."""
    reason = F.when(F.col("units").isNull(), "no units").when(F.size("units") == 0, "empty").when(
        F.exists("units", lambda u: u.isNull()), "unknown unit"
    )
    marked = units.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def _counted(keyed: DataFrame, keys: Column) -> DataFrame:
    """sample_id, label, feature, cnt, total from an array of feature keys; total counts repetitions.

    explode_outer, then a filter on what it gives: a filter on the array, which a plain explode brings along, would be
    pushed below the expressions that make the array and evaluate them once more.
    """
    arrays = keyed.select("sample_id", "label", keys.alias("keys"))
    each = arrays.select(
        "sample_id", "label", F.size("keys").cast("long").alias("total"), F.explode_outer("keys").alias("feature")
    ).where("feature is not null")
    return each.groupBy("sample_id", "label", "feature").agg(F.count(F.lit(1)).alias("cnt"), F.first("total").alias("total"))


def count_ngrams(units: DataFrame, n: int = 4) -> DataFrame:
    """Count of each n-gram of a sample, and the number of all its n-grams.

    Samples whose codes are small are counted by packed numbers, so that rows are short; only what was counted is written
    out as text. Other samples, and units that are no integers, are counted by their text keys.
    """
    element = units.schema["units"].dataType.elementType
    if not isinstance(element, (ByteType, ShortType, IntegerType, LongType)) or n < 1 or n * BITS > 63:
        return _counted(units, ngrams(F.col("units"), n))
    fits = packable(F.col("units"), n)
    packed = F.when(fits, packed_ngrams(F.col("units"), n)).otherwise(F.array().cast("array<bigint>"))
    texts = F.when(fits, F.array().cast("array<string>")).otherwise(ngrams(F.col("units"), n))
    both = units.select("sample_id", "label", F.arrays_zip(packed.alias("p"), texts.alias("t")).alias("keys"))
    each = both.select("sample_id", "label", F.size("keys").cast("long").alias("total"), F.explode_outer("keys").alias("key")).where("key is not null")
    counts = each.groupBy("sample_id", "label", F.col("key.p").alias("p"), F.col("key.t").alias("t")).agg(F.count(F.lit(1)).alias("cnt"), F.first("total").alias("total"))
    return counts.select("sample_id", "label", F.coalesce("t", unpacked_key(F.col("p"), n)).alias("feature"), "cnt", "total")


def count_values(value_units: DataFrame) -> DataFrame:
    """Count of each (unit, value) pair of a sample, and the number of all its pairs."""
    return _counted(value_units, F.transform("units", lambda u: value_key(u["unit"], u["value"])))


def count_value_ngrams(value_units: DataFrame, n: int = 4) -> DataFrame:
    """Count of each n-gram of (unit, value) pairs."""
    return _counted(value_units, ngrams(F.transform("units", lambda u: value_key(u["unit"], u["value"])), n))


def sequences(rows: DataFrame, order: list[str], unit: str = "unit", value: str | None = None) -> DataFrame:
    """Rows (sample_id, label, unit, ...) as one array per sample in the given order."""
    fields = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    item = F.struct(*fields, F.col(unit).alias("unit"), *([F.col(value).alias("value")] if value else []))
    pick = (lambda s: F.struct(s["unit"].alias("unit"), s["value"].alias("value"))) if value else (lambda s: s["unit"])
    return rows.groupBy("sample_id", "label").agg(F.transform(F.sort_array(F.collect_list(item)), pick).alias("units"))


def popular_values(value_units: DataFrame, min_df: int = 10, digest_bits: int = 64) -> DataFrame:
    """label, feature, df of the (unit, value) features in strictly more than min_df samples of a label.

    Values can be long and most stand in few samples, so only 64-bit digests are counted over all samples. A feature is in
    no more samples than its digest, so those of rare digests are done with; the others are counted by their text, which
    makes the result exact whatever digests clash. digest_bits: fewer bits make clashes likely, for tests.
    """
    key = lambda u: value_key(u["unit"], u["value"])
    digest = lambda k: F.shiftrightunsigned(F.xxhash64(k), 64 - digest_bits)
    keyed = value_units.select("label", F.array_distinct(F.transform("units", key)).alias("keys"))
    marks = keyed.select("label", F.explode(F.array_distinct(F.transform("keys", digest))).alias("digest"))
    often = marks.groupBy("label", "digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_df).select("label", "digest")
    texts = keyed.select("label", F.explode("keys").alias("feature")).withColumn("digest", digest(F.col("feature")))
    counted = texts.join(often, ["label", "digest"], "left_semi").groupBy("label", "feature").agg(F.count(F.lit(1)).alias("df"))
    return counted.where(F.col("df") > min_df)


def numbered_units(rows: DataFrame, order: list[str], bucket: Column, unit: str = "unit") -> DataFrame:
    """sample_id, label, pos, unit: rows numbered from 0 within their sample, in the given order.

    bucket must not fall with the order. Rows are ranked inside buckets, so a sample's rows are dealt to as many tasks as
    it has buckets, and only the buckets' sizes are summed up along the sample.
    """
    placed = rows.withColumn("_bucket", bucket)
    inside = Window.partitionBy("sample_id", "_bucket").orderBy(*order)
    sizes = placed.groupBy("sample_id", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("sample_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("sample_id", "_bucket", before.alias("_before"))
    ranked = placed.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["sample_id", "_bucket"])
    return ranked.select("sample_id", "label", (F.col("_before") + F.col("_rank")).alias("pos"), F.col(unit).alias("unit"))


def long_ngrams(units: DataFrame, n: int = 4, span: int = 100_000) -> DataFrame:
    """sample_id, label, part, feature: one row per n-gram of units (sample_id, label, pos from 0, unit), without arrays.

    A sample is cut into parts of `span` positions; each part also gets the n - 1 units after its end, so a sample of any
    length is dealt to many tasks and no n-gram is lost or found twice. Samples of fewer than n units give one padded key.
    """
    if n < 1:
        return units.select("sample_id", "label", F.lit(0).cast("long").alias("part"), F.lit(None).cast("string").alias("feature")).limit(0)
    own = F.floor(F.col("pos") / span)
    also = F.when((F.col("pos") % span < n - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    if n - 1 > span:
        raise ValueError("span must be at least n - 1")
    dealt = units.withColumn("part", F.explode(also))
    ahead = Window.partitionBy("sample_id", "part").orderBy("pos")
    following = [F.lead(F.col("unit").cast("string"), k).over(ahead) for k in range(1, n)]
    there = [F.lead(F.lit(True), k).over(ahead) for k in range(1, n)]
    key = F.concat_ws(",", F.coalesce(F.col("unit").cast("string"), F.lit(PAD)), *[F.coalesce(u, F.lit(PAD)) for u in following])
    full = there[-1] if there else F.lit(True)
    grams = dealt.withColumn("feature", F.when(full | (F.col("pos") == 0), key)).where((F.col("part") == own) & F.col("feature").isNotNull())
    return grams.select("sample_id", "label", "part", "feature")


def count_long_ngrams(units: DataFrame, n: int = 4, span: int = 100_000) -> DataFrame:
    """`count_ngrams` of units in rows: sample_id, label, feature, cnt, total. Parts are counted before they meet."""
    counts = long_ngrams(units, n, span).groupBy("sample_id", "label", "feature").agg(F.count(F.lit(1)).alias("cnt"))
    totals = counts.groupBy("sample_id").agg(F.sum("cnt").alias("total"))
    return counts.join(totals, "sample_id").select("sample_id", "label", "feature", "cnt", "total")
