"""Quality rules whose thresholds follow each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitweave.llm.common import write_shared

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Width of a sketch bucket: neighbouring buckets differ by this factor, so a quantile is known to about 2.5 %.
GAMMA = 1.05
#: Values below this fall into the sketch's zero bucket, whose number is ZERO.
TINY, ZERO = 1e-4, -(2**30)
#: metric -> share of a group's documents that its limit leaves below it, as far as the tail decides.
LEVELS = {"symbol_share": 0.95, "dup_line_share": 0.99, "repeat_share": 0.99, "word_length": 0.95}
#: Quartile distances above the median within which a value is never refused.
FENCE = 3.0
#: A group's limit counts as its number of documents, its parent's (the language's, then the whole's) as this many.
PRIOR = 200.0
#: Groups up to this number are broadcast to the documents; more are joined by key with this many salts.
BROADCAST_GROUPS, SALTS = 50_000, 32


def text_counts(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to documents (null text: none of each).

    Repeated windows of three words are found inside the row: window hashes are sorted together with their positions,
    equal neighbours give the repeated positions, and the gaps between these the number of covered words.
    """
    text = F.coalesce("text", F.lit(""))
    counted = docs.withColumn("_uw_words", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    counted = counted.withColumn("n_words", F.size("_uw_words").cast("long"))
    counted = counted.withColumn("_uw_hashes", F.transform("_uw_words", lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(F.get("_uw_hashes", i), F.get("_uw_hashes", i + 1), F.get("_uw_hashes", i + 2))
    counted = counted.withColumn(
        "_uw_windows",
        F.when(
            F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_uw_hashes") - 3), window)
        ).otherwise(F.array().cast("array<bigint>")),
    )
    some = F.size(F.array_distinct("_uw_windows")) < F.size("_uw_windows")
    placed = F.sort_array(F.transform("_uw_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    counted = counted.withColumn("_uw_placed", F.when(some, placed))
    equal = lambda x, j: F.coalesce(F.get("_uw_placed", j)["h"] == x["h"], F.lit(False))
    again = F.filter(
        "_uw_placed",
        lambda x, i: equal(x, i + 1) | F.when(i > 0, equal(x, F.greatest(i - 1, F.lit(0)))).otherwise(False),
    )
    counted = counted.withColumn("_uw_at", F.sort_array(F.transform(again, lambda x: x["i"])))
    gaps = F.zip_with(
        "_uw_at",
        F.slice("_uw_at", 2, F.greatest(F.size("_uw_at"), F.lit(1))),
        lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)),
    )
    covered = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = counted.withColumn("_uw_lines", lines)
    return counted.select(
        *docs.columns, "n_words",
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_uw_lines") - F.size(F.array_distinct("_uw_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"), F.size("_uw_lines").cast("long").alias("n_lines"),
    )


def metric_values() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
    }


def quantile_sketches(counted: DataFrame) -> DataFrame:
    """Mergeable sketches as rows (lang, source, metric, bucket, n): counts in buckets whose bounds grow by GAMMA.

    Sketches of several groups merge by adding the counts of equal buckets; the order never matters.
    """
    long = counted.select(
        F.col("_uw_lang"),
        F.col("_uw_source"),
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metric_values().items()])
        ).alias("m"),
    )
    bucket = F.when(F.col("m.value") <= TINY, F.lit(ZERO)).otherwise(F.ceil(F.log(F.col("m.value")) / F.log(F.lit(GAMMA)))).cast("int")
    return long.groupBy(
        "_uw_lang", "_uw_source", F.col("m.metric").alias("metric"), bucket.alias("bucket")
    ).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def limits(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and metric: its documents n, and limit, read from the sketch alone.

    The limit is the quantile of the metric's level, or FENCE quartile distances above the median if that is more: the
    first lies in the tail that junk makes, the second spares the ordinary tail of a group without junk.
    """
    upto = Window.partitionBy(*keys, "metric").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys, "metric")
    ranked = sketches.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(every))
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA))
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("metric")]
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.struct("bucket", value.alias("v"))))["v"]
    quantiles = ranked.withColumn("level", level).groupBy(*keys, "metric").agg(
        F.max("all").alias("n"),
        at(F.lit(0.25)).alias("q25"),
        at(F.lit(0.5)).alias("q50"),
        at(F.lit(0.75)).alias("q75"),
        at(F.col("level")).alias("top"),
    )
    return quantiles.select(
        *keys, "metric", "n", F.greatest("top", F.col("q50") + FENCE * (F.col("q75") - F.col("q25"))).alias("limit")
    )


def group_limits(sketches: DataFrame) -> DataFrame:
    """One row per language and source with a limit for each metric.

    Limits are weighed with those of the merged sketches above them, by documents: a language leans on the whole, a
    language and source on its language. Small groups follow their parent, large ones themselves; nothing switches.
    """
    shrunk = lambda n, own, parent: (F.col(n) * F.col(own) + PRIOR * F.col(parent)) / (F.col(n) + PRIOR)
    fine = limits(sketches, ["_uw_lang", "_uw_source"])
    overall = limits(merge_sketches(sketches, []), []).select("metric", F.col("limit").alias("all_limit"))
    by_lang = limits(merge_sketches(sketches, ["_uw_lang"]), ["_uw_lang"]).join(F.broadcast(overall), "metric")  # a row per metric
    by_lang = by_lang.select("_uw_lang", "metric", shrunk("n", "limit", "all_limit").alias("lang_limit"))
    joined = fine.join(by_lang, ["_uw_lang", "metric"]).withColumn("limit", shrunk("n", "limit", "lang_limit"))
    return joined.groupBy("_uw_lang", "_uw_source").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("limit"))).alias(f"_uw_limit_{m}") for m in LEVELS]
    )


def with_limits(counted: DataFrame, found: DataFrame) -> DataFrame:
    """Each document with its group's limits. The groups are counted: few are broadcast, many are joined with salted
    keys, so that a source with a third of all documents is dealt to many tasks."""
    keys = ["_uw_lang", "_uw_source"]
    if found.count() <= BROADCAST_GROUPS:
        return counted.join(F.broadcast(found), keys, "left")
    salted = found.withColumn("_uw_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return counted.withColumn(
        "_uw_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    ).join(salted, [*keys, "_uw_salt"], "left")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Counts, base_failed and kept for each document.

    Fixed base rules refuse documents of under 50 words or mostly of repeated three-word windows. All documents that
    pass them feed the sketches of their language and source; a document is kept unless one of its metrics lies above
    its group's limit. Needs doc_id, text, lang, source; other columns are ignored.
    Null text: no words, so refused. Null lang or source: a group of its own. Empty table: no rows. Repeated rows
    count and return each. Very long texts are counted whole, inside their row.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("a"), F.col(c)), F.lit("n"))
    base = docs.select("doc_id", "text", key("lang").alias("_uw_lang"), key("source").alias("_uw_source"))
    counted = write_shared(text_counts(base).drop("text"), "counts")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed)
    sketches = write_shared(quantile_sketches(counted.where("not base_failed")), "sketches")
    judged = with_limits(counted, write_shared(group_limits(sketches), "limits"))
    fine = F.lit(True)
    for name, value in metric_values().items():
        fine = fine & F.coalesce(value <= F.col(f"_uw_limit_{name}"), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & fine).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
