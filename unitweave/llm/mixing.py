"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitweave.llm.common import WORD, slice_of, write_shared

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more than this many times.
MAX_EPOCHS = 3
#: Size classes per doubling of the size. Documents of a class differ in size by a tenth at most.
CLASSES_PER_OCTAVE = 8
#: Hash slices of each (source, size class); a hot source is dealt to all of them.
SLICES = 64
#: Random offsets that are drawn for each source; the one whose words come nearest to the target is used.
OFFSETS = 64


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """Words to take from each source: `share` of all words dealt by weight, none above `epochs` times its source.

    What a source can't give is dealt again by weight among the others until none is above. The end of these rounds
    has a closed form: target = least(epochs * size, level * weight), where level is the largest over k of
    (total - limits of the k tightest sources) / (weights of the rest).
    """
    sources = sized.groupBy("_uw_source").agg(F.sum("_uw_size").alias("source_size"))
    k = (F.row_number().over(Window.orderBy(F.col("_uw_source"))) - 1) % len(weights)
    sources = sources.withColumn("_uw_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int")))
    sources = sources.withColumn("_uw_limit", F.col("source_size") * F.lit(float(epochs)))
    tight = Window.orderBy(F.col("_uw_limit") / F.col("_uw_weight"), "_uw_source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limits, used = F.coalesce(F.sum("_uw_limit").over(tight), F.lit(0.0)), F.coalesce(F.sum("_uw_weight").over(tight), F.lit(0.0))
    total, weight = F.sum("source_size").over(every) * F.lit(float(share)), F.sum("_uw_weight").over(every)
    sources = sources.withColumn("_uw_level", (total - limits) / (weight - used))
    target = F.least("_uw_limit", F.max("_uw_level").over(every) * F.col("_uw_weight"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(epochs)))).otherwise(0.0)
    return sources.withColumn("target", target).withColumn("_uw_rate", rate).select("_uw_source", "source_size", "target", "_uw_rate")


def mix_sources(
    docs: DataFrame,
    carry: Sequence[str] = (),
    seed: int = 17,
    weights: Sequence[int] = WEIGHTS,
    epochs: int = MAX_EPOCHS,
    slices: int = SLICES,
) -> DataFrame:
    """How often each document is taken so that sources reach their target weights.

    Systematic sampling: within a source every document is expected `target / source size` times; documents are laid
    out by size class (so that each stretch of the line is a fair share of large and small ones), their expected
    copies are summed up from the left, one random offset is added, and a document is emitted once per whole number
    that its stretch crosses. Of OFFSETS random offsets each source uses the one whose words come nearest to its
    target, so a document's chance is only nearly its expected copies. The prefix sums come from counts per (source,
    size class, hash slice), so no source is gathered, and they depend on values only: reruns agree. Documents are
    ranked once and stored with their places; windows without partition hold one row per source. Very long texts are
    counted whole.

    Needs doc_id, text and source; returns doc_id, size, source_size, target, copies, taken and the `carry` columns.
    Null text: size 0. Null source: a source of its own, last in order. Repeated rows count each. Documents without
    words may be copied but add nothing. Ties of size and doc_id follow the carried columns. Empty table: no rows.
    Other columns are ignored unless carried, so their names can't clash.
    """
    extra = [c for c in carry if c != "doc_id"]
    carried = [f"_uw_carried_{i}" for i in range(len(extra))]
    sized = docs.select(
        "doc_id",
        *[F.col(c).alias(name) for c, name in zip(extra, carried, strict=True)],
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col("source"))).alias("_uw_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_uw_size"),
    )
    # never null, or the joins below would filter by it, counting the words again
    sized = sized.withColumn("_uw_class", F.coalesce(F.floor(F.log2(F.col("_uw_size") + 1) * CLASSES_PER_OCTAVE).cast("int"), F.lit(0)))
    sized = sized.withColumn("_uw_content", F.xxhash64(*map(F.col, carried)) if carried else F.lit(0).cast("long"))
    order = [F.col("_uw_size"), F.xxhash64(F.col("doc_id"), F.lit(seed)), F.col("doc_id"), F.col("_uw_content")]
    keys = ["_uw_source", "_uw_class", "_uw_slice"]
    sized = sized.withColumn("_uw_slice", slice_of(order, slices))
    if not extra:  # narrow rows are stored, so that words are counted once; texts that are carried are not written twice
        sized = write_shared(sized, "sized")

    counts = write_shared(sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("_uw_n"), F.sum("_uw_size").alias("_uw_size")), "counts")
    before = Window.partitionBy("_uw_source").orderBy("_uw_class", "_uw_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_uw_start", F.coalesce(F.sum("_uw_n").over(before), F.lit(0))).drop("_uw_n", "_uw_size")
    starts = starts.join(write_shared(source_targets(counts, weights, epochs), "targets"), "_uw_source")
    inside = Window.partitionBy(*keys).orderBy(*order)
    placed = sized.withColumn("_uw_row", F.row_number().over(inside) - 1).join(starts, keys)
    placed = write_shared(placed.withColumn("_uw_at", F.col("_uw_start") + F.col("_uw_row")).drop("_uw_class", "_uw_slice", "_uw_content", "_uw_start", "_uw_row"), "placed")

    drawn = F.array(*[  # one in each 64th
        (
            k + F.pmod(F.xxhash64(F.lit(seed), F.lit(k)), F.lit(1021)) / F.lit(1021.0)
        ) / F.lit(float(OFFSETS)) for k in range(OFFSETS)
    ])
    begin, end = F.col("_uw_at") * F.col("_uw_rate"), (F.col("_uw_at") + 1) * F.col("_uw_rate")
    mixed = placed.join(write_shared(_nearest_offsets(placed, begin, end, drawn), "offsets"), "_uw_source")
    copies = F.floor(end + F.col("_uw_offset")) - F.floor(begin + F.col("_uw_offset"))
    mixed = mixed.withColumn("copies", F.least(copies, F.lit(epochs)).cast("long"))
    return mixed.select(
        "doc_id", F.col("_uw_size").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), "copies",
        (F.col("copies") * F.col("_uw_size")).alias("taken"), *[F.col(name).alias(c) for c, name in zip(extra, carried, strict=True)],
    )


def _nearest_offsets(placed: DataFrame, begin: Column, end: Column, drawn: Column) -> DataFrame:
    """_uw_source, _uw_offset: of the drawn offsets (rising, one in each OFFSETS-th) the one whose words come nearest to
    the target; the least of equals.

    An offset only decides whether an end of a document's stretch passes the next whole number. So the words of all
    offsets follow from sums per source and pair of first offsets that push the two ends over: the words taken are a
    step function of the offset, summed up over its at most OFFSETS + 1 steps.
    """

    def first_over(x: Column) -> Column:
        needed = F.lit(1.0) - (x - F.floor(x))
        k = F.floor(needed * OFFSETS).cast("int")
        return F.when(k >= OFFSETS, OFFSETS).when(F.get(drawn, k) >= needed, k).otherwise(k + 1)

    sums = placed.groupBy("_uw_source", first_over(begin).alias("_uw_begin"), first_over(end).alias("_uw_end")).agg(
        F.max("target").alias("target"),
        F.sum((F.floor(end) - F.floor(begin)) * F.col("_uw_size")).alias("_uw_always"),
        F.sum("_uw_size").alias("_uw_words"),
    )
    step = lambda k, words: F.struct(k.cast("int").alias("k"), words.cast("long").alias("words"))
    steps = sums.select(
        "_uw_source",
        "target",
        F.inline(F.array(step(F.lit(0), F.col("_uw_always")), step(F.col("_uw_end"), F.col("_uw_words")), step(F.col("_uw_begin"), -F.col("_uw_words")))),
    ).where(F.col("k") < OFFSETS).groupBy("_uw_source", "k").agg(F.max("target").alias("target"), F.sum("words").alias("words"))
    upto = Window.partitionBy("_uw_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    off = F.abs(F.sum("words").over(upto) - F.col("target"))
    best = steps.select("_uw_source", "k", off.alias("off")).groupBy("_uw_source").agg(F.min(F.struct("off", "k"))["k"].alias("k"))
    return best.select("_uw_source", F.get(drawn, F.col("k")).alias("_uw_offset"))


def emit_copies(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per taken copy, with the given columns; mixed: as `mix_sources` gives it with carry=columns.

    Nulls and repeated rows stay as `mix_sources` has them; carried columns are told by their places, so they may have
    any names. Documents of no copies and empty tables give no rows.
    """
    extra = [c for c in columns if c != "doc_id"]
    own = ["doc_id", "_uw_size", "_uw_source_size", "_uw_target", "_uw_copies", "_uw_taken"]
    named = mixed.toDF(*own, *[f"_uw_carried_{i}" for i in range(len(extra))]).where("_uw_copies > 0")
    each = named.withColumn("_uw_copy", F.explode(F.sequence(F.lit(1), F.col("_uw_copies").cast("int"))))
    return each.select(*["doc_id" if c == "doc_id" else F.col(f"_uw_carried_{extra.index(c)}").alias(c) for c in columns])
