"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitweave.llm.common import write_shared

#: Bits of a code.
BITS = 64


def binary_codes(vectors: DataFrame, bits: int = BITS) -> DataFrame:
    """vec_id and code: bit i tells whether element i is above 0. Null vectors and elements, and missing ones, give 0.

    Null ids and repeated rows stay; columns other than vec_id and embedding are ignored. Empty table: no rows.
    """
    bit = [F.shiftleft(F.when(F.get("embedding", F.lit(i)) > 0, F.lit(1)).otherwise(0).cast("long"), i) for i in range(bits)]
    return vectors.select("vec_id", reduce(lambda a, b: a.bitwiseOR(b), bit).alias("code"))


def _segment(code: Column, k: int, width: int) -> Column:
    return F.shiftrightunsigned(code, k * width).bitwiseAND(F.lit((1 << width) - 1))


def _flipped(probes: DataFrame, width: int, r: int) -> DataFrame:
    """Each row once for every choice of r of the `width` bits, with these bits of v flipped.

    Bits are chosen one after the other, each above the last and low enough for the rest, so no row is made in vain
    and the plan has r steps whatever their number.
    """
    probes = probes.withColumn("next", F.lit(0))
    for i in range(r):
        bit = F.explode(F.sequence(F.col("next"), F.lit(width - r + i))).alias("bit")
        probes = probes.select("q", "kth", "s", "v", bit).select(
            "q",
            "kth",
            "s",
            F.col("v").bitwiseXOR(F.expr("shiftleft(1L, bit)")).alias("v"),
            (F.col("bit") + 1).alias("next"),
        )
    return probes.select("q", "kth", "s", "v")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS, width: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, distance: the k rows of least (Hamming distance, vec_id) for each query row.

    Equal codes are one entry of the index with their number and k least ids, which is all that can be asked of them.
    Round r looks up, in each segment, all values that differ from the query's in exactly r bits. A code that no
    segment has shown after round r is at least segments * (r + 1) away, so a query whose kth distance is less is
    answered; the others go on. Codes beyond a query's kth distance so far are dropped as they are met. Queries with
    equal codes are searched once. Segments have `width` bits: by default 8, 16 or 32, so that the lookups of a query
    and the codes they meet are about as many. Lookups are merge joins: Spark takes the exploded lookups for as small as the queries and would
    broadcast them.
    Null ids are left out. Fewer than k rows: all of them. Empty tables: no rows. Repeated rows count each.
    """
    dealt = codes.where("vec_id is not null").withColumn("_uw_part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    nth = F.row_number().over(Window.partitionBy("code", "_uw_part").orderBy("vec_id"))
    first = F.collect_list(F.when(F.col("_uw_nth") <= k, F.col("vec_id")))
    entry = dealt.withColumn("_uw_nth", nth).groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(first), 1, k).alias("ids")
    )
    entries = write_shared(entry, "entries")
    different, rows = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    width = width or (8 if different <= 1 << 12 else 16 if different <= 1 << 26 else 32)
    segments = bits // width
    parts = lambda code: F.explode(
        F.array(*[F.struct(F.lit(s).alias("s"), _segment(F.col(code), s, width).alias("v")) for s in range(segments)])
    )
    index = write_shared(
        entries.select("code", "n", parts("code").alias("p")).select(
            F.col("p.s").alias("s"), F.col("p.v").alias("v"), "code", "n"
        ),
        "index",
    )
    asked = queries.where("vec_id is not null").select(F.col("vec_id").alias("query_id"), F.col("code").alias("q"))
    active = write_shared(asked.select("q", F.lit(bits).alias("kth")).distinct(), "active")
    found: DataFrame | None = None
    for r in range(width + 1):
        probes = active.select("q", "kth", parts("q").alias("p"))
        probes = _flipped(probes.select("q", "kth", F.col("p.s").alias("s"), F.col("p.v").alias("v")), width, r)
        met = probes.join(index.hint("merge"), ["s", "v"]).withColumn(
            "distance", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int")
        )
        met = met.where(F.col("distance") <= F.col("kth")).select("q", "code", "n", "distance")
        met = write_shared((met if found is None else met.union(found)).distinct(), "met")
        by_distance = met.groupBy("q", "distance").agg(F.sum("n").alias("n"))
        upto = by_distance.withColumn("upto", F.sum("n").over(Window.partitionBy("q").orderBy("distance")))
        kth = write_shared(upto.where(F.col("upto") >= min(k, rows)).groupBy("q").agg(F.min("distance").alias("least")), "kth")
        found = write_shared(
            met.join(kth, "q", "left").where(
                F.col("distance") <= F.coalesce("least", "distance")
            ).select("q", "code", "n", "distance"),
            "found",
        )
        closer = active.join(kth, "q", "left").where(F.coalesce(F.col("least") >= segments * (r + 1), F.lit(True)))
        active = write_shared(closer.select("q", F.coalesce("least", "kth").alias("kth")), "active")
        if not active.limit(1).count():
            break
    near = found.join(entries.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("vec_id"))
    best = near.withColumn(
        "rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec_id"))
    ).where(F.col("rank") <= k)
    return asked.join(best, "q").select("query_id", "rank", "vec_id", "distance")
