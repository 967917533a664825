"""Near-duplicate classes by Order MinHash, verified by a banded alignment. The alignment is written as bit vectors (one
bit for each place of the band), the rest as Spark joins and aggregates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import write_shared

#: Words of a shingle, least similarity, independent sketches, minima of each sketch.
WORDS, SIMILARITY, SKETCHES, MINIMA = 5, 0.8, 16, 2
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Entries of a worker's memory of word hashes before it starts anew.
WORD_MEMORY = 500_000
#: Bins of the shingle counts that bound what two texts share; how many times more leaders a bucket has in each round.
BINS, MORE_LEADERS = 128, 16
#: Comparisons of members with leaders for which a round takes more leaders at once.
COMPARISONS = 30_000_000
#: Marks of repeated rows that are broadcast, at most.
MARKS = 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) ^ (x >> np.uint64(32))


def word_hashes(text: str, memory: dict[str, int]) -> np.ndarray:
    words = [w for w in BLANKS.split(text) if w]
    if len(memory) > WORD_MEMORY:
        memory.clear()
    for w in words:
        if w not in memory:
            memory[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(memory.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hash of each run of `size` words; of the whole text if it is shorter."""
    n = len(words) - size + 1
    if n < 1:
        words, n, size = words, min(len(words), 1), len(words)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * MIX + words[k : k + n]
    return _mixed(out)


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Shingle hashes with the number of their occurrence mixed in, so that repeats are told apart."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    same = np.concatenate([[False], sorted_[1:] == sorted_[:-1]])
    if not same.any():
        return hashes
    at = np.arange(len(hashes))
    occurrence = np.empty(len(hashes), dtype=np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
    return np.where(occurrence > 0, _mixed(hashes + occurrence * MIX), hashes)


def order_minhash(hashes: np.ndarray, sketches: int = SKETCHES, minima: int = MINIMA) -> np.ndarray:
    """One hash per sketch, over its least occurrence-labelled shingles in the order they have in the text."""
    k = min(minima, len(hashes))
    if not k:
        return np.empty(0, dtype=np.int64)
    out, seeds = np.zeros(sketches, dtype=np.uint64), _mixed(np.arange(1, sketches + 1, dtype=np.uint64) * MIX)
    step = max(1, 2_000_000 // len(hashes))
    for a in range(0, sketches, step):
        values = _mixed(hashes[None, :] ^ seeds[a : a + step, None])
        least = np.sort(np.argpartition(values, k - 1, axis=1)[:, :k], axis=1)
        out[a : a + step] = reduce(lambda h, j: _mixed(h * MIX + hashes[least[:, j]]), range(k), seeds[a : a + step])
    return out.view(np.int64)


def binned(hashes: np.ndarray) -> bytes:
    """Numbers of shingles by hash bin."""
    counts = np.bincount((hashes % np.uint64(BINS)).astype(np.int64), minlength=BINS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def may_align(a: bytes, b: bytes, similarity: float = SIMILARITY) -> bool:
    """Whether the bins leave room for `similarity`: no two texts share more shingles than their bins do."""
    x, y = (np.frombuffer(v, np.uint8 if len(v) == BINS else np.uint32) for v in (a, b))
    return bool(
        np.minimum(x, y).sum(dtype=np.int64) >= similarity / (1 + similarity) * (
            int(x.sum(dtype=np.int64)) + int(y.sum(dtype=np.int64))
        ) - 1e-9
    )


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the shingles that can be aligned in order are at least `similarity` of all: m / (len a + len b - m).

    Common ends are taken off. The shared count bounds m from above. The rest is a longest common subsequence, bit
    by bit, in the band that an alignment of this similarity cannot leave: its unaligned shingles on either side are
    fewer than the band is wide.
    """
    need = similarity / (1 + similarity) * (len(a) + len(b)) - 1e-9
    if min(len(a), len(b)) < need:
        return False
    values, counts_a = np.unique(a, return_counts=True)
    others, counts_b = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    if np.minimum(counts_a[i], counts_b[j]).sum() < need:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    n -= head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1]) if n else differ[:0]
    tail = int(differ[0]) if len(differ) else n
    x, y = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    need -= head + tail
    if need <= 0:
        return True
    return banded_common(x, y, int(len(x) + len(y) - 2 * need) + 1) >= need


def banded_common(x: list[int], y: list[int], band: int) -> int:
    """Length of the longest common subsequence among alignments that keep within `band` places of the diagonal.

    Bit-parallel: only the 2 * band + 1 places of x around the diagonal are held as bits; a place that leaves the
    window is counted (its bit is 0 if it ends a longer common subsequence) and forgotten. The places of a value in x
    are kept as blocks of bits as wide as the window, so time is in proportion to length times band.
    """
    wide = 2 * band + 1
    places: dict[int, dict[int, int]] = {}
    for k, v in enumerate(x):
        block, bit = divmod(k, wide)
        blocks = places.setdefault(v, {})
        blocks[block] = blocks.get(block, 0) | 1 << bit
    every = state = (1 << wide) - 1
    common = 0
    for k, v in enumerate(y):
        if blocks := places.get(v):
            block, bit = divmod(k - band, wide)
            if match := (blocks.get(block, 0) >> bit | blocks.get(block + 1, 0) << wide - bit) & every:
                u = state & match
                state = (state + u | state - u) & every
        common += not state & 1
        state = state >> 1 | 1 << wide - 1
    return common + wide - state.bit_count()


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key (128-bit hash of the words; null if there are none), n (shingles), bins, sketches."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for batch in batches:
            keys, counts, bins, found = [], [], [], []
            for x in batch.column(1):
                words = word_hashes(x.as_py() or "", memory)
                hashes = shingles(words)
                keys.append(xxhash.xxh3_128_digest(words.tobytes()) if len(words) else None)
                counts.append(len(hashes))
                bins.append(binned(hashes))
                found.append(order_minhash(labelled(hashes)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(keys, pa.binary()),
                    pa.array(counts, pa.int32()),
                    pa.array(bins, pa.binary()),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                ["doc_id", "key", "n", "bins", "sketches"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        sketch,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, n int, bins binary, sketches array<long>",
    )


def _placed(named: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with most (the bucket's largest component) and outside (how
    many members are not in it). Both come from partial aggregation, so a bucket is never gathered."""
    by_root = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"), F.max("mates").alias("mates"))
    buckets = by_root.groupBy("bucket").agg(
        F.sum("k").alias("k"), F.max(F.struct("k", (-F.col("mates")).alias("m"), "root")).alias("most")
    )
    return named.join(
        buckets.select(
            "bucket", F.col("most.root").alias("most"), (F.col("k") - F.col("most.k")).alias("outside")
        ).where("outside > 0"),
        "bucket",
    )


def _leaders(placed: DataFrame, least: int) -> tuple[int, int]:
    """How many leaders each bucket gets in a round, and the most members that any bucket has outside its largest
    component. At least `least` leaders; as many as the last round would need if that makes few comparisons in all."""
    steps = [least * MORE_LEADERS**k for k in range(1, 5)]
    costs = [F.sum(F.least("outside", F.lit(s))).alias(str(s)) for s in steps]
    outside, *found = placed.agg(F.max("outside"), *costs).first()
    return max([least, *(s for s, c in zip(steps, found, strict=True) if c is not None and c <= COMPARISONS)]), outside or 0


def _links(placed: DataFrame, leaders: int, similarity: float) -> DataFrame:
    """Pairs to verify: the members of a bucket with its leaders of other components.

    Leaders stand outside the largest component: the most central member (with the most bucket mates) of each of
    `leaders` hash slices, or all if they are no more. Then the pairs are all that the bucket has between components,
    as of any two components one is not the largest. Of a text at most `common` shingles can be aligned, and a pair
    needs similarity / (1 + similarity) of both texts' shingles: pairs that can't have them, by these numbers or by the
    bins of their shingles (from the second round on), are left out.

    Columns: the nodes a and b, and root_a and root_b, their components' least (first_id, node).
    """
    all_lead = F.col("outside") <= leaders
    slice_ = F.when(~all_lead, F.pmod(F.xxhash64("node", F.lit(leaders)), F.lit(leaders)))
    binned_ = [c for c in placed.columns if c == "bins"]
    best = F.max(F.struct("mates", F.xxhash64("node", "bucket").alias("h"), "node", "n", "common", "root", "class_id", *binned_)).alias("l")
    leading = placed.where("root != most").groupBy(
        "bucket", F.when(all_lead, F.col("node")).alias("_1"), slice_.alias("_2")
    ).agg(best).select("bucket", "l")
    need = F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("l.n")) - 1e-9
    may = F.least("common", "l.common") >= need
    if binned_:
        shared = F.aggregate(F.zip_with("bins", "l.bins", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
        may = may & (shared >= need)
    both = placed.select("bucket", "node", "n", "common", "root", "class_id", *binned_).join(leading, "bucket").where((F.col("root") != F.col("l.root")) & may)
    ends = [F.struct(F.col(f"{at}node").alias("node"), F.struct(F.col(f"{at}class_id").alias("first_id"), F.col(f"{at}root").alias("node")).alias("root")) for at in ("", "l.")]
    pairs = both.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y"))
    return pairs.select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.root").alias("root_a"), F.col("y.root").alias("root_b")
    ).dropDuplicates(["a", "b"])


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose bins leave room for the similarity, so that few texts are read for those that do not align."""
    columns = pairs.columns

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [may_align(x.as_py(), y.as_py(), similarity) for x, y in zip(batch.column("bins_a"), batch.column("bins_b"), strict=True)]
            yield batch.select(columns).filter(pa.array(good, pa.bool_()))

    bins = lambda end: nodes.select(F.col("node").alias(end), F.col("bins").alias(f"bins_{end}"))
    return pairs.join(bins("b"), "b").join(bins("a"), "a").select(*columns, "bins_a", "bins_b").mapInArrow(bound, pairs.schema)


def _bodies(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """node, n, body (the shingles), bins (as numbers) of the wanted nodes (node, doc_id), whose texts are hashed again."""

    def rehash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for batch in batches:
            nodes, counts, bodies, bins = [], [], [], []
            for node, text in zip(batch.column(0), batch.column(1), strict=True):
                words = word_hashes(text.as_py() or "", memory)
                if xxhash.xxh3_128_digest(words.tobytes()) == node.as_py():
                    hashes = shingles(words)
                    nodes.append(node.as_py())
                    counts.append(len(hashes))
                    bodies.append(hashes.tobytes())
                    bins.append(np.bincount((hashes % np.uint64(BINS)).astype(np.int64), minlength=BINS).astype(np.int32))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(bins) + 1, dtype=np.int32) * BINS), pa.array(np.concatenate([*bins, np.zeros(0, np.int32)]))
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array(counts, pa.int32()), pa.array(bodies, pa.binary()), lists],
                ["node", "n", "body", "bins"],
            )

    texts = docs.select("doc_id", "text").join(wanted, "doc_id").select("node", "text")
    return texts.mapInArrow(rehash, "node binary, n int, body binary, bins array<int>").dropDuplicates(["node"])


def _bounded(members: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """The members with their bins and `common`, the number of their shingles that stand in another member's text too: no
    alignment with another member has more. Members of which this leaves less than the similarity can't be linked and go.

    Shingles are counted by text before they meet, so the common ones of a large group are added up in the tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, body in zip(batch.column(0), batch.column(1), strict=True):
                values, times = np.unique(np.frombuffer(body.as_py(), np.uint64), return_counts=True)
                names = pa.array([node.as_py()], pa.binary()).take(pa.array(np.zeros(len(values), np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(values.view(np.int64)), pa.array(times.astype(np.int32))], ["node", "shingle", "times"]
                )

    left = bodies.select("node", "body").join(members.select("node"), "node", "left_semi")
    each = left.mapInArrow(count, "node binary, shingle long, times int")
    alone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.first("node").alias("node"), F.first("times").alias("times")).where("k = 1")
    own = alone.groupBy("node").agg(F.sum("times").alias("own"))
    bounds = bodies.select("node", "n", "bins").join(own, "node", "left").select(
        "node", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"), "n", "bins"
    ).where(F.col("common") >= F.lit(similarity) * F.col("n") - 1e-9)
    return members.select("bucket", "node", "mates").join(bounds, "node")


def _verified(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """The components a and b of the pairs whose texts align."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [aligned(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), similarity) for x, y in zip(batch.column("body_a"), batch.column("body_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    body = lambda end: bodies.select(F.col("node").alias(end), F.col("body").alias(f"body_{end}"))
    joined = pairs.join(body("b"), "b").join(body("a"), "a").select(
        F.col("root_a").alias("a"), F.col("root_b").alias("b"), "body_a", "body_b"
    )
    return joined.mapInArrow(align, joined.select("a", "b").schema).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label of each end of an edge; a and b and what is returned are (first_id, node), label is the least of its
    component.

    Labels go along the edges and then from each label to the label it had before, until nothing changes.
    """
    both = write_shared(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a"))),
        "edges",
    )
    labels = write_shared(
        both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")), "labels"
    )
    while True:
        known = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        near = both.withColumnRenamed("other", "to").join(known, "to").groupBy("node").agg(F.min("further").alias("theirs"))
        moved = labels.join(near, "node").select("node", "label", F.least("label", "theirs").alias("to"))
        new = F.least("to", "further")
        labels = write_shared(moved.join(known, "to").select("node", new.alias("label"), (new != F.col("label")).alias("moved")), "labels")
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "label")
        labels = labels.drop("moved")


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id (least doc_id of its class) of each document; classes are connected by near-duplicate links.

    Texts with equal words are one node from the start. Each node has 16 sketches of two minima; nodes that share a
    sketch are in one bucket. In rounds, the members of a bucket are aligned with its leaders of other components, and
    found links join components. Each round has more leaders, until all members that are not in the bucket's largest
    component lead: then no two of a bucket's members are in different classes without having been aligned, or having too few
    shingles in common with all other members that are left.
    Null, empty and blank texts have no words: each is a class of its own. Texts of under five words are one shingle.
    Null doc_ids share classes with exact copies only. Repeated rows are exact copies. Empty table: no rows.
    Columns other than doc_id and text are ignored.
    """
    sketches = write_shared(sketched(docs), "sketches")
    nodes = sketches.where("key is not null").groupBy(F.col("key").alias("node")).agg(
        F.min("doc_id").alias("first_id"),
        F.first("n").alias("n"),
        F.first("bins").alias("bins"),
        F.first("sketches").alias("sketches"),
    ).where("first_id is not null")
    nodes = write_shared(nodes, "nodes")
    entries = nodes.select(
        "node", "first_id", "n", F.posexplode("sketches").alias("t", "s")
    ).select(F.xxhash64("t", "s").alias("bucket"), "node", "first_id", "n")
    shared = write_shared(
        entries.join(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket"),
        "entries",
    )
    members = shared.join(shared.groupBy("node").agg(F.sum("size").alias("mates")), "node").select(
        "bucket", "node", "n", "mates", F.col("n").alias("common"), F.col("node").alias("root"), F.col("first_id").alias("class_id")
    )
    labels = nodes.select("node", F.col("node").alias("root"), F.col("first_id").alias("class_id"))
    bodies, tested, least = None, None, 1
    while True:
        placed = write_shared(_placed(members), "members")
        leaders, outside = (1, placed.agg(F.max("outside")).first()[0] or 0) if bodies is None else _leaders(placed, least)
        if not outside:
            break
        left = placed.where(F.col("outside") > leaders)
        pairs = _links(placed, leaders, similarity)
        pairs = write_shared(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        if bodies is None:  # only texts that may be aligned now or later are hashed again, once for all rounds
            pairs = write_shared(_possible(pairs, nodes, similarity), "possible")
            wanted = reduce(DataFrame.union, [
                left.select("node", F.col("class_id").alias("doc_id")),
                *(pairs.select(x, F.col(f"root_{x}.first_id")) for x in ("a", "b")),
            ]).distinct()
            bodies = write_shared(_bodies(wanted, docs), "bodies")
        # found links join whole components: only their roots go through the search
        found = write_shared(_verified(pairs, bodies, similarity), "verified")
        if found.limit(1).count():
            merged = components(found).select(F.col("node.node").alias("root"), "label")
            labels = labels.join(merged, "root", "left").select(
                "node",
                F.coalesce("label.node", "root").alias("root"),
                F.coalesce("label.first_id", "class_id").alias("class_id"),
            )
            labels = write_shared(labels, "labels")
        if outside <= leaders:
            break
        members = write_shared(_bounded(left, bodies, similarity).join(labels, "node"), "bounded")
        least = leaders * MORE_LEADERS

    return sketches.select("doc_id", "key").join(
        labels.select(F.col("node").alias("key"), "class_id"), "key", "left"
    ).select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one whose doc_id is the least; all columns stay, in place.

    Null doc_ids: a document whose words a document with id has too goes, of others without id one of each text stays.
    Rows of equal doc_id and text: one of them stays. Rows of equal doc_id and other text stay if the id stands for a
    class. Null, empty and blank texts are no duplicates of each
    other, but for rows of equal id. Empty table: no rows. Other columns may have any names.

    Only rows whose (doc_id, text) stands several times are shuffled to drop duplicates. Their marks are broadcast up
    to MARKS of them, and joined beyond.
    """
    classes = near_duplicate_classes(docs.select("doc_id", "text"), similarity)
    first = classes.where("doc_id = class_id").select(F.col("doc_id").alias("_uw_id")).distinct()
    unknown = classes.where("doc_id is null and class_id is not null").limit(1).count() > 0
    marked = docs.withColumn("_uw_mark", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    again = write_shared(
        marked.groupBy("_uw_mark").agg(F.count(F.lit(1)).alias("_uw_n")).where("_uw_n > 1").select(
            "_uw_mark", F.lit(True).alias("_uw_again")
        ),
        "again",
    )
    split = marked.join(F.broadcast(again) if again.count() <= MARKS else again, "_uw_mark", "left")
    once = split.where("_uw_again is null").unionByName(split.where("_uw_again").dropDuplicates(["_uw_mark", "doc_id", "text"]))
    kept = once.where("doc_id is not null").join(first, F.col("doc_id") == F.col("_uw_id")).select(*docs.columns)
    without = once.where("doc_id is null").select(*docs.columns)
    if unknown:  # words of these documents stand in documents with ids
        keyed = sketched(docs.select("doc_id", "text")).where("doc_id is not null and key is not null").select("key").distinct()
        without = _keyed(without).join(keyed.withColumnRenamed("key", "_uw_key"), "_uw_key", "left_anti").select(*docs.columns)
    return kept.unionByName(without)


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with _uw_key, the 128-bit hash of their words (null if there are none)."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    at = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for batch in batches:
            words = [word_hashes(x.as_py() or "", memory) for x in batch.column(at)]
            keys = pa.array([xxhash.xxh3_128_digest(w.tobytes()) if len(w) else None for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "_uw_key"])

    return docs.mapInArrow(add, StructType([*docs.schema.fields, StructField("_uw_key", BinaryType())]))
