"""Packing tokenised documents into sequences of fixed length by best-two-fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import ranked_in_slices, write_shared

#: Entries that a worker's memory of tokenised words may hold before it starts anew.
WORD_MEMORY = 300_000
SLICES = 64
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def _tokenizers(json_name: str, ranks_name: str):
    """The tokenizer and the same vocabulary as ranks, which is faster on single words."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(ranks_name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(public_tokenizers.path(json_name)), fast


class WordEncoder:
    """Token ids of texts as little-endian bytes, word by word from memory.

    A blank between two other characters always starts a token, so the words between single blanks can be encoded on
    their own. Texts with other white space next to a blank, or with a special token's string, are encoded whole.
    """

    def __init__(self, json_name: str, ranks_name: str):
        self.slow, self.fast = _tokenizers(json_name, ranks_name)
        self.memory: dict[str, bytes | None] = {}

    def _word(self, word: str) -> bytes | None:
        if len(self.memory) > WORD_MEMORY:
            self.memory.clear()
        found = None
        if word and not word[0].isspace() and not word[-1].isspace():
            found = np.array(self.fast.encode_ordinary(" " + word), dtype="<u4").tobytes()
        if len(word) < 64:
            self.memory[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        if rest and first and not first[-1].isspace():
            known, out = self.memory, [np.array(self.fast.encode_ordinary(first), dtype="<u4").tobytes()]
            for word in rest:
                ids = known[word] if word in known else self._word(word)
                if ids is None:
                    break
                out.append(ids)
            else:
                return b"".join(out)
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


def tokenised_pieces(
    docs: DataFrame,
    capacity: int = 2048,
    json_name: str = "byte_bpe_50k.json",
    ranks_name: str = "byte_bpe_50k.tiktoken",
    end_id: int = 0,
) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece: a document's ids and end_id, cut only if over capacity.

    The first piece of a cut document takes the remainder, all others are full.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(json_name, ranks_name)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                start, piece, length = 0, 0, n if n <= capacity else n % capacity or capacity
                while start < n:
                    rows.append((k, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, piece, length = start + length, piece + 1, capacity
            at, *rest = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-two-fit over a histogram of lengths: [(bin as (length, how many) by falling length, number of such bins)].

    A bin is filled greedily with the longest pieces that fit. Then its shortest piece is replaced by the two unpacked
    pieces that fill the widened gap best, if they leave less of it. The same bin is made as often as the counts allow,
    so the work depends on the number of different lengths (below the capacity), not on the number of pieces.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    sizes, plan = np.arange(capacity + 1), []
    while left.any():
        longest = np.maximum.accumulate(np.where(left > 0, sizes, 0))
        gap, at, used = capacity, capacity, {}
        while at and (length := int(longest[at])):
            used[length] = n = int(min(left[length], gap // length))
            gap -= n * length
            at = min(gap, length - 1)
        if gap:
            shortest = min(used)
            wide = gap + shortest
            free = left.copy()
            for length, n in used.items():
                free[length] -= n
            x = sizes[1 : wide][free[1:wide] > 0]
            if len(x):
                best = np.maximum.accumulate(np.where(free > 0, sizes, 0))
                y = best[wide - x]
                alone = (y == x) & (free[x] < 2)
                if alone.any():
                    y = np.where(alone, best[np.maximum(x - 1, 0)], y)
                total = np.where(y > 0, x + y, 0)
                k = int(total.argmax())
                if total[k] > shortest:
                    used[shortest] -= 1
                    if not used[shortest]:
                        del used[shortest]
                    for length in (int(x[k]), int(y[k])):
                        used[length] = used.get(length, 0) + 1
        times = int(min(left[length] // n for length, n in used.items()))
        for length, n in used.items():
            left[length] -= n * times
        plan.append((sorted(used.items(), reverse=True), times))
    return plan


def pack_documents(docs: DataFrame, capacity: int = 2048, slices: int = SLICES, **tokenizer) -> DataFrame:
    """Pieces with sequence_id and offset: gapless sequences of at most `capacity` tokens, few of them.

    Texts are tokenised once. Full pieces are sequences of their own. For the rest only the histogram of lengths
    (fewer rows than the capacity) is planned on the driver, by `plan_bins`; it gives for each length the ranges of
    ranks that go to each kind of bin. Pieces are ranked within their length over hash slices, and each looks its
    place up by binary search in these ranges (at most one for each kind of bin and length).
    Null text: end_id alone. Null doc_id and repeated rows are packed like others. Empty table: no rows.
    Needs doc_id and text; other columns are ignored.
    """
    pieces = write_shared(tokenised_pieces(docs, capacity, **tokenizer), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    full = counts.pop(capacity, 0)
    keys, firsts, spans, places = [], [], [], []
    sequence, taken = full, {}
    for used, times in plan_bins(counts, capacity):
        offset = 0
        for length, n in used:
            keys.append((length << 44) + taken.get(length, 0))
            firsts.append(sequence), spans.append(n), places.append(offset)
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        sequence += times
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    keys, firsts, spans, places = (np.array(x, dtype=np.int64)[order] for x in (keys, firsts, spans, places))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_uw_rank"))
            sequence_id, offset = rank.copy(), np.zeros_like(rank)
            short = length < capacity
            if short.any():
                key = (length[short] << 44) + rank[short]
                k = np.searchsorted(keys, key, side="right") - 1
                inside = key - keys[k]
                sequence_id[short] = firsts[k] + inside // spans[k]
                offset[short] = places[k] + inside % spans[k] * length[short]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence_id), pa.array(offset)],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked, _ = ranked_in_slices(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], slices, "_uw_rank")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select(*columns, "_uw_rank").mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
