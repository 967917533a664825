"""Benchmark passages in documents, by an FM-index over each training shard.

Texts are sequences of words. The alphabet is the benchmark's vocabulary; a word outside it can't stand in a match, so it
parts a document into stretches, and stretches shorter than every window are left out. What remains of a shard is indexed:
Burrows-Wheeler transform, wavelet matrix, sampled suffix positions. All windows are searched backwards at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import write_shared

#: Words of a window.
WINDOW = 10
#: Symbols of an index (a shard is an Arrow batch of documents, and has more than one index if it is larger); distance of sampled suffix positions; matches located at once.
SHARD_WORDS, SAMPLE, AT_ONCE = 1 << 20, 8, 1 << 18
#: Benchmark words that are searched for in one pass; longer items are dealt out in overlapping pieces of PIECE words. A
#: larger benchmark takes several passes, the result of CHAIN of which is written before the next.
BLOCK_WORDS, PIECE, CHAIN = 1_000_000, 5_000, 4
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What each byte of a text becomes: letters and digits and all beyond ASCII stay, the rest is blank.
FOLDED = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 if c < 128 else c for c in range(256))
FOUND = "n_words long, spans array<struct<begin:long,end:long>>, items array<string>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLDED).split()


class Bits:
    """A bit vector with the number of ones before each place, by words of 64 bits and their running counts."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, dtype=bool)]), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in their order, by prefix doubling. Each 0 counts as a symbol of its own, by its place, so
    that no comparison goes beyond it and the rounds follow the longest stretch."""
    n, parts = len(symbols), symbols == 0
    rank = np.where(parts, np.cumsum(parts) - 1, symbols + int(parts.sum())).astype(np.int64)
    second, step = np.zeros(n, dtype=np.int64), 1
    while True:
        order = np.argsort(rank * (n + 1) + second, kind="stable")
        first, then = rank[order], second[order]
        changes = (first[1:] != first[:-1]) | (then[1:] != then[:-1])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(changes)])[:n]
        if changes.all():
            return order
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        step *= 2


class FMIndex:
    """Index of a sequence of symbols 1 to `most`, parted and ended by 0."""

    def __init__(self, symbols: np.ndarray, most: int, sample: int = SAMPLE):
        order = suffix_order(symbols)
        last = symbols[order - 1]
        self.size = len(symbols)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=most + 1))]).astype(np.int64)
        self.levels: list[tuple[int, Bits, int]] = []
        x = last
        for shift in reversed(range(max(1, int(most).bit_length()))):
            bit = (x >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit), int((~bit).sum())))
            x = np.concatenate([x[~bit], x[bit]])
        symbols_ = np.arange(most + 1)
        self.base = np.zeros(most + 1, dtype=np.int64)
        self.base = self._down(symbols_, np.zeros(most + 1, dtype=np.int64))
        known = (order % sample == 0) | (last == 0)
        self.known, self.places = Bits(known), order[known]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first `at` of the transform."""
        return self._down(symbol, at) - self.base[symbol]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows whose suffixes begin with each window. windows: one a row, aligned to the right."""
        n, width = windows.shape
        low, high = np.zeros(n, dtype=np.int64), np.full(n, self.size, dtype=np.int64)
        for k in range(width):
            at = np.flatnonzero((lengths > k) & (low < high))
            if not len(at):
                break
            symbol = windows[at, width - 1 - k]
            both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low[at], high[at]]))
            low[at], high[at] = self.starts[symbol] + both[: len(at)], self.starts[symbol] + both[len(at) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes of rows: back to the next sampled one, symbol by symbol."""
        out, steps = np.empty(len(rows), dtype=np.int64), 0
        waiting, rows = np.arange(len(rows)), rows.copy()
        while len(waiting):
            there = self.known.get(rows)
            out[waiting[there]] = self.places[self.known.ones(rows[there])] + steps
            waiting, rows = waiting[~there], rows[~there]
            at, symbol = rows, np.zeros(len(rows), dtype=np.int64)
            for shift, bits, zeros in self.levels:
                bit, ones = bits.get(at), bits.ones(at)
                symbol |= bit.astype(np.int64) << shift
                at = np.where(bit, zeros + ones, at - ones)
            rows = self.starts[symbol] + at - self.base[symbol]
            steps += 1
        return out


@dataclass
class Windows:
    """The distinct windows of a block of items: symbols of its words, windows aligned to the right, and the items of
    each window (those of window k stand from first[k] to first[k + 1])."""

    symbols: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    items: list[str | None]


def windows_of(items: list[tuple[str | None, list[str]]], width: int = WINDOW) -> Windows:
    symbols: dict[bytes, int] = {}
    found: dict[tuple[int, ...], dict[str | None, None]] = {}
    for item, words in items:
        ids = [symbols.setdefault(w.encode("utf-8", "surrogatepass"), len(symbols) + 1) for w in words]
        for k in range(max(1, len(ids) - width + 1)):
            found.setdefault(tuple(ids[k : k + width]), {})[item] = None
    matrix = np.zeros((len(found), width), dtype=np.int64)
    for row, w in zip(matrix, found, strict=True):
        row[width - len(w) :] = w
    lengths = np.array([len(w) for w in found], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum([len(v) for v in found.values()])]).astype(np.int64)
    return Windows(symbols, matrix, lengths, first, [x for v in found.values() for x in v])


@dataclass
class Shard:
    """Stretches of benchmark words of some documents, waiting to be indexed and searched."""

    block: Windows
    parts: list[np.ndarray] = field(default_factory=list)
    owners: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0

    def add(self, doc: int, ids: np.ndarray) -> Iterator[list[tuple[int, int, int, int]]]:
        """Take the stretches of a document (symbols of all its words, 0 for others). Gives matches when it is full."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
        longest, shortest = int(self.block.lengths.max()), int(self.block.lengths.min())
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            while end - begin >= shortest:
                stop = min(end, begin + SHARD_WORDS)
                self.parts.append(ids[begin:stop].copy())
                self.owners.append((doc, begin))
                self.size += stop - begin + 1
                if self.size >= SHARD_WORDS:
                    yield self.matches()
                if stop == end:
                    break
                begin = stop - longest + 1

    def matches(self) -> list[tuple[int, int, int, int]]:
        """(document, first word, word after the last, window) of each match; the shard is empty afterwards."""
        if not self.parts:
            return []
        pieces, zero = self.parts, np.zeros(1, dtype=np.int64)
        text = np.concatenate([y for x in pieces for y in (x, zero)])
        begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in pieces])])[:-1]
        owners = np.array(self.owners, dtype=np.int64)
        self.parts, self.owners, self.size = [], [], 0
        index = FMIndex(text, len(self.block.symbols))
        low, high = index.search(self.block.windows, self.block.lengths)
        counts = np.maximum(high - low, 0)
        hit = np.flatnonzero(counts)
        which = np.repeat(hit, counts[hit])
        rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(counts[hit])])[:-1], counts[hit]) + np.arange(len(which))
        found = []
        for a in range(0, len(rows), AT_ONCE):
            places, window = index.locate(rows[a : a + AT_ONCE]), which[a : a + AT_ONCE]
            part = np.searchsorted(begins, places, side="right") - 1
            begin = places - begins[part] + owners[part, 1]
            found += zip(owners[part, 0].tolist(), begin.tolist(), (begin + self.block.lengths[window]).tolist(), window.tolist(), strict=True)
        return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one, in order."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def _search(docs: DataFrame, block: Windows) -> DataFrame:
    """Add the block's matches to n_words, spans and items."""
    names = docs.columns
    columns = [names.index(c) for c in ("text", "spans", "items")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, spans, items = Shard(block), {}, {}

            def take(found, spans=spans, items=items):
                for doc, begin, end, window in found:
                    spans.setdefault(doc, []).append((begin, end))
                    items.setdefault(doc, set()).update(block.items[block.first[window] : block.first[window + 1]])

            n_words = []
            for k, text in enumerate(batch.column(columns[0])):
                words = words_of(text.as_py() or "")
                n_words.append(len(words))
                ids = np.fromiter(map(block.symbols.get, words, repeat(0)), dtype=np.int64, count=len(words))
                for found in shard.add(k, ids):
                    take(found)
            take(shard.matches())
            old_spans, old_items = batch.column(columns[1]), batch.column(columns[2])
            new_spans, new_items = [], []
            for k in range(batch.num_rows):
                was = [(x["begin"], x["end"]) for x in old_spans[k].as_py() or []]
                new_spans.append([{"begin": a, "end": b} for a, b in merged(was + spans[k])] if k in spans else old_spans[k].as_py() or [])
                new_items.append(sorted({*(old_items[k].as_py() or []), *(x for x in items[k] if x is not None)}) if k in items else old_items[k].as_py() or [])
            added = {
                "n_words": pa.array(n_words, pa.int64()),
                "spans": pa.array(new_spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                "items": pa.array(new_items, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([added.get(c, batch.column(i)) for i, c in enumerate(names)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(search, f"doc_id {kind}, text string, {FOUND}")


def blocks_of(items: DataFrame, width: int = WINDOW) -> Iterator[Windows]:
    """The items' windows in blocks of about BLOCK_WORDS words. Each block passes the driver by itself."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(PATTERN), F.lit(0))
    lists = items.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    begins = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)), F.lit(PIECE))
    piece = F.slice("words", F.col("begin") + 1, F.lit(PIECE + width - 1))
    pieces = write_shared(
        lists.select("item", "words", F.explode(begins).alias("begin")).select("item", piece.alias("words")), "items"
    )
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    count = -(-total // BLOCK_WORDS)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(max(count, 1))))
    for k in range(count):
        if rows := dealt.where(F.col("block") == k).select("item", "words").collect():
            yield windows_of([tuple(r) for r in rows], width)


def find_contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, text, n_words, spans and items of each document.

    docs: doc_id, text; items: item_id, text. Words are runs of digits, of letters a to z (A to Z are lowered) and of
    anything beyond ASCII. A window is `width` consecutive words of an item; an item of fewer words, but not none, is one
    window. spans: the words that stand in an occurrence of any window, as begin and end numbers of words, merged where
    they touch. items: ids of the items with occurring windows, as text, each once, sorted.

    Null texts have no words. Items without words match nothing; items without id count for spans but are not listed.
    Repeated documents and items are handled like others, null doc_ids too. Very long documents are indexed in pieces
    that overlap, very long items searched for in pieces. Empty tables: no rows, or no spans. Columns other than the named
    ones are ignored.
    """
    found = docs.select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    number = 0
    for number, block in enumerate(blocks_of(items, width), 1):
        if number > 1 and number % CHAIN == 1:
            found = write_shared(found, "searched")
        found = _search(found, block)
    if not number:
        return found.withColumn("n_words", F.coalesce(F.size(F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))), F.lit(0)).cast("long"))
    return found


WORD_BYTES = re.compile(rb"[^\x20]+")


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them; one blank is left in place of each."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD_BYTES.finditer(raw.translate(FOLDED))]
    at, kept = 0, []
    for begin, end in spans:
        kept.append(raw[at : places[begin][0]])
        at = places[end - 1][1]
    return b" ".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, text and n_hit of each document, text with its benchmark passages cut out; clean and null texts stay.

    Odd rows are handled as by `find_contamination`.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hits = [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                cuts = [(x["begin"], x["end"]) for x in spans.as_py() or []]
                texts.append(cut_out(text.as_py(), cuts) if cuts else text.as_py())
                hits.append(sum(b - a for a, b in cuts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(hits, pa.int64())], ["doc_id", "text", "n_hit"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = find_contamination(docs, items, width).select("doc_id", "text", "spans")
    return found.mapInArrow(clean, f"doc_id {kind}, text string, n_hit long")
