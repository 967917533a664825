"""Removal of repeated byte strings, found by a distributed merge sort of sparse suffixes that remembers prefixes.

Every string of `length` bytes holds exactly one anchor: the least of the hashes of its first `window` eight-byte
pieces (the leftmost of equals). Equal strings hold the same anchor at the same place, so two strings are equal if
and only if their anchors are, their bytes from the anchor on, and their bytes before it. Only suffixes that begin at
anchors are sorted: about 2 in `window` bytes.

1. Anchors with the strings that they stand for are exchanged by a hash of the bytes which all these strings share; of
   equal surroundings that are met together two are, the rest are told to repeat on the spot.
   Anchors whose whole surroundings have equal 128-bit digests are repeats: there is nothing to order among equals, so
   one of them stands for all in what follows. Anchors with a key of their own are unique.
2. The rest are places where repeats begin, end or differ. Their suffixes are sorted per task, exchanged as
   front-coded runs and merged by loser trees that never compare a known common prefix again.
3. The merged order gives the common prefixes; together with the bytes before the anchors they decide each string.
   Keys with more than `most` different surroundings are not merged in one place: each of their strings is counted by
   its digest instead, with partial aggregation, however many there are.

The same steps over words in place of bytes count the words in passages of over 50 words that other documents have
too, which may be shorter than `length` bytes. There, places that differ are all counted by digest.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from unitweave.llm.common import write_shared

#: Bytes of a repeated string, and pieces among which its anchor is chosen.
LENGTH, WINDOW = 400, 256
#: Words of a shared passage, at least; words of a piece among which its anchor is chosen.
PASSAGE, PIECE_WORDS = 51, 8
#: Different surroundings of one key that are merged in one place.
MOST = 100_000
#: Keys of more surroundings than that which are broadcast, at most; more are joined.
HOT_KEYS = 1_000_000
#: Windows of a text that are hashed at once.
CHUNK = 1 << 21
PIECE = 8
#: Anchors are places in bytes or in words; the kind is the lowest bit of the key.
BYTES, WORDS = 0, 1
#: Bit of a packed place: the anchor is known to repeat.
TOLD = 1 << 19
AT, LEFT, WIDTH = "shiftright(place, 20)", "shiftright(place, 10) & 1023", "place & 1023"


def _least(pieces: np.ndarray, begin: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Windows over the hashes of the pieces of several texts, laid one after the other: text k has `count[k]` windows
    from piece `begin[k]` on. Of runs of windows with one least piece: text, place of the piece, first and last window."""
    marked = pieces & np.uint64(0xFFFFFFFF00000000) | np.arange(len(pieces), dtype=np.uint64)
    padded = np.full(-(-len(marked) // window) * window, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(marked)] = marked
    blocks = padded.reshape(-1, window)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(pieces) - window + 1
    least = np.minimum(onward[:n], upto[window - 1 : window - 1 + n])
    new = np.ones(n + 1, bool)
    np.not_equal(least[1:], least[:-1], out=new[1:n])
    new[begin] = new[begin + count] = True
    first = np.flatnonzero(new)
    last = first[1:] - 1
    first = first[:-1]
    text = np.searchsorted(begin, first, side="right") - 1
    inside = (text >= 0) & (first < (begin + count)[text])
    first = first[inside]
    return text[inside], (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), first, last[inside]


def _byte_pieces(data: bytes) -> np.ndarray:
    """Hash of the PIECE (8) bytes from each place on; the eight shifts of the data are read as whole numbers."""
    n = len(data) - PIECE + 1
    pieces = np.empty(n, dtype=np.uint64)
    for shift in range(min(PIECE, n)):
        pieces[shift::PIECE] = np.frombuffer(data, dtype="<u8", count=(len(data) - shift) // PIECE, offset=shift)
    pieces *= np.uint64(0x9E3779B97F4A7C15)
    pieces ^= pieces >> np.uint64(29)
    pieces *= np.uint64(0xBF58476D1CE4E5B9)
    return pieces


def anchors(data: bytes, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of one text, and the first and last start of the strings that each stands for; by stretches."""
    n, found = len(data) - length + 1, []
    for begin in range(0, max(n, 0), CHUNK):
        count = min(CHUNK, n - begin)
        part = _byte_pieces(data[begin : begin + count + window - 1 + PIECE - 1])
        found.append(tuple(x + begin for x in _least(part, np.array([0]), np.array([count]), window)[1:]))
    return tuple(np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))


def anchors_of(
    blob: bytes, offsets: np.ndarray, sizes: np.ndarray, length: int = LENGTH, window: int = WINDOW
) -> tuple[np.ndarray, ...]:
    """text, place, first and last (all from the text's beginning) of the anchors of texts that lie in one blob."""
    some = np.flatnonzero(sizes >= length)
    if len(blob) > 2 * CHUNK or not len(some):  # one long text, or none
        found = [(k, *anchors(blob[offsets[k] : offsets[k] + sizes[k]], length, window)) for k in some.tolist()]
        return tuple(
            np.concatenate(x) for x in zip(*[(np.full(len(f[1]), f[0]), *f[1:]) for f in found], strict=True)
        ) if found else (np.empty(0, np.int64),) * 4
    text, at, first, last = _least(_byte_pieces(blob), offsets[some], sizes[some] - length + 1, window)
    text = some[text]
    return text, at - offsets[text], first - offsets[text], last - offsets[text]


#: Odd factors of the polynomial hashes: of the bytes of a word, and two of the words of a run.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) ^ (x >> np.uint64(32))


@lru_cache(maxsize=16)
def _powers(factor: int, bits: int) -> np.ndarray:
    """The first 2 ** bits powers of an odd factor, modulo 2 ** 64."""
    powers = np.full(1 << bits, factor, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _runs(values: np.ndarray, first: np.ndarray, end: np.ndarray, factor: int) -> np.ndarray:
    """Polynomial hash of each run values[first:end], whatever its place: prefix sums, brought to one exponent."""
    bits = max(len(values), 1).bit_length()
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(factor, bits)[: len(values)], out=sums[1:])
    return _mixed((sums[end] - sums[first]) * _powers(pow(factor, -1, 1 << 64), bits)[first] + (end - first).astype(np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (run of bytes but blanks) and its place, in stretches of about CHUNK bytes that end at
    blanks."""
    found, begin = [(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))], 0
    while begin < len(data):
        end = begin + CHUNK
        while end < len(data) and not BLANK[data[end]]:
            end += 1
        part = np.frombuffer(data, dtype=np.uint8, count=min(end, len(data)) - begin, offset=begin)
        edge = np.flatnonzero(np.diff(~BLANK[part], prepend=False, append=False))
        found.append((_runs(part.astype(np.uint64) + np.uint64(1), edge[::2], edge[1::2], FACTORS[0]), edge[::2] + begin))
        begin = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_anchors(
    words: np.ndarray, begin: np.ndarray, size: np.ndarray, passage: int = PASSAGE, piece: int = PIECE_WORDS
) -> tuple[np.ndarray, ...]:
    """The same over hashes of words of several texts (text k has `size[k]` from `begin[k]` on), anchors of runs of
    `passage` words among pieces of `piece` words: text, place, first and last in `words`, and the hash of the piece."""
    some = np.flatnonzero(size >= passage)
    if not len(some):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    start = np.arange(len(words) - piece + 1)
    pieces = _runs(words, start, start + piece, FACTORS[0])
    text, at, first, last = _least(pieces, begin[some], size[some] - passage + 1, passage - piece + 1)
    return some[text], at, first, last, pieces[at]


def word_digests(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digest of each run of words, as two columns of 64 bits."""
    return np.stack([_runs(words, first, end, f).view(np.int64) for f in FACTORS[1:]], axis=1)


def _digests(data: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in spans]), dtype="<i8").reshape(-1, 2)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), mark. A text is known by its doc_id and its 64-bit mark, so null and repeated
    doc_ids are told apart; rows with both equal have one text and one result."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"))


def _told(key: np.ndarray, whole: np.ndarray, place: np.ndarray, text: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Rows that repeat for certain, since two others of their surroundings are exchanged (of words: of other texts)."""
    extent = place & 0xFFFFF
    order = np.lexsort((text, extent, whole[:, 1], whole[:, 0], key))
    same = lambda x: x[order][1:] == x[order][:-1]
    new = np.concatenate([[True], ~(same(key) & same(whole[:, 0]) & same(whole[:, 1]) & same(extent))])[: len(order)]
    starts = np.flatnonzero(new)
    class_of = np.cumsum(new) - 1
    rank = np.arange(len(order)) - starts[class_of]
    other = mark[order] != mark[order][starts[class_of]]
    first_other = np.full(len(starts), len(order))
    np.minimum.at(first_other, class_of[other], np.flatnonzero(other))
    second = np.where((key[order][starts] & np.uint64(1)) == WORDS, first_other, starts + 1)  # exchanged with the first
    ends = np.append(starts[1:], len(order))
    found = np.zeros(len(order), bool)
    found[order] = (rank > 0) & (np.arange(len(order)) != second[class_of]) & (second < ends)[class_of]
    return found


def _anchor_rows(docs: DataFrame, length: int, window: int) -> DataFrame:
    """doc_id, mark, place (at, left, width packed), key (64-bit hash and kind) and whole (128-bit digest) of each anchor."""
    common = length - window + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                datas, held, end = [], 0, begin
                while end < batch.num_rows and (not datas or held < CHUNK):  # texts that are hashed together
                    datas.append(batch.column(1)[end].as_py().encode("utf-8", "surrogatepass"))
                    held, end = held + len(datas[-1]), end + 1
                if len(datas) > 1 and len(datas[-1]) > CHUNK:
                    datas, end = datas[:-1], end - 1
                blob = b" ".join(datas)
                sizes = np.array([len(d) for d in datas])
                offsets = np.cumsum(sizes + 1) - sizes - 1
                text, at, first, last = anchors_of(blob, offsets, sizes, length, window)
                base = offsets[text]
                key = np.array([xxhash.xxh3_64_intdigest(blob[p : p + common]) for p in (base + at).tolist()], dtype=np.uint64)
                whole = _digests(blob, list(zip((base + first).tolist(), (base + last + length).tolist(), strict=True)))
                words, where = word_hashes(blob)
                edges = np.searchsorted(where, np.append(offsets, len(blob) + 1))
                w_text, w_at, w_first, w_last, w_key = word_anchors(words, edges[:-1], np.diff(edges))
                w_whole = word_digests(words, w_first, w_last + PASSAGE)
                w_at, w_first, w_last = (x - edges[w_text] for x in (w_at, w_first, w_last))
                rows = pa.array(np.concatenate([text, w_text]) + begin)
                at, first, last = np.concatenate([at, w_at]), np.concatenate([first, w_first]), np.concatenate([last, w_last])
                key = np.concatenate([key, w_key]) >> np.uint64(1) << np.uint64(1)
                key |= np.repeat(np.array([BYTES, WORDS], np.uint64), [len(text), len(w_text)])
                whole, place = np.concatenate([whole, w_whole]), at << 20 | (at - first) << 10 | last - first
                mark = batch.column(2).take(rows)
                told = _told(key, whole, place, np.concatenate([text, w_text]), mark.to_numpy())
                place[told] |= TOLD
                # what is settled here already goes anywhere, spread by text and place
                key[told] = key[told] & np.uint64(1) | _mixed(
                    mark.to_numpy()[told].view(np.uint64) + place[told].view(np.uint64) * np.uint64(FACTORS[0])
                ) >> np.uint64(1) << np.uint64(1)
                columns = [
                    batch.column(0).take(rows),
                    mark,
                    pa.array(place),
                    pa.array(key.view(np.int64)),
                    pa.array(whole[:, 0].copy()),
                    pa.array(whole[:, 1].copy()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "place", "key", "w1", "w2"])
                begin = end

    return docs.mapInArrow(
        find,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, place long, key long, w1 long, w2 long",
    )


class Settler:
    """Over rows sorted by key, whole and packed extent (but for those told to repeat already): members of equal surroundings become repeats ("r"); if a key
    has several classes of surroundings, its classes go on ("m"), one row for a class of repeats, else every row.

    Bytes repeat if a class has two rows, words if it has two texts. Of a class that goes on in the next batch at most
    one row is carried if it repeats, else the rows of its one text; of its key only the number of classes. So memory
    is bounded by a batch and a text, whatever the size of a key.
    """

    NAMES = ["doc_id", "mark", "place", "key", "w1", "w2"]

    def __init__(self):
        self.open: pa.Table | None = None  # rows of the open class
        self.told = False  # whether they are out as repeats
        self.before = 0  # closed classes of the open class's key

    def add(self, table: pa.Table | None) -> Iterator[pa.Table]:
        n_open = 0 if self.open is None else len(self.open)
        if table is not None and (told := table["place"].to_numpy() & TOLD > 0).any():
            at = np.flatnonzero(told)
            some = table.take(pa.array(at))
            some = some.set_column(2, "place", pa.array(some["place"].to_numpy() & ~TOLD))
            yield self._tagged(some, np.arange(len(at)), "r", np.full(len(at), 2), np.zeros(len(at)))
            table = table.filter(pa.array(~told))
            if not len(table):
                return
        if table is None:
            table = self.open if n_open else None
        elif n_open:
            table = pa.concat_tables([self.open, table]).combine_chunks()
        if table is None or not len(table):
            return
        last_batch = len(table) == n_open
        key, w1, w2, mark = (table[c].to_numpy() for c in ("key", "w1", "w2", "mark"))
        extent = table["place"].to_numpy() & 0xFFFFF
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new = new_key | np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (extent[1:] != extent[:-1])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        class_of = np.cumsum(new) - 1
        words = (key[starts] & 1) == WORDS
        other = mark != mark[starts][class_of]
        if table["doc_id"].null_count == 0 and pa.types.is_integer(table["doc_id"].type):
            ids = table["doc_id"].to_numpy()
            other |= ids != ids[starts][class_of]
        else:
            ids = table["doc_id"].to_pylist()
            other |= np.array([ids[i] != ids[starts[c]] for i, c in enumerate(class_of.tolist())])
        many = np.where(words, np.bincount(class_of, weights=other, minlength=len(starts)) > 0, sizes > 1)
        if n_open and self.told:
            many[0] = True
        closed = np.ones(len(starts), bool)
        closed[-1] = last_batch
        key_of = np.cumsum(new_key[starts]) - 1
        first_of_key = np.searchsorted(key_of, np.arange(key_of[-1] + 1))
        ordinal = np.arange(len(starts)) - first_of_key[key_of] + np.where(key_of == 0, self.before if n_open else 0, 0)
        # a key that lies in this table whole, and all of whose classes repeat, has nothing left to find
        contained = ~((key_of == 0) & (n_open > 0)) & ((key_of != key_of[-1]) | last_batch)
        single = np.bincount(key_of, weights=~many) > 0
        several = ((np.bincount(key_of)[key_of] > 1) | (ordinal > 0)) & (~contained | single[key_of])
        told = np.zeros(len(key), bool)
        told[:n_open] = self.told
        out = np.flatnonzero(many[class_of] & ~told)
        if len(out):
            yield self._tagged(table, out, "r", np.full(len(out), 2), np.zeros(len(out)))
        going = closed & several
        head = np.arange(len(key)) == starts[class_of]
        out = np.flatnonzero(going[class_of] & (head | ~many[class_of]))
        if len(out):
            yield self._tagged(table, out, "m", np.where(many[class_of[out]], 2, 1), ordinal[class_of[out]])
        if last_batch:
            self.open = None
            return
        kept = np.array([starts[-1]]) if many[-1] else np.arange(starts[-1], len(key))
        self.open, self.told, self.before = table.take(pa.array(kept)).combine_chunks(), bool(many[-1]), int(ordinal[-1])

    def _tagged(self, table: pa.Table, at: np.ndarray, tag: str, members: np.ndarray, ordinal: np.ndarray) -> pa.Table:
        some = table.take(pa.array(at)).select(self.NAMES[:4])
        if tag == "r":  # of the key only the kind is needed
            some = some.set_column(3, "key", pa.array(some["key"].to_numpy() & 1))
        return some.append_column("tag", pa.array([tag] * len(at))).append_column(
            "members", pa.array(members.astype(np.int32))
        ).append_column("ordinal", pa.array(ordinal.astype(np.int64)))


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    settler = Settler()
    for batch in batches:
        for x in settler.add(pa.Table.from_batches([batch]).select(Settler.NAMES)):
            yield from x.combine_chunks().to_batches()
    for x in settler.add(None):
        yield from x.combine_chunks().to_batches()


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes need not be looked at."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low if a[low : low + 1] != b[low : low + 1] else low + 1


def front_coded(records: list[tuple[bytes, tuple]]) -> bytes:
    """A sorted run as bytes: of each suffix only what differs from the one before."""
    coded, before = [], b""
    for suffix, rest in records:
        shared = common_prefix(before, suffix)
        coded.append((shared, suffix[shared:], rest))
        before = suffix
    return pickle.dumps(coded, protocol=5)


def decoded(run: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    before = b""
    for shared, tail, rest in pickle.loads(run):
        before = before[:shared] + tail
        yield shared, before, rest


def merge_runs(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Merge sorted runs of (prefix shared with the one before, suffix, rest) into one such run.

    A loser tree: each inner node holds the run that lost there and the prefix it shares with the winner. Of two runs
    the one that shares more with the last output is smaller; only if they share as much are bytes compared, from
    there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[tuple[int, bytes, tuple] | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix becomes the one with the winner."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        n = common_prefix(x, y, shared[a])
        if x[n:] <= y[n:]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if size > 1 else 0
    while heads[winner] is not None:
        yield shared[winner], heads[winner][1], heads[winner][2]
        head = heads[winner] = next(runs[winner], None)
        shared[winner] = head[0] if head else 0
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def decide(group: list[tuple[int, bytes, tuple]], length: int = LENGTH) -> Iterator[tuple[tuple, int, int]]:
    """(rest, first offset, last offset) of the repeated strings among suffixes that share the bytes of their key.

    group: (prefix shared with the one before, suffix, (left bytes, width, members, ...)) in sorted order. The string
    at offset o holds the o bytes before the anchor and length - o from it on. Two suffixes agree on it if their common
    prefix and their common left bytes suffice. For each offset, suffixes are put in classes by both.
    """
    m = len(group)
    left = [g[2][0] for g in group]
    high = np.array([len(x) for x in left])
    low = high - np.array([g[2][1] for g in group])
    right = np.array([g[0] for g in group])
    right[0] = 0
    order = sorted(range(m), key=lambda k: left[k][::-1])
    lefts = np.array([0] + [common_prefix(left[a][::-1], left[b][::-1]) for a, b in zip(order, order[1:], strict=False)])
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    # between these offsets the classes stay the same
    turns = np.unique(np.concatenate([low, high + 1, length - right[1:], lefts[1:] + 1]))
    turns = turns[(turns >= low.min()) & (turns <= high.max() + 1)]
    begun: dict[int, int] = {}
    out = []
    for o in turns.tolist():
        here = (low <= o) & (o <= high)
        by_right = np.cumsum(np.concatenate([[0], right[1:] < length - o]))
        by_left = np.cumsum(np.concatenate([[0], lefts[1:] < o]))[place]
        both = np.where(here, by_right * m + by_left, -1)
        _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
        again = here & (counts[inverse] > 1)
        for k in np.flatnonzero(again).tolist():
            begun.setdefault(k, o)
        for k in [k for k in begun if not again[k]]:
            out.append((k, begun.pop(k), o - 1))
    out += [(k, o, int(high[k])) for k, o in begun.items()]
    for k, a, b in out:
        if group[k][2][2] == 1:  # classes of several members are known to be repeats
            yield group[k][2], a, b


def repeated_starts(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """doc_id, mark, kind, first, last: the starts of all strings of `length` bytes that also start anywhere else (kind
    BYTES), and of all runs of PASSAGE words that another text has too (kind WORDS). docs: as `identified`.

    Surroundings in words are told by two polynomial hashes of 64 bits, single runs of words by one: among 10^12 runs one
    in 10 million may be counted as shared though it is not. No byte is removed by it."""
    spark = docs.sparkSession
    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    common = length - window + 1
    dealt = _anchor_rows(docs, length, window).repartition(parts, "key").sortWithinPartitions(
        "key", "w1", "w2", F.expr("place & 1048575")
    )
    settled = write_shared(
        dealt.mapInArrow(
            _sorted_out, f"doc_id {kind}, mark long, place long, key long, tag string, members int, ordinal long"
        ),
        "anchors",
    )
    at, left, width = F.expr(AT), F.expr(LEFT), F.expr(WIDTH)
    of_kind = F.col("key").bitwiseAND(F.lit(1)).cast("int").alias("kind")
    whole = settled.where("tag = 'r'").select("doc_id", "mark", of_kind, (at - left).alias("first"), (at - left + width).alias("last"))

    hot = settled.where(F.col("ordinal") >= most).select("key").distinct().withColumn("hot", F.lit(True))
    hot = write_shared(hot, "hot")
    hot = F.broadcast(hot) if hot.count() <= HOT_KEYS else hot
    each = (F.coalesce("hot", F.lit(False)) | (F.col("key").bitwiseAND(F.lit(1)) == WORDS)).alias("each")
    wanted = settled.where("tag = 'm'").join(hot, "key", "left").select(
        "doc_id", "mark", F.struct("place", "key", "members", each).alias("w")
    )
    wanted = wanted.groupBy("doc_id", "mark").agg(F.collect_list("w").alias("wanted")).withColumnsRenamed(
        {"doc_id": "_uw_id", "mark": "_uw_mark"}
    )
    texts = docs.join(
        wanted, F.col("_uw_id").eqNullSafe(F.col("doc_id")) & (F.col("_uw_mark") == F.col("mark"))
    ).select("doc_id", "text", "mark", "wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Front-coded runs of suffixes to merge, by part; digests of strings to count, with start, kind and whether the
        string is known to repeat packed into one number."""
        for batch in batches:
            by_part: dict[int, list[tuple[bytes, tuple]]] = {}
            rows, packed, digests = [], [], []
            for k, (doc_id, text, mark, wanted) in enumerate(zip(*batch.columns, strict=True)):
                data = text.as_py().encode("utf-8", "surrogatepass")
                runs_of_words = []
                for x in wanted.as_py():
                    p, n_left, n_width = x["place"] >> 20, x["place"] >> 10 & 1023, x["place"] & 1023
                    first = p - n_left
                    if not x["each"]:
                        suffix, before = data[p : first + n_width + length], data[first:p]
                        by_part.setdefault(x["key"] % (4 * parts), []).append(
                            (suffix, (before, n_width, x["members"], doc_id.as_py(), mark.as_py(), p, x["key"]))
                        )
                    elif x["key"] & 1 == WORDS:
                        runs_of_words.append((first, n_width + 1, x["members"] > 1))
                    else:
                        starts = np.arange(first, first + n_width + 1)
                        rows.append(np.full(len(starts), k))
                        packed.append(starts << 2 | BYTES << 1 | int(x["members"] > 1))
                        digests.append(_digests(data, [(o, o + length) for o in starts.tolist()]))
                if runs_of_words:
                    starts = np.concatenate([np.arange(a, a + n) for a, n, _ in runs_of_words])
                    many = np.concatenate([np.full(n, int(m)) for _, n, m in runs_of_words])
                    rows.append(np.full(len(starts), k))
                    packed.append(starts << 2 | WORDS << 1 | many)
                    digest = word_digests(word_hashes(data)[0], starts, starts + PASSAGE)
                    digest[:, 1] = 0  # 64 bits do for words, which only are counted
                    digests.append(digest)
            for records in by_part.values():
                records.sort(key=lambda r: r[0])
            n, at = len(by_part), pa.array(np.concatenate(rows) if rows else [], pa.int64())
            number = lambda x: pa.concat_arrays([pa.nulls(n, pa.int64()), x])  # noqa: B023, E731
            digest = np.concatenate(digests) if rows else np.empty((0, 2), np.int64)
            columns = [
                pa.array([*by_part, *[None] * len(at)], pa.int32()), pa.array([*map(front_coded, by_part.values()), *[None] * len(at)], pa.binary()), pa.concat_arrays([pa.nulls(n, id_type), batch.column(0).take(at)]),
                *map(number, (batch.column(2).take(at), pa.array(np.concatenate(packed) if rows else [], pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "run", "doc_id", "mark", "packed", "d1", "d2"])

    found = write_shared(
        texts.mapInArrow(read, f"part int, run binary, doc_id {kind}, mark long, packed long, d1 long, d2 long"), "runs"
    )
    runs = found.where("part is not null").select("part", "run").repartition(parts, "part").sortWithinPartitions("part")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts_of():
            now, held = None, []
            for batch in batches:
                for part, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if part != now:
                        if held:
                            yield held
                        now, held = part, []
                    held.append(run)
            if held:
                yield held

        for held in parts_of():
            rows, group = [], []

            def close(group=group, rows=rows):
                if len(group) > 1:
                    rows.extend((r[3], r[4], BYTES, r[5] - b, r[5] - a) for r, a, b in decide(group, length))
                group.clear()

            seen: set[tuple] = set()
            for shared, suffix, rest in merge_runs([decoded(x) for x in held]):
                if shared < common:
                    close()
                    seen.clear()
                if (same := (*rest[3:6], len(rest[0]))) in seen:  # the same suffix, read from a repeated row
                    continue
                seen.add(same)
                group.append((shared, suffix, rest))
            close()
            if rows:
                types = (id_type, pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)],
                    ["doc_id", "mark", "kind", "first", "last"],
                )

    merged = runs.mapInArrow(merge, f"doc_id {kind}, mark long, kind int, first long, last long")
    # a text that stands in several rows is read as often: its strings count once
    strings = found.where("part is null").select(
        "d1",
        "d2",
        F.expr("shiftright(packed, 1) & 1").cast("int").alias("kind"),
        "doc_id",
        "mark",
        F.expr("shiftright(packed, 2)").alias("first"),
        (F.expr("packed & 1") == 1).alias("many"),
    )
    text = F.xxhash64("doc_id", "mark")
    differ = lambda c: F.min(c) != F.max(c)
    counts = strings.groupBy("d1", "d2", "kind").agg(
        F.max(F.col("many").cast("int")).alias("many"),
        differ(text).alias("texts"),
        differ(F.col("first")).alias("places"),
    )
    again = counts.where(
        (F.col("many") == 1) | F.col("texts") | ((F.col("kind") == BYTES) & F.col("places"))
    ).select("d1", "d2", "kind")
    # those known to repeat are in `whole` already
    counted = strings.where("not many").join(again, ["d1", "d2", "kind"]).select(
        "doc_id", "mark", "kind", "first", F.col("first").alias("last")
    )
    return whole.union(merged).union(counted)


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """n_bytes, n_removed, n_spans, kept_sha256, n_shared_words and kept (binary) of each document without its repeated
    bytes. n_shared_words: words in runs of PASSAGE or more words that a document of other id or text has too.

    Null text: empty. Texts of under `length` bytes lose nothing. Repeated rows and exact copies lose all bytes of
    texts that are long enough; rows of equal id and text are not others to each other in n_shared_words. Null doc_ids
    are treated like others. Empty table: no rows. Columns other than doc_id and text are ignored. Very long texts are
    hashed in stretches.
    """
    texts = identified(docs)
    found = repeated_starts(texts, length, window, most).groupBy("doc_id", "mark").agg(
        F.collect_list(F.struct("kind", "first", "last")).alias("found")
    ).withColumnsRenamed({"doc_id": "_uw_id", "mark": "_uw_mark"})
    joined = texts.join(
        found, F.col("_uw_id").eqNullSafe(F.col("doc_id")) & (F.col("_uw_mark") == F.col("mark")), "left"
    ).select("doc_id", "text", "found")

    def spans_of(found: list[dict], kind: int, size: int) -> list[list[int]]:
        spans: list[list[int]] = []
        for a, b in sorted((s["first"], s["last"] + size) for s in found if s["kind"] == kind):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        return spans

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data, found = text.as_py().encode("utf-8", "surrogatepass"), found.as_py() or ()
                spans = spans_of(found, BYTES, length)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                rows.append(
                    (
                        len(data),
                        len(data) - len(rest),
                        len(spans),
                        sha256(rest).hexdigest(),
                        sum(b - a for a, b in spans_of(found, WORDS, PASSAGE)),
                        rest,
                    )
                )
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words", "kept"],
            )

    return joined.mapInArrow(
        cut,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long, kept binary",
    )
