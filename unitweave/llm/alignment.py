"""Alignment of two tokenisations of a text by byte offsets.

Each text is tokenised twice. A token of one side is matched with the token of the other side that covers its first byte,
by as-of joins within documents; the union of both directions is every overlap. Where tokens of both sides end at one byte,
the text is cut into groups, the least pieces that both sides can be translated by.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import write_shared
from unitweave.llm.packing import _tokenizers

#: Bytes of texts that are aligned at once; a longer text by itself.
BATCH_BYTES = 1 << 20
#: Words that a worker's memory may hold before it starts anew (100 to 200 bytes each).
WORD_MEMORY = 600_000
#: Id pairs whose counts are broadcast, at most (about 100 MB as a hash table). Beyond it they are joined by shuffle.
BROADCAST_PAIRS = 2_000_000
#: A pair of ids is one number: a * ID_SPAN + b.
ID_SPAN = 1 << 32
#: How the second vocabulary writes a blank.
SIGN = "▁"
TOKEN, PAIR = "array<int>", "struct<a:int,b:int>"


@lru_cache(maxsize=2)
def _pieces(model_name: str):
    """The second tokenizer and the bytes of each of its ids."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model_name))
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SIGN, " ").encode() for i, p in enumerate(names)]


class Tokens:
    """Ids of both sides and the bytes of each id.

    A blank between other characters starts a token of either side, so words between single blanks are encoded on their
    own, once for each worker's memory. Of the second side this holds as no piece of its vocabulary has the blank's sign
    after another one. Texts with other white space at a blank, or with the sign itself, are encoded whole.
    """

    def __init__(self, json_name: str, ranks_name: str, model_name: str):
        _, self.fast = _tokenizers(json_name, ranks_name)
        self.model, self.b_bytes = _pieces(model_name)
        self.a_bytes = [b""] * self.fast.n_vocab
        for i in range(self.fast.n_vocab):
            try:
                self.a_bytes[i] = self.fast.decode_single_token_bytes(i)
            except KeyError:
                pass  # a special token's number, which no text gives
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        self.spellings = Spelling(self.a_bytes, self.a_sizes), Spelling(self.b_bytes, self.b_sizes)
        self.by_word = all(SIGN not in self.model.id_to_piece(i).lstrip(SIGN) for i in range(self.model.get_piece_size()))
        self.memory: dict[str, tuple[bytes, bytes] | None] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.memory) > WORD_MEMORY:
            self.memory.clear()
        alone = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        self.memory.update(dict.fromkeys(words))
        for w, b in zip(alone, self.model.encode(alone, num_threads=1), strict=True):
            self.memory[w] = array("i", self.fast.encode_ordinary(" " + w)).tobytes(), array("i", b).tobytes()

    def both(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of both sides (of a blank and the text by the first, of the text by the second), as 32-bit integers."""
        split = [t.split(" ") if t and self.by_word and SIGN not in t else None for t in texts]
        known = self.memory
        if new := {w for words in split if words for w in words if w not in known}:
            self._learn(new)
        found = []
        for text, words in zip(texts, split, strict=True):
            pairs = [known.get(w) for w in words] if words else [None]
            if not text:
                pairs = []
            elif None in pairs:
                pairs = [tuple(array("i", ids).tobytes() for ids in (self.fast.encode_ordinary(" " + text), self.model.encode(text)))]
            found.append((b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])))
        return found


class Spelling:
    """Whether tokens spell texts, for many texts at once: the bytes of the ids, gathered from one long array."""

    def __init__(self, words: list[bytes], sizes: np.ndarray):
        self.letters, self.begins, self.sizes = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes

    def right(self, ids: np.ndarray, firsts: np.ndarray, raw: list[bytes]) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        whole = int(ends[-1]) if len(ends) else 0
        letters = self.letters[np.repeat(self.begins[ids] - (ends - sizes), sizes) + np.arange(whole)]
        lengths = np.diff(np.concatenate([[0], ends])[firsts])
        same = lengths == np.array([len(r) for r in raw])
        if same.all():
            wrong = np.flatnonzero(letters != np.frombuffer(b"".join(raw), np.uint8))
            same[np.searchsorted(np.cumsum(lengths), wrong, side="right")] = False
            return same
        at = np.cumsum(lengths) - lengths
        return np.array([ok and letters[x : x + n].tobytes() == r for ok, x, n, r in zip(same, at, lengths, raw, strict=True)])


def overlaps(docs_a: np.ndarray, ends_a: np.ndarray, sizes_a: np.ndarray, docs_b: np.ndarray, ends_b: np.ndarray, sizes_b: np.ndarray) -> pd.DataFrame:
    """a, b (numbers of tokens in the batch) and together (whether they end at one byte) of every pair that shares a byte.

    docs and ends rise from token to token; ends count bytes through all documents of the batch.
    """
    left = pd.DataFrame({"doc": docs_a, "at": ends_a - sizes_a, "a": np.arange(len(ends_a))})
    right = pd.DataFrame({"doc": docs_b, "at": ends_b - sizes_b, "b": np.arange(len(ends_b))})
    forward = pd.merge_asof(left, right, on="at", by="doc")
    back = pd.merge_asof(right, left, on="at", by="doc")
    a, b = back["a"].to_numpy(), back["b"].to_numpy()
    new = left["at"].to_numpy()[a] != right["at"].to_numpy()  # tokens that begin together are found both ways
    a = np.concatenate([forward["a"].to_numpy(), a[new]])
    b = np.concatenate([forward["b"].to_numpy(), b[new]])
    return pd.DataFrame({"a": a, "b": b, "together": ends_a[a] == ends_b[b]})


class Aligned:
    """A batch of texts, aligned: ids of all tokens, where each document's begin, overlaps, and groups by their last tokens.
    Texts that are null, empty, or not spelt by the tokens of both sides have none."""

    def __init__(self, tokens: Tokens, texts: list[str | None]):
        pairs = tokens.both(texts)
        raw = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        right = np.ones(len(texts), dtype=bool)
        for k, spelling in enumerate(tokens.spellings):
            ids, firsts = self._side(pairs, k)
            right &= spelling.right(ids, firsts, raw)
        if not right.all():
            pairs = [p if ok else (b"", b"") for p, ok in zip(pairs, right, strict=True)]
        (self.a, self.first_a), (self.b, self.first_b) = (self._side(pairs, k) for k in (0, 1))
        docs_a, docs_b = (np.repeat(np.arange(len(texts)), np.diff(n)) for n in (self.first_a, self.first_b))
        sizes_a, sizes_b = tokens.a_sizes[self.a], tokens.b_sizes[self.b]
        self.overlaps = overlaps(docs_a, np.cumsum(sizes_a), sizes_a, docs_b, np.cumsum(sizes_b), sizes_b)
        ending = self.overlaps[self.overlaps["together"].to_numpy()]
        order = np.argsort(ending["a"].to_numpy(), kind="stable")
        self.last_a, self.last_b = ending["a"].to_numpy()[order], ending["b"].to_numpy()[order]
        self.first_group = np.searchsorted(self.last_a, self.first_a)

    @staticmethod
    def _side(pairs: list[tuple[bytes, bytes]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a side, and where each text's begin."""
        firsts = np.concatenate([[0], np.cumsum([len(p[k]) // 4 for p in pairs])]).astype(np.int64)
        return np.frombuffer(b"".join([p[k] for p in pairs]), np.int32).astype(np.int64), firsts

    def group_texts(self, decimal: list[str]) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each document. decimal: texts of ids followed by each of the four signs in turn."""
        groups_a, groups_b = (np.zeros(len(x) + 1, dtype=np.int64) for x in (self.a, self.b))
        groups_a[self.last_a + 1] = 1
        groups_b[self.last_b + 1] = 1
        ends_a, ends_b = groups_a[1:], groups_b[1:]
        of_a, of_b = np.cumsum(groups_a)[:-1], np.cumsum(groups_b)[:-1]
        codes = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        # a group's a tokens stand after the b tokens of all groups before it, its b tokens after its own a tokens
        codes[np.arange(len(self.a)) + np.concatenate([[0], self.last_b + 1])[of_a]] = self.a * 3 + ends_a
        codes[np.arange(len(self.b)) + (self.last_a + 1)[of_b]] = self.b * 3 + 2 * ends_b
        firsts = self.first_a + self.first_b
        parts = list(map(decimal.__getitem__, codes.tolist()))
        return ["".join(parts[x:y])[:-1] for x, y in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]


def _batches(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a column in runs of about BATCH_BYTES, with the place of the first."""
    begin, texts, size = 0, [], 0
    for k, x in enumerate(column):
        text = x.as_py()
        texts.append(text)
        size += len(text or "") + 64
        if size >= BATCH_BYTES:
            yield begin, texts
            begin, texts, size = k + 1, [], 0
    if texts:
        yield begin, texts


def align_tokens(
    docs: DataFrame,
    json_name: str = "byte_bpe_50k.json",
    ranks_name: str = "byte_bpe_50k.tiktoken",
    model_name: str = "piece_bpe_32k.model",
) -> DataFrame:
    """doc_id, a and b (ids of both sides), overlaps (numbers of an a and a b token, from 0, that share a byte, in order)
    and groups (numbers of the last tokens of each group) of each document.

    The first side encodes a blank and the text, the second the text, to which it adds a blank itself; special tokens'
    strings are plain text. Texts that are null, empty, or that a side's tokens do not spell have no tokens. Null doc_ids
    and repeated rows are handled like others, very long texts whole and by themselves. Other columns are ignored.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(json_name, ranks_name, model_name)
        for batch in batches:
            for begin, texts in _batches(batch.column(1)):
                x = Aligned(tokens, texts)
                pairs = x.overlaps.sort_values(["a", "b"])
                a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
                cut = np.searchsorted(a, x.first_a)
                rows = []
                for k in range(len(texts)):
                    i, j = x.first_a[k], x.first_b[k]
                    some, ends = slice(cut[k], cut[k + 1]), slice(x.first_group[k], x.first_group[k + 1])
                    struct = lambda p, q, i=i, j=j: [{"a": u, "b": v} for u, v in zip((p - i).tolist(), (q - j).tolist(), strict=True)]
                    rows.append((x.a[i : x.first_a[k + 1]].tolist(), x.b[j : x.first_b[k + 1]].tolist(), struct(a[some], b[some]), struct(x.last_a[ends], x.last_b[ends])))
                ids, pair = pa.list_(pa.int32()), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (ids, ids, pair, pair), strict=True))],
                    ["doc_id", "a", "b", "overlaps", "groups"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(align, f"doc_id {kind}, a {TOKEN}, b {TOKEN}, overlaps array<{PAIR}>, groups array<{PAIR}>")


def linked_documents(
    docs: DataFrame,
    json_name: str = "byte_bpe_50k.json",
    ranks_name: str = "byte_bpe_50k.tiktoken",
    model_name: str = "piece_bpe_32k.model",
) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and pairs: each linked pair of ids once with its
    number of links there. Links are the overlaps that end together."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(json_name, ranks_name, model_name)
        decimal = [f"{i}{sign}" for i in range(max(len(tokens.a_bytes), len(tokens.b_bytes))) for sign in ",|;"]
        for batch in batches:
            for begin, texts in _batches(batch.column(1)):
                x = Aligned(tokens, texts)
                hashes = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in x.group_texts(decimal)]
                codes = x.a[x.last_a] * ID_SPAN + x.b[x.last_b]
                owners = np.repeat(np.arange(len(texts)), np.diff(x.first_group))
                order = np.lexsort((codes, owners))
                codes, owners = codes[order], owners[order]
                new = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (owners[1:] != owners[:-1])])[: len(codes)])
                times = np.diff(np.concatenate([new, [len(codes)]]))
                offsets = np.searchsorted(owners[new], np.arange(len(texts) + 1)).astype(np.int32)
                struct = pa.StructArray.from_arrays([pa.array(codes[new]), pa.array(times.astype(np.int32))], ["pair", "k"])
                n_groups = np.diff(x.first_group).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, len(texts)),
                        pa.array(np.diff(x.first_a)),
                        pa.array(np.diff(x.first_b)),
                        pa.array(n_groups),
                        pa.array(np.bincount(owners, minlength=len(texts)).astype(np.int64)),
                        pa.array(hashes, pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets), struct),
                    ],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair:bigint,k:int>>"
    return docs.select("doc_id", "text").mapInArrow(link, schema)


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, n (links of the pair in all documents), best (whether no other pair of its b id has more). Documents hold
    their pairs once, and tasks add them up before they are shuffled."""
    counts = linked.select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.sum("p.k").alias("n"))
    counts = write_shared(counts, "pair_counts")
    b = F.pmod("pair", F.lit(ID_SPAN)).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_quality(docs: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS, **tokenizers: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document.

    n_best: links whose pair is the corpus's most frequent one of its b id (ties count); count_sum: sum over links of their
    pairs' counts. Documents are tokenised and aligned once, into a stored table. The counts of pairs are joined by
    broadcast if they are at most `broadcast_pairs`, else by shuffle; the result is the same. Odd rows: as by
    `align_tokens`; documents without tokens have zeros and an empty digest. Empty table: no rows.
    """
    linked = write_shared(linked_documents(docs, **tokenizers), "linked")
    counts = write_shared(pair_counts(linked), "pairs")
    small = counts.count() <= broadcast_pairs
    numbered = linked.withColumn("row", F.monotonically_increasing_id())
    each = numbered.select("row", F.explode("pairs").alias("p")).select("row", "p.pair", "p.k")
    joined = each.join(F.broadcast(counts) if small else counts, "pair")
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("best"), F.sum(F.col("k") * F.col("n")).alias("total")
    )
    zero = F.lit(0).cast("long")
    return numbered.drop("pairs").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("best", zero).alias("n_best"), F.coalesce("total", zero).alias("count_sum"), "groups_sha256"
    )
