"""Secret scans: patterns, and values near credential words that would take many guesses."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache
from hashlib import sha256
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import write_shared

#: The patterns of the base kinds, in order. Runs below the least length can't hold a match of it.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
#: Words that make a value a candidate, in four languages, and what may part them: a sign, "is" and its like, or white
#: space. A value in quotes ends at its quote, another one at white space or a quote.
CONTEXT = re.compile(
    r"""(?<![^\W_])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|authorization|bearer|(?:api|access|private|client|auth)[_\x20-]?key"""
    r"""|passwort|kennwort|geheimnis|zugangscode|schlüssel|contraseña|clave|secreto|mot\x20de\x20passe|mdp|jeton|clé)["'“”]?"""
    r"""(\s*[:=]\s*|\s+(?:is|ist|lautet|es|est)\s+|\s+)(?:"([^\s"]{8,})"|'([^\s']{8,})'|“([^\s”]{8,})”|["'“]?([^\s"'“”]{8,}))""",
    re.I,
)
CONTEXT_WORDS = (
    "pass", "pwd", "secret", "token", "credential", "authorization", "bearer", "key", "kennwort", "geheimnis", "zugangscode", "schlüssel", "contraseña", "clave", "mdp", "jeton", "clé",
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A value is a secret if it would take at least 10 to this power guesses; if only a blank parts it from the word before,
#: 10 to the second power.
LEAST_GUESSES, LEAST_GUESSES_LOOSE = 10.0, 14.0
#: The dictionary takes words that make at least one in so many of all words of a corpus, so it has at most so many.
RAREST = 50_000
#: Walks and repeats are offered at every length up to the first, and at their whole length; longest block of a repeat.
LONGEST, BLOCK = 64, 8
#: Common parts of passwords and placeholders, most common first; the words of the corpus rank behind them.
WORDS = (
    "password pass admin test user login welcome letmein qwerty dragon monkey master secret token example sample changeme default demo hello "
    "love sunshine princess football baseball shadow root guest public private key access temp value your my the null none true false "
    "undefined placeholder dummy foo bar baz string text data config server client api app dev prod stage local host mail com org net http https www"
).split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("0134578@$!", "oieastbasi")


@lru_cache(maxsize=1)
def neighbours() -> dict[str, set[str]]:
    """Keys that touch on the keyboard: left and right, and the two below (each row is set half a key to the right)."""
    near: dict[str, set[str]] = {}
    for y, row in enumerate(KEYBOARD):
        for x, c in enumerate(row):
            near.setdefault(c, set()).update(row[max(0, x - 1) : x] + row[x + 1 : x + 2])
            if y + 1 < len(KEYBOARD):
                shift = 1 if y == 0 else 0
                for d in KEYBOARD[y + 1][max(0, x - 1 - shift) : max(0, x + 1 - shift)]:
                    near[c].add(d)
                    near.setdefault(d, set()).add(c)
    return near


DATE = re.compile(
    r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d"
)
CUT = log10(2)


def _alphabet(c: str) -> float:
    return log10(10 if c.isdigit() else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33)


@lru_cache(maxsize=1)
def directions() -> dict[str, int]:
    """Two neighbouring keys -> direction of the step: along the row to the right 1, to the left -1, across rows 2."""
    return {a + b: 1 if any(a + b in row for row in KEYBOARD) else -1 if any(b + a in row for row in KEYBOARD) else 2 for a, near in neighbours().items() for b in near}


class GuessCost:
    """log10 of the guesses for a value: the cheapest way to cut it into known spans and brute-force characters.

    Dynamic programming over end positions; every span of every length from each place on is offered. Spans: words of
    the dictionary (rank; twice for capitals, four times for substitutions), dates (days of 120 years), repeats of a
    block of up to BLOCK characters (the block by brute force, times the count), walks on the keyboard (start and
    length, four choices at each turn), runs up or down the alphabet or the digits, single characters by their
    alphabet. Each known span after the first costs a factor of 2 for where to cut. Walks and repeats of more than LONGEST
    characters are offered at their whole length only, so time is in proportion to the value. Empty value: 0.
    """

    def __init__(self, words: Mapping[str, int] | None = None):
        """words: further dictionary words with their ranks, which count behind WORDS."""
        self.ranks = {w: r + len(WORDS) for w, r in (words or {}).items()} | {w: k + 1 for k, w in enumerate(WORDS)}
        self.longest = max(map(len, self.ranks))

    def word(self, part: str, low: str, plain: str) -> float | None:
        if rank := self.ranks.get(low):
            return log10(rank + 1) + (0 if part.islower() else CUT)
        if rank := self.ranks.get(plain):
            return log10(rank + 1) + 2 * CUT
        return None

    def __call__(self, value: str) -> float:
        n, low, steps = len(value), value.lower(), directions()
        plain = low.translate(LEET)
        # how far walks go from each place and their turns to the end, and how long each place goes on like `size` later
        walks, turned, alike = list(range(1, n + 1)), [0] * (n + 1), {size: [0] * (n + 1) for size in range(1, BLOCK + 1)}
        for i in reversed(range(n)):
            if d := steps.get(low[i : i + 2]):
                walks[i] = walks[i + 1]
                turned[i] = turned[i + 1] + (d != steps.get(low[i + 1 : i + 3], 0))
            for size, same in alike.items():
                if i + size < n and value[i] == value[i + size]:
                    same[i] = same[i + 1] + 1
        best = [0.0] + [float("inf")] * n

        def offer(end: int, cost: float):
            if cost < best[end]:
                best[end] = cost

        for i in range(n):
            here = best[i] + (CUT if i else 0.0)
            offer(i + 1, best[i] + _alphabet(value[i]))
            for end in range(i + 3, min(i + self.longest, n) + 1):
                cost = self.word(value[i:end], low[i:end], plain[i:end])
                if cost is not None:
                    offer(end, here + cost)
            if value[i].isdigit():
                for end in (i + 4, i + 8, i + 9, i + 10):
                    if end <= n and DATE.fullmatch(value, i, end):
                        offer(end, here + log10(366 * 120 if end - i > 4 else 120))
            last = min(n, i + LONGEST)
            turns, before, j = 0, 0, i
            while j + 1 < last and (d := steps.get(low[j : j + 2])):
                turns, before, j = turns + (d != before), d, j + 1
                if j - i >= 2:
                    offer(j + 1, here + log10(47 * (j - i + 1)) + turns * log10(4))
            if walks[i] > last:
                offer(walks[i], here + log10(47 * (walks[i] - i)) + (turned[i] - turned[walks[i] - 1]) * log10(4))
            j = i + 1
            if j < last and low[i].isalnum() and (delta := ord(low[j]) - ord(low[i])) in (1, -1):
                while j < last and low[j].isalnum() and ord(low[j]) - ord(low[j - 1]) == delta:
                    j += 1
                    if j - i >= 3:
                        offer(j, here + log10(26 * (j - i)))  # runs have 36 characters at most
            block = 0.0
            for size in range(1, min(BLOCK, n - i) + 1):
                block += _alphabet(value[i + size - 1])
                end, times = i + size, 1
                while end + size <= last and value[end : end + size] == value[i : i + size]:
                    end, times = end + size, times + 1
                    if times >= (3 if size == 1 else 2):
                        offer(end, here + block + log10(times))
                whole = 1 + alike[size][i] // size
                if i + size * whole > last:
                    offer(i + size * whole, here + block + log10(whole))
        return best[n]


def frequent_words(docs: DataFrame, rarest: int = RAREST) -> dict[str, int]:
    """Word (three or more letters a to z, in either case) -> rank, of the words that make at least 1 in `rarest` of
    all such words of the documents. So there are at most `rarest`; only they are collected. Ties rank by the word."""
    words = docs.select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("word")
    ).where(F.regexp_like("word", F.lit("^[a-z]+$")))
    counted = write_shared(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.where(F.col("n") * rarest >= total).collect()
    return {r["word"]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r["n"], r["word"])))}


def find_secrets(text: str, cost: GuessCost) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each span, sorted; kinds by their place in KINDS. Positions are code points."""
    spans = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if any(w in low for w in CONTEXT_WORDS):
        for m in CONTEXT.finditer(text):
            group = m.lastindex
            value = m[group] if group < 5 else m[group].rstrip(".,;:!?)]}>")
            if len(value) >= 8 and cost(value) >= (LEAST_GUESSES if m[1].strip() else LEAST_GUESSES_LOOSE):
                spans.append((m.start(group), 3, m.start(group) + len(value)))
    return sorted(spans)


def scan_secrets(docs: DataFrame, words: Mapping[str, int] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each document; base spans and those of the method.

    words: the dictionary; by default the frequent words of docs themselves.
    Null and empty texts have no spans. Null doc_ids and repeated rows are scanned like others. Empty table: no rows.
    Columns other than doc_id and text are ignored. Very long texts are scanned whole.
    """
    cost = GuessCost(frequent_words(docs) if words is None else words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_secrets(x.as_py() or "", cost) for x in batch.column(1)]
            join = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
            counts = [pa.array([sum(x[1] == k for x in spans) for spans in found], pa.int64()) for k in range(3)]
            base = [sha256(join([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(base, pa.string()), pa.array(list(map(join, found)), pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        scan,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )


def redact(text: str, cost: GuessCost, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for start, _, end in find_secrets(text, cost):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", words: Mapping[str, int] | None = None) -> DataFrame:
    """The documents with each secret span replaced by a mark (overlapping spans by one); n_chars follows the text.

    All rows and columns stay, in place. Null texts stay null, empty ones empty, and null doc_ids, repeated rows and
    other columns as they are. Empty table: no rows. words: as for `scan_secrets`.
    """
    names, at = docs.columns, docs.columns.index("text")
    cost = GuessCost(frequent_words(docs) if words is None else words)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else redact(t, cost, mark) for x in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names and pa.types.is_integer(batch.schema.field("n_chars").type):
                k = names.index("n_chars")
                columns[k] = pa.array(
                    [v.as_py() if t is None else len(t) for v, t in zip(batch.column(k), texts, strict=True)],
                    batch.schema.field(k).type,
                )
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(clean, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
