"""Toxicity scores from a weighted lexicon that is learned, folded and matched in one pass over each text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log, log1p, sqrt

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the lexicon and the scale of scores are fitted on, at most (those of least hash).
MAX_TRAINING = 20_000
#: A term must be in this share of the toxic documents, so that groups of copies make no terms. This also bounds the
#: terms: a document with w words has part in at most 6 w of them.
LEAST_SHARE = 0.012
#: Shortest and longest word beginning that may become a term of its own.
STEMS = range(4, 9)
#: Digits and look-alike letters, each with the letter it stands for. l and i are one letter after folding.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i"}
CYRILLIC = {
    "а": "a",
    "в": "b",
    "е": "e",
    "к": "k",
    "м": "m",
    "н": "h",
    "о": "o",
    "р": "p",
    "с": "c",
    "т": "t",
    "у": "y",
    "х": "x",
    "і": "i",
    "ѕ": "s",
    "ј": "j",
    "ԁ": "d",
    "ԛ": "q",
    "ѡ": "w",
}
GREEK = {"α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w"}
#: Symbols that stand for letters between letters.
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "i"}
INSIDE = re.compile(r"(?<=[^\W_])[@$!|€£](?=[^\W_])")
ZERO_WIDTH = "­​‌‍⁠﻿"


def fold_table() -> dict[int, str]:
    """Character -> folded character: lower case, accents off, look-alikes and digits to letters, all else to a blank."""
    table: dict[int, str] = {}
    for code in [
        *range(0x250),
        *range(0x370, 0x530),
        *range(0x1E00, 0x2000),
        *range(0x2000, 0x2070),
        *range(0x20A0, 0x20D0),
        *range(0x2100, 0x2200),
        *range(0xFF00, 0xFFF0),
        *range(0x1D400, 0x1D800),
    ]:
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        c = unicodedata.normalize("NFD", c)[:1] if c[:1] not in CYRILLIC and c[:1] not in GREEK else c[:1]
        c = CYRILLIC.get(c) or GREEK.get(c) or c
        c = DIGITS.get(c, c)
        table[code] = c if c.isalnum() else " "
    table.update({ord(c): "" for c in ZERO_WIDTH})
    return table


FOLD = fold_table()


def fold(text: str) -> str:
    """Folded words, parted and framed by blanks."""
    text = INSIDE.sub(lambda m: SYMBOLS[m[0]], text)
    return " " + text.translate(FOLD) + " "


@dataclass
class Lexicon:
    """Terms (a blank, then a word beginning; a blank at the end too if it is a whole word) with weights; exception phrases; the scale of scores."""

    weights: dict[str, float] = field(default_factory=dict)
    phrases: list[str] = field(default_factory=list)
    scale: tuple[float, ...] = (-3.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.phrases:
            found.add_word(phrase, (len(phrase), 0.0))
        found.make_automaton()
        return found

    def features(self, matcher, text: str) -> tuple[float, float]:
        """Weight of the hits outside exception phrases: its logarithm, and per square root of the words."""
        folded = fold(text)
        if not len(matcher):
            return 0.0, 0.0
        hits, excused = [], []
        for end, (length, weight) in matcher.iter(folded):
            (hits if weight else excused).append((end + 1 - length, end + 1, weight))
        total = sum(_outside(hits, excused)) if excused else sum(x[2] for x in hits)
        return log1p(total), total / sqrt(1.0 + folded.count(" ")) if total else 0.0

    def score(self, matcher, text: str) -> float:
        a, b = self.features(matcher, text)
        z = self.scale[0] + self.scale[1] * a + self.scale[2] * b
        return 1 / (1 + exp(-z)) if z > -700 else 0.0


def _outside(hits: list[tuple[int, int, float]], excused: list[tuple[int, int, float]]) -> Iterator[float]:
    """Weights of the hits that lie in no excused span: both in order of their beginnings, so the furthest end of the
    spans that begin no later decides."""
    excused.sort()
    k, furthest = 0, -1
    for begin, end, weight in sorted(hits):
        while k < len(excused) and excused[k][0] <= begin:
            furthest = max(furthest, excused[k][1])
            k += 1
        if end > furthest:
            yield weight


def _significance(toxic: float, clean: float, toxic_docs: int, clean_docs: int) -> tuple[float, float]:
    """Log odds of a term with smoothing, and these over their standard error."""
    odds = log((toxic + 0.5) / (toxic_docs - toxic + 0.5)) - log((clean + 0.5) / (clean_docs - clean + 0.5))
    return odds, odds / sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def _terms_of(text: str) -> set[str]:
    words = set(fold(text).split())
    return {f" {w} " for w in words if 3 <= len(w) <= 40} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


def _document_counts(training: DataFrame, terms_of) -> DataFrame:
    """term, toxic and clean documents that have it; summed in each batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                counts[toxic.as_py()].update(terms_of(text.as_py()))
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(terms, pa.string()),
                    pa.array([counts[1][t] for t in terms], pa.int64()),
                    pa.array([counts[0][t] for t in terms], pa.int64()),
                ],
                ["term", "toxic", "clean"],
            )

    partial = training.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long")
    return partial.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> Lexicon:
    """Fit terms, exception phrases and scale on labelled documents (at most max_training of them, by hash of doc_id).

    A term is a word or word beginning that toxic documents have significantly more often; of beginnings that continue
    each other only the most significant is kept. An exception phrase is a term with the word before or after it that
    clean documents have at least as often as toxic ones. The scale is a logistic fit of the two features.
    Copies of a text count once; unlabelled documents and null texts are left out. With no toxic or no clean document the lexicon is empty.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training)
    training = docs.where("text is not null").select("doc_id", "text").join(known, "doc_id").select("text", "toxic").dropDuplicates()
    training = training.persist()
    try:
        sizes = {r["toxic"]: r["count"] for r in training.groupBy("toxic").count().collect()}
        toxic_docs, clean_docs = sizes.get(1, 0), sizes.get(0, 0)
        if not toxic_docs or not clean_docs:
            return Lexicon()
        least = max(3, round(LEAST_SHARE * toxic_docs))
        share = clean_docs / toxic_docs
        frequent = _document_counts(training, _terms_of).where(F.col("toxic") >= least).where(
            F.col("toxic") * F.lit(share) > 4 * F.col("clean")
        )
        ranked = frequent.collect()
        scored = sorted(((z, r["term"], odds) for r in ranked for odds, z in [_significance(r["toxic"], r["clean"], toxic_docs, clean_docs)] if z > 3.5), key=lambda x: (-round(x[0], 6), len(x[1]), x[1]))
        weights: dict[str, float] = {}
        beginnings: set[str] = set()
        for _, term, odds in scored:
            stem = term.rstrip()
            if stem not in beginnings and not any(stem[:k] in weights for k in range(2, len(stem) + 1)) and term not in weights:
                weights[term] = odds
                beginnings.update(stem[:k] for k in range(2, len(stem) + 1))
        lexicon = Lexicon(weights)
        matcher = lexicon.automaton() if weights else None

        def phrases_of(text: str) -> set[str]:
            folded, found = fold(text), set()
            for end, (length, _) in matcher.iter(folded):
                start, stop = end + 1 - length, folded.find(" ", end)
                word = folded[start : stop + 1]
                before = folded[folded.rfind(" ", 0, start) + 1 : start]
                after = folded[stop + 1 : folded.find(" ", stop + 1)]
                found |= {f" {before}{word}"} if before else set()
                found |= {f"{word}{after} "} if after else set()
            return found

        if weights:
            excused = _document_counts(training, phrases_of).where(F.col("clean") >= 3).where(
                F.col("clean") >= F.col("toxic") * F.lit(share)
            ).collect()
            lexicon.phrases = sorted(r["term"] for r in excused)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = lexicon.automaton()
            for batch in batches:
                both = [lexicon.features(matcher, x.as_py()) for x in batch.column(0)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in both], pa.float64()),
                        pa.array([x[1] for x in both], pa.float64()),
                        batch.column(1),
                    ],
                    ["a", "b", "toxic"],
                )

        rows = training.mapInArrow(measure, "a double, b double, toxic int").collect()
        lexicon.scale = _logistic(np.array([[1, r["a"], r["b"]] for r in rows]), np.array([r["toxic"] for r in rows]))
        return lexicon
    finally:
        training.unpersist()


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, penalty: float = 0.05) -> tuple[float, ...]:
    """Newton steps for a logistic fit with a small penalty on the slopes."""
    w, ridge = np.zeros(x.shape[1]), penalty * np.diag([1e-3, 1, 1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return tuple(float(v) for v in w)


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1) of each document; whole texts, one pass of the automaton over each.

    Null and empty texts have no hits and get the score of such texts. Null doc_ids and repeated rows are scored like
    others. Empty table: no rows. Columns other than doc_id and text are ignored.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([lexicon.score(matcher, x.as_py() or "") for x in batch.column(1)], pa.float64()),
                ],
                ["doc_id", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def reject_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns in place.

    Null and empty texts have the score of texts without hits. Null doc_ids and repeated rows are judged like others.
    Empty table: no rows. Other columns may have any names.
    """
    columns, names = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.automaton()
        for batch in batches:
            yield batch.filter(pa.array([lexicon.score(matcher, x.as_py() or "") < threshold for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, names)
