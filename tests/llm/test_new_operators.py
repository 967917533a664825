"""Whitening, token alignment and decontamination against brute force on whole small tables, and on odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from unitweave.llm import alignment, contamination, queries, whitening

SCHEMA = "doc_id long, text string, a string, items string, spans long, n_words int"
VECTORS = "vec_id long, embedding array<float>, x int, n string, component string"


def doc_rows(spark, texts):
    return spark.createDataFrame([(k if k != 2 else None, t, "clash", "clash", 5, 6) for k, t in enumerate(texts)], SCHEMA)


# Whitening.
def dense(rows):
    """Distinct vectors, mean, eigenvalues and vectors of the covariance, by numpy."""
    x = np.unique(np.array(rows, dtype=np.int64), axis=0)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return x, x.mean(axis=0), values[::-1], vectors[:, ::-1]


def test_whitening_equals_dense_eigenvectors(spark, sf):
    given = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = {r.vec_id: np.floor(256 * np.array(r.embedding, dtype=np.float64)).astype(np.int64) for r in given.collect()}
    x, mean, values, vectors = dense(list(rows.values()))
    found = queries.op11_whiten_embeddings(spark, sf).toPandas()
    assert len(found) == 4 * len(rows) and set(found.n) == {len(x)}
    assert np.allclose(found.groupby("component").explained.first(), values[:4] / values.sum(), rtol=1e-10)
    assert found.identity_error.nunique() == 1 and found.identity_error.max() < 1e-9
    sums = [int(s) for s in x.sum(axis=0)]
    for component, part in found.groupby("component"):
        want = np.array([(rows[v] - mean) @ vectors[:, component - 1] for v in part.vec_id]) / np.sqrt(values[component - 1])
        sign = np.sign(want @ part.whitened.to_numpy())
        assert np.abs(part.whitened.to_numpy() * sign - want).max() < 1e-9
        assert part.deviation.tolist() == [sum((len(x) * int(v) - s) ** 2 for v, s in zip(rows[k], sums, strict=True)) for k in part.vec_id]


@pytest.mark.parametrize("d, n, rank", [(1, 9, 1), (3, 50, 3), (5, 4, 3), (30, 200, 2), (40, 300, 40)])
def test_whitening_of_small_and_degenerate_tables(spark, d, n, rank):
    rng = np.random.default_rng(d)
    x = rng.integers(-40, 40, (n, rank)) @ rng.integers(-3, 4, (rank, d))
    given = spark.createDataFrame([(k, [float(v) / 256 for v in row], 1, "n", "c") for k, row in enumerate(x)], VECTORS)
    fitted = whitening.fit_whitening(given)
    distinct, mean, values, vectors = dense(x)
    k = min(4, int(np.sum(values > 1e-9 * max(values[0], 1e-300))))
    assert fitted.n == len(distinct) and len(fitted.values) == k
    assert np.allclose(fitted.values, values[:k], rtol=1e-9) and fitted.identity_error < 1e-8
    gaps = np.abs(np.diff(np.append(values, 0)))[:k]
    for j in range(k):
        if gaps[j] > 1e-3 * values[0] and (j == 0 or gaps[j - 1] > 1e-3 * values[0]):
            assert abs(abs(fitted.vectors[:, j] @ vectors[:, j]) - 1) < 1e-10
    assert whitening.whiten(given, fitted).count() == k * n


def test_whitening_of_odd_rows(spark):
    good = [(k, [float(k % 5), float(k % 7), k / 512], k, "n", "c") for k in range(60)]
    odd = [
        (100, None, 1, "n", "c"), (101, [], 1, "n", "c"), (102, [1.0, None, 2.0], 1, "n", "c"), (103, [1.0, float("nan"), 2.0], 1, "n", "c"),
        (104, [float("inf"), 0.0, 2.0], 1, "n", "c"), (105, [1.0, 2.0], 1, "n", "c"), (106, [3e38, 0.0, 0.0], 1, "n", "c"),
    ]
    more = [(None, [0.0, 1.0, 2.0], 1, "n", "c"), (7, good[7][1], 1, "n", "c"), (7, good[7][1], 1, "n", "c")]
    given = spark.createDataFrame(good + odd + more, VECTORS)
    found = whitening.whiten(given, whitening.fit_whitening(given)).toPandas()
    counts = Counter(None if np.isnan(v) else int(v) for v in found.vec_id)
    assert counts == Counter({**{k: 3 for k in range(60)}, 7: 9, None: 3})
    assert not found.duplicated().all() and set(found.component) == {1, 2, 3}
    nothing = spark.createDataFrame(odd[:2], VECTORS)
    assert whitening.fit_whitening(nothing) is None and whitening.whiten(nothing, None).count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0], 1, "n", "c") for k in range(9)], VECTORS)
    assert whitening.whiten(same, whitening.fit_whitening(same)).count() == 0


def test_deviations_are_exact_beyond_floats():
    sums = np.array([3 * 10**8, -5], dtype=object)
    x = np.array([[2**31, -7], [5, 5]], dtype=np.int64)
    n = 10**9
    want = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert whitening._deviations(x, n, sums) == [None if w >= 2**63 else w for w in want]
    assert whitening._deviations(x[1:], 10, sums) == [sum((10 * int(v) - int(s)) ** 2 for v, s in zip(x[1], sums, strict=True))]


# Token alignment.
@pytest.fixture(scope="module")
def sides():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return first, second


def byte_level():
    """Bytes of the characters in which a byte-level vocabulary is written."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def tokens_of(sides, text):
    """(id, begin, end) of both sides' tokens, straight from the two libraries."""
    if not text:
        return [], []
    first, second = sides
    spelt, letters, out = (" " + text).encode(), byte_level(), []
    ids = first.encode(" " + text, add_special_tokens=False).ids
    a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in ids]
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()))
    if any(b"".join(x[1] for x in side) != spelt for side in (a, b)):
        return [], []
    for side in (a, b):
        at, placed = 0, []
        for i, raw in side:
            placed.append((i, at, at + len(raw)))
            at += len(raw)
        out.append(placed)
    return out


def brute_links(sides, texts):
    aligned, counts = [], Counter()
    for text in texts:
        a, b = tokens_of(sides, text)
        ends = {e: i for i, _, e in b}
        links = [(i, ends[e]) for i, _, e in a if e in ends]
        counts.update(links)
        aligned.append((a, b, sorted({e for *_, e in a} & {e for *_, e in b}), links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    rows = []
    for a, b, cuts, links in aligned:
        groups = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= high) for side in (a, b)))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(cuts), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", "a", "a", " ", "  two  blanks ", "tab\tline\n\nend \n", "<|endoftext|> <s> </s> <unk>", "▁not spelt", "<0x41> \x00 nul", "é😀 日本語 ÄÖ " * 3,
    "word " * 3000, "x" * 5000, " ".join(f"w{i}" for i in range(4000)),
]


def test_alignment_equals_both_libraries(spark, sf, sides):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = Counter(zip([d.doc_id for d in docs], *zip(*brute_links(sides, [d.text for d in docs]), strict=True), strict=True))
    assert Counter(map(tuple, queries.op12_align_tokenizers(spark, sf).select("doc_id", *COLUMNS).collect())) == want


def test_alignment_of_odd_rows_by_broadcast_and_by_shuffle(spark, sides):
    want = Counter(brute_links(sides, ODD))
    docs = doc_rows(spark, ODD)
    for limit in (0, 10**6):
        found = alignment.link_quality(docs, broadcast_pairs=limit)
        assert Counter(map(tuple, found.select(*COLUMNS).collect())) == want
    assert found.where("doc_id is null").count() == 1
    assert alignment.link_quality(docs.limit(0)).count() == 0


def test_overlaps_equal_all_pairs(spark, sides):
    found = {r.doc_id: r for r in alignment.align_tokens(doc_rows(spark, ODD[:11])).collect()}
    for k, text in enumerate(ODD[:11]):
        a, b = tokens_of(sides, text)
        row = found[k if k != 2 else None]
        assert (row.a, row.b) == ([x[0] for x in a], [x[0] for x in b])
        shared = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
        assert [tuple(p) for p in row.overlaps] == shared
        assert [tuple(p) for p in row.groups] == [(i, j) for i, j in shared if a[i][2] == b[j][2]]


# Decontamination.
def test_index_equals_plain_search():
    rng = np.random.default_rng(5)
    for _ in range(60):
        most = int(rng.integers(1, 12))
        text = np.concatenate([np.append(rng.integers(1, most + 1, int(rng.integers(1, 40))), 0) for _ in range(int(rng.integers(1, 8)))])
        index = contamination.FMIndex(text, most, int(rng.integers(1, 9)))
        assert contamination.suffix_order(text[:-1]).tolist() != [] or len(text) == 1
        patterns = [rng.integers(1, most + 1, int(rng.integers(1, 6))) for _ in range(20)]
        matrix = np.zeros((20, 6), dtype=np.int64)
        for row, p in zip(matrix, patterns, strict=True):
            row[6 - len(p) :] = p
        for p, low, high in zip(patterns, *index.search(matrix, np.array([len(p) for p in patterns])), strict=True):
            plain = [k for k in range(len(text) - len(p) + 1) if (text[k : k + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(low, max(low, high))).tolist()) == plain


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(texts, items, width=10):
    windows = {}
    for item, text in items:
        words = plain_words(text)
        for k in range(max(1, len(words) - width + 1) if words else 0):
            windows.setdefault(tuple(words[k : k + width]), set()).add(item)
    out = []
    for text in texts:
        words, hit, found = plain_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if (w := tuple(words[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[w]
        out.append((len(words), sorted(hit), sorted(str(x) for x in found if x is not None)))
    return out


def hit_words(row):
    return [k for s in row.spans for k in range(s.begin, s.end)]


def test_contamination_equals_plain_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = contamination.find_contamination(docs, items).collect()
    want = brute_contamination([r.text for r in rows], [(r.item_id, r.text) for r in items.collect()])
    assert [(r.n_words, hit_words(r), r.items) for r in rows] == want
    assert any(r.spans for r in rows) and len(rows) == docs.count()


def test_contamination_of_odd_rows(spark, monkeypatch):
    common = " ".join(f"w{k % 7}" for k in range(400))
    texts = [
        None, "", common, common, "W0 w1, W2!", "é日本 über straße x", " - . ", "one two", "x " + common + " y", "w1 w2 w3 w4 w5 w6 w0 w1 w2", "über", "ÜBER", "Long " * 3000,
    ]
    items = [(1, "w1 w2 w3 w4 w5 w6 w0 w1 w2 w3 w4"), (2, "Über"), (2, "one"), (None, "straße"), (4, None), (5, ""), (6, "..."), (7, "w0 w1"), (7, "w0 w1"), (8, "long " * 12), (9, "W1 W2 w3 w4 w5 w6 w0 w1 w2 w3")]
    docs = doc_rows(spark, texts)
    bench = spark.createDataFrame([(*x, "clash", 3) for x in items], "item_id long, text string, doc_id string, spans int")
    want = brute_contamination(texts, items)
    ids = [k if k != 2 else None for k in range(len(texts))]
    for words in (10**6, 12, 3):  # one block, several, many: the passes add up
        monkeypatch.setattr(contamination, "BLOCK_WORDS", words)
        monkeypatch.setattr(contamination, "PIECE", 4)
        rows = contamination.find_contamination(docs, bench).collect()
        assert {r.doc_id: (r.n_words, hit_words(r), r.items) for r in rows} == dict(zip(ids, want, strict=True)) and len(rows) == len(ids)
    assert all(a.end < b.begin for r in rows for a, b in zip(r.spans, r.spans[1:], strict=False))
    none = contamination.find_contamination(docs, bench.limit(0)).collect()
    assert [(r.n_words, r.spans, r.items) for r in none] == [(n, [], []) for n, *_ in want]
    assert contamination.find_contamination(docs.limit(0), bench).count() == 0


def test_long_stretches_are_indexed_in_overlapping_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    block = contamination.windows_of([(str(k), [f"w{x}" for x in rng.integers(0, 3, n)]) for k, n in enumerate((12, 9, 4, 10))])
    texts = [rng.integers(0, 4, n) for n in (0, 3, 700, 90)]
    for size in (10, 23, 10**6):
        monkeypatch.setattr(contamination, "SHARD_WORDS", size)
        shard, found = contamination.Shard(block), set()
        for k, text in enumerate(texts):
            for more in shard.add(k, np.array([block.symbols.get(b"w%d" % x, 0) for x in text], dtype=np.int64)):
                found |= set(more)
        found |= set(shard.matches())
        want = set()
        for j, (w, n) in enumerate(zip(block.windows, block.lengths.tolist(), strict=True)):
            for k, text in enumerate(texts):
                ids = [block.symbols.get(b"w%d" % x, 0) for x in text]
                want |= {(k, i, i + n, j) for i in range(len(ids) - n + 1) if ids[i : i + n] == w[-n:].tolist()}
        assert found == want and want


def test_cutting_out_keeps_the_rest(spark):
    docs = doc_rows(spark, ["Keep THIS, then (one; two) three. And é that", None, "one two three", "clean text"])
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    found = [(r.text, r.n_hit) for r in contamination.decontaminate(docs, bench).collect()]
    assert found == [("Keep THIS, then ( . And é that", 3), (None, 0), (" ", 3), ("clean text", 0)]
