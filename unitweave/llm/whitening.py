"""Whitening of embeddings on their leading principal components, found by Chebyshev-filtered subspace iteration.

Vectors are rounded to integers first, so that counts, sums and deviations are exact. The covariance is never formed: each
pass over the fit list multiplies it, centred row by row, with a thin block, and only sums of the block's size leave a
task. The driver holds blocks of dimensions times columns, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import write_shared

#: Columns of the iterated block beyond the wanted components; how many of them are drawn anew in each round.
GUARD, FRESH = 8, 2
#: Applications of the covariance by one filter; least and most rounds.
DEGREE, LEAST_ROUNDS, MOST_ROUNDS = 8, 3, 60
#: A component is certified when its residual is below this share of the largest eigenvalue. Eigenvalues below the
#: second share of the largest are taken for 0: nothing can be scaled by them.
RESIDUAL, NOTHING = 2e-14, 1e-12
#: Vectors of a stored block hold as many bytes together.
BLOCK_BYTES = 1 << 20
TYPES = ("<i1", "<i2", "<i4", "<i8")


@dataclass
class Whitening:
    """n vectors with per-dimension sums; unit eigenvectors as columns by falling eigenvalue; the trace; residuals as
    shares of the largest eigenvalue; passes made over the fit list; identity_error of the whitened fit list."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float


def quantised(batch_column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which rows have a vector of finite entries, and each such row's floor(scale * entry) as long.

    Entries whose product leaves the range of a long count as not finite.
    """
    lists = batch_column
    size = len(lists)
    good = np.zeros(size, dtype=bool)
    found: list[np.ndarray | None] = [None] * size
    offsets = lists.offsets.to_numpy()
    values = lists.values.cast(pa.float64())
    entries = values.to_numpy(zero_copy_only=False)  # null entries are NaN here
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(entries * scale)
        fits = np.isfinite(entries) & (np.abs(scaled) < 2.0**63)
    bad = np.concatenate([[0], np.cumsum(~fits)])
    x = np.where(fits, scaled, 0).astype(np.int64)
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    for k in range(size):
        a, b = offsets[k], offsets[k + 1]
        if valid[k] and b > a and bad[a] == bad[b]:
            good[k] = True
            found[k] = x[a:b]
    return good, found


def packed(x: np.ndarray) -> bytes:
    """The vector in the narrowest integers that hold it, after a byte that tells which; equal vectors, equal bytes."""
    least, most = int(x.min()), int(x.max())
    kind = next(k for k, t in enumerate(TYPES) if np.iinfo(t).min <= least and most <= np.iinfo(t).max)
    return bytes([kind]) + x.astype(TYPES[kind]).tobytes()


def _fit_list(vectors: DataFrame, column: str, scale: int) -> DataFrame:
    """Each distinct vector once: d, x (packed). Equal vectors meet after partial aggregation, however many there are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found = quantised(batch.column(0), scale)
            kept = {packed(x): len(x) for x in found if x is not None}
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept.values(), pa.int32()), pa.array(kept.keys(), pa.binary())], ["d", "x"]
            )

    rows = vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(pack, "d int, x binary")
    return rows.distinct()


def _blocks(fit: DataFrame, d: int) -> DataFrame:
    """The fit list as blocks: rows, kind, body, and their exact sums in a high and a low part (of 32 bits each)."""

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[bytes]] = {k: [] for k in range(len(TYPES))}

        def block(kind: int) -> pa.RecordBatch:
            body = b"".join(waiting[kind])
            x = np.frombuffer(body, TYPES[kind]).reshape(-1, d).astype(np.int64)
            sums = [(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]
            waiting[kind] = []
            return pa.RecordBatch.from_arrays(
                [pa.array([len(x)], pa.int64()), pa.array([kind], pa.int32()), pa.array([body], pa.binary()), *(pa.array([s.tolist()], pa.list_(pa.int64())) for s in sums)],
                ["rows", "kind", "body", "high", "low"],
            )

        for batch in batches:
            for x in batch.column(0):
                kind = x.as_py()[0]
                waiting[kind].append(x.as_py()[1:])
                if len(waiting[kind]) * d * int(TYPES[kind][2]) >= BLOCK_BYTES:
                    yield block(kind)
        for kind in waiting:
            if waiting[kind]:
                yield block(kind)

    return fit.select("x").mapInArrow(stack, "rows long, kind int, body binary, high array<long>, low array<long>")


def _centred(batch: pa.RecordBatch, mean: np.ndarray) -> Iterator[np.ndarray]:
    for kind, body in zip(batch.column(0), batch.column(1), strict=True):
        yield np.frombuffer(body.as_py(), TYPES[kind.as_py()]).reshape(-1, len(mean)).astype(np.float64) - mean


def _summed(blocks: DataFrame, mean: np.ndarray, make, width: int, height: int) -> np.ndarray:
    """Sum over all blocks of make(centred block), an array of height x width. Each task gives one such array, and Spark
    adds them up by row; what is collected has as many rows as the array."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for batch in batches:
            for x in _centred(batch, mean):
                total += make(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(height), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"]
        )

    rows = blocks.select("kind", "body").mapInArrow(partial, "i int, v array<double>")
    added = rows.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"c{j}") for j in range(width)])
    out = np.zeros((height, width))
    for i, *v in added.collect():
        out[i] = v
    return out


def fit_whitening(vectors: DataFrame, components: int = 4, column: str = "embedding", scale: int = 256, seed: int = 0) -> Whitening | None:
    """Leading components of the distinct rounded vectors, or None if there is no vector.

    One dimension is whitened: the length that most distinct vectors have (of equally frequent ones the greatest).
    Fewer components are found if the covariance has fewer positive eigenvalues.

    A round applies a Chebyshev polynomial of the covariance to the block, by its three-term recurrence, one pass a term;
    it is scaled to stay small on the unwanted part of the spectrum, from 0 to the least Ritz value of the block, and to
    grow beyond it. QR and Rayleigh-Ritz then turn the block into Ritz vectors. The last columns are random in each
    round, so that no direction is left out for good. It ends when all wanted residuals are below RESIDUAL of the
    largest eigenvalue in the third round or later, or fail to shrink any more there. A residual bounds the error of an
    eigenvalue, and over the gap to the next one that of an eigenvector.
    """
    fit = write_shared(_fit_list(vectors, column, scale), "fit_list")
    lengths = fit.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d, n = lengths[0]
    blocks = write_shared(_blocks(fit.where(F.col("d") == d), d), "fit_blocks")
    parts = blocks.select(F.posexplode(F.arrays_zip("high", "low")).alias("i", "s")).groupBy("i").agg(F.sum("s.high"), F.sum("s.low")).collect()
    sums = np.zeros(d, dtype=object)
    for i, high, low in parts:
        sums[i] = (high << 32) + low
    mean = np.array([s / n for s in sums])
    trace = float(_summed(blocks, mean, lambda x: np.array([[np.einsum("ij,ij->", x, x)]]), 1, 1)[0, 0]) / n
    wanted, passes = min(components, d), 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return _summed(blocks, mean, lambda x: x.T @ (x @ q), q.shape[1], d) / n

    def ritz(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = np.linalg.qr(q)[0]
        aq = times(q)
        h = q.T @ aq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        return values[::-1], q @ turn[:, ::-1], aq @ turn[:, ::-1]

    rng = np.random.default_rng(seed)
    width = min(d, wanted + GUARD)
    values, q, aq = ritz(rng.standard_normal((d, width)))
    best, stuck = np.inf, 0
    for turn in range(MOST_ROUNDS):
        top = max(float(values[0]), 0.0)
        residuals = np.linalg.norm(aq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0) / (top or 1.0)
        worst = float(residuals.max())
        stuck = stuck + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if not top or width == d or turn >= LEAST_ROUNDS and (worst <= RESIDUAL or worst <= NOTHING and stuck >= 2):
            break
        keep = width - FRESH
        fresh = rng.standard_normal((d, FRESH))
        fresh -= q[:, :keep] @ (q[:, :keep].T @ fresh)
        block = np.linalg.qr(np.column_stack([q[:, :keep], fresh]))[0]
        edge = float(values[keep - 1])
        if edge <= NOTHING * top:  # the rest of the spectrum is nothing: one plain pass tells it
            values, q, aq = ritz(np.column_stack([q[:, :keep], times(block)[:, keep:]]))
            continue
        half = edge / 2
        sigma = first = half / (top - half)
        before, now = block, (times(block) - half * block) * (first / half)
        for _ in range(2, DEGREE + 1):
            following = 1 / (2 / first - sigma)
            before, now = now, (times(now) - half * now) * (2 * following / half) - sigma * following * before
            sigma = following
        values, q, aq = ritz(now)
    else:
        raise ValueError(f"not certified after {MOST_ROUNDS} rounds: residual {worst:.2g} of the largest eigenvalue")
    wanted = int(np.sum(values[:wanted] > NOTHING * top))
    scaled = q[:, :wanted] / np.sqrt(values[:wanted]) if wanted else q[:, :0]
    error = 0.0
    if wanted:
        both = _summed(blocks, mean, lambda x: np.vstack([(w := x @ scaled).T @ w, w.sum(axis=0)]), wanted, wanted + 1) / n
        error = float(np.abs(both[:-1] - np.outer(both[-1], both[-1]) - np.eye(wanted)).max())
    return Whitening(n, sums, q[:, :wanted], values[:wanted], trace, residuals[:wanted], passes, error)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - sums) squared, exact; null beyond the range of a long."""
    most = max(abs(int(x.min())), abs(int(x.max())), 1) if x.size else 1
    if (n * most + max(abs(s) for s in sums)) ** 2 * len(sums) < 2**62:
        y = n * x - sums.astype(np.int64)
        return np.einsum("ij,ij->i", y, y).tolist()
    found = (((n * x.astype(object) - sums) ** 2).sum(axis=1)).tolist()
    return [v if v < 2**63 else None for v in found]


def whiten(vectors: DataFrame, fitted: Whitening | None, column: str = "embedding", scale: int = 256, id_column: str = "vec_id") -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty, have null or non-finite entries, or have another length than the fitted ones give no
    rows; so does every vector if nothing was fitted or all distinct vectors are one. Null ids and repeated rows are
    whitened like others. Columns other than the id and the vectors are ignored. A deviation past the range of a long
    is null.
    """
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if fitted is None or not len(fitted.values):
                continue
            d, k = fitted.vectors.shape
            good, found = quantised(batch.column(1), scale)
            at = [i for i in np.flatnonzero(good) if len(found[i]) == d]
            x = np.array([found[i] for i in at], dtype=np.int64).reshape(-1, d)
            y = (x - np.array([s / fitted.n for s in fitted.sums])) @ fitted.vectors / np.sqrt(fitted.values)
            m = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.array(at, dtype=np.int64), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fitted.n, dtype=np.int64)),
                    pa.array([v for v in _deviations(x, fitted.n, fitted.sums) for _ in range(k)], pa.int64()),
                    pa.array(y.reshape(-1)),
                    pa.array(np.tile(fitted.values / fitted.trace, m)),
                    pa.array(np.full(m * k, fitted.identity_error)),
                ],
                names,
            )

    picked = vectors.select(F.col(id_column), F.col(column).cast("array<double>").alias("_uw_vector"))
    return picked.mapInArrow(apply, schema)
