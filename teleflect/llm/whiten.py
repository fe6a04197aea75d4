"""Embedding whitening by Jacobi-Davidson on a covariance matrix that is never formed.

The fit list holds each distinct vector once, packed in blocks in the shared folder. All that the solver asks of it is
the product of the covariance with a few columns, sum over vectors of (x - mean) ((x - mean) . v) / n, which Spark
computes block by block: every task gives its part of d x columns sums, and these are added up. Vectors stay where they
are; the driver holds the sums, and a search space of d x `most` numbers.

Outer loop: Rayleigh-Ritz in the search space, by falling Ritz values; a pair whose residual has come down to double
precision is locked. For the others, and some guard pairs below them, the correction equation (I - QQ')(V - theta I)(I - QQ')
t = -r, Q all current Ritz vectors that are sought, locked ones among them, is solved by a few steps of MINRES, a step of
all of them in one product. The corrections widen the space, and a full one starts anew from its best Ritz vectors. It
ends when all wanted pairs are locked and the first guard pair is near enough to its end to show that no larger
eigenvalue was passed over.

Vectors that are null, or hold null or non-finite components, take no part, nor do those that have not the most
frequent dimension (ties: the larger). Repeated rows, and different rows with equal vectors, count once in the fit and
each get their result. Components whose eigenvalue is beyond double precision of the first (as with fewer distinct
vectors than components, or equal vectors) do not exist, so there are fewer rows then. Equal eigenvalues have any basis
of their space. A deviation beyond a long is null. Null and repeated ids are carried. Columns other than the id and the
vector are left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .topk import scaled

EPS = float(np.finfo(np.float64).eps)
#: Vectors of a block of the fit list.
PACK = 2048
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    products: int


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def packed(rows: DataFrame, dim: int) -> DataFrame:
    """v of rows(v), PACK to a row: n, block (longs)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PACK):
                part = b.slice(at, PACK)
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64()), pa.array([_matrix(part["v"], dim).tobytes()], pa.binary())], ["n", "block"])

    return rows.mapInArrow(pack, "n long, block binary")


def _summed(fit: DataFrame, dim: int, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of work(block of vectors as doubles) -> `size` doubles over the fit list; a task gives one row."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lost, some = np.zeros(size), np.zeros(size), False
        for b in batches:
            for block in b["block"]:
                x = np.frombuffer(block.as_buffer(), np.int64).reshape(-1, dim).astype(np.float64)
                # compensated, so that the sum over many blocks keeps double precision
                y = work(x).ravel() - lost
                t = total + y
                total, lost, some = t, (t - total) - y, True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])

    parts = fit.select("block").mapInArrow(part, "part array<double>")
    return np.sum([r["part"] for r in parts.collect()], axis=0)  # `size` numbers a task


def minres(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """Least-residual solutions of symmetric systems, column by column, one product a step for all: Lanczos vectors and Givens rotations."""
    x, beta = np.zeros_like(b), np.linalg.norm(b, axis=0)
    first = np.where(beta > 0, beta, 1)
    v_old, v, eta = np.zeros_like(b), b / first, beta.copy()
    w_old, w = np.zeros_like(b), np.zeros_like(b)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    last = np.zeros_like(beta)
    going = beta > 0
    for _ in range(steps):
        if not going.any():
            break
        p = product(v)
        alpha = np.sum(p * v, axis=0)
        p = p - alpha * v - last * v_old
        size = np.linalg.norm(p, axis=0)
        # the new column of the tridiagonal matrix, turned by the two rotations before it, then by its own
        upper, middle = s_old * last, c_old * last
        diagonal, off = c * alpha - s * middle, s * alpha + c * middle
        length = np.hypot(diagonal, size)
        safe = np.where(length > 0, length, 1)
        c_old, s_old, c, s = c, s, diagonal / safe, size / safe
        w_old, w = w, (v - upper * w_old - off * w) / safe
        x = x + np.where(going & (length > 0), c * eta, 0) * w
        eta = -s * eta
        going = going & (np.abs(eta) > tol * first) & (size > EPS * np.abs(alpha))
        v_old, v, last = v, p / np.where(size > 0, size, 1), size
    return x


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """new, orthogonal to basis and to each other, each of length one; what is left of none is dropped."""
    out = basis
    for column in new.T:
        size = np.linalg.norm(column)
        if size == 0 or not np.isfinite(size):
            continue
        column = column / size
        for _ in range(3):
            column = column - out @ (out.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            out = np.concatenate([out, column[:, None]], axis=1)
    return out[:, basis.shape[1] :]


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, guard: int = 2, most: int = 48, inner: int = 5, outer: int = 200, near: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric positive matrix, falling, and their vectors. product: of the matrix with the columns of an array.

    guard: pairs below the k that are sought as well, to show that none was passed over; most: columns of the search
    space; inner: steps of MINRES for a correction; outer: rounds, after which it ends with an error; near: residual of
    the guard pair that is small enough, as a share of the first eigenvalue.
    """
    k = min(k, dim)
    size, most = min(dim, k + guard), min(dim, max(most, 3 * (k + guard)))
    draw = np.random.default_rng(seed)
    space = _orthonormal(draw.standard_normal((dim, size)), np.zeros((dim, 0)))
    image = product(space)
    for _ in range(outer):
        h = space.T @ image
        values, turn = (x[..., ::-1] for x in np.linalg.eigh((h + h.T) / 2))
        ritz = space @ turn[:, :size]
        residual = image @ turn[:, :size] - ritz * values[:size]
        left, top = np.linalg.norm(residual, axis=0), max(abs(values[0]), np.finfo(float).tiny)
        locked = left <= 8 * EPS * np.sqrt(dim) * top
        if locked[:k].all() and (size == k or left[k] <= near * top):
            return values[:k], ritz[:, :k]
        if space.shape[1] >= most:
            # start anew from the best, locked ones among them; of the whole space, this leaves the errors of rounding smaller
            space = np.linalg.qr(space @ turn[:, : dim if space.shape[1] == dim else 2 * size])[0]
            image = product(space)
            continue
        open_ = np.flatnonzero(~locked)
        # corrections are orthogonal to what is locked and to what is being improved; each has its own shift
        q = np.linalg.qr(ritz)[0]
        shut = lambda v, q=q: v - q @ (q.T @ v)
        shifted = lambda v, shut=shut, theta=values[open_]: shut(product(shut(v)) - shut(v) * theta)
        t = shut(minres(shifted, -shut(residual[:, open_]), inner, 1e-3))
        new = _orthonormal(t, space)[:, : most - space.shape[1]]
        if not new.shape[1]:  # the corrections lie in the space already
            new = _orthonormal(draw.standard_normal((dim, size)), space)[:, : most - space.shape[1]]
        space, image = np.concatenate([space, new], axis=1), np.concatenate([image, product(new)], axis=1)
    raise RuntimeError(f"no {k} pairs at double precision after {outer} rounds: residuals {left[:k] / top}")


def _exact_sums(fit: DataFrame, dim: int) -> list[int]:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for b in batches:
            for block in b["block"]:
                x = np.frombuffer(block.as_buffer(), np.int64).reshape(-1, dim)
                small = max(int(x.max()), -int(x.min())) <= (1 << 62) // len(x)
                total = [t + int(s) for t, s in zip(total, (x if small else x.astype(object)).sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([[str(t) for t in total]], pa.list_(pa.string()))], ["part"])

    out = [0] * dim
    for r in fit.select("block").mapInArrow(part, "part array<string>").toLocalIterator():  # dim numbers a task
        out = [t + int(s) for t, s in zip(out, r["part"], strict=True)]
    return out


def fit(rows: DataFrame, dim: int, components: int = 4, each: int = 4 * PACK) -> Whitening | None:
    """Components of rows(v), vectors of `dim` longs; None where there are none. each: rows that a task should have at least."""
    blocks = stored(packed(rows.select("v").distinct().coalesce(max(1, rows.count() // each)), dim), "whitening-fit")
    n = blocks.agg(F.sum("n")).first()[0]
    if not n or not dim:
        return None
    sums = _exact_sums(blocks, dim)
    mean, used = np.array([s / n for s in sums]), [0]

    def total(work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        used[0] += 1
        return _summed(blocks, dim, lambda x: work(x - mean), int(np.prod(shape))).reshape(shape) / n

    trace = float(total(lambda c: np.sum(c * c, keepdims=True), (1,))[0])
    if not trace:
        return None
    values, vectors = jacobi_davidson(lambda v: total(lambda c: c.T @ (c @ v), v.shape), dim, components)
    there = values > 16 * EPS * dim * values[0]
    values, vectors = values[there], vectors[:, there]
    k, scale = len(values), vectors / np.sqrt(values)
    middle = total(lambda c: (c @ scale).sum(axis=0), (k,))
    cov = total(lambda c: (c @ scale - middle).T @ (c @ scale - middle), (k, k))
    return Whitening(n, sums, values, vectors, trace, float(np.abs(cov - np.eye(k)).max()), used[0])


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """RESULT: a row for each usable vector of df and each component."""
    rows = stored(scaled(df, id_col, vector, scale).select("id", "v"), "whitening-vectors")
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    rows = rows.filter(F.size("v") == dim)
    model = fit(rows, dim, components)
    if model is None:
        return df.sparkSession.createDataFrame([], RESULT)
    n, k = model.n, len(model.values)
    mean, turn = np.array([s / n for s in model.sums]), model.vectors / np.sqrt(model.values)
    explained = model.values / model.trace
    largest = max(abs(s) for s in model.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PACK):
                part = b.slice(at, PACK)
                x = _matrix(part["v"], dim)
                size = n * max(int(x.max()), -int(x.min())) + largest
                if dim * size * size < 1 << 63:
                    off = ((n * x - np.array(model.sums)) ** 2).sum(axis=1).tolist()
                else:
                    off = ((n * x.astype(object) - np.array(model.sums, object)) ** 2).sum(axis=1).tolist()
                off = pa.array([d if d < 1 << 63 else None for d in off], pa.int64())
                every = np.repeat(np.arange(len(x)), k)
                rest = [np.full(len(every), n), off.take(pa.array(every)), ((x - mean) @ turn).ravel(), np.tile(explained, len(x)), np.full(len(every), model.identity_error)]
                columns = [part["id"].take(pa.array(every)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), *rest]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(project, RESULT)
