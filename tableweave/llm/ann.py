"""Approximate nearest neighbours by inner product, with randomly rotated one-bit codes.

Vectors are brought to a common size, the power of two nearest to the mean length (in
logarithms, so that single huge vectors do not move it). Each vector o is taken relative
to a centre c, the mean of all directions; any centre is right, this one bears outliers.
Its direction, padded
to ``bits`` dimensions and randomly rotated, keeps one sign bit per dimension; beside the
packed bits three scalars are stored: the length of o - c, the inner product f of the
direction with its own code, and <o - c, c>. For a query q, <code, rotated q - c> / f is
an unbiased estimate of the inner product of the direction with q - c; its error is below

    sqrt((1 - f²) / f²) / sqrt(bits - 1) · ``eps`` · |q - c|

except with a probability that falls exponentially in eps². In each block, rows whose
upper bound reaches the k-th best lower bound are scored on the original vectors.

A query is scaled to its own power of two first, which scales its products alike. Where a
vector is too long for the estimate, its bound is infinite and it is scored.

Codes are made once per row and stored. Scale and centre come from all rows; the rotation
is fixed by a seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_ROWS, QUERY_ROWS, best_of_blocks, matrix, query_rows_of, usable
from .shared import stored

EPS = 2.2
_STEP = 2_048  # rows whose codes are unpacked at once
_LONGEST = 1e12  # of vectors with estimates, in mean lengths


def code_bits(dim: int) -> int:
    """Bits of a code: four per dimension, 64 at least, in whole bytes."""
    return max(64, -(-4 * dim // 64) * 64)


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """dim × bits: the first rows of a random orthogonal matrix."""
    bits = code_bits(dim)
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(bits, dim)))
    return (q * np.sign(np.diag(r))).T


def encode(x: np.ndarray, c: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, length of x - c, f, <x - c, c>) of each row."""
    rest = x - c
    length = np.sqrt((rest**2).sum(1))
    turned = (rest / np.where(length > 0, length, 1)[:, None]) @ turn
    f = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, f, 1.0), rest @ c


def estimates(codes, length, f, dot, q: np.ndarray, c: np.ndarray, turn: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products and their error bounds, a row per vector and a column per query."""
    bits = turn.shape[1]
    rest = q - c
    turned = (rest @ turn).astype(np.float32).T
    out = np.empty((len(codes), len(q)), np.float32)
    length, dot = (np.where(length < _LONGEST, x, np.inf) for x in (length, dot))
    for lo in range(0, len(codes), _STEP):
        signs = np.unpackbits(codes[lo : lo + _STEP], axis=1, count=bits).astype(np.float32) * 2 - 1
        out[lo : lo + _STEP] = signs @ turned
    out *= (length / (f * np.sqrt(bits)))[:, None].astype(np.float32)
    out += dot[:, None].astype(np.float32)
    out += (q @ c)[None, :].astype(np.float32)
    spread = length * np.sqrt(np.maximum(1 - f**2, 0)) / f / np.sqrt(bits - 1)
    error = spread[:, None] * (eps * np.sqrt((rest**2).sum(1)))[None, :] + 1e-5
    return out, error.astype(np.float32)


def powers_of(x: np.ndarray) -> np.ndarray:
    """The binary logarithm of each row's length, in whole numbers."""
    most = np.frexp(np.abs(x).max(axis=1, initial=0))[1]
    unit = np.ldexp(x, -most[:, None])
    return most + np.rint(np.log2(np.maximum(np.sqrt((unit**2).sum(1)), 1e-300))).astype(np.int64)


def _searcher(centers: dict[int, tuple[int, np.ndarray]], k: int, eps: float):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        c, turn = centers[dim][1], rotation(dim)
        ids, x = rows.column("id").to_numpy(), matrix(rows.column("vec"), dim)
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        scalars = [rows.column(n).to_numpy() for n in ("length", "f", "dot")]
        query_ids, q = queries.column("id").to_numpy(), matrix(queries.column("vec"), dim)
        unit = np.ldexp(q, -powers_of(q)[:, None])
        found: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, len(q), 64):
            with np.errstate(invalid="ignore", over="ignore"):
                guess, error = estimates(codes, *scalars, unit[lo : lo + 64], c, turn, eps)
                least, most = guess - error, guess + error
            least[np.isnan(least)], most[np.isnan(most)] = -np.inf, np.inf
            for j in range(guess.shape[1]):
                lower = least[:, j]
                lower[ids == query_ids[lo + j]] = -np.inf
                kth = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else -np.inf
                near = np.flatnonzero(most[:, j] >= kth)
                near = near[ids[near] != query_ids[lo + j]]
                with np.errstate(over="ignore", invalid="ignore"):
                    score = (x[near] * q[lo + j]).sum(1)
                best = np.lexsort((ids[near], -score))[:k]
                found.append((np.full(len(best), query_ids[lo + j]), ids[near][best], score[best]))
        return pa.table({n: np.concatenate(v) for n, v in zip(("query_id", "vec_id", "score"), zip(*found))})

    return search


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, rows, sum of the lengths' logarithms, sum of directions) of a task."""
    total: dict[int, list] = {}
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for dim in np.unique(dims):
            x = batch.column(1).filter(pa.array(dims == dim)).flatten().to_numpy().reshape(-1, dim)
            powers = powers_of(x)
            unit = np.ldexp(x, -powers[:, None])
            part = total.setdefault(int(dim), [0, 0, np.zeros(dim)])
            part[0] += len(x)
            part[1] += int(powers.sum())
            part[2] += (unit / np.sqrt((unit**2).sum(1))[:, None]).sum(0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([p[0] for p in total.values()], pa.int64()),
         pa.array([p[1] for p in total.values()], pa.int64()),
         pa.array([p[2].tolist() for p in total.values()], pa.list_(pa.float64()))], ["dim", "n", "powers", "directions"],
    )


def _centers(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Scale (a power of two) and centre of each dimension; one sum per task comes to the driver."""
    parts: dict[int, list] = {}
    for r in rows.select("dim", "vec").mapInArrow(_sums, "dim int, n long, powers long, directions array<double>").collect():
        parts.setdefault(r.dim, []).append((r.n, r.powers, r.directions))
    found = {}
    for dim, some in parts.items():
        n = sum(p[0] for p in some)
        # Rounded, so that the order of the parts does not tell.
        found[dim] = round(sum(p[1] for p in some) / n), np.round(sum(np.array(p[2]) for p in sorted(some)) / n, 9)
    return found


def _coder(centers: dict[int, tuple[int, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                power, c = centers[int(dim)]
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.ldexp(part.column(2).flatten().to_numpy().reshape(-1, dim), -power)
                    codes, length, f, dot = encode(x, c, rotation(int(dim)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([row.tobytes() for row in codes], pa.binary()), pa.array(length), pa.array(f), pa.array(dot)],
                    ["id", "dim", "vec", "code", "length", "f", "dot"],
                )

    return run


def nearest(
    vectors: DataFrame, is_query: Column | str, id_col: str = "vec_id", vec_col: str = "embedding", *,
    k: int = 20, eps: float = EPS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of largest inner product found.

    ``is_query`` is a condition on a column ``id``. Scores are the exact inner products in
    double precision (where these are no number, behind all others); ties go to the smaller
    id; with fewer candidates all are returned.
    A row is no candidate for a query of its own id. Null ids, and vectors that are null,
    empty, zero or hold null or non-finite components, take no part. Only vectors of the
    query's dimension are candidates. Repeated rows are candidates each; queries that
    repeat an id are one. No rows give no rows.
    """
    rows = usable(vectors, id_col, vec_col, zero_too=False)
    centers = _centers(rows)
    coded = stored(
        rows.mapInArrow(_coder(centers), "id long, dim int, vec array<double>, code binary, length double, f double, dot double")
    )
    queries = query_rows_of(coded.select("id", "dim", "vec"), is_query)
    return best_of_blocks(coded, queries, _searcher(centers, k, eps), "double", k, block_rows=block_rows, query_rows=query_rows)
