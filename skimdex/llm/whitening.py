"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries are fixed to integers, ``floor(256 c)``, and every distinct integer vector once is the list
that the fit sees. With ``A`` its centred rows over the root of their number, each step is one pass of
the tasks: the rows' product with the right vector, then the transposed product, which is added up.
Left vectors are as long as the table, so none is stored: each is ``A c`` for a ``c`` the driver
holds, and the pass takes the new one's inner products with all of them, by which it is made
orthogonal again. Right vectors are made orthogonal again on the driver. The driver holds three
matrices of the width squared at most, and the singular value decomposition of the bidiagonal matrix
gives deviations and components.

The steps end when the wanted triplets have converged and what is left of the trace is smaller than
the last wanted eigenvalue, so none can have been missed, repeated ones included; at the latest after
as many steps as there are dimensions.

Defined results: null vectors and vectors with a null, NaN or infinite entry are dropped; shorter
vectors count as padded by zeros; rows that repeat give one result each; components without variance
do not exist, so fewer rows come out, and none where all vectors are equal or the table is empty. An
entry beyond 64 bits takes the nearest integer that has them; a deviation beyond them is null. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimdex.llm.common import session, stored

SCALE = 256
COMPONENTS = 4
#: numbers in one matrix of a task
BLOCK_CELLS = 4_000_000
#: residual, against the largest singular value, at which a triplet has converged
CONVERGED = 1e-15
#: least eigenvalue, against the largest, of a component that exists
LEAST = 1e-11
#: share of a new left vector in the old ones above which it is made orthogonal a second time
LOOSE = 1e-8
_LOW, _HIGH = -(2**63), 2**63 - 1


class Fit(NamedTuple):
    """What the fit found: rows and sums of the list, and per component a column and a deviation."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    trace: float
    identity_error: float
    steps: int


def _integers(vectors: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors, and their integers padded to ``width`` (default: the widest)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes])
    rows = np.flatnonzero(good)
    width = int(sizes[rows].max(initial=0)) if width is None else width
    keep = np.repeat(good, sizes)
    scaled = np.floor(np.clip(flat[keep], -1e300, 1e300) * SCALE)
    whole = np.where(scaled >= 2.0**63, _HIGH, np.where(scaled < -(2.0**63), _LOW, 0))
    inside = whole == 0
    whole[inside] = scaled[inside].astype(np.int64)
    out = np.zeros((len(rows), width), dtype=np.int64)
    starts = np.cumsum(sizes[rows]) - sizes[rows]
    at = np.repeat(np.arange(len(rows)), sizes[rows])
    out[at, np.arange(len(whole)) - np.repeat(starts, sizes[rows])] = whole
    return rows, out


def _shape(vectors: DataFrame) -> tuple[int, int]:
    """Width of the widest usable vector and the largest magnitude of an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, most = -1, 0
        for batch in batches:
            rows, x = _integers(batch.column(0), None)
            if len(rows):
                width = max(width, x.shape[1])
                most = max(most, -int(x.min(initial=0)), int(x.max(initial=0)))
        yield pa.RecordBatch.from_pydict({"width": [width], "most": [float(most)]})

    found = vectors.mapInArrow(run, "width long, most double").agg(F.max("width"), F.max("most")).head()
    return (-1, 0) if found[0] is None else (found[0], int(found[1]) + (int(found[1]) >> 50))


def _entry_type(most: int) -> str:
    return "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"


def fit_list(vectors: DataFrame, width: int, kind: str) -> DataFrame:
    """(x): every distinct integer vector once, as bytes of ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _integers(batch.column(0), width)
            codes = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([codes.unique()], ["x"])

    return stored(vectors.mapInArrow(run, "x binary").distinct(), "vectors")


def _decoded(batches: Iterator[pa.RecordBatch], width: int, kind: str) -> Iterator[np.ndarray]:
    rows = max(1, BLOCK_CELLS // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            codes = batch.column(0).slice(at, rows).to_pylist()
            yield np.frombuffer(b"".join(codes), kind).reshape(len(codes), width)


def _added(fit: DataFrame, work: Callable[[np.ndarray], np.ndarray], width: int, kind: str, size: int, typ: str) -> np.ndarray:
    """Sum of ``work`` over all blocks of the list; tasks add up their own, Spark adds up the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _decoded(batches, width, kind):
            part = work(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "value"])

    out = np.zeros(size, dtype=np.int64 if typ == "long" else np.float64)
    for r in fit.mapInArrow(run, f"at int, value {typ}").groupBy("at").sum("value").collect():
        out[r[0]] = r[1]
    return out


def _counted(fit: DataFrame, width: int, kind: str) -> tuple[int, list[int]]:
    """Rows and exact sums; halves of 32 bits are added apart, so that no sum overflows."""

    def halves(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        return np.concatenate([[len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])

    found = _added(fit, halves, width, kind, 1 + 2 * width, "long").tolist()
    return found[0], [(hi << 32) + lo for hi, lo in zip(found[1 : 1 + width], found[1 + width :])]


def _orthogonal(r: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in basis:
            r = r - (v @ r) * v
    return r


def fit(vectors: DataFrame, width: int, kind: str, components: int = COMPONENTS, seed: int = 13) -> Fit | None:
    """Bidiagonalise the list of integer vectors; None where it has no variance."""
    n, sums = _counted(vectors, width, kind)
    if n < 2:
        return None
    mean = np.array([s / n for s in sums])

    def product(w: np.ndarray, lefts: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Trace, and for p = A w: its square, its products with the left vectors, and A'p."""
        k = lefts.shape[1]

        def work(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            p = centred @ w
            return np.concatenate([[np.einsum("ij,ij->", centred, centred), p @ p], (centred @ lefts).T @ p, centred.T @ p])

        found = _added(vectors, work, width, kind, 2 + k + width, "double") / n
        return found[0], found[1], found[2 : 2 + k], found[2 + k :]

    rng = np.random.default_rng(seed)

    def fresh() -> tuple[float, np.ndarray]:
        """Trace, and a random vector that the rows span: a part they do not see would only grow in ``c``."""
        trace, _, _, z = product(rng.standard_normal(width), np.zeros((width, 0)))
        return trace, z

    trace, start = fresh()
    if trace == 0.0:
        return None
    rights = [start / np.linalg.norm(start)]
    lefts, turned = np.zeros((width, 0)), np.zeros((width, 0))  # c of each left vector, and A' times it
    alphas, betas = [], [0.0]
    wanted = min(components, width)
    while True:
        k = len(alphas)
        w = rights[k] - (betas[k] * lefts[:, k - 1] if k else 0.0)
        for _ in range(2):
            _, square, overlap, z = product(w, lefts)
            w, z = w - lefts @ overlap, z - turned @ overlap
            if np.linalg.norm(overlap) <= LOOSE * np.sqrt(square):
                break
        square = max(0.0, square - overlap @ overlap)
        alpha = float(np.sqrt(square))
        if square <= LEAST**2 * trace:  # nothing new in this direction
            alpha, w, z = 0.0, np.zeros(width), np.zeros(width)
        else:
            w, z = w / alpha, z / alpha
        alphas.append(alpha)
        lefts, turned = np.column_stack([lefts, w]), np.column_stack([turned, z])
        r = _orthogonal(z - alpha * rights[k], rights)
        beta = float(np.linalg.norm(r))
        bidiagonal = np.diag(alphas) + np.diag(betas[1:], 1)
        left, sigma, right = np.linalg.svd(bidiagonal)
        if k + 1 == width:
            break
        if k + 1 > wanted:
            done = beta * np.abs(left[-1, :wanted]).max() <= CONVERGED * sigma[0]
            if done and trace - float(sigma @ sigma) < sigma[wanted - 1] ** 2:
                break
        if beta <= 1e-13 * np.sqrt(trace):  # an invariant space: go on beside it
            beta, other = 0.0, fresh()[1]
            r = _orthogonal(other, rights)
            if np.linalg.norm(r) <= 1e-10 * np.linalg.norm(other):
                break  # the rows span no more
            r = _orthogonal(r / np.linalg.norm(r), rights)
        betas.append(beta)
        rights.append(r / np.linalg.norm(r))
    wanted = min(wanted, len(sigma))
    exist = int((sigma[:wanted] ** 2 > LEAST * sigma[0] ** 2).sum())
    columns = np.column_stack(rights) @ right[:exist].T
    columns *= np.where(columns[np.abs(columns).argmax(0), np.arange(exist)] < 0, -1.0, 1.0)
    columns /= np.linalg.norm(columns, axis=0)
    scaled = columns / sigma[:exist]

    def spread(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ scaled
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    found = _added(vectors, spread, width, kind, exist + exist * exist, "double") / n
    covariance = found[exist:].reshape(exist, exist) - np.outer(found[:exist], found[:exist])
    error = float(np.abs(covariance - np.eye(exist)).max())
    return Fit(n, sums, columns, sigma[:exist], trace, error, len(alphas))


def _deviations(x: np.ndarray, n: int, sums: list[int], most: int) -> list[int | None]:
    """Exact sums of squares of ``n x - S``; in 64 bits where nothing can overflow."""
    bound = n * most + max((abs(s) for s in sums), default=0)
    if x.shape[1] * bound * bound <= _HIGH:
        away = n * x - np.array(sums, dtype=np.int64)
        return (away * away).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [e if e <= _HIGH else None for e in exact]


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Per usable row and component: identifier, component from 1, n, deviation, whitened, explained, identity_error."""
    spark = session(rows)
    kind = rows.schema[ident].dataType.simpleString()
    shape = f"{ident} {kind}, {SCHEMA}"
    vectors = rows.select(vector)
    width, most = _shape(vectors)
    if width < 1:
        return spark.createDataFrame([], shape)
    code = _entry_type(most)
    found = fit(fit_list(vectors, width, code), width, code, components)
    if found is None:
        return spark.createDataFrame([], shape)
    n, sums = found.n, found.sums
    mean = np.array([s / n for s in sums])
    scaled = found.components / found.deviations
    explained = found.deviations**2 / found.trace
    exist = len(explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_CELLS // width)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                usable, x = _integers(part.column(1), width)
                m = len(usable)
                columns = [
                    part.column(0).take(pa.array(np.repeat(usable, exist))),
                    pa.array(np.tile(np.arange(1, exist + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * exist, n)),
                    pa.array([d for d in _deviations(x, n, sums, most) for _ in range(exist)], pa.int64()),
                    pa.array(((x - mean) @ scaled).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * exist, found.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [ident, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(ident, vector).mapInArrow(run, shape)
