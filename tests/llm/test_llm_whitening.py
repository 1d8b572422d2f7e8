"""Whitening against a dense eigenvalue solver, and its defined results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skimdex.llm import queries, whitening

VEC = "vec_id long, embedding array<float>"


def plain(rows):
    """Usable rows by id, exact deviations and the eigenvalues and vectors of the list."""
    keep = [(i, [int(max(min(math.floor(256 * float(np.float32(c))), 2**63 - 1), -(2**63))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in keep), default=0)
    keep = [(i, tuple(v + [0] * (width - len(v)))) for i, v in keep]
    distinct = sorted({v for _, v in keep})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array(distinct, dtype=float).reshape(n, width) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / max(1, n))
    return keep, n, sums, values[::-1], vectors[:, ::-1]


def check(frame, rows, least=1e-9):
    got = frame.collect()
    keep, n, sums, values, vectors = plain(rows)
    exist = min(4, int((values > 1e-11 * max(values[0], 1e-300)).sum())) if len(values) else 0
    assert len(got) == exist * len(keep)
    by_id = {}
    for i, v in keep:
        by_id.setdefault(i, v)
    ys = np.full((exist, len(got)), np.nan)
    for at, r in enumerate(got):
        x = by_id[r.vec_id]
        exact = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        assert (r.n, r.deviation) == (n, exact if exact < 2**63 else None)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-8)
        assert r.identity_error <= 1e-9
        k = r.component - 1
        true = (np.array(x, dtype=float) - np.array([s / n for s in sums])) @ vectors[:, k] / np.sqrt(values[k])
        ys[k, at] = true * r.whitened
        gaps = [abs(values[k] - v) for j, v in enumerate(values) if j != k]
        if min(gaps, default=1) > 1e-3 * values[0]:
            assert abs(r.whitened) == pytest.approx(abs(true), abs=least)
    for k in range(exist):  # one sign for all rows
        gaps = [abs(values[k] - v) for j, v in enumerate(values) if j != k]
        if min(gaps, default=1) > 1e-3 * values[0]:
            signs = ys[k][~np.isnan(ys[k])]
            assert (signs >= -1e-9).all() or (signs <= 1e-9).all()
    return got


def vectors(n, width, seed=0, scale=None):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)) * (np.linspace(1, 3, width) if scale is None else scale)
    return [[float(np.float32(c)) for c in r] for r in x]


def test_random_vectors_with_bad_rows_and_copies(spark):
    rows = list(enumerate(vectors(400, 12)))
    rows += [(5, rows[5][1]), (1000, rows[0][1]), (1001, None), (1002, [math.nan] * 12), (1003, [1.0] * 11 + [math.inf]),
             (1004, [1.0] * 11 + [None]), (None, rows[1][1])]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # a vector that holds much of the table
    frame = spark.createDataFrame(rows, VEC).repartition(5)
    for name in ("x", "at", "value", "n", "component", "whitened", "width"):
        frame = frame.withColumn(name, F.lit("x"))
    check(whitening.whiten(frame), rows)


@pytest.mark.parametrize(("n", "width", "scale"), [
    (2, 3, 1.0), (3, 5, 1.0), (50, 1, 1.0), (50, 2, 1.0), (300, 6, [9, 1e-3, 4, 0, 2, 0]), (200, 40, 0.5**np.arange(40) * 100),
])
def test_ranks_widths_and_spectra(spark, n, width, scale):
    rows = list(enumerate(vectors(n, width, 3, scale)))
    check(whitening.whiten(spark.createDataFrame(rows, VEC)), rows)


def test_repeated_eigenvalues_are_all_found(spark):
    corners = [[a, b, c, d, 0.0, 0.0] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0) for d in (-2.0, 2.0)]
    got = check(whitening.whiten(spark.createDataFrame(list(enumerate(corners)), VEC)), list(enumerate(corners)))
    assert {r.component for r in got} == {1, 2, 3, 4}


def test_steps_end_early_where_the_spectrum_allows(spark):
    rows = list(enumerate(vectors(500, 60, 5, [100, 70, 50, 30, 20] + [0.01] * 55)))
    frame = spark.createDataFrame(rows, VEC).select("embedding")
    width, most = whitening._shape(frame)
    kind = whitening._entry_type(most)
    found = whitening.fit(whitening.fit_list(frame, width, kind), width, kind)
    assert found.steps < 30
    values = plain(rows)[3]
    assert found.deviations**2 == pytest.approx(values[:4], rel=1e-10)


def test_shorter_vectors_are_padded(spark):
    rows = [(i, v[: 3 + i % 3] if i % 4 else []) for i, v in enumerate(vectors(60, 6, 9))]
    check(whitening.whiten(spark.createDataFrame(rows, VEC)), rows)


def test_no_variance_and_no_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])], [(1, [0.001]), (2, [0.002])]):
        got = whitening.whiten(spark.createDataFrame(rows, VEC))
        assert got.collect() == []
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact_or_null(spark):
    rows = [(i, [c * 1e7 for c in v]) for i, v in enumerate(vectors(40, 5, 2))]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    got = check(whitening.whiten(spark.createDataFrame(rows, VEC)), rows)
    assert any(r.deviation is None for r in got) or all(r.deviation > 2**40 for r in got)
    check(whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, -5.0])], VEC)), [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, -5.0])], 1e-6)


def test_wide_vectors(spark):
    rows = list(enumerate(vectors(12, 3000, 4, 1.0)))
    check(whitening.whiten(spark.createDataFrame(rows, VEC)), rows)


def test_query_on_the_given_table(spark, tables):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    check(queries.QUERIES["op13_whitening"](spark, tables), rows)
