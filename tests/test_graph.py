"""The neighbour graph: recall against the plain join, copies, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skimdex.operators import ann, graph, knn
from test_pruned_search import clustered, frame, mixed


def recall(rows, k, **how):
    exact = knn.knn_join(rows.select(F.col("id").alias("query_id"), "vector"), rows, k, True)
    return ann.ann_recall(graph.neighbor_graph(rows, k, **how), exact, k).agg(F.avg("recall")).head()[0]


@pytest.mark.parametrize("data", ["uniform", "clusters"])
def test_nine_of_ten_neighbours(spark, data):
    vectors = np.random.default_rng(1).standard_normal((1500, 32)) if data == "uniform" else clustered(1500, 30, 16, 0.3)
    assert recall(frame(spark, vectors), 8) >= 0.9


def test_lists_too_narrow_for_the_table_are_widened(spark):
    rows = frame(spark, np.random.default_rng(5).standard_normal((2000, 48)))
    assert recall(rows, 8, width=10, recall=0.0) < 0.85
    assert recall(rows, 8, width=10) >= 0.9


def test_rounds_improve_the_start(spark):
    rows = frame(spark, np.random.default_rng(2).standard_normal((1500, 32)))
    assert recall(rows, 8, rounds=0) < 0.6 < recall(rows, 8, rounds=2)


def test_lists_are_whole_and_true(spark):
    data = np.random.default_rng(3).standard_normal((300, 6))
    got = graph.neighbor_graph(frame(spark, data), 5).collect()
    assert len(got) == 300 * 5
    unit = np.float32(data).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    lists = {}
    for r in got:
        i, j = int(r.query_id[1:]), int(r.id[1:])
        assert i != j and abs(1 - r.distance - unit[i] @ unit[j]) < 1e-9
        lists.setdefault(i, []).append((r["rank"], r.distance, j))
    for found in lists.values():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and len({f[2] for f in found}) == 5
        assert [f[1] for f in found] == sorted(f[1] for f in found)


def test_copies_and_rows_without_direction(spark):
    got = graph.neighbor_graph(frame(spark, mixed()).repartition(3), 4).collect()
    held = {r.query_id for r in got}
    usable = {f"v{i:04}" for i, v in enumerate(mixed()) if v is not None and len(v) == 8 and np.isfinite(v).all() and np.any(v)}
    assert held == usable
    copies = {f"v{i:04}" for i in [3, *range(160, 250)]}
    assert all(r.distance < 1e-9 for r in got if r.query_id in copies)


def test_few_rows_and_none(spark):
    some = frame(spark, [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0]])
    assert len(graph.neighbor_graph(some, 5).collect()) == 6
    assert graph.neighbor_graph(some.limit(1), 5).collect() == []
    assert graph.neighbor_graph(some.where("false"), 5).collect() == []


def test_the_start_of_a_large_table_holds_what_was_asked_for(spark):
    """Hash tables go on until the lists hold enough, so that rounds over many rows are few or none."""
    rows = frame(spark, np.random.default_rng(4).standard_normal((4500, 24)))
    assert recall(rows, 8, rounds=0) >= 0.9
