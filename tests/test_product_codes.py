"""Product codes: exact with full intervals, recall and what is looked at with the default."""

import numpy as np
from pyspark.sql import functions as F

from skimdex.operators import ann, knn
from skimdex.operators.intervals import scan_intervals
from skimdex.operators.product_codes import ProductIndex, _means, _nearest, build_product_index
from skimdex.session import work_dir
from test_pruned_search import answer, asked_of, frame, mixed


def centroids_of(rows, cells, width):
    return ann.train_centroids(rows.where(F.size("vector") == width), cells, iterations=5)


def test_full_intervals_are_exact_for_any_table(spark):
    rows = frame(spark, mixed()).repartition(4)
    for parts in (1, 3, 8):
        index = build_product_index(rows, work_dir(spark, "products"), centroids_of(rows, 5, 8), parts)
        asked = asked_of(rows, 2)
        for exclude in (False, True):
            assert answer(index.neighbors(asked, rows, 6, z=100, exclude_same_id=exclude)) == answer(knn.knn_join(asked, rows, 6, exclude))


def test_default_finds_nine_of_ten_and_looks_at_few(spark):
    """Directions without any structure, sixteen bytes for 64 dimensions."""
    rows = frame(spark, np.random.default_rng(2).standard_normal((4000, 64)))
    index = build_product_index(rows, work_dir(spark, "products"), centroids_of(rows, 16, 64))
    asked = asked_of(rows, 40)
    exact = knn.knn_join(asked, rows, 10, True)
    near = index.neighbors(asked, rows, 10, exclude_same_id=True)
    assert ann.ann_recall(near, exact, 10).agg(F.avg("recall")).head()[0] >= 0.9
    table = asked.toPandas()
    given = np.array([np.asarray(v, dtype=float) for v in table["vector"]])
    found = scan_intervals(index.codes.coalesce(1), ["pq", "off", "cell"], index.ends(2.0), table["query_id"].tolist(), given, 10, True, 16)
    assert found.count() < 0.15 * 4000 * len(table)


def test_more_bytes_leave_out_less(spark):
    rows = frame(spark, np.random.default_rng(3).standard_normal((600, 24)))
    start = centroids_of(rows, 4, 24)
    off = [build_product_index(rows, work_dir(spark, "products"), start, p).codes.agg(F.avg("off")).head()[0] for p in (2, 6, 24)]
    assert off[0] > off[1] > off[2]


def test_codes_say_what_they_leave_out(spark):
    data = np.random.default_rng(4).standard_normal((300, 12))
    rows = frame(spark, data)
    path = work_dir(spark, "products")
    build_product_index(rows, path, centroids_of(rows, 3, 12), 4)
    index = ProductIndex(spark, path)  # opened anew
    edges = np.cumsum([0, *[b.shape[1] for b in index.books]])
    for r in index.codes.collect():
        unit = np.float32(data[int(r.id[1:])]).astype(float)
        unit /= np.linalg.norm(unit)
        back = index.matrix[index.cells[r.cell]].copy()
        for p, code in enumerate(bytes(r.pq)):
            back[edges[p] : edges[p + 1]] += index.books[p][code]
            piece = unit[edges[p] : edges[p + 1]] - index.matrix[index.cells[r.cell]][edges[p] : edges[p + 1]]
            assert code == np.argmin(((index.books[p] - piece) ** 2).sum(1))
        assert abs(np.linalg.norm(unit - back) - r.off) < 1e-9


def test_means_of_few_and_equal_rows():
    rng = np.random.default_rng(0)
    same = _means(np.ones((50, 3)), 256, 5, rng)
    assert same.shape == (1, 3) and (same == 1).all()
    rows = rng.standard_normal((40, 2))
    centers = _means(rows, 256, 5, rng)
    assert len(centers) == 40 and (_nearest(centers, centers) == np.arange(40)).all()


def test_empty_table(spark):
    some = frame(spark, [[1.0, 2.0, 0.5], [0.0, 1.0, 1.0], [1.0, 0.0, 3.0]])
    none = some.where("false")
    index = build_product_index(none, work_dir(spark, "products"), centroids_of(some, 2, 3), 2)
    assert index.neighbors(asked_of(some, 1), none, 2).collect() == []
    full = build_product_index(some, work_dir(spark, "products"), centroids_of(some, 2, 3), 2)
    assert full.neighbors(none.select(F.col("id").alias("query_id"), "vector"), some, 2).collect() == []


def test_codes_are_held_in_bounded_pieces(monkeypatch):
    import pyarrow as pa

    from skimdex.operators import intervals

    monkeypatch.setattr(intervals, "HELD_ROWS", 5)
    batches = [pa.RecordBatch.from_pydict({"pq": [b"ab"] * 3 + [b"a", None], "id": list(range(i, i + 5))}) for i in (0, 10, 20)]
    pieces = [p.column("id").to_pylist() for p in intervals._held(iter(batches), "pq", 2)]
    assert pieces == [[0, 1, 2, 10, 11, 12], [20, 21, 22]]
