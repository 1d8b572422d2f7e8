import numpy as np
import pytest
from pyspark.sql import functions as F

from skimdex.operators import ann, knn, search
from skimdex.schemas import VECTORS


def make(spark, vectors, files=None):
    rows = [
        (f"v{i:03d}", files[i] if files else f"f{i // 3}", i % 3, [float(x) for x in v] if v is not None else None)
        for i, v in enumerate(vectors)
    ]
    return spark.createDataFrame(rows, "id string, file_path string, chunk_index int, vector array<float>")


def brute(vectors, query, k):
    q = np.asarray(query, dtype=float)
    out = []
    for i, v in enumerate(vectors):
        if v is None or len(v) != len(q):
            continue
        v = np.asarray(v, dtype=np.float32).astype(float)
        with np.errstate(all="ignore"):
            c = v @ q / np.sqrt((v @ v) * (q @ q))
        if not np.isnan(c):
            out.append((-round(float(c), 12), f"v{i:03d}"))
    return [i for _, i in sorted(out)[:k]]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(90, 8)).astype(np.float32).tolist()
    # a third of all rows are copies of one vector
    return points[:60] + [points[0]] * 30


QUERY = [1.0, -0.5, 0.25, 0.0, 2.0, 0.5, -1.0, 0.1]


def test_topk_equals_brute_force_with_many_copies(spark, cloud):
    for query in (QUERY, cloud[0]):
        hits = search.search_topk(make(spark, cloud).repartition(5), query, 20).collect()
        assert [h.id for h in hits] == brute(cloud, query, 20)


def test_unusable_vectors_never_match(spark):
    bad = [None, [0.0, 0.0], [float("nan"), 1.0], [1.0], [1.0, 0.0], [-1.0, 0.0]]
    hits = search.search_topk(make(spark, bad), [1.0, 0.0], 10).collect()
    assert [(h.id, h.score) for h in hits] == [("v004", 1.0), ("v005", 0.0)]


def test_empty_table(spark):
    none = make(spark, [[1.0, 0.0]]).where("false")
    assert search.search_page(none, [1.0, 0.0]).count() == 0
    assert search.search_files(none, [1.0, 0.0]).count() == 0


def test_pages_overlap_but_file_pages_do_not(spark, cloud):
    vectors = make(spark, cloud, [f"f{i % 7}" for i in range(len(cloud))])
    page = search.search_page(vectors, QUERY, offset=4, limit=20).collect()
    raw = brute(cloud, QUERY, 24)[4:]
    best = {}
    for i in raw:
        best.setdefault(f"f{int(i[1:]) % 7}", i)
    assert [r.id for r in page] == list(best.values())
    assert all(r.has_more and r.total == len(best) and r.offset == 4 for r in page)

    every = [r.file_path for r in search.search_files(vectors, QUERY, 0, 100).collect()]
    paged = [r.file_path for o in range(0, 9, 3) for r in search.search_files(vectors, QUERY, o, 3).collect()]
    assert paged == every and len(set(every)) == 7


def test_last_page_has_no_more(spark, cloud):
    page = search.search_page(make(spark, cloud), QUERY, offset=80, limit=20).collect()
    assert page and not any(r.has_more for r in page)


def test_best_per_file_drops_empty_paths(spark):
    hits = spark.createDataFrame(
        [("a", "f", 0.5), ("b", "f", 0.9), ("c", "", 1.0), ("d", None, 1.0), ("e", "g", 0.9), ("0", "f", 0.9)],
        "id string, file_path string, score double",
    )
    assert [tuple(r) for r in search.best_per_file(hits).collect()] == [("0", "f", 0.9), ("e", "g", 0.9)]


def test_results_from_missing_and_broken_metadata(spark):
    rows = [("a", '{"file_path":"p","file_size":7,"chunk_text":"' + "é" * 300 + '","exif":{"iso":"100"}}'), ("b", "{}"), ("c", "nope")]
    hits = spark.createDataFrame(rows, "id string, metadata string").withColumn("score", F.lit(0.123456))
    got = {r.id: r for r in search.format_results(hits).collect()}
    assert (got["a"].file_size, got["a"].text_preview, got["a"].exif) == (7, "é" * 200, '{"iso":"100"}')
    for i in ("b", "c"):
        assert (got[i].file_path, got[i].file_size, got[i].text_preview, got[i].exif) == ("", 0, None, None)
    assert got["a"].similarity == 12.35 and got["a"].band == "low"


def test_knn_join_paths_agree_with_brute_force(spark, cloud, monkeypatch):
    vectors = make(spark, cloud)
    queries = vectors.select(F.col("id").alias("query_id"), "vector")
    shipped = knn.knn_join(queries, vectors, 6, exclude_same_id=True)
    grid = knn.knn_join(queries, vectors, 6, exclude_same_id=True, broadcast_bytes=8 * 8 * 10, block_bytes=8 * 8 * 25)
    monkeypatch.setattr(knn, "RESULT_ROWS", 60)
    many = knn.knn_join(queries, vectors, 6, exclude_same_id=True)
    table = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())
    assert table(shipped) == table(grid) == table(many)
    for i in (0, 17, 61):
        mine = [t[2] for t in table(shipped) if t[0] == f"v{i:03d}"]
        want = [x for x in brute(cloud, cloud[i], len(cloud)) if x != f"v{i:03d}"][:6]
        assert mine == want


def test_probing_all_cells_is_exact(spark, cloud, folder):
    vectors = make(spark, [*cloud, None, [0.0] * 8])
    ann.build_coarse_index(vectors, folder, cells=4, iterations=5)
    cells, centroids = ann.load_coarse_index(spark, folder)
    assert cells.count() == len(cloud) + 2
    exact = search.search_topk(vectors, QUERY, 15).collect()
    found = ann.search_ann(cells, centroids, QUERY, 15, nprobe=4).collect()
    assert [(r.id, round(r.score, 9)) for r in found] == [(r.id, round(r.score, 9)) for r in exact]
    queries = vectors.where("id < 'v030'").select(F.col("id").alias("query_id"), "vector")
    truth = knn.knn_join(queries, vectors, 5)
    # small blocks force several passes
    near = ann.knn_ann(queries, cells, centroids, 5, nprobe=4, block_bytes=8 * 8 * 7)
    assert {r.recall for r in ann.ann_recall(near, truth, 5).collect()} == {1.0}
    few = ann.ann_recall(ann.knn_ann(queries, cells, centroids, 5, nprobe=1), truth, 5)
    assert all(0.0 <= r.recall <= 1.0 for r in few.collect())


def test_scan_of_codes_with_exact_second_look(spark, cloud):
    vectors = make(spark, [*cloud, None, [1.0], [0.0] * 8])
    ranges = ann.dimension_ranges(vectors)
    coded = ann.quantize_sq8(vectors, ranges)
    hits = ann.search_sq8(coded, vectors, ranges, QUERY, 10).collect()
    assert [h.id for h in hits] == brute(cloud, QUERY, 10)
    assert [h.id for h in ann.search_sq8(coded, vectors, ranges, [2.0], 3).collect()] == ["v091"]  # another width: exact
    none = vectors.where("false")
    assert ann.search_sq8(ann.quantize_sq8(none), none, ann.dimension_ranges(none), QUERY, 3).count() == 0


def test_probing_prunes_cells_from_the_scan(spark, cloud, folder):
    ann.build_coarse_index(make(spark, cloud), folder, cells=4, iterations=5)
    cells, centroids = ann.load_coarse_index(spark, folder)
    plan = ann.search_ann(cells, centroids, QUERY, 5, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_search_of_a_store_is_exact_and_prunes(spark, folder):
    from skimdex.plans.coarse import CoarseIndex
    from skimdex.plans.query import search as search_store
    from skimdex.sources.tables import IndexStore

    rng = np.random.default_rng(5)
    width = 64
    spots = rng.normal(size=(24, width))
    points = (np.repeat(spots, 20, axis=0) + 0.1 * rng.normal(size=(480, width))).astype(np.float32)
    rows = [(f"v{i:03d}", f"f{i}", 0, "text", v.tolist(), "{}") for i, v in enumerate(points)]
    store = IndexStore(spark, folder)
    store.vectors.upsert(spark.createDataFrame(rows, VECTORS))
    index = CoarseIndex(store)
    index.refresh(24, iterations=5)
    cells, centroids = index.tables()
    for query, k in ((points[7], 5), (spots[3] + spots[4], 30)):
        asked = [float(x) for x in query]
        read = ann.probed_exactly(cells, centroids, index.radii(), asked, k)
        assert [r.id for r in search.search_topk(read, asked, k).collect()] == brute(points, asked, k)
    few = ann.probed_exactly(cells, centroids, index.radii(), points[7].tolist(), 5)
    assert 5 <= few.count() < len(points) / 2

    class Fixed:
        def embed_batch(self, values):
            return [spots[3].tolist()]

    page = search_store(store, "text", text="x", limit=400, embedder=Fixed())
    assert {r.id for r in page.select("id").collect()} == set(brute(points, spots[3], 400))


def test_centroids_too_large_to_ship_assign_alike(spark, cloud, folder, monkeypatch):
    vectors = make(spark, [*cloud, None, [0.0] * 8])
    centroids = ann.train_centroids(vectors, 4, iterations=5)
    shipped = sorted((r.id, r.cell) for r in ann.assign_cells(vectors, centroids).collect())
    monkeypatch.setattr(ann, "BROADCAST_BYTES", 1)
    assert sorted((r.id, r.cell) for r in ann.assign_cells(vectors, centroids).collect()) == shipped


def test_rows_of_another_width_are_left_out(spark, cloud):
    mixed = make(spark, [*cloud, [1.0, 2.0], None])
    codes = {r.id: r.code for r in ann.quantize_sq8(mixed).collect()}
    assert sum(c is None for c in codes.values()) == 2 and len(codes) == len(cloud) + 2
    assert len(ann.lsh_neighbors(mixed, cloud[5], 3).collect()) == 3


def test_quantization_keeps_order_within_a_step(spark, cloud):
    vectors = make(spark, cloud)
    coded = {r.id: np.frombuffer(r.code, dtype=np.uint8) for r in ann.quantize_sq8(vectors).collect()}
    block = np.array(cloud, dtype=np.float32).astype(float)
    low, high = block.min(axis=0), block.max(axis=0)
    for i, v in enumerate(block):
        back = low + coded[f"v{i:03d}"] / 255 * (high - low)
        assert np.all(np.abs(back - v) <= (high - low) / 255 * 0.5000001)


def test_lsh_finds_the_vector_itself(spark, cloud):
    found = ann.lsh_neighbors(make(spark, cloud[:60]), cloud[5], 3).collect()
    assert found[0].id == "v005" and found[0].score == pytest.approx(1.0)


def test_vector_schema_names():
    assert VECTORS.names == ["id", "file_path", "chunk_index", "file_type", "vector", "metadata"]


def test_neighbours_do_not_depend_on_the_plan(spark):
    from skimdex.operators.knn import knn_join

    vectors = spark.createDataFrame(
        [(f"v{i}", f"f{i}", [float(i % 7) + 0.1, float(i % 5), 1.0 / (i + 1)]) for i in range(60)] + [("w", "w", [1.0, 2.0]), ("n", "n", None)],
        "id string, file_path string, vector array<double>",
    )
    asked = [("null", None), ("short", [1.0, 1.0]), ("none", []), ("q1", [1.0, 2.0, 0.5]), ("zero", [0.0, 0.0, 0.0]), ("q2", [3.0, 1.0, 0.1])]
    answers = []
    for order in (asked, asked[::-1]):
        queries = spark.createDataFrame(order, "query_id string, vector array<double>")
        for most in (1, 1 << 26):
            found = knn_join(queries, vectors, 4, broadcast_bytes=most).collect()
            answers.append(sorted((r.query_id, r["rank"], r.id, round(r.distance, 12)) for r in found))
    assert all(a == answers[0] for a in answers)
    assert {a[0] for a in answers[0]} == {"short", "q1", "q2"} and len(answers[0]) == 1 + 4 + 4


def test_payload_scan_is_filtered_by_the_page(spark, cloud, folder):
    make(spark, cloud).withColumn("metadata", F.lit("{}")).write.parquet(f"{folder}/v")
    stored = spark.read.parquet(f"{folder}/v")
    hits = search.search_page(stored, QUERY, limit=3)
    found = search.with_payload(hits, stored)
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(file_path" in plan or "In(file_path, [" in plan
    assert [r.id for r in found.collect()] == [r.id for r in hits.collect()]
    assert search.with_payload(hits.where("false"), stored).count() == 0


def test_many_queries_share_one_cut_of_the_found_rows(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from skimdex.operators.scoring import TopK, partition_topk

    rng = np.random.default_rng(3)
    rows = np.round(rng.normal(size=(5000, 4)), 1)  # coarse, so that cosines tie
    ids = [f"v{i}" for i in rng.permutation(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["id", "vector"])
    cuts, cut = [], TopK._cut
    monkeypatch.setattr(TopK, "_cut", lambda self, table: cuts.append(1) or cut(self, table))
    got = pa.Table.from_batches(partition_topk(iter([batch]), rows[:4096], 5, ids[:4096]))
    assert len(cuts) == 1
    with np.errstate(invalid="ignore"):
        unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    found = {}
    for r in got.to_pylist():
        found.setdefault(r["_q"], []).append(r["id"])
    for q in range(0, 4096, 97):
        near = np.nan_to_num(np.round(unit @ unit[q], 12), nan=-9.0)
        best = sorted((i for i in range(5000) if i != q and near[i] > -9), key=lambda i: (-near[i], ids[i]))[:5]
        assert found.get(q, []) == ([ids[i] for i in best] if np.isfinite(unit[q]).all() else [])
