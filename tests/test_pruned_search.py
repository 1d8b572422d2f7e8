"""Stored hash index, cells by angle bounds and byte codes: answers, recall and what is left out."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skimdex.operators import ann, bounded, hash_index, knn, search
from skimdex.operators.intervals import scan_intervals
from skimdex.session import work_dir

VECTOR = "id string, file_path string, vector array<float>"


def frame(spark, vectors, prefix="v"):
    rows = [(f"{prefix}{i:04}", f"f{i // 3}", None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, VECTOR)


def clustered(n=1200, groups=24, dim=12, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((groups, dim))
    return centers[np.arange(n) % groups] + spread * rng.standard_normal((n, dim))


def mixed(seed=2):
    """Random rows, a vector held by a third of them, other widths, and rows that match nothing."""
    rng = np.random.default_rng(seed)
    rows = list(rng.standard_normal((160, 8)))
    rows += [rows[3]] * 90 + [None, [], [0.0] * 8, [math.nan] * 8, [1.0, 2.0], [2.0, 1.0], [3.0, -1.0], rows[5] * 1e6, rows[6] * 1e-6]
    return rows


def asked_of(df, every=7):
    keep = F.pmod(F.xxhash64("id"), F.lit(every)) == 0
    return df.where(keep).select(F.col("id").alias("query_id"), "vector")


def answer(df):
    return sorted((r.query_id, r["rank"], r.id, r.file_path, round(r.score, 9)) for r in df.collect())


# -- hash index


@pytest.fixture(scope="module")
def cluster_index(spark):
    rows = frame(spark, clustered())
    return rows, hash_index.build_hash_index(rows, work_dir(spark, "hashed"))


def test_full_reach_is_exact_for_any_table(spark):
    rows = frame(spark, mixed()).repartition(5)
    index = hash_index.build_hash_index(rows, work_dir(spark, "hashed"), tables=3, bits=6, folder_bits=3)
    for exclude in (False, True):
        asked = asked_of(rows, 3).where(F.size("vector") == 8)
        assert answer(index.neighbors(asked, 5, reach=1.0, exclude_same_id=exclude)) == answer(knn.knn_join(asked, rows, 5, exclude))


def test_each_copy_counts_once(spark):
    rows = frame(spark, [[1.0, 2.0, 3.0]] * 40)
    index = hash_index.build_hash_index(rows, work_dir(spark, "hashed"))
    got = [r.id for r in index.search([1.0, 2.0, 3.0], 25).collect()]
    assert sorted(got) == [f"v{i:04}" for i in range(25)]


def test_reach_reads_the_buckets_it_names(spark):
    data = np.random.default_rng(4).standard_normal((300, 10))
    rows = frame(spark, data)
    index = hash_index.build_hash_index(rows, work_dir(spark, "hashed"), tables=2, bits=7, folder_bits=3)
    normals = hash_index.planes(10, 2, 7, 7)
    stored = np.float32(data).astype(float)
    for reach in (0.0, 0.1, 0.3):
        for q in (3, 50):
            near = set()
            for t in range(2):
                m = normals[t] @ (stored[q] / np.linalg.norm(stored[q]))
                apart = ((stored @ normals[t].T) > 0) != (m > 0)
                near |= set(np.flatnonzero((apart * m**2).sum(1) <= reach * (m**2).sum() + 1e-12).tolist())
            got = index.search(stored[q].tolist(), 300, reach=reach).collect()
            assert {int(r.id[1:]) for r in got} == near


def test_clusters_are_found_in_few_folders(spark, cluster_index):
    rows, index = cluster_index
    asked = asked_of(rows, 12)
    exact = knn.knn_join(asked, rows, 10, True)
    near = index.neighbors(asked, 10, exclude_same_id=True)
    assert ann.ann_recall(near, exact, 10).agg(F.avg("recall")).head()[0] >= 0.9
    query = clustered()[5]
    m = hash_index._margins(query[None, :] / np.linalg.norm(query), index.normals)
    reach = hash_index.reaches(m, np.array([0.97]), 1 - 0.1**0.25)
    folders = index.folders(m, reach)
    assert sum(map(len, folders)) < 0.25 * index.tables * 2**index.folder_bits
    scan = index._scan(["q"], query[None, :], m, reach, 10, False)
    plan = scan._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "folder" in plan.split("PartitionFilters")[1][:300]
    assert len(scan.inputFiles()) >= 1


def test_recall_of_vectors_without_structure(spark):
    """Uniform directions are the hardest case: still most rows are left out and nine of ten hits found."""
    rows = frame(spark, np.random.default_rng(9).standard_normal((4000, 64)))
    index = hash_index.build_hash_index(rows, work_dir(spark, "hashed"))
    asked = asked_of(rows, 40)
    exact = knn.knn_join(asked, rows, 10, True)
    near = index.neighbors(asked, 10, exclude_same_id=True)
    assert ann.ann_recall(near, exact, 10).agg(F.avg("recall")).head()[0] >= 0.9
    ids = [r.query_id for r in asked.collect()]
    given = np.array([r.vector for r in asked.collect()], dtype=float)
    m = hash_index._margins(given / np.linalg.norm(given, axis=1)[:, None], index.normals)
    last = {r.query_id: r.c for r in near.where("rank = 10").select("query_id", (1 - F.col("distance")).alias("c")).collect()}
    reach = hash_index.reaches(m, np.array([last[i] for i in ids]), 1 - 0.1**0.25)
    slopes, offsets, reach = hash_index.member_of(m, reach)
    copies = index.rows.select(F.col("codes").alias("_codes"), F.col("tbl").alias("_tbl")).toArrow()
    part = copies.combine_chunks().to_batches()[0]
    read = hash_index._meet(part, slopes, offsets, reach, index.bits).sum() / (index.n * len(ids))
    assert read < 0.5


def test_blocks_of_queries_change_nothing(spark, cluster_index):
    rows, index = cluster_index
    asked = asked_of(rows, 30)
    assert answer(index.neighbors(asked, 5)) == answer(index.neighbors(asked, 5, block_bytes=1000))


def test_few_rows_and_none(spark):
    none = frame(spark, [[1.0, 2.0]]).where("false")
    index = hash_index.build_hash_index(none, work_dir(spark, "hashed"))
    assert index.search([1.0], 5).collect() == []
    few = hash_index.build_hash_index(frame(spark, [[1.0, 2.0], [0.0, 0.0], [-1.0, 0.5]]), work_dir(spark, "hashed"))
    assert [r.id for r in few.search([1.0, 2.0], 5).collect()] == ["v0000", "v0002"]
    assert few.search([1.0, 2.0, 3.0], 5).collect() == [] and few.search([0.0, 0.0], 5).collect() == []
    with pytest.raises(ValueError):
        hash_index.build_hash_index(none, work_dir(spark, "hashed"), bits=17)


def test_reach_holds_the_chance_asked_for():
    rng = np.random.default_rng(0)
    margins = rng.standard_normal((5, 2, 6))
    for cosine, chance in itertools.product((0.2, 0.6, 0.95), (0.3, 0.6, 0.9)):
        reach = hash_index.reaches(margins, np.full(5, cosine), chance)
        for q, t in itertools.product(range(5), range(2)):
            m = np.abs(margins[q, t])
            p = [0.5 * math.erfc(x * cosine / math.sqrt(1 - cosine**2) / math.sqrt(2)) for x in m]
            held = sum(
                math.prod(p[j] if s[j] else 1 - p[j] for j in range(6))
                for s in itertools.product((0, 1), repeat=6) if (m**2 * np.array(s)).sum() <= reach[q, t] + 1e-9
            )
            assert held >= chance - 1e-9


# -- cells and codes


@pytest.mark.parametrize("exclude", [False, True])
def test_cells_equal_the_plain_join(spark, exclude):
    rows = frame(spark, mixed()).repartition(4)
    path = work_dir(spark, "coarse")
    # training takes vectors of one width; the layout takes all
    ann.build_coarse_index(rows, path, centroids=ann.train_centroids(rows.where(F.size("vector") == 8), 6, iterations=5))
    cells, centroids = ann.load_coarse_index(spark, path)
    asked = asked_of(rows, 2)
    want = answer(knn.knn_join(asked, rows, 6, exclude))
    assert answer(bounded.knn_cells(asked, cells, centroids, 6, exclude, lead=2)) == want
    assert answer(bounded.knn_cells(asked, cells, centroids, 6, exclude, lead=1, block_bytes=2000)) == want


def test_cells_out_of_reach_are_left_out(spark):
    rows = frame(spark, clustered())
    path = work_dir(spark, "coarse")
    ann.build_coarse_index(rows, path, cells=24, iterations=15)
    cells, centroids = ann.load_coarse_index(spark, path)
    asked = asked_of(rows, 5)
    spans = bounded.cell_spans(cells, centroids)
    assert answer(bounded.knn_cells(asked, cells, centroids, 10, True, spans=spans, lead=1)) == answer(knn.knn_join(asked, rows, 10, True))
    pairs = bounded.cell_pairs(asked.withColumn("reach", F.lit(0.2)), spans)
    assert pairs.count() < 0.2 * asked.count() * spans.count()


def test_cell_pairs_never_miss_a_near_row(spark):
    rows = frame(spark, clustered(400, 10, 6, 0.4))
    path = work_dir(spark, "coarse")
    ann.build_coarse_index(rows, path, cells=9, iterations=5)
    cells, centroids = ann.load_coarse_index(spark, path)
    asked = asked_of(rows, 9)
    kept = {(r.query_id, r.cell) for r in bounded.cell_pairs(asked.withColumn("reach", F.lit(0.5)), bounded.cell_spans(cells, centroids), 500).collect()}
    home = {r.id: (r.cell, np.array(r.vector, dtype=float)) for r in cells.collect()}
    for q in asked.collect():
        v = np.array(q.vector, dtype=float)
        for cell, w in home.values():
            if math.acos(np.clip(v @ w / np.linalg.norm(v) / np.linalg.norm(w), -1, 1)) <= 0.5:
                assert (q.query_id, cell) in kept


@pytest.mark.parametrize("exclude", [False, True])
def test_codes_equal_the_plain_join(spark, exclude):
    rows = frame(spark, mixed()).repartition(4)
    ranges = bounded.unit_ranges(rows)
    coded = bounded.quantize_units(rows, ranges)
    asked = asked_of(rows, 2)
    want = answer(knn.knn_join(asked, rows, 6, exclude))
    assert answer(bounded.knn_codes(asked, coded, rows, ranges, 6, exclude)) == want
    assert answer(bounded.knn_codes(asked, coded, rows, ranges, 6, exclude, block_bytes=600)) == want


def test_outliers_and_dense_clusters_lose_nothing(spark):
    rng = np.random.default_rng(6)
    dense = np.ones(16) + 1e-4 * rng.standard_normal((700, 16))  # closer together than a step of the code
    far = 1e5 * rng.standard_normal((2, 16))
    data = np.vstack([rng.standard_normal((300, 16)), dense, far])
    rows = frame(spark, data)
    ranges = bounded.unit_ranges(rows)
    coded = bounded.quantize_units(rows, ranges)
    query = frame(spark, [np.ones(16)], "q").select(F.col("id").alias("query_id"), "vector")
    want = [(r.id, round(r.score, 9)) for r in knn.knn_join(query, rows, 50).orderBy("rank").collect()]
    got = [(r.id, round(r.score, 9)) for r in bounded.search_codes(coded, rows, ranges, [1.0] * 16, 50).orderBy("rank").collect()]
    assert got == want
    plain = ann.dimension_ranges(rows)
    hits = ann.search_sq8(ann.quantize_sq8(rows, plain), rows, plain, [1.0] * 16, 50).collect()
    assert [(r.id, round(r.score, 9)) for r in hits] == want


def test_plain_codes_equal_the_scan_for_every_kind_of_row(spark):
    rows = frame(spark, mixed()).withColumn("chunk_index", F.lit(0))
    ranges = ann.dimension_ranges(rows.where("NOT exists(vector, x -> isnan(x))"))
    coded = ann.quantize_sq8(rows, ranges)
    for query in (mixed()[3], mixed()[9], [1.0, 2.0], [0.0] * 8):
        want = [(r.id, r.file_path, round(r.score, 9)) for r in search.search_topk(rows, list(map(float, query)), 20).collect()]
        got = ann.search_sq8(coded, rows, ranges, list(map(float, query)), 20).collect()
        assert [(r.id, r.file_path, round(r.score, 9)) for r in got] == want


def test_most_rows_are_decided_by_their_code(spark):
    rng = np.random.default_rng(8)
    rows = frame(spark, rng.standard_normal((3000, 32)))
    ranges = bounded.unit_ranges(rows)
    bounds = ranges.head()
    query = rng.standard_normal((1, 32))
    coded = bounded.quantize_units(rows, ranges).coalesce(1)
    found = scan_intervals(coded, ["code", "off"], bounded.unit_intervals(bounds), ["q"], query, 10, False).collect()
    assert 10 <= len(found) < 200
    assert all(r.lower < r.upper for r in found)


def test_ranges_of_other_rows_still_bound(spark):
    rows = frame(spark, np.random.default_rng(3).standard_normal((200, 8)))
    narrow = spark.createDataFrame([([-0.01] * 8, [0.01] * 8)], "low array<double>, high array<double>")
    asked = asked_of(rows, 20)
    got = bounded.knn_codes(asked, bounded.quantize_units(rows, narrow), rows, narrow, 5)
    assert answer(got) == answer(knn.knn_join(asked, rows, 5))


def test_empty_tables(spark):
    none = frame(spark, [[1.0, 2.0]]).where("false")
    some = frame(spark, [[1.0, 2.0], [2.0, 1.0]])
    ranges = bounded.unit_ranges(none)
    assert bounded.quantize_units(none).collect() == []
    assert bounded.search_codes(bounded.quantize_units(none), none, ranges, [1.0, 2.0], 3).collect() == []
    real = bounded.unit_ranges(some)
    assert bounded.knn_codes(asked_of(none), bounded.quantize_units(some, real), some, real, 3).collect() == []
