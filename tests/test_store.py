import pytest
from pyspark.sql import functions as F

from skimdex.operators.upsert import latest, upsert_vectors
from skimdex.sources.tables import IndexStore, IndexTable, scan_meta, scan_vectors
from skimdex.schemas import META


def rows(spark, *entries):
    data = [(f"{p}#{c}", p, c, "text", [float(x)], "{}") for p, c, x in entries]
    return spark.createDataFrame(data, "id string, file_path string, chunk_index int, file_type string, vector array<float>, metadata string")


def content(table):
    return sorted((r.file_path, r.chunk_index, r.vector[0]) for r in table.read().collect())


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file_path string")


def test_missing_table_reads_as_empty(spark, folder):
    assert scan_vectors(spark, f"{folder}/none").count() == 0
    assert scan_meta(spark, f"{folder}/none").count() == 0
    assert IndexStore(spark, f"{folder}/none").vectors.count().head().n_rows == 0


def test_upsert_replaces_files_and_is_idempotent(spark, folder):
    table = IndexStore(spark, folder).vectors
    table.upsert(rows(spark, ("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 4)))
    again = rows(spark, ("a", 0, 9), ("c", 0, 5))
    for _ in range(2):
        table.upsert(again)
        # the shorter file leaves no tail behind
        assert content(table) == [("a", 0, 9.0), ("b", 0, 4.0), ("c", 0, 5.0)]
    before = table.state()
    table.upsert(again.where("false"))
    assert table.state() == before


def test_upsert_by_id_keeps_other_rows(spark, folder):
    table = IndexStore(spark, folder, vector_key="id").vectors
    table.upsert(rows(spark, ("a", 0, 1), ("a", 1, 2)))
    table.upsert(rows(spark, ("a", 0, 7)))
    assert content(table) == [("a", 0, 7.0), ("a", 1, 2.0)]
    pure = upsert_vectors(rows(spark, ("a", 0, 1), ("a", 1, 2)), rows(spark, ("a", 0, 7)), "by_id")
    assert sorted(r.vector[0] for r in pure.collect()) == [2.0, 7.0]
    with pytest.raises(ValueError):
        upsert_vectors(pure, pure, "other")


def test_delete_takes_any_path(spark, folder):
    store = IndexStore(spark, folder)
    odd = ["it's", "100%", "a_b", "UPPER"]
    store.vectors.upsert(rows(spark, *[(p, 0, 1) for p in [*odd, "keep"]]))
    store.meta.upsert(paths(spark, *odd, "keep").select("file_path", F.lit("h").alias("file_hash"), F.current_timestamp().alias("indexed_at")))
    store.delete_paths(paths(spark, *odd, "unknown"))
    assert [c[0] for c in content(store.vectors)] == ["keep"]
    assert [r.file_path for r in store.meta.read().collect()] == ["keep"]
    store.delete_paths(paths(spark))
    assert [c[0] for c in content(store.vectors)] == ["keep"]


def test_deleted_file_can_come_back(spark, folder):
    table = IndexStore(spark, folder).vectors
    table.upsert(rows(spark, ("a", 0, 1)))
    table.delete(paths(spark, "a"))
    assert content(table) == []
    table.upsert(rows(spark, ("a", 0, 2)))
    assert content(table) == [("a", 0, 2.0)]


def test_compact_clear_and_vacuum(spark, folder):
    table = IndexStore(spark, folder).vectors
    table.upsert(rows(spark, *[(f"f{i}", 0, i) for i in range(20)]))
    table.upsert(rows(spark, ("f3", 0, 33)))
    table.delete(paths(spark, "f4"))
    before = content(table)
    table.compact(target_files=2)
    assert content(table) == before and table.state().n_gone == 0
    table.compact()
    assert content(table) == before
    current = {r.version: r.is_current for r in table.versions().collect()}
    assert current == {1: False, 2: False, 3: False, 4: False, 5: True}
    # nothing has been retired for a day, everything has been retired since the future
    assert table.vacuum(24) == 0
    assert table.vacuum(-1) == 4
    assert content(table) == before
    table.clear()
    assert content(table) == []
    table.upsert(rows(spark, ("n", 0, 1)))
    assert content(table) == [("n", 0, 1.0)]


def test_leftovers_of_a_dead_write_stay_invisible(spark, folder):
    table = IndexStore(spark, folder).vectors
    table.upsert(rows(spark, ("a", 0, 1), ("b", 0, 2)))
    gen = table.state().gen + 1
    rows(spark, ("z", 0, 0)).write.parquet(f"{table.root}/rows/gen={gen}")
    paths(spark, "b").write.parquet(f"{table.root}/gone/gen={gen}")
    assert content(table) == [("a", 0, 1.0), ("b", 0, 2.0)]
    table.delete(paths(spark, "a"))
    assert content(table) == [("b", 0, 2.0)]


def test_reads_ship_the_replaced_keys(spark, folder):
    table = IndexStore(spark, folder).vectors
    table.upsert(rows(spark, ("a", 0, 1)))
    assert "Join" not in table.read()._jdf.queryExecution().toString()
    table.upsert(rows(spark, ("a", 0, 2)))
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_latest_takes_one_row_per_key(spark):
    data = [("k", i, f"x{i}") for i in range(500)] + [("l", 1, "y")]
    df = spark.createDataFrame(data, "k string, n int, v string").repartition(4)
    assert sorted(tuple(r) for r in latest(df, ["k"], F.col("n")).collect()) == [("k", 499, "x499"), ("l", 1, "y")]


def test_metadata_table_is_keyed_by_path(spark, folder):
    meta = IndexTable(spark, folder, META, "file_path")
    one = spark.sql("SELECT 'p' AS file_path, 'h1' AS file_hash, timestamp'2024-01-01' AS indexed_at")
    meta.upsert(one)
    meta.upsert(one.withColumn("file_hash", F.lit("h2")))
    assert [r.file_hash for r in meta.read().collect()] == ["h2"]


def test_one_upsert_writes_a_key_once(spark, folder):
    table = IndexStore(spark, folder, vector_key="id").vectors
    table.upsert(rows(spark, ("a", 0, 1), ("a", 0, 7)))
    assert content(table) == [("a", 0, 7.0)]
    both = upsert_vectors(rows(spark, ("a", 0, 1)), rows(spark, ("a", 0, 2), ("a", 0, 3)), "by_id")
    assert [r.vector[0] for r in both.collect()] == [3.0]



def test_vectors_of_one_table_have_one_width(spark, folder):
    wide = rows(spark, ("w", 0, 1)).withColumn("vector", F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")))
    table = IndexStore(spark, f"{folder}/strict").vectors
    table.upsert(rows(spark, ("a", 0, 1)))
    before = table.state()
    for bad in (wide, wide.unionByName(rows(spark, ("b", 0, 1)))):
        with pytest.raises(ValueError, match="entries"):
            table.upsert(bad, one_width=True)
    assert table.state() == before and content(table) == [("a", 0, 1.0)]
    table.clear()
    table.upsert(wide, one_width=True)
    assert table.width() == 2
    fitted = IndexStore(spark, f"{folder}/fitted", fit_width=1).vectors
    fitted.upsert(wide.unionByName(rows(spark, ("b", 0, 3))))
    assert content(fitted) == [("b", 0, 3.0), ("w", 0, 1.0)]
