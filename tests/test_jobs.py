import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.inputs import _png
from skimdex.functions.embed import HashingEmbedder
from skimdex.functions.paths import content_hash
from skimdex.operators.ann import UNPLACED
from skimdex.operators.diff import progress_by_phase
from skimdex.plans.coarse import CoarseIndex
from skimdex.plans.jobs import IndexOptions, incremental_index_job
from skimdex.plans.query import search
from skimdex.sources.files import load_files, stream_files
from skimdex.sources.tables import IndexStore
from skimdex.streaming.ingest import incremental_index_stream


def picky():
    """An embedder that fails on texts that mention "poison"; local, so it travels by value."""

    class Picky(HashingEmbedder):
        def embed_batch(self, values: pd.Series):
            if values.str.contains("poison").any():
                raise RuntimeError("model refused")
            return [self.counts(v).tolist() for v in values]

    return Picky()


def put(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(data if isinstance(data, bytes) else data.encode())


def scan(spark, root):
    return load_files(spark, [root]).withColumn("file_hash", content_hash(F.col("content")))


def contents(store):
    rows = store.vectors.read().collect()
    return sorted((os.path.basename(r.file_path), r.chunk_index) for r in rows)


def indexed(store):
    return sorted(os.path.basename(r.file_path) for r in store.meta.read().collect())


LONG = " ".join(f"word{i}" for i in range(120))
OPTIONS = IndexOptions(chunk_size=100, chunk_overlap=10)


def test_folder_life_cycle(spark, folder):
    root, store = f"{folder}/files", IndexStore(spark, f"{folder}/index")
    put(root, "long.txt", LONG)
    put(root, "note.md", "a short note about harbours")
    put(root, "sub/pic.png", _png(4, 4))
    put(root, "copy.png", _png(4, 4))
    put(root, "empty.txt", "  ...  ")
    put(root, "bad.txt", b"\xff\xfe broken")
    run = incremental_index_job(store, scan(spark, root), OPTIONS)
    assert tuple(run.summary().head()) == (6, 6, 0, 0, 1)
    assert run.errors.head().error == "invalid UTF-8"
    assert contents(store) == [("copy.png", 0), *[("long.txt", i) for i in range(3)], ("note.md", 0), ("pic.png", 0)]
    # a file without words is indexed with no rows, a failed file is tried again
    assert indexed(store) == ["copy.png", "empty.txt", "long.txt", "note.md", "pic.png"]

    run = incremental_index_job(store, scan(spark, root), OPTIONS)
    assert tuple(run.summary().head()) == (6, 1, 0, 0, 1)

    put(root, "long.txt", "now short")
    put(root, "bad.txt", "now readable")
    os.remove(f"{root}/copy.png")
    run = incremental_index_job(store, scan(spark, root), OPTIONS)
    assert tuple(run.summary().head()) == (5, 1, 1, 1, 0)
    assert contents(store) == [("bad.txt", 0), ("long.txt", 0), ("note.md", 0), ("pic.png", 0)]
    assert indexed(store) == ["bad.txt", "empty.txt", "long.txt", "note.md", "pic.png"]
    done = {r.phase: r.percentage for r in progress_by_phase(run.progress()).collect()}
    assert done["processing"] == 100 and len(done) == 6

    hits = search(store.vectors.read(), "text", text="a short note about harbours", limit=10).collect()
    assert hits[0].file_name == "note.md" and hits[0].text_preview.startswith("ashortnote")
    same = search(store.vectors.read(), "image", image_path=f"{root}/sub/pic.png", limit=10).collect()
    assert same[0].file_name == "pic.png" and same[0].similarity == 100.0


def test_shared_image_rows_by_id(spark, folder):
    root, store = f"{folder}/files", IndexStore(spark, f"{folder}/index", vector_key="id")
    put(root, "a.png", _png(2, 2))
    put(root, "b.png", _png(2, 2))
    incremental_index_job(store, scan(spark, root), OPTIONS)
    assert store.vectors.read().count() == 1
    by_path = IndexStore(spark, f"{folder}/by_path")
    incremental_index_job(by_path, scan(spark, root), OPTIONS)
    hits = search(by_path.vectors.read(), "image", image_path=f"{root}/a.png").collect()
    assert [h.file_name for h in hits] == ["a.png", "b.png"]
    assert indexed(store) == ["a.png", "b.png"]


def test_one_bad_chunk_fails_only_its_file(spark, folder):
    store = IndexStore(spark, f"{folder}/index")
    rows = [("ok.txt", LONG), ("sick.txt", LONG + " poison " + LONG)]
    files = spark.createDataFrame(rows, "file_path string, text string").selectExpr(
        "file_path", "length(text) AS file_size", "1L AS modified_at", "sha2(text, 256) AS file_hash", "text"
    )
    files = files.withColumn("file_size", F.col("file_size").cast("long"))
    run = incremental_index_job(store, files, IndexOptions(picky(), chunk_size=100, chunk_overlap=10))
    assert {c[0] for c in contents(store)} == {"ok.txt"} and indexed(store) == ["ok.txt"]
    assert [tuple(r) for r in run.errors.collect()] == [("sick.txt", "model refused")]


def test_scoped_run_leaves_other_folders_alone(spark, folder):
    store = IndexStore(spark, f"{folder}/index")
    put(f"{folder}/a", "x.txt", "first")
    put(f"{folder}/b", "y.txt", "second")
    incremental_index_job(store, scan(spark, folder), OPTIONS)
    os.remove(f"{folder}/a/x.txt")
    put(f"{folder}/a", "z.txt", "third")
    scoped = IndexOptions(scope=f"{folder}/a/", compact=True, cells=2)
    incremental_index_job(store, scan(spark, f"{folder}/a"), scoped)
    assert indexed(store) == ["y.txt", "z.txt"]
    assert store.vectors.state().n_gone == 0
    cells, _ = CoarseIndex(store).tables()
    assert cells.count() == 2
    hits = search(store, "text", text="third", limit=5, nprobe=1).collect()
    assert hits[0].file_name == "z.txt" and hits[0].similarity == 100.0


def test_coarse_index_follows_the_store(spark, folder):
    root, store = f"{folder}/files", IndexStore(spark, f"{folder}/index")
    for i in range(6):
        put(root, f"f{i}.txt", f"note number {i} on harbours {'x' * i}")
    options = IndexOptions(chunk_size=100, chunk_overlap=10, cells=2)
    incremental_index_job(store, scan(spark, root), options)
    index = CoarseIndex(store)
    trained = index.tables()[1].collect()
    assert not index.refresh(2)  # nothing was written since
    put(root, "f1.txt", "an entirely different subject")
    os.remove(f"{root}/f2.txt")
    put(root, "new.txt", "lanterns in the fog")
    incremental_index_job(store, scan(spark, root), OPTIONS)  # leaves the index behind
    late = {os.path.basename(r.file_path): r.cell for r in index.tables()[0].collect()}
    assert set(late) == {"f0.txt", "f1.txt", "f3.txt", "f4.txt", "f5.txt", "new.txt"}
    assert late["new.txt"] == late["f1.txt"] == UNPLACED and late["f0.txt"] >= 0
    assert search(store, "text", text="lanterns in the fog", nprobe=1).first().file_name == "new.txt"
    # a dead refresh left cells behind without saying so
    stale = f"{store.root}/coarse/base={store.vectors.state().base}/cells/upto=99"
    index.tables()[0].withColumn("cell", F.lit(0)).withColumn("gen", F.lit(1)).write.partitionBy("cell").parquet(stale)
    assert index.refresh(2) and index.tables()[1].collect() == trained
    cells = index.tables()[0].collect()
    assert sorted(os.path.basename(r.file_path) for r in cells) == sorted(late) and all(r.cell >= 0 for r in cells)
    store.clear()
    assert index.tables() is None and not index.refresh(2)
    assert search(store, "text", text="lanterns").count() == 0


def test_images_carry_exif_and_thumbnail(spark, folder):
    root, store = f"{folder}/files", IndexStore(spark, f"{folder}/index")
    put(root, "a.png", _png(4, 4))
    put(root, "b.png", _png(5, 4))
    tags = [(f"{root}/a.png", '{"Make": "Acme", "GPSLatitude": -1.5}'), (f"{root}/a.png", '{"Make": "Zed"}'), ("gone.png", "{}")]
    options = IndexOptions(tags=spark.createDataFrame(tags, "file_path string, tags string"), thumbnails="/thumbs/")
    incremental_index_job(store, scan(spark, root), options)
    rows = {os.path.basename(r.file_path): json.loads(r.metadata) for r in store.vectors.read().collect()}
    assert rows["a.png"]["exif"] == {"camera_make": "Acme", "gps_latitude": "1.5 S"}
    assert "exif" not in rows["b.png"] and set(rows) == {"a.png", "b.png"}
    assert all(r["thumbnail_path"] == f"/thumbs/{r['file_hash']}.webp" for r in rows.values())


def text_stream(spark, path):
    schema = "file_path string, file_size long, modified_at long, file_hash string, text string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_equals_batch_and_replays_are_skipped(spark, folder):
    def arrive(rows):
        df = spark.createDataFrame(rows, "file_path string, modified_at long, text string").coalesce(1)
        df.selectExpr(
            "file_path", "cast(length(text) AS long) AS file_size", "modified_at", "sha2(text, 256) AS file_hash", "text"
        ).write.mode("append").parquet(f"{folder}/in")

    streamed = IndexStore(spark, f"{folder}/stream")
    arrive([("a.txt", 1, LONG), ("b.txt", 1, "hello there"), ("b.txt", 2, "hello again")])
    start = lambda: incremental_index_stream(streamed, text_stream(spark, f"{folder}/in"), f"{folder}/cp", OPTIONS)
    start().awaitTermination()
    arrive([("a.txt", 5, "shorter"), ("c.txt", 5, "new one")])
    start().awaitTermination()
    gen = streamed.vectors.state().gen
    start().awaitTermination()
    assert streamed.vectors.state().gen == gen

    batch = IndexStore(spark, f"{folder}/batch")
    arrived = spark.read.parquet(f"{folder}/in")
    newest = arrived.groupBy("file_path").agg(F.max_by(F.struct(*arrived.columns[1:]), "modified_at").alias("n"))
    incremental_index_job(batch, newest.select("file_path", "n.*"), OPTIONS)
    table = lambda s: sorted((r.id, r.metadata, tuple(r.vector)) for r in s.vectors.read().collect())
    assert table(streamed) == table(batch)
    hashes = lambda s: sorted((r.file_path, r.file_hash) for r in s.meta.read().collect())
    assert hashes(streamed) == hashes(batch)


def test_files_arriving_in_a_folder(spark, folder):
    root, store = f"{folder}/files", IndexStore(spark, f"{folder}/index")
    put(root, "a.txt", "first text")
    put(root, "p.png", _png(3, 3))
    put(root, "skip.pdf", "no")
    for _ in range(2):
        incremental_index_stream(store, stream_files(spark, root, 2), f"{folder}/cp", OPTIONS).awaitTermination()
        put(root, "sub/b.md", "second text")
    assert contents(store) == [("a.txt", 0), ("b.md", 0), ("p.png", 0)]
    assert indexed(store) == ["a.txt", "b.md", "p.png"]


def test_vectors_without_metadata_are_replaced_on_the_next_run(spark, folder):
    """A run that died between the two tables repeats the files without doubling rows."""
    store = IndexStore(spark, f"{folder}/index")
    put(f"{folder}/f", "x.txt", "some text")
    incremental_index_job(store, scan(spark, f"{folder}/f"), OPTIONS)
    store.meta.clear()
    incremental_index_job(store, scan(spark, f"{folder}/f"), OPTIONS)
    assert contents(store) == [("x.txt", 0)] and indexed(store) == ["x.txt"]


def test_search_input_errors(spark, folder):
    vectors = IndexStore(spark, folder).vectors.read()
    for kind, args in (("text", {"text": ""}), ("image", {}), ("sound", {"text": "x"})):
        with pytest.raises(ValueError):
            search(vectors, kind, **args)
    assert search(vectors, "text", text="anything").collect() == []


def text_table(spark, *rows):
    frame = spark.createDataFrame(list(rows), "file_path string, text string")
    return frame.selectExpr("file_path", "cast(length(text) AS bigint) AS file_size", "1L AS modified_at", "sha2(text, 256) AS file_hash", "text")


def test_a_tag_may_be_used_again(spark, folder):
    store = IndexStore(spark, f"{folder}/index")
    incremental_index_job(store, text_table(spark, ("a.txt", "one")), OPTIONS, tag="nightly")
    incremental_index_job(store, text_table(spark, ("a.txt", "two words"), ("b.txt", "more")), OPTIONS, tag="nightly")
    incremental_index_job(store, text_table(spark, ("a.txt", "one"), ("b.txt", "more")), OPTIONS, tag="nightly")
    incremental_index_job(store, text_table(spark, ("a.txt", "two words"), ("b.txt", "more")), OPTIONS, tag="nightly")
    texts = {r.file_path: r.metadata for r in store.vectors.read().collect()}
    assert set(texts) == {"a.txt", "b.txt"} and "twowords" in texts["a.txt"]
    assert indexed(store) == ["a.txt", "b.txt"]


def test_two_streams_feed_one_store(spark, folder):
    store = IndexStore(spark, f"{folder}/index")
    for n in range(2):
        text_table(spark, (f"s{n}.txt", f"text of stream {n}")).write.parquet(f"{folder}/in{n}")
        incremental_index_stream(store, text_stream(spark, f"{folder}/in{n}"), f"{folder}/cp{n}", OPTIONS).awaitTermination()
    assert contents(store) == [("s0.txt", 0), ("s1.txt", 0)] and indexed(store) == ["s0.txt", "s1.txt"]


def test_only_processed_files_count_as_indexed(spark, folder):
    store = IndexStore(spark, f"{folder}/index")
    run = incremental_index_job(store, text_table(spark, ("a.txt", "one"), ("pic.png", "not a text")), OPTIONS)
    assert indexed(store) == ["a.txt"]
    assert [tuple(r) for r in run.errors.collect()] == [("pic.png", "no content for this file type")]


def test_runs_without_changes_commit_nothing(spark, folder):
    store = IndexStore(spark, f"{folder}/index")
    files = text_table(spark, *[(f"f{i}.txt", f"text {i}") for i in range(20)])
    incremental_index_job(store, files, OPTIONS)
    incremental_index_job(store, files.limit(0).unionByName(text_table(spark, ("g.txt", "new"))), IndexOptions(chunk_size=100, chunk_overlap=10, scope="g"))
    assert store.meta.state().n_gone == 0 and store.vectors.state().n_gone == 0
    before = store.meta.state().gen, store.vectors.state().gen
    incremental_index_job(store, files.unionByName(text_table(spark, ("g.txt", "new"))), OPTIONS)
    assert (store.meta.state().gen, store.vectors.state().gen) == before


def test_a_run_that_died_between_the_tables_goes_on(spark, folder, monkeypatch):
    store = IndexStore(spark, f"{folder}/index")
    first = text_table(spark, ("ok.txt", "fine"), ("sick.txt", "poison"))
    with monkeypatch.context() as patch:
        patch.setattr(store.meta, "upsert", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            incremental_index_job(store, first, IndexOptions(picky(), chunk_size=100, chunk_overlap=10))
    incremental_index_job(store, first, OPTIONS)
    assert contents(store) == [("ok.txt", 0), ("sick.txt", 0)] and indexed(store) == ["ok.txt", "sick.txt"]


def test_work_list_takes_the_shorter_side(spark, folder):
    from skimdex.plans.jobs import _work_list

    files = spark.createDataFrame([(f"f{i}.txt", "x") for i in range(6)] + [("f.bin", "x")], "file_path string, text string")
    for changed in range(7):
        diff = spark.createDataFrame(
            [(f"f{i}.txt", "new" if i < changed else "unchanged") for i in range(6)] + [("gone.txt", "deleted")],
            "file_path string, change_type string",
        )
        todo = _work_list(files, diff, 6 - changed, changed)
        assert sorted(r.file_path for r in todo.collect()) == [f"f{i}.txt" for i in range(changed)]
        assert changed < 6 or "Join" not in todo._jdf.queryExecution().toString()


def test_report_lists_processed_files(spark, folder):
    files = spark.createDataFrame(
        [("a.txt", 3, 1, "h1", "one two"), ("b.png", 3, 1, "h2", "x")],
        "file_path string, file_size long, modified_at long, file_hash string, text string",
    )
    run = incremental_index_job(IndexStore(spark, f"{folder}/index"), files, OPTIONS)
    assert [(r.file_path, r.n_chunks, r.file_hash) for r in run.report(files).collect()] == [("a.txt", 1, "h1")]


def test_stream_reads_a_table_that_is_a_folder_of_files(spark, folder, tables):
    from checks.compare import _plain
    from checks.queries import QUERIES

    spark.read.parquet(f"{tables}/documents.parquet").repartition(3).write.parquet(f"{folder}/documents.parquet")
    want = sorted(map(_plain, QUERIES["incremental_index_stream"](spark, tables).collect()))
    assert want and sorted(map(_plain, QUERIES["incremental_index_stream"](spark, folder).collect())) == want


def test_a_text_without_direction_is_no_error(spark, folder):
    """The trigrams of "Un" cancel: the file is indexed with a vector that never matches."""
    store = IndexStore(spark, f"{folder}/index")
    rows = [("un.txt", "Un."), ("long.txt", LONG)]
    files = spark.createDataFrame(rows, "file_path string, text string").selectExpr(
        "file_path", "length(text) AS file_size", "1L AS modified_at", "sha2(text, 256) AS file_hash", "text"
    )
    files = files.withColumn("file_size", F.col("file_size").cast("long"))
    assert tuple(incremental_index_job(store, files, OPTIONS).summary().head()) == (2, 2, 0, 0, 0)
    assert indexed(store) == ["long.txt", "un.txt"]
    assert {r.file_path: len(r.vector) for r in store.vectors.read().collect()} == {"long.txt": 64, "un.txt": 64}
    assert tuple(incremental_index_job(store, files, OPTIONS).summary().head()) == (2, 0, 0, 0, 0)
    hits = search(store.vectors.read(), "text", text=LONG).collect()
    assert {h.file_name for h in hits} == {"long.txt"}
    with pytest.raises(ValueError):
        search(store.vectors.read(), "text", text="Un.")
