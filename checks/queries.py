"""One query per operator. Each takes (spark, folder of tables) and returns a DataFrame."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from skimdex.functions import paths as P
from skimdex.functions import text as X
from skimdex.functions import vectors as V
from skimdex.operators import ann, bounded, chunk, diff, graph, hash_index, index_rows, knn, listing, maintain, media, model_io, product_codes, search, upsert
from skimdex.operators.scoring import score_rows
from skimdex.plans import folders, jobs, query
from skimdex.plans.coarse import CoarseIndex
from skimdex.session import configure, spread, work_dir
from skimdex.sources import files, readers, tables
from skimdex.streaming.ingest import incremental_index_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(configure(spark), sf)

    QUERIES[fn.__name__.removeprefix("q_")] = run
    return fn


def _score6(name: str = "score") -> Column:
    return F.round(name, 6).alias("score")


def _ms(name: str) -> Column:
    return maintain.iso_millis(F.col(name)).alias(name)


# -- scans ---------------------------------------------------------------------------------------


@register
def q_scan_files(spark, sf):
    root = I.write_text_tree(spark, sf, work_dir(spark, "tree"))
    found = files.scan_files(spark, [root, f"{root}/", f"{root}-missing"])
    doc = F.regexp_extract("file_path", r"doc_id=(\d+)/", 1).cast("long")
    return found.select(doc.alias("doc_id"), "file_size", "file_hash", (F.col("modified_at") > 0).alias("dated"))


@register
def q_content_hash(spark, sf):
    docs = I.table(spark, sf, "documents")
    return docs.select("doc_id", P.content_hash(F.encode("text", "UTF-8")).alias("file_hash"))


@register
def q_read_text_docs(spark, sf):
    docs = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id", "left")
    raw = F.encode("text", "UTF-8")
    broken = F.concat(F.unhex(F.lit("FF")), raw)
    content = F.when(F.col("toxic") == 1, broken).otherwise(raw)
    return files.read_text_docs(docs.select("doc_id", content.alias("content")))


@register
def q_scan_images(spark, sf):
    root = I.write_image_tree(spark, sf, work_dir(spark, "images"))
    vec = F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("long")
    return files.scan_images(spark, root).select(vec.alias("vec_id"), "width", "height", "channels", "ok")


@register
def q_scan_image_headers(spark, sf):
    """Sizes from the first bytes of each file; the paths are listed by tasks, not read."""
    root = I.write_image_tree(spark, sf, work_dir(spark, "images"))
    found = readers.image_headers(files.list_files(spark, [root]).select("file_path", "file_size"))
    vec = F.regexp_extract("file_path", r"(\d+)\.png$", 1).cast("long")
    return found.select(vec.alias("vec_id"), "width", "height", "channels", "ok")


@register
def q_scan_vectors(spark, sf):
    root = work_dir(spark, "store")
    tables.IndexStore(spark, root).vectors.upsert(I.vector_rows(spark, sf))
    return tables.scan_vectors(spark, root).select(
        "id", "file_path", "chunk_index", "file_type", F.size("vector").alias("dim"),
        F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"),
    )


@register
def q_scan_meta(spark, sf):
    root = work_dir(spark, "store")
    tables.IndexStore(spark, root).meta.upsert(I.meta(spark, sf))
    return tables.scan_meta(spark, root).select("file_path", "file_hash", _ms("indexed_at"))


# -- table maintenance ---------------------------------------------------------------------------


@register
def q_upsert_vectors(spark, sf):
    """Through the table: a second write replaces all rows of the files it holds."""
    store = tables.IndexStore(spark, work_dir(spark, "store"))
    store.vectors.upsert(I.vector_rows(spark, sf))
    fresh = I.turns(spark, sf).withColumns({"file_type": F.lit("text"), "metadata": F.lit("{}")})
    store.vectors.upsert(fresh)
    return store.vectors.read().select(
        "id", "file_path", "chunk_index", F.size("vector").alias("dim"),
        F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"),
    )


@register
def q_upsert_vectors_by_id(spark, sf):
    updates = I.table(spark, sf, "labels").selectExpr(
        "concat('v', doc_id) AS id",
        "concat('l', doc_id) AS file_path",
        "0 AS chunk_index",
        "array(cast(quality AS float), cast(toxic AS float)) AS vector",
    )
    target = I.vectors(spark, sf).select(*updates.columns)
    return upsert.upsert_vectors(target, updates, mode="by_id").select(
        "id", "file_path", "chunk_index", F.size("vector").alias("dim"),
        F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"),
    )


@register
def q_latest(spark, sf):
    """Newest event per user and type, the de-duplication ahead of an upsert."""
    events = I.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return upsert.latest(events, ["user_id", "event_type"], F.col("event_id"))


@register
def q_fit_vector_dim(spark, sf):
    vecs = I.vectors(spark, sf)
    out = vecs.select(
        "id",
        V.fit_vector_dim(F.col("vector"), 96).alias("wide"),
        V.fit_vector_dim(F.col("vector"), 48).alias("cut"),
    )
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
    return out.select(
        "id", F.size("wide").alias("wide_dim"), total("wide").alias("wide_sum"),
        F.round(F.element_at("wide", 96).cast("double"), 6).alias("wide_last"),
        F.size("cut").alias("cut_dim"), total("cut").alias("cut_sum"),
        F.round(F.element_at("cut", 48).cast("double"), 6).alias("cut_last"),
    )


def _meta_updates(spark, sf) -> DataFrame:
    stamp = F.lit(I.INDEXED_AT).cast("timestamp")
    return I.current_files(spark, sf).select("file_path", "file_hash", stamp.alias("indexed_at"))


@register
def q_upsert_meta(spark, sf):
    out = upsert.upsert_meta(I.meta(spark, sf), _meta_updates(spark, sf), I.labelled_paths(spark, sf))
    return out.select("file_path", "file_hash", _ms("indexed_at"))


@register
def q_written_gate(spark, sf):
    out = upsert.written_gate(_meta_updates(spark, sf), I.labelled_paths(spark, sf))
    return out.select("file_path", "file_hash")


@register
def q_delete_by_paths(spark, sf):
    out = maintain.delete_by_paths(I.listing(spark, sf), I.unwanted_paths(spark, sf))
    return out.select("file_path", "file_hash", _ms("indexed_at"))


@register
def q_delete_from_store(spark, sf):
    """Through both tables of an index."""
    store = tables.IndexStore(spark, work_dir(spark, "store"))
    store.vectors.upsert(I.vector_rows(spark, sf))
    store.meta.upsert(
        I.vectors(spark, sf).select(
            "file_path", F.sha2("file_path", 256).alias("file_hash"),
            F.lit(I.INDEXED_AT).cast("timestamp").alias("indexed_at"),
        ).distinct()
    )
    store.delete_paths(I.turns(spark, sf).select("file_path"))
    left = store.vectors.read().groupBy("file_path").agg(F.count(F.lit(1)).alias("n_rows"))
    return store.meta.read().join(left, "file_path", "left").select("file_path", "n_rows")


@register
def q_delete_summary(spark, sf):
    return maintain.delete_summary(I.listing(spark, sf), I.unwanted_paths(spark, sf))


@register
def q_clear_index(spark, sf):
    store = tables.IndexStore(spark, work_dir(spark, "store"))
    store.vectors.upsert(I.vector_rows(spark, sf))
    store.meta.upsert(I.meta(spark, sf))
    before = store.vectors.count().select(F.lit("before").alias("moment"), "n_rows")
    before = before.unionByName(store.meta.count().select(F.lit("meta before").alias("moment"), "n_rows"))
    store.clear()
    after = store.vectors.count().select(F.lit("after").alias("moment"), "n_rows")
    after = after.unionByName(store.meta.count().select(F.lit("meta after").alias("moment"), "n_rows"))
    return before.unionByName(after)


@register
def q_compact_table(spark, sf):
    store = tables.IndexStore(spark, work_dir(spark, "store"))
    store.vectors.upsert(I.vector_rows(spark, sf))
    fresh = I.turns(spark, sf).withColumns({"file_type": F.lit("text"), "metadata": F.lit("{}")})
    store.vectors.upsert(fresh)
    store.vectors.compact(target_files=2)
    return store.vectors.read().select("id", "file_path", "chunk_index", F.size("vector").alias("dim"))


@register
def q_prune_versions(spark, sf):
    versions = I.table(spark, sf, "events").selectExpr(
        "event_id AS version", "cast(ts AS timestamp) AS created_at", "event_type = 'purchase' AS is_current"
    )
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return maintain.prune_versions(versions, 24, now).select("version", _ms("created_at"))


# -- model requests and responses ----------------------------------------------------------------


@register
def q_build_embedding_requests(spark, sf):
    texts = I.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    params = json.dumps({"dimensions": 64})
    chat = model_io.build_embedding_requests(texts, "chat", "embedder", params)
    plain = model_io.build_embedding_requests(texts, "contents", "embedder", "[1]")
    get = lambda path: F.get_json_object("request", path)
    return chat.select(
        "conv_id", "turn", F.lit("chat").alias("protocol"), get("$.model").alias("model"),
        get("$.messages[0].content[0].text").alias("instruction"),
        get("$.messages[1].content[0].text").alias("body"),
        get("$.messages[2].role").alias("last_role"),
        get("$.parameters.dimensions").cast("int").alias("dimensions"),
    ).unionByName(
        plain.select(
            "conv_id", "turn", F.lit("contents").alias("protocol"), get("$.model").alias("model"),
            F.lit(None).cast("string").alias("instruction"),
            get("$.input.contents[0].text").alias("body"),
            F.lit(None).cast("string").alias("last_role"),
            get("$.parameters").cast("int").alias("dimensions"),
        )
    )


@register
def q_parse_embedding_responses(spark, sf):
    """Every embedding as a model response, its shape chosen by the label."""
    v = "to_json(embedding)"
    shapes = {
        0: f"concat('{{\"data\":[{{\"embedding\":', {v}, '}}]}}')",
        1: f"concat('{{\"data\":[{{\"embedding\":[', {v}, ']}}]}}')",
        2: f"concat('[{{\"embedding\":', {v}, '}}]')",
        3: f"concat('[{{\"embedding\":[', {v}, ']}}]')",
        4: f"concat('[', {v}, ']')",
        5: v,
        6: f"concat('{{\"output\":{{\"embeddings\":[{{\"embedding\":', {v}, '}}]}}}}')",
        7: "'{\"data\":[{\"embedding\":[]}]}'",
        8: "'{\"data\":[{\"embedding\":[0.5,\"x\"]}]}'",
    }
    case = " ".join(f"WHEN {label} THEN {sql}" for label, sql in shapes.items())
    made = I.table(spark, sf, "embeddings").selectExpr(
        "vec_id", "embedding", f"CASE label {case} ELSE 'not json' END AS response"
    )
    out = model_io.parse_embedding_responses(made)
    same = F.coalesce(F.col("vector") == F.col("embedding"), F.lit(False))
    return out.select(
        "vec_id", F.size("vector").alias("dim"), same.alias("same"), F.col("error").isNotNull().alias("failed"),
        F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"),
    ).withColumn("dim", F.when(F.col("dim") > 0, F.col("dim")))


# -- columns of the file and result tables -------------------------------------------------------


@register
def q_file_catalog(spark, sf):
    found = I.mixed_files(spark, sf)
    dims = found.select(F.col("file_path").alias("origin"), "width", "height")
    return media.file_catalog(found.select("file_path", "file_size", "modified_at"), dims, max_edge=1024)


@register
def q_classify_files(spark, sf):
    out = media.classify_files(I.mixed_files(spark, sf).select("file_path"))
    return out.select("file_path", "file_type", "extension", "file_name")


@register
def q_needs_transcode(spark, sf):
    found = I.mixed_files(spark, sf)
    need = P.needs_transcode(F.col("file_path"), F.col("file_size"))
    return found.select("file_path", need.alias("needs_transcode"))


@register
def q_mime_type(spark, sf):
    return I.mixed_files(spark, sf).select("file_path", P.mime_type(F.col("file_path")).alias("mime_type"))


@register
def q_data_url(spark, sf):
    url = P.data_url(F.col("file_path"), F.encode("text", "UTF-8"))
    return I.mixed_files(spark, sf).select("file_path", url.alias("url"))


def _listing_filter() -> dict:
    return {
        "path": "ICK/1",
        "after": dt.datetime(2024, 1, 5, tzinfo=dt.timezone.utc),
        "before": dt.datetime(2024, 1, 25, tzinfo=dt.timezone.utc),
    }


@register
def q_filter_index(spark, sf):
    out = maintain.filter_index(I.listing(spark, sf), **_listing_filter())
    return out.select("file_path", "file_hash", _ms("indexed_at"))


@register
def q_list_index(spark, sf):
    out = maintain.list_index(I.listing(spark, sf), **_listing_filter(), page=2, page_size=50)
    return out.select("file_path", "file_hash", _ms("indexed_at"))


@register
def q_filter_index_grams(spark, sf):
    """The same filter by the trigram postings of a stored listing."""
    index = listing.build_path_index(I.listing(spark, sf), work_dir(spark, "paths"))
    return index.filter(**_listing_filter()).select("file_path", "file_hash", _ms("indexed_at"))


@register
def q_list_index_seek(spark, sf):
    """The same page, found by counting bands of times."""
    out = listing.seek_page(I.listing(spark, sf), **_listing_filter(), page=2, page_size=50, most=64)
    return out.select("file_path", "file_hash", _ms("indexed_at"))


@register
def q_count_index(spark, sf):
    return maintain.count_index(I.listing(spark, sf), **_listing_filter())


@register
def q_distance_to_score(spark, sf):
    distance = F.col("value") / 25.0
    score = F.round(V.distance_to_score(distance), 6)
    return I.table(spark, sf, "events").select("event_id", score.alias("score"))


@register
def q_similarity_band(spark, sf):
    score = V.distance_to_score(F.col("value") / 25.0)
    return I.table(spark, sf, "events").select("event_id", V.similarity_band(score).alias("band"))


@register
def q_size_label(spark, sf):
    sizes = I.table(spark, sf, "events").selectExpr("event_id", "event_id * event_id * (1 + user_id) AS bytes")
    return sizes.select("event_id", P.size_label(F.col("bytes")).alias("size_label"))


@register
def q_fit_dimensions(spark, sf):
    fit = P.fit_dimensions(F.col("width"), F.col("height"), 1024)
    return I.mixed_files(spark, sf).select("file_path", fit.alias("fit")).select("file_path", "fit.width", "fit.height")


@register
def q_exif_fields(spark, sf):
    tags = """to_json(named_struct(
        'Make', event_type, 'Model', concat('M', user_id), 'ISOSpeedRatings', get_json_object(props, '$.k'),
        'FNumber', if(event_type = 'view', cast(user_id AS string), NULL), 'ApertureValue', 'f/2.8',
        'ExposureTime', NULL, 'DateTimeOriginal', date_format(ts, 'yyyy:MM:dd HH:mm:ss'),
        'GPSLatitude', if(event_type = 'error', NULL, round(value - 20, 2)),
        'GPSLongitude', round(20 - value, 2)))"""
    made = I.table(spark, sf, "events").selectExpr("cast(event_id AS string) AS file_path", f"{tags} AS tags")
    return media.exif_fields(made)


# -- joins and aggregates ------------------------------------------------------------------------


def _diff(spark, sf) -> DataFrame:
    now = I.current_files(spark, sf).select("file_path", "modified_at", "file_hash")
    return diff.snapshot_diff(now, I.meta(spark, sf))


@register
def q_snapshot_diff(spark, sf):
    return _diff(spark, sf)


@register
def q_snapshot_diff_scoped(spark, sf):
    """Documents only in scope: pages outside it are not reported as deleted."""
    now = I.current_files(spark, sf).select("file_path", "modified_at", "file_hash")
    return diff.snapshot_diff(now, I.meta(spark, sf), scope="src")


@register
def q_incremental_files(spark, sf):
    return diff.incremental_files(_diff(spark, sf)).select("file_path", "change_type")


@register
def q_index_summary(spark, sf):
    errors = I.table(spark, sf, "labels").where("toxic = 1")
    return diff.index_summary(_diff(spark, sf), errors)


def _indexed_hashes(spark, sf) -> DataFrame:
    docs = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id")
    return docs.select(F.sha2("text", 256).alias("file_hash"))


@register
def q_expired_artifacts(spark, sf):
    return media.expired_artifacts(I.artifacts(spark, sf), _indexed_hashes(spark, sf))


@register
def q_expired_summary(spark, sf):
    return media.expired_summary(I.artifacts(spark, sf), _indexed_hashes(spark, sf))


@register
def q_clear_artifacts_summary(spark, sf):
    return media.clear_artifacts_summary(I.artifacts(spark, sf))


@register
def q_count_vectors(spark, sf):
    return maintain.count_vectors(I.vectors(spark, sf))


@register
def q_best_per_file(spark, sf):
    scored = score_rows(I.vectors(spark, sf).select("id", "file_path", "chunk_index", "vector"), I.QUERY)
    hits = scored.withColumn("distance", 1.0 - F.col("cosine"))
    hits = hits.withColumn("score", V.distance_to_score(F.col("distance"))).drop("cosine")
    return search.best_per_file(hits).select("id", "file_path", "chunk_index", _score6())


def _turn_files(spark, sf) -> DataFrame:
    return I.turns(spark, sf).groupBy("file_path").agg(
        F.sum(F.length("chunk_text")).cast("long").alias("file_size"),
        F.max("chunk_index").cast("long").alias("modified_at"),
    ).withColumn("file_hash", F.sha2("file_path", 256))


@register
def q_indexed_files_report(spark, sf):
    return diff.indexed_files_report(I.turns(spark, sf), _turn_files(spark, sf))


@register
def q_indexed_files_report_per_file(spark, sf):
    return diff.indexed_files_report(I.turns(spark, sf), _turn_files(spark, sf), per="file")


@register
def q_progress_by_phase(spark, sf):
    steps = I.table(spark, sf, "events").selectExpr(
        "cast(user_id AS string) AS job_id", "event_type AS phase", "cast(value AS int) AS current",
        "if(event_type = 'view', 0, 250) AS total",
    )
    return diff.progress_by_phase(steps)


# -- search --------------------------------------------------------------------------------------


@register
def q_search_topk(spark, sf):
    hits = search.search_topk(I.vectors(spark, sf), I.QUERY, 50)
    return hits.select("id", "file_path", "chunk_index", _score6())


@register
def q_search_page(spark, sf):
    page = search.search_page(I.vectors(spark, sf), I.QUERY, offset=10, limit=50)
    return page.select("id", "file_path", "chunk_index", _score6(), "has_more", "total", "offset")


@register
def q_search_files(spark, sf):
    out = search.search_files(I.vectors(spark, sf), I.QUERY, offset=10, limit=20)
    return out.select("id", "file_path", "chunk_index", _score6())


@register
def q_format_results(spark, sf):
    rows = I.vector_rows(spark, sf)
    hits = search.with_payload(search.search_page(rows, I.QUERY), rows)
    return search.format_results(hits).drop("score", "offset")


@register
def q_knn_join(spark, sf):
    vecs = I.vectors(spark, sf).select("id", "file_path", "vector")
    asked = vecs.select(F.col("id").alias("query_id"), "vector")
    out = knn.knn_join(asked, vecs, 10, exclude_same_id=True)
    return out.select("query_id", "rank", "id", "file_path", _score6())


@register
def q_build_coarse_index(spark, sf):
    """Given centroids, written to disk partitioned by cell and read back."""
    root = work_dir(spark, "coarse")
    vecs = I.vectors(spark, sf).select("id", "file_path", "vector")
    ann.build_coarse_index(vecs, root, centroids=I.label_centroids(spark, sf))
    cells, _ = ann.load_coarse_index(spark, root)
    return cells.select("id", F.col("cell").cast("int").alias("cell"))


@register
def q_build_coarse_index_kmeans(spark, sf):
    """Trained centroids: every row is laid out once, in the cell whose centroid is nearest."""
    root = work_dir(spark, "coarse")
    vecs = I.vectors(spark, sf).select("id", "file_path", "vector")
    ann.build_coarse_index(vecs, root, cells=8, iterations=10)
    cells, centroids = ann.load_coarse_index(spark, root)
    given = F.array(*[F.struct(F.lit(r.cell).alias("cell"), F.array(*map(F.lit, r.centroid)).alias("c")) for r in centroids.collect()])
    cosine = lambda g: F.round(V.cosine_similarity(F.col("vector"), g["c"]), 9)
    scored = F.transform(given, lambda g: F.struct(cosine(g).alias("s"), g["cell"].alias("cell")))
    top = F.array_max(F.transform(scored, lambda g: g["s"]))
    own = F.exists(scored, lambda g: (g["cell"] == F.col("cell")) & (g["s"] == F.col("top")))
    return cells.withColumn("top", top).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(own).alias("n_nearest"), F.count_distinct("id").alias("n_ids")
    )


def _indexed(spark, sf) -> tuple[DataFrame, DataFrame]:
    root = work_dir(spark, "coarse")
    vecs = I.vectors(spark, sf).select("id", "file_path", "chunk_index", "vector")
    ann.build_coarse_index(vecs, root, centroids=I.label_centroids(spark, sf))
    return ann.load_coarse_index(spark, root)


@register
def q_search_ann(spark, sf):
    cells, centroids = _indexed(spark, sf)
    hits = ann.search_ann(cells, centroids, I.QUERY, k=50, nprobe=3)
    return hits.select("id", "file_path", "chunk_index", _score6())


@register
def q_knn_ann(spark, sf):
    cells, centroids = _indexed(spark, sf)
    asked = I.vectors(spark, sf).select(F.col("id").alias("query_id"), "vector")
    out = ann.knn_ann(asked, cells, centroids, k=10, nprobe=3, exclude_same_id=True)
    return out.select("query_id", "rank", "id", _score6())


@register
def q_ann_recall(spark, sf):
    cells, centroids = _indexed(spark, sf)
    vecs = I.vectors(spark, sf).select("id", "file_path", "vector")
    asked = vecs.select(F.col("id").alias("query_id"), "vector")
    exact = knn.knn_join(asked, vecs, 10, exclude_same_id=True)
    near = ann.knn_ann(asked, cells, centroids, k=10, nprobe=3, exclude_same_id=True)
    return ann.ann_recall(near, exact, 10).select("query_id", F.round("recall", 6).alias("recall"))


@register
def q_quantize_sq8(spark, sf):
    coded = ann.quantize_sq8(I.vectors(spark, sf).select("id", "vector"))
    return coded.select("id", F.hex("code").alias("code"))


@register
def q_search_sq8(spark, sf):
    """A scan of codes with an exact second look finds what the exact search finds."""
    rows = I.vectors(spark, sf)
    ranges = ann.dimension_ranges(rows)
    hits = ann.search_sq8(ann.quantize_sq8(rows, ranges), rows, ranges, I.QUERY, 50)
    return hits.select("id", "file_path", "chunk_index", _score6())


def _grown_index(spark, sf) -> CoarseIndex:
    """A store written three times: trained on the first part, extended by the second, the third not yet laid out."""
    store = tables.IndexStore(spark, work_dir(spark, "index"))
    index = CoarseIndex(store)
    rows = I.vector_rows(spark, sf)
    for part in range(3):
        store.vectors.upsert(rows.where(F.pmod(F.xxhash64("file_path"), F.lit(3)) == part))
        if part < 2:
            index.refresh(8, iterations=10)
    return index


@register
def q_coarse_index_upkeep(spark, sf):
    """Every row is there once, and it has a cell if its part was laid out."""
    cells, _ = _grown_index(spark, sf).tables()
    due = F.pmod(F.xxhash64("file_path"), F.lit(3)) < 2
    return cells.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(due == (F.col("cell") >= 0)).alias("n_placed"),
        F.count_distinct("id").alias("n_ids"),
    )


@register
def q_search_grown_index(spark, sf):
    """Probing every cell of an index that lags behind is exact."""
    cells, centroids = _grown_index(spark, sf).tables()
    hits = ann.search_ann(cells, centroids, I.QUERY, k=50, nprobe=8)
    return hits.select("id", "file_path", "chunk_index", _score6())


@register
def q_lsh_neighbors(spark, sf):
    """Buckets as wide as the data, where only a row differing in all tables could be missed."""
    out = ann.lsh_neighbors(I.vectors(spark, sf), I.QUERY, 10, bucket=4.0, tables=24)
    return out.select("id", "file_path", _score6())


def _every_hundredth(spark, sf) -> DataFrame:
    return I.vectors(spark, sf).where("vec_id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


@register
def q_hash_index_neighbors(spark, sf):
    """A stored hash index of two tables, probed up to a fixed share of the highest score."""
    index = hash_index.build_hash_index(I.vectors(spark, sf), work_dir(spark, "hashed"), tables=2, bits=8, folder_bits=4)
    out = index.neighbors(_every_hundredth(spark, sf), 10, reach=0.25, exclude_same_id=True)
    return out.select("query_id", "rank", "id", "file_path", "chunk_index", _score6())


def _nine_of_ten(near: DataFrame, exact: DataFrame) -> DataFrame:
    """Number of queries, and whether on average nine of their ten nearest rows were found."""
    found = ann.ann_recall(near, exact, 10)
    return found.agg(F.count("*").alias("n_queries"), (F.avg("recall") >= 0.9).alias("nine_of_ten"))


@register
def q_hash_index_recall(spark, sf):
    """What the index finds with its defaults."""
    index = hash_index.build_hash_index(I.vectors(spark, sf), work_dir(spark, "hashed"))
    asked = _every_hundredth(spark, sf)
    exact = knn.knn_join(asked, I.vectors(spark, sf).select("id", "file_path", "vector"), 10, exclude_same_id=True)
    return _nine_of_ten(index.neighbors(asked, 10, exclude_same_id=True), exact)


@register
def q_knn_cells(spark, sf):
    """Cells are left out by the triangle inequality alone, so the answer is that of the plain join."""
    cells, centroids = _indexed(spark, sf)
    asked = I.vectors(spark, sf).select(F.col("id").alias("query_id"), "vector")
    out = bounded.knn_cells(asked, cells, centroids, 10, exclude_same_id=True)
    return out.select("query_id", "rank", "id", "file_path", _score6())


@register
def q_knn_codes(spark, sf):
    """A scan of codes for a table of queries, with every undecided row looked at in full."""
    rows = I.vectors(spark, sf).select("id", "file_path", "vector")
    ranges = bounded.unit_ranges(rows)
    asked = rows.select(F.col("id").alias("query_id"), "vector")
    out = bounded.knn_codes(asked, bounded.quantize_units(rows, ranges), rows, ranges, 10, exclude_same_id=True)
    return out.select("query_id", "rank", "id", "file_path", _score6())


@register
def q_search_codes(spark, sf):
    """As above for one query, with two rows a thousand times as long as the others."""
    long = F.transform("vector", lambda x: x * 1000)
    rows = I.vectors(spark, sf).withColumn("vector", F.when(F.col("vec_id") < 2, long).otherwise(F.col("vector")))
    ranges = bounded.unit_ranges(rows)
    hits = bounded.search_codes(bounded.quantize_units(rows, ranges), rows, ranges, I.QUERY, 50)
    return hits.select("rank", "id", "file_path", _score6())


def _product_index(spark, sf, parts: int) -> tuple[product_codes.ProductIndex, DataFrame]:
    rows = I.vectors(spark, sf).select("id", "file_path", "vector")
    return product_codes.build_product_index(rows, work_dir(spark, "products"), I.label_centroids(spark, sf), parts), rows


@register
def q_product_index_neighbors(spark, sf):
    """Product codes with full intervals, which decide by the vectors wherever a code leaves doubt."""
    index, rows = _product_index(spark, sf, 32)
    out = index.neighbors(_every_hundredth(spark, sf), rows, 10, z=8.0, exclude_same_id=True)
    return out.select("query_id", "rank", "id", "file_path", _score6())


@register
def q_product_index_recall(spark, sf):
    """What sixteen bytes a row find with the default spread."""
    index, rows = _product_index(spark, sf, 16)
    asked = _every_hundredth(spark, sf)
    exact = knn.knn_join(asked, rows, 10, exclude_same_id=True)
    return _nine_of_ten(index.neighbors(asked, rows, 10, exclude_same_id=True), exact)


@register
def q_neighbor_graph_recall(spark, sf):
    """What the refined graph holds, for every row."""
    rows = I.vectors(spark, sf).select("id", "file_path", "vector")
    exact = knn.knn_join(rows.select(F.col("id").alias("query_id"), "vector"), rows, 10, exclude_same_id=True)
    return _nine_of_ten(graph.neighbor_graph(rows, 10), exact)


# -- text to vectors -----------------------------------------------------------------------------


def _texts(spark, sf) -> DataFrame:
    docs = I.table(spark, sf, "documents").selectExpr("concat('d', doc_id) AS id", "text")
    talk = I.table(spark, sf, "conversations").selectExpr("concat('c', conv_id, '-', turn) AS id", "text")
    pages = I.table(spark, sf, "pages").selectExpr("concat('p', page_id) AS id", "html AS text")
    return spread(docs).unionByName(talk).unionByName(spread(pages))


@register
def q_tokenize_words(spark, sf):
    words = _texts(spark, sf).select("id", X.tokenize_words(F.col("text")).alias("words"))
    return words.select("id", F.size("words").alias("n_words"), F.array_join("words", " ").alias("words"))


@register
def q_estimate_tokens(spark, sf):
    words = _texts(spark, sf).select("id", X.tokenize_words(F.col("text")).alias("words"))
    return words.select("id", F.round(X.estimate_tokens(F.col("words")), 6).alias("tokens"))


@register
def q_chunk_documents(spark, sf):
    return chunk.chunk_documents(spread(I.table(spark, sf, "documents").select("doc_id", "text")))


@register
def q_chunk_documents_spaced(spark, sf):
    talk = I.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return chunk.chunk_documents(talk, size=40, overlap=8, sep=" ")


def _directed() -> Column:
    """Whether a vector has a direction."""
    return F.exists("vector", lambda x: x != 0)


@register
def q_embed_texts(spark, sf):
    docs = spread(I.table(spark, sf, "documents").select("doc_id", "text"))
    out = index_rows.embed_texts(docs, text="text").where("error IS NULL").where(_directed())
    return out.select("doc_id", F.posexplode("vector").alias("dim", "x")).select(
        "doc_id", F.col("dim").cast("int").alias("dim"), F.round(F.col("x").cast("double"), 5).alias("x")
    )


@register
def q_embed_images(spark, sf):
    found = I.mixed_files(spark, sf).select("doc_id", "file_path", F.encode("text", "UTF-8").alias("content"))
    found = spread(found.where(P.file_type(F.col("file_path")) == "image"))
    out = index_rows.embed_images(found).where("error IS NULL").where(_directed())
    return out.select("doc_id", F.posexplode("vector").alias("dim", "x")).select(
        "doc_id", F.col("dim").cast("int").alias("dim"), F.round(F.col("x").cast("double"), 5).alias("x")
    )


def _row_fields(rows: DataFrame, *names: str) -> DataFrame:
    parts = [F.get_json_object("metadata", f"$.{n}").alias(n) for n in names]
    return rows.select("id", F.col("file_path").alias("path"), F.size("vector").alias("dim"), *parts)


@register
def q_text_index_rows(spark, sf):
    sizes = _turn_files(spark, sf).select("file_path", "file_size", "modified_at")
    total = I.turns(spark, sf).groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("total_chunks"))
    chunks = I.turns(spark, sf).drop("id").join(sizes, "file_path").join(total, "file_path")
    return _row_fields(
        index_rows.text_index_rows(chunks),
        "file_name", "file_type", "file_size", "modified_at", "chunk_index", "total_chunks", "chunk_text",
    )


@register
def q_image_index_rows(spark, sf):
    found = I.mixed_files(spark, sf).where(P.file_type(F.col("file_path")) == "image")
    found = found.select(
        "file_path", "file_size", "modified_at", F.sha2("text", 256).alias("file_hash"),
        F.array(F.lit(1.0).cast("float")).alias("vector"),
        F.struct(F.col("width").cast("string").alias("iso")).alias("exif"),
    )
    return _row_fields(
        index_rows.image_index_rows(found), "file_name", "file_type", "file_hash", "total_chunks", "exif.iso"
    ).withColumnRenamed("exif.iso", "iso")


@register
def q_index_rows_from_json(spark, sf):
    """Events as entries with metadata of varying completeness."""
    rows = I.table(spark, sf, "events").selectExpr(
        "concat('e', event_id) AS id",
        "array(cast(value AS float)) AS vector",
        """CASE event_type WHEN 'error' THEN 'not json' WHEN 'view' THEN props
           ELSE to_json(named_struct('file_path', concat(event_type, '/', event_id), 'file_type', event_type)) END
           AS metadata""",
    )
    out = index_rows.index_rows_from_json(rows)
    return out.select("id", "file_path", "file_type", F.size("vector").alias("dim"))


def _document_rows(spark, sf) -> DataFrame:
    docs = spread(I.current_files(spark, sf).drop("file_hash"))
    return index_rows.text_index_rows(index_rows.embed_texts(chunk.chunk_documents(docs)))


@register
def q_search(spark, sf):
    """Documents chunked, embedded and searched by a text."""
    rows = _document_rows(spark, sf)
    out = query.search(rows, "text", text=I.QUERY_TEXT, offset=5, limit=40)
    return out.select(
        "id", "file_path", "file_name", "file_type", "file_size", "similarity", "band",
        "text_preview", "has_more", "total",
    )


# -- jobs ----------------------------------------------------------------------------------------


def _final_tables(store: tables.IndexStore) -> DataFrame:
    text = F.get_json_object("metadata", "$.chunk_text")
    total = F.get_json_object("metadata", "$.total_chunks").cast("int")
    rows = store.vectors.read().select(
        "file_path", "id", "chunk_index", total.alias("total_chunks"),
        F.sha2(text, 256).alias("chunk_hash"), F.size("vector").alias("dim"),
    )
    return store.meta.read().select("file_path", "file_hash").join(rows, "file_path", "full_outer")


@register
def q_incremental_index_job(spark, sf):
    """Index the earlier files, then the current ones: edits replaced, pages gone."""
    store = tables.IndexStore(spark, work_dir(spark, "index"))
    jobs.incremental_index_job(store, I.earlier_files(spark, sf))
    jobs.incremental_index_job(store, I.current_files(spark, sf))
    return _final_tables(store)


@register
def q_index_folders(spark, sf):
    """A tree of files indexed twice: what is indexed, and how many files the second build changed."""
    root = I.write_text_tree(spark, sf, work_dir(spark, "tree"))
    store = tables.IndexStore(spark, work_dir(spark, "index"))
    folders.index_folders(store, [root])
    again = folders.index_folders(store, [root, f"{root}-missing"]).summary()
    doc = F.regexp_extract("file_path", r"doc_id=(\d+)/", 1).cast("long")
    rows = store.meta.read().select(doc.alias("doc_id"), "file_hash", "file_path")
    seen = folders.listing(store).read().select("file_path", "file_size")
    changed = F.lit(sum(again.select("new_count", "modified_count", "deleted_count").head()))
    return rows.join(seen, "file_path").select("doc_id", "file_hash", "file_size", changed.cast("long").alias("changed_again"))


@register
def q_incremental_index_summary(spark, sf):
    """Counts the second of the two runs reports."""
    store = tables.IndexStore(spark, work_dir(spark, "index"))
    store.meta.upsert(I.meta(spark, sf))
    return jobs.incremental_index_job(store, I.current_files(spark, sf)).summary()


@register
def q_incremental_index_stream(spark, sf):
    store = tables.IndexStore(spark, work_dir(spark, "index"))
    source = spark.read.parquet(f"{sf}/documents.parquet")
    # a pattern fits both a table of one file, which a stream does not take by its name, and a folder of files
    arrivals = spark.readStream.schema(source.schema).parquet(f"{sf}/documents.parque[t]").selectExpr(
        "concat(source, '/', doc_id, '.txt') AS file_path", "n_chars AS file_size",
        "doc_id AS modified_at", "sha2(text, 256) AS file_hash", "text",
    )
    incremental_index_stream(store, arrivals, f"{store.root}/checkpoint").awaitTermination()
    return _final_tables(store)
