"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from checks.inputs import EXTENSIONS, INDEXED_AT, QUERY, QUERY_TEXT
from skimdex.functions.embed import HashingEmbedder
from skimdex.functions.text import DELIMITER_PATTERN, WORD_PATTERN


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


WORDS = f"regexp_extract_all(text, {_quote(WORD_PATTERN)})"
CJK_WORD = "regexp_matches(w, '^[一-鿿㐀-䶿豈-﫿]')"
UNITS = f"CASE WHEN {CJK_WORD} THEN 20 ELSE octet_length(encode(w)) * 9 END"

# -- inputs --------------------------------------------------------------------------------------

V = """v AS (SELECT 'v' || vec_id AS id, 'f' || (vec_id // 5) AS file_path,
  CAST(vec_id % 5 AS INT) AS chunk_index, embedding AS vector, label, vec_id FROM embeddings)"""
Q = f"q AS (SELECT {[float(x) for x in QUERY]}::DOUBLE[] AS qv)"
SCORED = """s AS (SELECT id, file_path, chunk_index, label, vec_id,
  list_cosine_similarity(vector::DOUBLE[], qv) AS c FROM v, q)"""
SCORE = "round(least(greatest(c, 0), 1), 6)"

CUR = """cur AS (SELECT source || '/' || doc_id || '.txt' AS file_path, n_chars AS file_size,
  doc_id AS modified_at, sha256(text) AS file_hash, text FROM documents)"""
META = """meta AS (
  SELECT source || '/' || doc_id || '.txt' AS file_path,
    sha256(CASE WHEN quality = 0 OR toxic = 1 THEN text || ' old' ELSE text END) AS file_hash,
    TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS indexed_at
  FROM documents JOIN labels USING (doc_id)
  UNION ALL
  SELECT 'web/' || page_id || '.txt', sha256(html), TIMESTAMP '2024-01-01' + to_seconds(page_id) FROM pages)"""
LABELLED = """labelled AS (SELECT source || '/' || doc_id || '.txt' AS file_path
  FROM documents JOIN labels USING (doc_id))"""
M = """m AS (SELECT event_type || '/' || user_id || '/' || event_id || '.md' AS file_path,
  sha256(props) AS file_hash, ts AS indexed_at FROM events)"""
UNWANTED = """unwanted AS (SELECT event_type || '/' || user_id || '/' || event_id || '.md' AS file_path
  FROM events WHERE event_type = 'error' UNION ALL SELECT url FROM pages)"""
_EXT_LIST = "[" + ", ".join(_quote("." + e if e else "") for e in EXTENSIONS) + "]"
F = f"""f AS (SELECT doc_id, source || '/' || doc_id || ({_EXT_LIST})[doc_id % {len(EXTENSIONS)} + 1] AS file_path,
  n_chars * n_chars * 61 AS file_size, doc_id AS modified_at,
  CAST(n_chars % 4000 + 1 AS INT) AS width, CAST(n_chars * 7 % 3000 + 1 AS INT) AS height, text,
  lower(replace(({_EXT_LIST})[doc_id % {len(EXTENSIONS)} + 1], '.', '')) AS ext FROM documents)"""
IS_IMAGE = "ext IN ('jpg','jpeg','png','gif','bmp','webp','heic','heif')"
IS_TEXT = "ext IN ('txt','md')"
FILE_TYPE = f"CASE WHEN {IS_IMAGE} THEN 'image' WHEN {IS_TEXT} THEN 'text' END"
MIME = """CASE WHEN ext IN ('', 'jpg', 'jpeg') THEN 'image/jpeg'
  WHEN ext IN ('heic', 'heif') THEN 'image/heic' ELSE 'image/' || ext END"""
NEEDS = "(ext NOT IN ('jpg','jpeg','png','webp','bmp','tiff','ico') OR file_size > 4194304)"
TURNS = """t AS (SELECT 'f' || (conv_id + 50) AS file_path, CAST(turn AS INT) AS chunk_index,
  'f' || (conv_id + 50) || '__chunk_' || turn AS id, text AS chunk_text,
  CAST(length(text) AS DOUBLE) AS first FROM conversations)"""
TURN_FILES = """tf AS (SELECT file_path, CAST(sum(length(chunk_text)) AS BIGINT) AS file_size,
  CAST(max(chunk_index) AS BIGINT) AS modified_at, sha256(file_path) AS file_hash,
  CAST(count(*) AS INT) AS total_chunks, count(*) AS n_chunks FROM t GROUP BY file_path)"""
ARTIFACTS = """a AS (SELECT DISTINCT 'cache/' || sha256(text) || '.webp' AS artifact_path FROM documents
  UNION SELECT 'cache/' || sha256(html) || '.webp' FROM pages
  UNION SELECT 'cache/' || sha256(text) || '.png' FROM conversations)"""
INDEXED = """indexed AS (SELECT DISTINCT sha256(text) AS hash FROM documents JOIN labels USING (doc_id))"""
TEXTS = """x AS (SELECT 'd' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations
  UNION ALL SELECT 'p' || page_id, html FROM pages)"""


def ms(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%gZ') AS {column}"


def size_label(n: str) -> str:
    def part(unit: int, digits: int, name: str) -> str:
        scale = 10**digits
        return f"printf('%.{digits}f', floor({n} / {float(unit)} * {scale} + 0.5) / {float(scale)}) || ' {name}'"

    return f"""CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN {part(1024, 1, 'KB')}
  WHEN {n} < 1073741824 THEN {part(1048576, 1, 'MB')} ELSE {part(1073741824, 2, 'GB')} END"""


def fit(edge: int) -> tuple[str, str]:
    fits = f"width <= {edge} AND height <= {edge}"

    def side(this: str, other: str, long_when: str) -> str:
        shrunk = f"floor(greatest({this}::DOUBLE * ({edge}::DOUBLE / {other}::DOUBLE), 1))"
        return f"CAST(CASE WHEN {fits} THEN {this} WHEN {long_when} THEN {edge} ELSE {shrunk} END AS INT)"

    return side("width", "height", "width > height"), side("height", "width", "NOT (width > height)")


def chunks(source: str, keys: str, size: int = 512, overlap: int = 50, sep: str = "") -> str:
    """CTEs ending in ``ck``: keys, chunk_index, total_chunks, chunk_text of ``source`` (keys, text).

    Prefix sums give the furthest end of a chunk from every start and the restart of every end; the
    recursion then walks from start to start.
    """
    k = ", ".join(keys.split())
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys.split())
    pre = lambda a: ", ".join(f"{a}.{c}" for c in keys.split())
    return f"""wl AS (SELECT {k}, {WORDS} AS ws FROM {source}),
wu AS (SELECT {k}, i - 1 AS i, {UNITS} AS u FROM (
  SELECT {k}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM wl)),
wc AS (SELECT {k}, i, u, CAST(sum(u) OVER (PARTITION BY {k} ORDER BY i) AS BIGINT) AS hi FROM wu),
ends AS (SELECT {pre('p')}, p.i AS s, p.hi - p.u AS lo, greatest(coalesce(e.i, p.i) + 1, p.i + 1) AS e
  FROM wc p ASOF LEFT JOIN wc e ON {on('p', 'e')} AND p.hi - p.u + {size * 30} >= e.hi),
tails AS (SELECT {pre('x')}, x.s, x.e, l.hi - {overlap * 30} AS cut
  FROM ends x JOIN wc l ON {on('x', 'l')} AND l.i = x.e - 1),
starts AS (SELECT {k}, i, hi - u AS lo FROM wc),
steps AS (SELECT {pre('x')}, x.s, x.e, CASE WHEN b.i IS NULL OR b.i <= x.s THEN x.e ELSE b.i END AS nx
  FROM tails x ASOF LEFT JOIN starts b ON {on('x', 'b')} AND x.cut >= b.lo),
walk AS (SELECT {k}, s, e, nx, 0 AS chunk_index FROM steps WHERE s = 0
  UNION ALL SELECT {pre('n')}, n.s, n.e, n.nx, w.chunk_index + 1 FROM walk w JOIN steps n
    ON {on('w', 'n')} AND n.s = w.nx WHERE w.e < (SELECT len(ws) FROM wl WHERE {on('wl', 'w')})),
ck AS (SELECT {pre('w')}, CAST(w.chunk_index AS INT) AS chunk_index,
  CAST(count(*) OVER (PARTITION BY {pre('w')}) AS INT) AS total_chunks,
  array_to_string(list_slice(l.ws, w.s + 1, w.e), {_quote(sep)}) AS chunk_text
  FROM walk w JOIN wl l ON {on('w', 'l')})"""


def embedding(source: str, keys: str, codes: str) -> str:
    """CTEs ending in ``em``: keys, dim, x with the default embedder's unit vector in float precision."""
    h = HashingEmbedder()
    k = ", ".join(keys.split())
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys.split())
    pre = lambda a: ", ".join(f"{a}.{c}" for c in keys.split())
    return f"""cs AS (SELECT {k}, list_concat(list_concat([32], {codes}), [32])::BIGINT[] AS cs FROM {source}),
gr AS (SELECT {k}, unnest(list_transform(range(1, len(cs) - 1),
  lambda j: ((cs[j] * {h.BASE} + cs[j + 1]) * {h.BASE} + cs[j + 2]) * {h.MULTIPLIER} % 4294967296)) AS g FROM cs),
bk AS (SELECT {k}, CAST((g >> 16) % {h.dim} AS INT) AS dim, sum(CASE WHEN (g >> 8) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS n
  FROM gr GROUP BY ALL),
nm AS (SELECT {k}, sqrt(sum(n * n)) AS norm FROM bk GROUP BY {k}),
em AS (SELECT {pre('nm')}, d.dim, CAST(coalesce(bk.n, 0) / nm.norm AS FLOAT) AS x
  FROM nm CROSS JOIN (SELECT CAST(unnest(range({h.dim})) AS INT) AS dim) d
  LEFT JOIN bk ON {on('bk', 'nm')} AND bk.dim = d.dim WHERE nm.norm > 0)"""




def chars(column: str) -> str:
    packed = f"regexp_replace({column}, {_quote(DELIMITER_PATTERN)}, '', 'g')"
    return f"list_transform(string_split({packed}, ''), lambda ch: unicode(ch))"


def octets(column: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({column})), '..'), lambda b: ('0x' || b)::INT)"


CENTROIDS = """pd AS (SELECT label AS cell, pos, avg(x::DOUBLE) AS m FROM (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
cen AS (SELECT cell, list(m ORDER BY pos) AS cv FROM pd GROUP BY cell)"""
CELLS = """cl AS (SELECT id, cell FROM (SELECT id, cell, row_number() OVER (PARTITION BY id
  ORDER BY round(list_cosine_similarity(vector::DOUBLE[], cv), 12) DESC, cell) AS r FROM v, cen) WHERE r = 1)"""
PAIRS = """pr AS (SELECT a.id AS query_id, b.id, b.file_path,
  list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]) AS c FROM v a, v b WHERE a.id <> b.id)"""
EXACT = """ex AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, id) AS INT) AS rank
  FROM pr) WHERE rank <= 10)"""
PROBED = """pb AS (SELECT query_id, cell FROM (SELECT id AS query_id, cell, row_number() OVER (PARTITION BY id
  ORDER BY round(list_cosine_similarity(vector::DOUBLE[], cv), 12) DESC, cell) AS r FROM v, cen) WHERE r <= 3)"""
NEAR = """nr AS (SELECT * FROM (SELECT pr.query_id, pr.id, c,
  CAST(row_number() OVER (PARTITION BY pr.query_id ORDER BY round(c, 12) DESC, pr.id) AS INT) AS rank
  FROM pr JOIN cl ON cl.id = pr.id JOIN pb ON pb.query_id = pr.query_id AND pb.cell = cl.cell) WHERE rank <= 10)"""
HASHED = """pl AS (SELECT t, b, list(CASE WHEN md5('7:' || t || ':' || b || ':' || d) >= '8' THEN 1.0 ELSE -1.0 END::DOUBLE ORDER BY d) AS p
  FROM range(2) AS a(t), range(8) AS e(b), range(64) AS g(d) GROUP BY t, b),
mg AS (SELECT id, vec_id, t, b, list_dot_product(vector::DOUBLE[], p) AS m, list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) AS l FROM v, pl),
sc AS (SELECT x.id AS query_id, y.id, x.t, sum(CASE WHEN (x.m > 0) <> (y.m > 0) THEN x.m * x.m / x.l ELSE 0 END) AS s,
  sum(x.m * x.m / x.l) AS most FROM mg x JOIN mg y ON x.t = y.t AND x.b = y.b WHERE x.vec_id % 100 = 0 AND x.id <> y.id GROUP BY ALL),
met AS (SELECT query_id, v.id, v.file_path, v.chunk_index, list_cosine_similarity(w.vector::DOUBLE[], v.vector::DOUBLE[]) AS c
  FROM (SELECT DISTINCT query_id, id FROM sc WHERE round(s, 9) <= 0.25 * most) AS f JOIN v ON v.id = f.id JOIN v AS w ON w.id = f.query_id)"""
DIFF = """df AS (SELECT file_path, CASE WHEN m.file_hash IS NULL THEN 'new' WHEN c.file_hash IS NULL THEN 'deleted'
  WHEN c.file_hash <> m.file_hash THEN 'modified' ELSE 'unchanged' END AS change_type,
  m.file_hash AS old_hash, c.file_hash AS new_hash FROM cur c FULL JOIN meta m USING (file_path))"""
FINAL = (
    _with(CUR, chunks("cur", "file_path"))
    + """SELECT c.file_path, c.file_hash, k.file_path || '__chunk_' || k.chunk_index AS id, k.chunk_index,
  k.total_chunks, sha256(k.chunk_text) AS chunk_hash, CASE WHEN k.chunk_text IS NULL THEN NULL ELSE 64 END AS dim
FROM cur c LEFT JOIN ck k USING (file_path)"""
)
BAND = "CASE WHEN {0} >= 0.8 THEN 'high' WHEN {0} >= 0.6 THEN 'medium' ELSE 'low' END"
LISTED = """file_path ILIKE '%ick/1%' AND indexed_at >= TIMESTAMP '2024-01-05'
  AND indexed_at <= TIMESTAMP '2024-01-25'"""
PAGE = """ranked AS (SELECT *, row_number() OVER (ORDER BY round(c, 12) DESC, id) AS rn FROM s),
page AS (SELECT *, count(*) OVER () AS raw, row_number() OVER (PARTITION BY file_path ORDER BY round(c, 12) DESC, id) AS fr
  FROM ranked WHERE rn > {0} AND rn <= {0} + {1})"""


def oracle_sql() -> dict[str, str]:
    """Key of ``queries()`` to SQL."""
    fw, fh = fit(1024)
    first = "round(vector[1]::DOUBLE, 6) AS first"
    top = _with(V, Q, SCORED) + f"""SELECT id, file_path, chunk_index, {SCORE} AS score
  FROM (SELECT * FROM s ORDER BY round(c, 12) DESC, id LIMIT 50)"""
    vrows = "SELECT id, file_path, chunk_index, 'text' AS file_type, CAST(len(vector) AS INT) AS dim"
    merged = f"""SELECT id, file_path, chunk_index, CAST(len(vector) AS INT) AS dim, {first} FROM v
  WHERE file_path NOT IN (SELECT file_path FROM t)
  UNION ALL SELECT id, file_path, chunk_index, 2, first FROM t"""
    return {
        "scan_files": """SELECT doc_id, octet_length(encode(text)) + 1 AS file_size,
  sha256(text || chr(10)) AS file_hash, true AS dated FROM documents""",
        "scan_image_headers": """SELECT vec_id, CASE WHEN label > 0 THEN label + 1 END AS width,
  CASE WHEN label > 0 THEN 8 END AS height, CASE WHEN label > 0 THEN 1 END AS channels, label > 0 AS ok
  FROM embeddings""",
        "index_folders": """SELECT doc_id, sha256(text || chr(10)) AS file_hash, octet_length(encode(text)) + 1 AS file_size,
  CAST(0 AS BIGINT) AS changed_again FROM documents""",
        "content_hash": "SELECT doc_id, sha256(text) AS file_hash FROM documents",
        "read_text_docs": """SELECT doc_id, CASE WHEN coalesce(toxic, 0) <> 1 THEN text END AS text,
  CASE WHEN toxic = 1 THEN 'invalid UTF-8' END AS error FROM documents LEFT JOIN labels USING (doc_id)""",
        "scan_images": """SELECT vec_id, CASE WHEN label > 0 THEN label + 1 END AS width,
  CASE WHEN label > 0 THEN 8 END AS height, CASE WHEN label > 0 THEN 1 END AS channels, label > 0 AS ok
  FROM embeddings""",
        "scan_vectors": _with(V) + f"{vrows}, {first} FROM v",
        "scan_meta": _with(META) + f"SELECT file_path, file_hash, {ms('indexed_at')} FROM meta",
        "upsert_vectors": _with(V, TURNS) + merged,
        "upsert_vectors_by_id": _with(V)
        + f"""SELECT id, file_path, chunk_index, CAST(len(vector) AS INT) AS dim, {first} FROM v
  WHERE vec_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'v' || doc_id, 'l' || doc_id, 0, 2, quality FROM labels""",
        "latest": """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""",
        "fit_vector_dim": _with(V)
        + """SELECT id, 96 AS wide_dim, round(list_sum(vector::DOUBLE[]), 6) AS wide_sum, 0.0::DOUBLE AS wide_last,
  48 AS cut_dim, round(list_sum(vector[1:48]::DOUBLE[]), 6) AS cut_sum,
  round(vector[48]::DOUBLE, 6) AS cut_last FROM v""",
        "upsert_meta": _with(META, CUR, LABELLED)
        + f"""SELECT file_path, file_hash, {ms('indexed_at')} FROM (
  SELECT * FROM meta WHERE file_path NOT IN (SELECT file_path FROM labelled)
  UNION ALL SELECT file_path, file_hash, TIMESTAMP '{INDEXED_AT}' FROM cur
  WHERE file_path IN (SELECT file_path FROM labelled))""",
        "written_gate": _with(CUR, LABELLED)
        + "SELECT file_path, file_hash FROM cur WHERE file_path IN (SELECT file_path FROM labelled)",
        "delete_by_paths": _with(M, UNWANTED)
        + f"""SELECT file_path, file_hash, {ms('indexed_at')} FROM m
  WHERE file_path NOT IN (SELECT file_path FROM unwanted)""",
        "delete_from_store": _with(V, TURNS)
        + """SELECT file_path, count(*) AS n_rows FROM v
  WHERE file_path NOT IN (SELECT file_path FROM t) GROUP BY file_path""",
        "delete_summary": _with(M, UNWANTED)
        + """SELECT (SELECT count(*) FROM unwanted) AS deleted,
  (SELECT count(*) FROM m WHERE file_path IN (SELECT file_path FROM unwanted)) AS matched""",
        "clear_index": _with(META)
        + """SELECT 'before' AS moment, (SELECT count(*) FROM embeddings) AS n_rows
  UNION ALL SELECT 'meta before', (SELECT count(*) FROM meta)
  UNION ALL SELECT 'after', 0 UNION ALL SELECT 'meta after', 0""",
        "compact_table": _with(V, TURNS) + f"SELECT id, file_path, chunk_index, dim FROM ({merged})",
        "prune_versions": f"""SELECT event_id AS version, {ms('ts').replace('AS ts', 'AS created_at')} FROM events
  WHERE ts < TIMESTAMP '2024-01-19 12:00:00' AND event_type <> 'purchase'""",
        "build_embedding_requests": """SELECT conv_id, turn, 'chat' AS protocol, 'embedder' AS model,
  'Represent the user''s input.' AS instruction, text AS body, 'assistant' AS last_role, 64 AS dimensions
  FROM conversations
  UNION ALL SELECT conv_id, turn, 'contents', 'embedder', NULL, text, NULL, NULL FROM conversations""",
        "parse_embedding_responses": """SELECT vec_id, CASE WHEN label < 7 THEN CAST(len(embedding) AS INT) END AS dim,
  label < 7 AS same, label >= 7 AS failed, CASE WHEN label < 7 THEN round(embedding[1]::DOUBLE, 6) END AS first
  FROM embeddings""",
        "file_catalog": _with(F)
        + f"""SELECT file_path, file_size, modified_at, {FILE_TYPE} AS file_type, ext AS extension,
  split_part(file_path, '/', -1) AS file_name, {size_label('file_size')} AS size_label,
  CASE WHEN {IS_IMAGE} THEN {MIME} END AS mime_type, CASE WHEN {IS_IMAGE} THEN {NEEDS} END AS needs_transcode,
  CASE WHEN {IS_IMAGE} AND {NEEDS} THEN CASE WHEN ext IN ('heic', 'heif') THEN 90 ELSE 80 END END AS webp_quality,
  width, height, {fw} AS fit_width, {fh} AS fit_height FROM f WHERE {IS_IMAGE} OR {IS_TEXT}""",
        "classify_files": _with(F)
        + f"""SELECT file_path, {FILE_TYPE} AS file_type, ext AS extension,
  split_part(file_path, '/', -1) AS file_name FROM f WHERE {IS_IMAGE} OR {IS_TEXT}""",
        "needs_transcode": _with(F) + f"SELECT file_path, {NEEDS} AS needs_transcode FROM f",
        "mime_type": _with(F) + f"SELECT file_path, {MIME} AS mime_type FROM f",
        "data_url": _with(F)
        + f"SELECT file_path, 'data:' || {MIME} || ';base64,' || to_base64(encode(text)) AS url FROM f",
        "filter_index": _with(M) + f"SELECT file_path, file_hash, {ms('indexed_at')} FROM m WHERE {LISTED}",
        "list_index": _with(M)
        + f"""SELECT file_path, file_hash, {ms('indexed_at')} FROM (SELECT * FROM m WHERE {LISTED}
  ORDER BY indexed_at DESC, file_path LIMIT 50 OFFSET 50)""",
        "filter_index_grams": _with(M) + f"SELECT file_path, file_hash, {ms('indexed_at')} FROM m WHERE {LISTED}",
        "list_index_seek": _with(M)
        + f"""SELECT file_path, file_hash, {ms('indexed_at')} FROM (SELECT * FROM m WHERE {LISTED}
  ORDER BY indexed_at DESC, file_path LIMIT 50 OFFSET 50)""",
        "count_index": _with(M) + f"SELECT count(*) AS total FROM m WHERE {LISTED}",
        "distance_to_score": """SELECT event_id, round(least(greatest(1 - value / 25.0, 0), 1), 6) AS score
  FROM events""",
        "similarity_band": f"""SELECT event_id, {BAND.format('sc')} AS band FROM (
  SELECT event_id, least(greatest(1.0 - value / 25.0::DOUBLE, 0), 1) AS sc FROM events)""",
        "size_label": f"""SELECT event_id, {size_label('n')} AS size_label FROM (
  SELECT event_id, event_id * event_id * (1 + user_id) AS n FROM events)""",
        "fit_dimensions": _with(F) + f"SELECT file_path, {fw} AS width, {fh} AS height FROM f",
        "exif_fields": """WITH g AS (SELECT *, round(value - 20, 2) AS lat, round(20 - value, 2) AS lon FROM events)
SELECT CAST(event_id AS VARCHAR) AS file_path, event_type AS camera_make, 'M' || user_id AS camera_model,
  json_extract_string(props, '$.k') AS iso,
  CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) ELSE 'f/2.8' END AS aperture,
  CAST(NULL AS VARCHAR) AS shutter_speed, CAST(NULL AS VARCHAR) AS focal_length,
  strftime(ts, '%Y:%m:%d %H:%M:%S') AS date_taken,
  CASE WHEN event_type <> 'error' THEN regexp_replace(CAST(abs(lat) AS VARCHAR), '\\.0$', '')
    || CASE WHEN lat >= 0 THEN ' N' ELSE ' S' END END AS gps_latitude,
  regexp_replace(CAST(abs(lon) AS VARCHAR), '\\.0$', '') || CASE WHEN lon >= 0 THEN ' E' ELSE ' W' END
    AS gps_longitude FROM g""",
        "snapshot_diff": _with(CUR, META, DIFF) + "SELECT * FROM df",
        "snapshot_diff_scoped": _with(CUR, META, DIFF)
        + "SELECT * FROM df WHERE change_type <> 'deleted' OR file_path LIKE 'src%'",
        "incremental_files": _with(CUR, META, DIFF)
        + "SELECT file_path, change_type FROM df WHERE change_type IN ('new', 'modified')",
        "index_summary": _with(CUR, META, DIFF)
        + """SELECT count(*) FILTER (change_type <> 'deleted') AS total, count(*) FILTER (change_type = 'new') AS new_count,
  count(*) FILTER (change_type = 'modified') AS modified_count,
  count(*) FILTER (change_type = 'deleted') AS deleted_count,
  (SELECT count(*) FROM labels WHERE toxic = 1) AS error_count FROM df""",
        "expired_artifacts": _with(ARTIFACTS, INDEXED)
        + """SELECT artifact_path, regexp_extract(artifact_path, '([0-9a-f]+)\\.webp$', 1) AS hash FROM a
  WHERE artifact_path LIKE '%.webp'
  AND regexp_extract(artifact_path, '([0-9a-f]+)\\.webp$', 1) NOT IN (SELECT hash FROM indexed)""",
        "expired_summary": _with(ARTIFACTS, INDEXED)
        + """SELECT count(*) AS total, count(*) FILTER (regexp_extract(artifact_path, '([0-9a-f]+)\\.webp$', 1)
  NOT IN (SELECT hash FROM indexed)) AS deleted FROM a WHERE artifact_path LIKE '%.webp'""",
        "clear_artifacts_summary": _with(ARTIFACTS) + "SELECT count(*) AS deleted FROM a",
        "count_vectors": "SELECT count(*) AS n_vectors FROM embeddings",
        "best_per_file": _with(V, Q, SCORED)
        + f"""SELECT id, file_path, chunk_index, {SCORE} AS score FROM (SELECT *, row_number() OVER (
  PARTITION BY file_path ORDER BY round(c, 12) DESC, id) AS r FROM s) WHERE r = 1""",
        "indexed_files_report": _with(TURNS, TURN_FILES)
        + """SELECT file_path, t.chunk_index, tf.file_size, tf.modified_at, tf.file_hash
  FROM t JOIN tf USING (file_path)""",
        "indexed_files_report_per_file": _with(TURNS, TURN_FILES)
        + "SELECT file_path, n_chunks, file_size, modified_at, file_hash FROM tf",
        "progress_by_phase": """SELECT job_id, phase, current, total,
  CAST(CASE WHEN total = 0 THEN 0 ELSE floor(current * 100.0 / total) END AS INT) AS percentage FROM (
  SELECT CAST(user_id AS VARCHAR) AS job_id, event_type AS phase, max(CAST(trunc(value) AS INT)) AS current,
    max(CASE WHEN event_type = 'view' THEN 0 ELSE 250 END) AS total FROM events GROUP BY ALL)""",
        "search_topk": top,
        "search_sq8": top,
        "search_grown_index": top,
        "coarse_index_upkeep": "SELECT count(*) AS n_rows, count(*) AS n_placed, count(*) AS n_ids FROM embeddings",
        "search_page": _with(V, Q, SCORED, PAGE.format(10, 50))
        + f"""SELECT id, file_path, chunk_index, {SCORE} AS score, raw >= 50 AS has_more,
  CAST(count(*) OVER () AS INT) AS total, 10 AS "offset" FROM page WHERE fr = 1""",
        "search_files": _with(V, Q, SCORED)
        + f"""SELECT id, file_path, chunk_index, {SCORE} AS score FROM (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY file_path ORDER BY round(c, 12) DESC, id) AS r FROM s) WHERE r = 1 ORDER BY round(c, 12) DESC, id LIMIT 20 OFFSET 10)""",
        "format_results": _with(V, Q, SCORED, PAGE.format(0, 50))
        + f"""SELECT id, chunk_index, raw >= 50 AS has_more, CAST(count(*) OVER () AS INT) AS total, file_path,
  file_path || '.txt' AS file_name, 'text' AS file_type, CAST(label * 1000 AS BIGINT) AS file_size,
  '' AS thumbnail_path, round(least(greatest(c, 0), 1) * 100, 2) AS similarity,
  {BAND.format('c')} AS band, CASE WHEN coalesce(text, '') <> '' THEN left(text, 200) END AS text_preview,
  CAST(NULL AS VARCHAR) AS exif FROM page LEFT JOIN documents ON doc_id = vec_id WHERE fr = 1""",
        "knn_join": _with(V, PAIRS, EXACT) + f"SELECT query_id, rank, id, file_path, {SCORE} AS score FROM ex",
        "knn_cells": _with(V, PAIRS, EXACT) + f"SELECT query_id, rank, id, file_path, {SCORE} AS score FROM ex",
        "knn_codes": _with(V, PAIRS, EXACT) + f"SELECT query_id, rank, id, file_path, {SCORE} AS score FROM ex",
        "hash_index_recall": "SELECT count(*) AS n_queries, true AS nine_of_ten FROM embeddings WHERE vec_id % 100 = 0",
        "product_index_recall": "SELECT count(*) AS n_queries, true AS nine_of_ten FROM embeddings WHERE vec_id % 100 = 0",
        "neighbor_graph_recall": "SELECT count(*) AS n_queries, true AS nine_of_ten FROM embeddings",
        "product_index_neighbors": _with(V, PAIRS, EXACT)
        + f"SELECT query_id, rank, id, file_path, {SCORE} AS score FROM ex WHERE CAST(substr(query_id, 2) AS BIGINT) % 100 = 0",
        "search_codes": _with(V, Q, SCORED)
        + f"""SELECT id, file_path, {SCORE} AS score, CAST(row_number() OVER (ORDER BY round(c, 12) DESC, id) AS INT) AS rank
  FROM s ORDER BY rank LIMIT 50""",
        "hash_index_neighbors": _with(V, HASHED)
        + f"""SELECT query_id, rank, id, file_path, chunk_index, {SCORE} AS score FROM (SELECT *,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, id) AS INT) AS rank FROM met) WHERE rank <= 10""",
        "build_coarse_index": _with(V, CENTROIDS, CELLS) + "SELECT id, cell FROM cl",
        "build_coarse_index_kmeans": """SELECT count(*) AS n_rows, count(*) AS n_nearest,
  count(DISTINCT vec_id) AS n_ids FROM embeddings""",
        "search_ann": _with(V, Q, SCORED, CENTROIDS, CELLS)
        + f"""SELECT id, file_path, chunk_index, {SCORE} AS score FROM (SELECT s.* FROM s JOIN cl USING (id)
  WHERE cell IN (SELECT cell FROM cen, q ORDER BY round(list_cosine_similarity(cv, qv), 12) DESC, cell LIMIT 3)
  ORDER BY round(c, 12) DESC, id LIMIT 50)""",
        "knn_ann": _with(V, CENTROIDS, CELLS, PAIRS, PROBED, NEAR)
        + f"SELECT query_id, rank, id, {SCORE} AS score FROM nr",
        "ann_recall": _with(V, CENTROIDS, CELLS, PAIRS, EXACT, PROBED, NEAR)
        + """SELECT ex.query_id, round(count(nr.id)::DOUBLE / count(*), 6) AS recall FROM ex
  LEFT JOIN nr ON nr.query_id = ex.query_id AND nr.id = ex.id GROUP BY ex.query_id""",
        "quantize_sq8": """WITH e AS (SELECT 'v' || vec_id AS id, unnest(embedding)::DOUBLE AS x,
  generate_subscripts(embedding, 1) AS pos FROM embeddings),
b AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM e GROUP BY pos)
SELECT id, string_agg(printf('%02X', CAST(floor((x - lo) * 255.0::DOUBLE / CASE WHEN hi > lo THEN hi - lo ELSE 1 END + 0.5) AS INT)),
  '' ORDER BY pos) AS code FROM e JOIN b USING (pos) GROUP BY id""",
        "lsh_neighbors": _with(V, Q, SCORED)
        + f"SELECT id, file_path, {SCORE} AS score FROM (SELECT * FROM s ORDER BY round(c, 12) DESC, id LIMIT 10)",
        "tokenize_words": _with(TEXTS)
        + f"""SELECT id, CAST(len(ws) AS INT) AS n_words, array_to_string(ws, ' ') AS words FROM (
  SELECT id, {WORDS} AS ws FROM x)""",
        "estimate_tokens": _with(TEXTS)
        + f"""SELECT id, round(coalesce(list_sum(list_transform(ws, lambda w: {UNITS})), 0) / 30.0::DOUBLE, 6) AS tokens
  FROM (SELECT id, {WORDS} AS ws FROM x)""",
        "chunk_documents": _with(chunks("documents", "doc_id"))
        + "SELECT doc_id, chunk_index, total_chunks, chunk_text FROM ck",
        "chunk_documents_spaced": _with(chunks("conversations", "conv_id turn", 40, 8, " "))
        + "SELECT conv_id, turn, chunk_index, total_chunks, chunk_text FROM ck",
        "embed_texts": _with(embedding("documents", "doc_id", chars("text")))
        + "SELECT doc_id, dim, round(x::DOUBLE, 5) AS x FROM em",
        "embed_images": _with(F, f"fi AS (SELECT * FROM f WHERE {IS_IMAGE})", embedding("fi", "doc_id", octets("text")))
        + "SELECT doc_id, dim, round(x::DOUBLE, 5) AS x FROM em",
        "text_index_rows": _with(TURNS, TURN_FILES)
        + """SELECT t.id, file_path AS path, 2 AS dim, file_path AS file_name, 'text' AS file_type,
  CAST(file_size AS VARCHAR) AS file_size, CAST(modified_at AS VARCHAR) AS modified_at,
  CAST(chunk_index AS VARCHAR) AS chunk_index, CAST(total_chunks AS VARCHAR) AS total_chunks, chunk_text
  FROM t JOIN tf USING (file_path)""",
        "image_index_rows": _with(F)
        + f"""SELECT sha256(text) AS id, file_path AS path, 1 AS dim, split_part(file_path, '/', -1) AS file_name,
  'image' AS file_type, sha256(text) AS file_hash, '1' AS total_chunks, CAST(width AS VARCHAR) AS iso
  FROM f WHERE {IS_IMAGE}""",
        "index_rows_from_json": """SELECT 'e' || event_id AS id,
  CASE WHEN event_type IN ('error', 'view') THEN 'e' || event_id ELSE event_type || '/' || event_id END AS file_path,
  CASE WHEN event_type IN ('error', 'view') THEN 'unknown' ELSE event_type END AS file_type, 1 AS dim FROM events""",
        "search": _with(
            CUR,
            chunks("cur", "file_path"),
            "tx AS (SELECT file_path, chunk_index, chunk_text AS body FROM ck "
            f"UNION ALL SELECT '', -1, {_quote(QUERY_TEXT)})",
            embedding("tx", "file_path chunk_index", chars("body")),
            "vec AS (SELECT file_path, chunk_index, list(x::DOUBLE ORDER BY dim) AS vector FROM em GROUP BY ALL)",
            """s AS (SELECT a.file_path || '__chunk_' || a.chunk_index AS id, a.file_path,
  list_cosine_similarity(a.vector, b.vector) AS c, chunk_text
  FROM vec a JOIN vec b ON b.chunk_index = -1 JOIN ck ON ck.file_path = a.file_path AND ck.chunk_index = a.chunk_index)""",
            PAGE.format(5, 40),
        )
        + f"""SELECT page.id, file_path, split_part(file_path, '/', -1) AS file_name, 'text' AS file_type,
  cur.file_size, round(least(greatest(c, 0), 1) * 100, 2) AS similarity, {BAND.format('c')} AS band,
  left(chunk_text, 200) AS text_preview, raw >= 40 AS has_more, CAST(count(*) OVER () AS INT) AS total
  FROM page JOIN cur USING (file_path) WHERE fr = 1""",
        "incremental_index_job": FINAL,
        "incremental_index_summary": _with(CUR, META, DIFF)
        + """SELECT count(*) FILTER (change_type <> 'deleted') AS total, count(*) FILTER (change_type = 'new') AS new_count,
  count(*) FILTER (change_type = 'modified') AS modified_count,
  count(*) FILTER (change_type = 'deleted') AS deleted_count, CAST(0 AS BIGINT) AS error_count FROM df""",
        "incremental_index_stream": FINAL,
    }
