"""Registered queries of the operators and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimdex.llm import chat, decontaminate, exact_dedup, html_text, licenses, merkle, mixing, pii, quality, simhash, url_rules, warc, whitening
from skimdex.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: host, path prefix, verdict
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def register(fn):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(configure(spark), sf)

    QUERIES[fn.__name__] = run
    return fn


@register
def op1_exact_dedup(spark, sf):
    groups = exact_dedup.exact_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLES["op1_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
"""


@register
def op2_simhash(spark, sf):
    groups = simhash.near_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op3_poisson_mix(spark, sf):
    mixed = mixing.mix_sources(table(spark, sf, "documents"))
    return mixed.select("doc_id", "source", "copy", "shuffle_key", "text")


ORACLES["op3_poisson_mix"] = """
WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
weights AS (SELECT source, size, sqrt(size) AS weight FROM sizes WHERE size > 0),
rates AS (SELECT source, (weight / (SELECT sum(weight) FROM weights))
                         * ((SELECT sum(size) FROM sizes) / size) AS rate FROM weights),
ks AS (SELECT source, rate, unnest(range(cast(ceil(rate + 12 * sqrt(rate) + 30) AS bigint) + 1)) AS k FROM rates),
p AS (SELECT source, k, exp(k * ln(rate) - rate - sum(CASE WHEN k > 0 THEN ln(greatest(k, 1)) ELSE 0 END)
             OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING)) AS p FROM ks),
steps AS (SELECT source, list(cdf ORDER BY k) AS steps FROM (
    SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM p) GROUP BY source),
drawn AS (SELECT d.doc_id, d.source, d.text, len(list_filter(s.steps, lambda c: c <=
              ('0x' || substr(md5('17:' || d.doc_id), 1, 13))::bigint / 4503599627370496.0)) AS times
          FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, copy, md5('17:' || doc_id || ':' || copy) AS shuffle_key, text
FROM (SELECT doc_id, source, text, unnest(range(1, times + 1)) AS copy FROM drawn)
"""


@register
def op4_html_text(spark, sf):
    texts = html_text.extract_text(table(spark, sf, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def relabelled(pages: DataFrame) -> DataFrame:
    """``pages`` whose articles open with a line that a host repeats, under a class that tells nothing,
    and whose headings stand under one that tells of noise."""
    line = F.concat(F.lit('<article><div class="k1"><p>'), html_text.host_of(F.col("url")), F.lit(" is read daily.</p></div>"))
    html = F.col("html")
    for old, new in (("<article>", line), ("<h1>", F.lit('<div class="side-effects"><h1>')), ("</h1>", F.lit("</h1></div>"))):
        html = F.replace(html, F.lit(old), new)
    return pages.withColumn("html", html)


@register
def style_tree_text(spark, sf):
    """Text of ``relabelled`` pages: the tree alone can tell their lines from their headings."""
    texts = html_text.extract_text(relabelled(table(spark, sf, "pages")))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register
def op5_url_filter(spark, sf):
    return url_rules.filter_urls(table(spark, sf, "pages"), URL_RULES, table(spark, sf, "labels"))


@register
def op6_quality(spark, sf):
    docs = table(spark, sf, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", quality.held_out_of(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register
def op7_warc(spark, sf):
    return warc.archive_pages(table(spark, sf, "pages")).drop("url")


ORACLES["op7_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest,
             min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to,
       cast(NULL AS varchar) AS error
FROM q
"""


@register
def op8_decontaminate(spark, sf):
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op8_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n,
               unnest([array_to_string(w[k:k + least(10, len(w)) - 1], ' ') FOR k IN range(1, len(w) - least(10, len(w)) + 2)]) AS win
        FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos,
                unnest([array_to_string(w[k:k + n - 1], ' ') FOR k IN range(1, len(w) - n + 2)]) AS win
         FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, pos, runs.n, item_id FROM runs JOIN win ON runs.win = win.win AND runs.n = win.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar)) AS items
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@register
def op9_pii(spark, sf):
    found = pii.summarise(table(spark, sf, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@register
def op10_chat(spark, sf):
    turns = table(spark, sf, "conversations")
    control = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        f"SELECT -1L AS conv_id, x.turn, x.role, '{control}' AS text FROM (SELECT explode(array("
        "named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) AS x)"
    )
    rows = turns.select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_windows(rows))


@register
def op11_merkle(spark, sf):
    docs = table(spark, sf, "documents")
    return merkle.manifest(docs, merkle.lowered_text(docs))


@register
def op12_licenses(spark, sf):
    return licenses.summarise(table(spark, sf, "documents")).drop("found")


@register
def op13_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))
