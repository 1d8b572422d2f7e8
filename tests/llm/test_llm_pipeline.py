"""The pipeline as a whole against a plain version of every stage, each on what the one before kept."""

import collections
import hashlib
import math
import re

import pytest

import corpus_pipeline
from skimdex.llm import near_texts, quality
from test_llm_near_texts import roots_slow

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_slow(rows):
    kept = {}
    for row in sorted(rows, key=lambda r: r.doc_id):
        kept.setdefault(SPACE.sub(" ", row.text or ""), row)
    return list(kept.values())


def near_slow(rows):
    prints = [near_texts.prints((r.text or "").encode()) for r in rows]  # tested on their own
    fps = [(int.from_bytes(p[:16], "big"), int.from_bytes(p[16:], "big")) for p in prints]
    best = {}
    for row, root in zip(rows, roots_slow(fps)):
        if root not in best or row.doc_id < best[root].doc_id:
            best[root] = row
    return list(best.values())


def clean_slow(rows, items):
    windows = set()
    for text in items:
        words = WORD.findall((text or "").translate(LOWER))
        n = min(10, len(words))
        windows |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1) if n}
    sizes = {len(w) for w in windows}

    def clean(text):
        words = WORD.findall((text or "").translate(LOWER))
        return not any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    return [r for r in rows if clean(r.text)]


def mixed_slow(rows):
    size = collections.Counter()
    for r in rows:
        size[r.source] += len(r.text or "")
    total, roots = sum(size.values()), sum(math.sqrt(s) for s in size.values())
    out = []
    for r in rows:
        if not size[r.source]:
            continue
        rate = math.sqrt(size[r.source]) / roots * total / size[r.source]
        u = int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        term = reached = math.exp(-rate)
        times = 0
        while reached <= u:
            times += 1
            term *= rate / times
            reached += term
        for copy in range(1, times + 1):
            key = hashlib.md5(f"17:{r.doc_id}:{copy}".encode()).hexdigest()
            out.append((r.doc_id, r.text, r.lang, r.source, r.n_chars, copy, key))
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_pipeline_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels)).where(f"score >= {quality.THRESHOLD}")
    good = {r.doc_id for r in scored.collect()}
    rows = [r for r in docs.collect() if r.doc_id in good]
    sizes = [docs.count(), len(rows)]
    for step in (exact_slow, near_slow):
        rows = step(rows)
        sizes.append(len(rows))
    rows = clean_slow(rows, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    sizes.append(len(rows))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"]
    assert sorted(map(tuple, got.collect())) == sorted(mixed_slow(rows))


def test_every_stage_takes_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs.limit(0), sf)
        assert left.count() == 0 and set(docs.columns) <= set(left.columns), name
