"""Exact and near duplicates, source mix: brute force and edge cases."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skimdex.llm import exact_dedup, mixing, simhash
from skimdex.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def clashing(df):
    """Extra columns under names that the operators use inside."""
    for name in ("row", "digest", "rank", "copy", "times", "count", "fp", "root", "keep", "n", "mark", "body", "kept_id"):
        df = df.withColumn(name, F.lit("x"))
    return df


ODD = [
    (5, "a  b\tc", "s"), (3, "a b c", "s"), (9, "a b c ", "s"), (None, "a b c", "s"), (1, None, "s"), (2, "", None),
    (4, " \n ", "s"), (7, "é " * 50_000, "t"), (6, "é\n" * 50_000, "t"), (8, "only", "u"), (8, "only", "u"), (8, "other", "u"),
]


def test_exact_matches_brute_force(spark):
    got = exact_dedup.exact_groups(clashing(docs_of(spark, ODD))).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in ODD:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = collections.Counter()
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, hashlib.sha256(body.encode()).hexdigest(), keep, len(ids))] += 1
    assert collections.Counter((r.doc_id, r.digest, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("cut", [1, 8])
def test_exact_tells_clashing_digests_apart(spark, cut):
    rows = [(i, f"text {i % 7}", "s") for i in range(40)] + [(None, "text 1", "s")]
    got = exact_dedup.exact_groups(docs_of(spark, rows), digest=lambda c: F.substring(F.sha2(c, 256), 1, cut // 8 + 1)).collect()
    assert len(got) == 41 and sum(r.kept for r in got) == 7
    assert {(r.doc_id, r.keep_id) for r in got if r.doc_id is not None} == {(i, i % 7) for i in range(40)}


def test_state_goes_on_with_later_arrivals(spark, folder):
    kind = "digest string, doc_id long, row long"
    state = exact_dedup.DedupState(spark, f"{folder}/state")
    spark.createDataFrame([("x", 5, 0), ("y", 6, 1)], kind).write.parquet(f"{folder}/in")
    state.feed(f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)
    spark.createDataFrame([("x", 2, 7)], kind).write.mode("append").parquet(f"{folder}/in")
    state.feed(f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)
    got = {r.digest: (r.keep_id, r.keep_row, r.n) for r in state.entries().collect()}
    assert got == {"x": (2, 7, 2), "y": (6, 1, 1)}


def test_exact_drop_keeps_columns_and_one_row_each(spark):
    frame = clashing(docs_of(spark, ODD))
    left = exact_dedup.drop_exact(frame)
    assert left.columns == frame.columns
    rows = left.collect()
    assert len(rows) == 7 and sum(r.text == "only" for r in rows) == 1
    assert exact_dedup.drop_exact(frame.limit(0)).count() == 0


def fingerprint_slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_slow(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(spark, tables):
    texts = [r.text for r in spark.read.parquet(f"{tables}/documents.parquet").select("text").collect()]
    texts += ["", None, "One", "one TWO", "A b\x0bc", "É é \u2003 x", "w " * 30_000]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) % (1 << 64) == fingerprint_slow(t)


def test_near_matches_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = [0, 7, 15, 0, (1 << 63) | 1]
    for b in base:
        fps.append(b)
        for _ in range(rng.choice([0, 1, 5])):  # chains of close fingerprints
            b ^= sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 5)))
            fps.append(b)
    fps += [base[0] ^ (1 << k) ^ (1 << j) for k in range(64) for j in range(0, 64, 7)]  # a crowded list
    prints = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    want = components_slow(fps)
    for block in (2048, 32):
        simhash.BLOCK, old = block, simhash.BLOCK
        try:
            got = {r.doc_id: r.component_id for r in simhash.components(stored(prints, "t")).collect()}
        finally:
            simhash.BLOCK = old
        assert got == dict(enumerate(want))


def test_every_close_pair_meets_in_a_list():
    for three in itertools.combinations(range(8), 3):
        assert any(not set(three) & set(q) for q in simhash.QUADS)
    rng = np.random.default_rng(5)
    x = rng.integers(-(1 << 62), 1 << 62, 500)
    y = x ^ (1 << rng.integers(0, 62, 500)) ^ (1 << rng.integers(0, 62, 500)) ^ (1 << rng.integers(0, 62, 500))
    assert simhash._linked(x ^ y).all()


def test_near_drop_edge_cases(spark):
    frame = clashing(docs_of(spark, ODD))
    rows = simhash.drop_near(frame)
    assert rows.columns == frame.columns
    got = rows.collect()
    assert len(got) == len({fingerprint_slow(t) for _, t, _ in ODD})  # none of these link but by equality
    plain = docs_of(spark, [(3, "x y z w", "s"), (1, "x y z w", "s"), (2, "q", "s")])
    assert sorted(r.doc_id for r in simhash.drop_near(plain).collect()) == [1, 2]
    assert simhash.drop_near(frame.limit(0)).count() == 0
    assert simhash.near_groups(frame.limit(0)).count() == 0


def test_mix_edge_cases(spark):
    frame = clashing(docs_of(spark, ODD))
    mixed = mixing.mix_sources(frame, epochs=3.0)
    assert mixed.columns == [c for c in frame.columns if c != "copy"] + ["copy", "shuffle_key"]
    rows = mixed.collect()
    assert {r.source for r in rows} <= {"s", "t", "u", None} and all(r.copy >= 1 for r in rows)
    assert mixing.mix_sources(frame.limit(0)).count() == 0


def test_mix_reaches_targets(spark):
    rows = [(i, "x" * (10 + i % 5), "big" if i % 3 else "small") for i in range(9000)]
    target = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    got = mixing.mix_sources(docs_of(spark, rows), target, epochs=2.0).groupBy("source").agg(F.sum(F.length("text")).alias("c"))
    size = {r.source: r.c for r in got.collect()}
    total = 2 * sum(len(t) for _, t, _ in rows)
    assert abs(size["big"] / total - 0.25) < 0.02 and abs(size["small"] / total - 0.75) < 0.03


def test_mix_counts_are_poisson_and_order_is_random(spark):
    rows = [(i, "x", "one") for i in range(20_000)]
    got = mixing.mix_sources(docs_of(spark, rows), epochs=1.5).select("doc_id", "copy").collect()
    times = collections.Counter(collections.Counter(r.doc_id for r in got).values())
    assert abs(sum(times.values()) / 20_000 - (1 - np.exp(-1.5))) < 0.015
    assert abs(times[2] / 20_000 - np.exp(-1.5) * 1.5**2 / 2) < 0.015
    ids = np.array([r.doc_id for r in got])
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.05
