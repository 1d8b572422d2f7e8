"""Merkle manifest: every column against a plain tree, with blocks small enough for several rounds."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from skimdex.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(levels, i):
    steps = []
    for nodes in levels[:-1]:
        run, k = nodes[i // 8 * 8 :][:8], i % 8
        steps.append((run[:k], run[k + 1 :]))
        i //= 8
    return steps


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in langs:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = tree([leaf(r) for r in groups[k]])
    top = tree([trees[k][-1][0] for k in langs])
    root, out = top[-1][0], []
    for g, k in enumerate(langs):
        for i, r in enumerate(groups[k]):
            steps = path(trees[k], i) + path(top, g)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4].translate(LOWER)) if hit else r)
            for left, right in steps:
                node = H(*left, node, *right)
            proof = H(*[x for left, right in steps for x in left + right])
            out.append((r[0], leaf(r), trees[k][-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


def found(docs, **how):
    got = merkle.manifest(docs, merkle.lowered_text(docs), **how)
    return sorted([tuple(r) for r in got.collect()], key=str)


@pytest.mark.parametrize("levels", [1, 2])
def test_every_column_equals_a_plain_tree(spark, levels):
    rng = random.Random(levels)
    rows = []
    for lang, n in (("en", 1321), (None, 65), ("de", 8), ("fr", 9), ("Ünter", 1), ("", 73), ("z", 64), ("a1", 2), ("a2", 3), ("a3", 1)):
        for _ in range(n):
            doc = rng.choice([None, rng.randrange(3000), rng.randrange(10**12), -rng.randrange(50)])
            text = rng.choice([None, "", "Ab Ü " * rng.randrange(5), "plain words"])
            rows.append((doc, rng.choice([None, "s"]), lang, rng.choice([None, 0, 7]), text))
    rows += [(5, "s", "en", 1, "Same Row")] * 700  # a third of the table is one row
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for name in ("grp", "block", "pos", "leaf", "shown", "ident", "part", "lay", "size", "node", "steps"):
        docs = docs.withColumn(name, F.lit("x"))
    assert found(docs, levels=levels) == plain(rows)


def test_short_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    one = [(3, "s", "en", 1, "Only One")]
    got = found(spark.createDataFrame(one, SCHEMA))
    assert got == plain(one)
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == H()  # a lone leaf is the root, without siblings
    nulls = [(None, None, None, None, None)] * 20 + [(1, "s", "en", 2, "x" * 1_000_000)]
    assert found(spark.createDataFrame(nulls, SCHEMA), levels=1) == plain(nulls)


def test_steps_fold_to_the_root_and_notice_a_change(spark):
    rows = [(i, "s", "en" if i % 3 else "de", 1, f"Text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = merkle.manifest(docs, F.when(F.col("doc_id") == 77, F.sha2(F.lit("forged"), 256)), steps=True, levels=1).collect()
    for r in got:
        node = r.leaf
        for s in r.steps:
            node = H(*s["others"][: s["at"]], node, *s["others"][s["at"] :])
        assert node == r.root
        assert r.verified == (r.doc_id != 77)


def test_query_on_the_given_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = queries.QUERIES["op11_merkle"](spark, tables).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain([tuple(r) for r in docs.collect()])
