"""Near-duplicate texts: the link rule against all pairs, recall on five-word Jaccard, odd rows."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from skimdex.llm import near_texts

DOC = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return (text or "").translate(LOWER).encode().split()


def print_slow(words, shingle):
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [int.from_bytes(xxhash.xxh3_128_digest(p, 42), "big") for p in parts]
    return sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_slow(x, y):
    shared = {p for p in range(16) if (x[0] ^ y[0]) >> 8 * (15 - p) & 0xFF == 0}
    return any(set(t) <= shared for t in near_texts.TRIPLES) and (x[1] ^ y[1]).bit_count() <= 26


def roots_slow(prints):
    """Component number of each row, all pairs of distinct prints compared."""
    distinct = list(dict.fromkeys(prints))
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(distinct)):
        for j in range(i):
            if linked_slow(distinct[i], distinct[j]):
                root[find(i)] = find(j)
    at = {p: find(i) for i, p in enumerate(distinct)}
    return [at[p] for p in prints]


def kept_slow(rows):
    """The rows that stay of (doc_id, text), as a multiset."""
    prints = [(print_slow(words_of(t), 2), print_slow(words_of(t), 5)) for _, t in rows]
    best = {}
    for row, r in zip(rows, roots_slow(prints)):
        rank = (row[0] is None, row[0] or 0)
        if r not in best or rank < best[r][0]:
            best[r] = (rank, row)
    return sorted([b[1][0] for b in best.values()], key=str)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


def test_prints():
    for text in ("", None, "one", "a b", "A b C d e", "some Words here\tand\nthere " * 30, "é ü 😀 x y z w"):
        data = None if text is None else text.encode()
        words = words_of(text)
        want = print_slow(words, 2).to_bytes(16, "big") + print_slow(words, 5).to_bytes(16, "big")
        assert near_texts.prints(data) == want


def test_shared_bytes_surely_meet():
    rng = random.Random(0)
    for _ in range(2000):
        some = set(rng.sample(range(16), near_texts.SURE))
        assert any(set(t) <= some for t in near_texts.TRIPLES)


@pytest.mark.parametrize("block", [near_texts.BLOCK, 3])
def test_kept_rows_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_texts, "BLOCK", block)
    rng = random.Random(block)
    vocabulary = [f"word{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 160))]
        rows += [edited(rng, base, rng.randrange(0, 1 + len(base) // 25)) for _ in range(rng.choice([1, 2, 3, 30 if g == 0 else 4]))]
    rows = list(enumerate(rows)) + [(500, None), (501, ""), (502, " \t"), (7, rows[7].upper()), (None, rows[3]), (None, "only here"), (3, "another text")]
    frame = spark.createDataFrame(rows, DOC).repartition(5)
    for name in ("place", "fp", "row", "node", "best", "key", "with.dot"):
        frame = frame.withColumn(name, F.lit("x"))
    got = near_texts.drop_near(frame)
    assert got.columns == frame.columns
    assert sorted([r.doc_id for r in got.collect()], key=str) == kept_slow(rows)


def test_a_thousand_null_ids_are_told_apart(spark):
    rng = random.Random(5)
    rows = [(None, " ".join(f"t{i}w{rng.randrange(10**6)}" for _ in range(40))) for i in range(1000)]
    rows += rows[:200] + [(None, None)] * 300 + [(1, "x")] * 50
    got = near_texts.drop_near(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == 1000 + 1 + 1 and collections.Counter(r.doc_id for r in got) == {None: 1001, 1: 1}


def test_recall_of_planted_copies(spark):
    """Of pairs with a five-word Jaccard similarity of 0.8 or more at least nine in ten are caught, unrelated texts stay."""
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows, pairs = [], 0
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for i in range(300):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(80, 400))]
        copy = edited(rng, base, max(1, len(base) // 60))
        a, b = sets(" ".join(base)), sets(copy)
        if len(a & b) / len(a | b) >= 0.8:
            rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, copy)]
            pairs += 1
    rows += [(10_000 + i, " ".join(rng.choice(vocabulary) for _ in range(100))) for i in range(500)]
    kept = {r.doc_id for r in near_texts.drop_near(spark.createDataFrame(rows, DOC)).collect()}
    caught = sum(2 * i + 1 not in kept for i in range(pairs))
    assert pairs > 100 and caught >= 0.9 * pairs
    assert all(10_000 + i in kept for i in range(500)) and all(2 * i in kept for i in range(pairs))


def test_long_texts_and_none(spark):
    rows = [(1, "word " * 300_000), (2, "Word " * 300_000), (3, "x" * 1_000_000)]
    assert sorted(r.doc_id for r in near_texts.drop_near(spark.createDataFrame(rows, DOC)).collect()) == [1, 3]
    assert near_texts.drop_near(spark.createDataFrame([], DOC)).collect() == []


def jaccard(x, y):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words_of(x), words_of(y)))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("block", [near_texts.BLOCK, 5])
def test_every_pair_that_meets_the_threshold_is_linked(spark, monkeypatch, block):
    """Pairs just above the threshold, also those whose prints differ by too many bits or not at all."""
    monkeypatch.setattr(near_texts, "BLOCK", block)
    rng = random.Random(5)
    texts, above, apart = [], [], 0
    for _ in range(60):
        words = [rng.choice("abcdefghijklmnop") + str(rng.randrange(500)) for _ in range(rng.choice([9, 30, 120, 400]))]
        one = " ".join(words)
        for _ in range(12):
            other = words[:]
            for _ in range(rng.randint(1, max(1, len(words) // 38))):
                other[rng.randrange(len(other))] = f"z{rng.randrange(10**6)}"
            if jaccard(one, " ".join(other)) >= 0.8:
                break
        texts += [one, " ".join(other)]
        if jaccard(*texts[-2:]) >= 0.8:
            above.append(len(texts) - 2)
            x, y = ((print_slow(words_of(t), 2), print_slow(words_of(t), 5)) for t in texts[-2:])
            apart += not linked_slow(x, y)
    repeats = "one two three four five " * 3  # the same five shingles, in unequal numbers
    texts += [repeats.strip(), (repeats * 4 + "one").strip()]
    kept = {r.doc_id for r in near_texts.drop_near(spark.createDataFrame(list(enumerate(texts)), DOC), whole=True).collect()}
    assert len(above) > 30 and apart > 0
    assert [i for i in above if i in kept and i + 1 in kept] == []
    assert not {len(texts) - 2, len(texts) - 1} <= kept


@pytest.mark.parametrize("block", [near_texts.BLOCK, 7])
def test_many_alike_texts_are_joined_as_all_pairs_are(spark, monkeypatch, block):
    """Texts that are nearly all alike to less than the threshold: components are those of brute force."""
    monkeypatch.setattr(near_texts, "BLOCK", block)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**4)}" for _ in range(60)]
    texts = [edited(rng, base, rng.choice([3, 4, 5])) for _ in range(90)]
    texts = [t for x in texts[:45] for t in (x, edited(rng, x.split(), 1))]
    shown = [(print_slow(words_of(t), 2), print_slow(words_of(t), 5)) for t in texts]
    root, by_sets = list(range(len(texts))), 0
    for linked in (lambda i, j: linked_slow(shown[i], shown[j]), lambda i, j: jaccard(texts[i], texts[j]) >= 0.8):
        by_sets = 0
        for i in range(len(texts)):
            for j in range(i):
                if root[i] != root[j] and linked(i, j):
                    by_sets += 1
                    root = [root[j] if r == root[i] else r for r in root]
    want = {min(i for i, r in enumerate(root) if r == k) for k in set(root)}
    kept = {r.doc_id for r in near_texts.drop_near(spark.createDataFrame(list(enumerate(texts)), DOC), whole=True).collect()}
    assert by_sets == 3 and len(want) == 41 and kept == want


def test_a_group_returns_fewer_pairs_than_rows():
    n = 300
    columns = {"key": [1] * n, "i": [0] * n, "j": [0] * n, "own": [0] * n, "place": range(n), "size": [20] * n, "root": range(n)}
    columns |= {f"s{k}": [0] * n for k in range(4)}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k in ("i", "j", "own", "size") else pa.int64()) for k, v in columns.items()})
    pairs = [p for b in near_texts._strangers(iter([batch])) for p in zip(*b.to_pydict().values())]
    assert len(pairs) == n - 1 and {x for p in pairs for x in p} == set(range(n))


@pytest.mark.parametrize("n", [16, 300])
def test_groups_of_the_same_rows_name_the_same_pairs(n):
    """Also where a list is cut into blocks: each row is named once, whatever the keys and blocks it comes under."""
    rng, rows = random.Random(2), []
    for key in range(6):
        blocks = 1 + key % 3 * 2
        pairs = [(i, j) for i in range(blocks) for j in range(i + (blocks > 1), blocks)]
        own = {node: node * 7 % blocks for node in range(n)}
        for i, j in pairs:
            met = [node for node in range(n) if own[node] in (i, j)]
            rows += [(key, i, j, node, 0, 0, own[node]) for node in rng.sample(met, len(met))]
    kinds = {"key": pa.int64(), "i": pa.int32(), "j": pa.int32(), "node": pa.int64(), "c0": pa.int64(), "c1": pa.int64(), "own": pa.int32()}
    batch = pa.RecordBatch.from_pydict({k: pa.array(c, kind) for (k, kind), c in zip(kinds.items(), zip(*rows))})
    pairs = {p for b in near_texts._links(iter([batch])) for p in zip(*b.to_pydict().values())}
    assert len(pairs) < 3 * n
    linked = {0}
    for _ in range(3):
        linked |= {x for p in pairs if linked & set(p) for x in p}
    assert linked == set(range(n))


def test_links_that_many_lists_name_reach_the_stars_as_forests(spark, monkeypatch):
    """Every list of a group names pairs of its own: star rounds would meet the sum of all lists."""
    rng = np.random.default_rng(5)
    pairs = [(int(x), int(y)) for x in range(40) for y in rng.integers(40, 2000, 900)] + [(5000, 5001), (5001, 5003)]
    edges = spark.createDataFrame(sorted(set(pairs)), "a long, b long")
    met = []
    real = near_texts.stars
    monkeypatch.setattr(near_texts, "stars", lambda e: met.append(e.count()) or real(e))
    got = {r.node: r.root for r in near_texts._components_of(edges, "links").collect()}
    assert got == {n: 0 for pair in pairs[:-2] for n in pair if n} | {5001: 5000, 5003: 5000}
    assert met[0] < 3000 < len(set(pairs)) / 8
