"""Near-duplicate texts: every pair of five-word Jaccard 0.8 or more, and what wide SimHash finds besides.

A text has two prints of 128 bits, of its 2-word and of its 5-word shingles. The first is posted by
its bytes: every distinct pair of prints goes to the lists of the positional triples ``TRIPLES``, so two
that share enough positional bytes meet, and three shared bytes are the least count that does. Any
``SURE`` shared bytes hold a triple, so prints up to ``16 - SURE`` bits apart always meet, and most
that are further apart do. Pairs that meet are verified on the 5-word prints: at most ``APART`` bits
of 128, where a Jaccard similarity of 0.8 gives 19 on average. Long lists are cut into blocks and every two
blocks meet in one group; a group returns a spanning forest of its links, never all pairs.

Prints estimate a similarity, so a pair may meet the threshold and stay apart in them. Therefore each
distinct set of 5-word shingles is also posted under ``BANDS`` keys of ``FUNCTIONS`` min-hashes each, with
two bits of ``SKETCHED`` min-hashes. Texts that meet under a key, that prints have not joined and whose
sketches differ in at most ``DIFFERING`` places may be alike: a group returns a spanning forest of these,
and the texts of a component are then compared by their sets, exactly, in blocks that again return
forests, of the links between components of prints. So no step returns more rows than it was given,
however alike the texts of a group are. A pair of Jaccard 0.8 shares 25 keys and differs in 19 places on
average; it shares no key in one of 10^14 cases and differs in more places in one of 10^13, which are the
only ways to lose one.

Defined results: case of A-Z and white space do not count; null and wordless texts have prints of
zeros and are alike; texts of fewer words than a shingle count as one shingle; rows and doc_ids may
repeat or be null: the row with the smallest doc_id stays, null last, and of equal ones the first to be
read; an empty table gives an empty result; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimdex.llm.common import session, shippable, stored, whole_groups
from skimdex.llm.simhash import stars

POSTED_WORDS, CHECKED_WORDS, APART, SEED = 2, 5, 26, 42
#: evenly spread triples of the 16 byte positions, and how many shared bytes surely hold one
TRIPLES = [t for t in combinations(range(16), 3) if sum(t) % 8 == 0]
SURE = next(n for n in range(3, 17) if all(any(set(t) <= set(s) for t in TRIPLES) for s in combinations(range(16), n)))
BLOCK = 2048
#: groups up to this size compare by shifts, all groups at once
FEW = 16
#: nodes posted at a time
STEP = 2000
#: keys of a set, and min-hashes in a key
BANDS, FUNCTIONS = 48, 3
#: min-hashes in a sketch, and how many of them may differ in two bits for a pair to be compared
SKETCHED, DIFFERING = 128, 54
#: shared and all shingles of a link: 5 * shared >= 4 * all
SHARED, ALL = 5, 4
#: shingles that min-hashes are taken of at a time
HASHED = 1024
#: shingles of a block of sets, and blocks that a component of fewer than ``BLOCK`` rows may be cut into, of ``PART`` rows
ROOM, PARTS, PART = 1 << 20, 16, 128
#: links whose forest one task makes, and the fewest such tasks
LINKS, FORESTS = 1 << 17, 16
_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(1, 2**63, (BANDS * FUNCTIONS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 2**63, (BANDS * FUNCTIONS, 1), np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _digests(text: bytes | None, *shingles: int) -> list[np.ndarray]:
    """Digests of a text's shingles of each width, a row of 16 bytes each; none for a text without words."""
    words = (text or b"").translate(_LOWER).split()
    digest, ends = xxhash.xxh3_128_digest, list(accumulate(len(w) + 1 for w in words))
    joined, starts = b" ".join(words), [0, *ends]
    out = []
    for shingle in shingles:
        last = ends[shingle - 1 :] or ends[-1:]
        found = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, last)])
        out.append(np.frombuffer(found, np.uint8).reshape(-1, 16))
    return out


def _majority(digests: np.ndarray) -> bytes:
    ones, n = np.zeros(128, np.int64), len(digests)
    for at in range(0, n, 8192):  # the bit matrix of a long text stays small
        ones += np.unpackbits(digests[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def prints(text: bytes | None) -> bytes:
    """Both prints of a UTF-8 text, 16 bytes each."""
    return b"".join(map(_majority, _digests(text, POSTED_WORDS, CHECKED_WORDS)))


def _set(digests: np.ndarray) -> np.ndarray:
    """The distinct shingles, as sorted numbers."""
    return np.unique(np.ascontiguousarray(digests[:, :8]).view(np.uint64).ravel())


def _least(shingles: np.ndarray) -> np.ndarray:
    """The min-hashes of a set of shingles."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), HASHED):
        mixed = shingles[None, at : at + HASHED] * _FACTORS
        mixed += _OFFSETS
        mixed ^= mixed >> np.uint64(31)
        mixed *= _MIX
        np.minimum(least, mixed.min(axis=1), out=least)
    return least


def _bands(least: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set by its min-hashes."""
    keys = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, FUNCTIONS).T:
        keys = (keys ^ part) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def _sketch(least: np.ndarray) -> bytes:
    """Two bits of each of ``SKETCHED`` min-hashes: all first ones, then all second ones."""
    bits = ((least[:SKETCHED] * _MIX) >> np.uint64(62)).astype(np.uint8)
    return np.packbits(np.stack([bits & 1, bits >> 1])).tobytes()


def _printed(texts: pa.Array) -> pa.Array:
    return pa.array([prints(t.as_py()) for t in texts], pa.binary())


def _banded(texts: pa.Array) -> pa.Array:
    """Per text: both prints, and size, digest, band keys and sketch of its set of shingles."""
    out = []
    for text in texts:
        posted, checked = _digests(text.as_py(), POSTED_WORDS, CHECKED_WORDS)
        shingles = _set(checked)
        mark = xxhash.xxh3_128_digest(shingles.tobytes(), SEED)
        least = _least(shingles)
        out.append((_majority(posted) + _majority(checked), mark, len(shingles), _bands(least).tobytes() + _sketch(least)))
    columns = [pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * 4, [pa.binary(), pa.binary(), pa.int32(), pa.binary()])]
    return pa.StructArray.from_arrays(columns, ["fp", "mark", "size", "bands"])


BANDED = T.StructType(
    [T.StructField("fp", T.BinaryType()), T.StructField("mark", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("bands", T.BinaryType())]
)


def _posted(nodes: DataFrame, slim: bool) -> DataFrame:
    """(key) or (key, node, c0, c1) per node (node, fp) and triple; c0 and c1 are the checked print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                code = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint8).reshape(-1, 32)
                wide = code[:, :16].astype(np.int64)
                keys = [(i << 24) | (wide[:, p] << 16) | (wide[:, q] << 8) | wide[:, r] for i, (p, q, r) in enumerate(TRIPLES)]
                columns = [pa.array(np.concatenate(keys))]
                if not slim:
                    check = np.ascontiguousarray(code[:, 16:]).view(np.int64)
                    node = part.column("node").to_numpy()
                    columns += [pa.array(np.tile(x, len(TRIPLES))) for x in (node, check[:, 0], check[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "node", "c0", "c1"][: len(columns)])

    return nodes.select("node", "fp").mapInArrow(run, "key long" if slim else "key long, node long, c0 long, c1 long")


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=1) <= APART


def _forest(node: np.ndarray, check: np.ndarray) -> np.ndarray:
    """The least node of each row's component within one group: one search per component."""
    least, left = node.copy(), np.ones(len(node), bool)
    for seed in range(len(node)):
        if not left[seed]:
            continue
        left[seed] = False
        front, held = [seed], [seed]
        while front:
            at = front.pop()
            rest = np.flatnonzero(left)
            found = rest[_alike(check[rest], check[at])].tolist()
            left[found] = False
            held += found
            front += found
        least[held] = node[held].min()
    return least


def _spread(least: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Bring ``least`` down to the least of each row's component, where rows ``x`` and ``y`` are linked."""
    while (least[x] != least[y]).any():
        low = np.minimum(least[x], least[y])
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b), a < b: every row under a key names the least of its component, so that groups that hold much
    the same rows name the same pairs. Where two blocks meet, components of a block are joined by one pair
    each; their rows name the least in a single group."""
    keys = ["key", "i", "j"]
    for table in whole_groups(batches, keys):
        cols = [table[k].to_numpy() for k in keys]
        node, own = table["node"].to_numpy(), table["own"].to_numpy()
        check = np.stack([table["c0"].to_numpy(), table["c1"].to_numpy()], axis=1)
        edge = np.ones(len(node) + 1, bool)
        edge[1:-1] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        bounds = np.flatnonzero(edge)
        sizes = np.diff(bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        whole = cols[1] == cols[2]
        few = np.flatnonzero(np.repeat((sizes <= FEW) & (sizes > 1), sizes) & whole)
        c, g = check[few], group[few]
        x, y = [few[:0]], [few[:0]]
        for shift in range(1, min(FEW, len(few))):
            at = np.flatnonzero(g[shift:] == g[:-shift])
            good = at[_alike(c[at], c[at + shift])]
            x.append(few[good])
            y.append(few[good + shift])
        least, named = node.copy(), np.ones(len(node), bool)
        _spread(least, np.concatenate(x), np.concatenate(y))
        a, b = [], []
        for k in np.flatnonzero((sizes > FEW) | ~whole[bounds[:-1]]):
            rows = slice(bounds[k], bounds[k + 1])
            all_least = _forest(node[rows], check[rows])
            if whole[bounds[k]]:
                least[rows] = all_least
                continue
            for block in (cols[1][bounds[k]], cols[2][bounds[k]]):
                at = bounds[k] + np.flatnonzero(own[rows] == block)
                least[at] = _forest(node[at], check[at])
            a.append(all_least)
            b.append(least[rows].copy())
            named[rows] = _counted(cols[1][rows], cols[2][rows], own[rows])
        other = named & (least != node)
        a, b = np.concatenate([*a, least[other]]), np.concatenate([*b, node[other]])
        yield _edges([a[a != b]], [b[a != b]])


def _counted(i: np.ndarray, j: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether a row of block ``own`` meets its own block's rows in (i, j) to count: they do in one group of many."""
    return (i == j) | ((i == 0) & (j == np.maximum(own, 1)))


def _blocked(lists: DataFrame, hot: DataFrame, node: str, more: list[str]) -> DataFrame:
    """``lists`` (key, ``node``, ``more``) sorted by key and pair of blocks (i, j); ``hot`` lists are cut into blocks."""
    lists = lists.join(shippable(stored(hot, "hot")), F.col("key") == F.col("hot"), "left")
    return _cut(lists.withColumn("blocks", F.coalesce("blocks", F.lit(1))), node, more)


def _cut(lists: DataFrame, node: str, more: list[str]) -> DataFrame:
    """``lists`` (key, blocks, ``node``, ``more``) sorted by key and pair of blocks (i, j)."""
    lists = lists.withColumn("own", F.pmod(F.xxhash64(node), "blocks").cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (F.col("blocks") == 1) | (o != F.col("own")))
    met = lists.select("key", node, *more, "own", F.explode(others).alias("other"))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), node, *more, "own")
    order = ["key", "i", "j"]
    return met.repartition(*order).sortWithinPartitions(*order)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b: links among nodes (node, fp) that span every component of the link graph."""
    hot = _posted(nodes, True).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    hot = hot.select(F.col("key").alias("hot"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = _blocked(_posted(nodes, False), hot, "node", ["c0", "c1"])
    return met.mapInArrow(_links, "a long, b long").distinct()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per band key of each set, with its sketch."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            words = np.frombuffer(b"".join(part.column("bands").to_pylist()), np.int64).reshape(part.num_rows, -1)
            rest = part.select(["place", "size", "root"]).take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))
            sketch = [pa.array(np.repeat(c, BANDS)) for c in words[:, BANDS:].T]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[:, :BANDS].ravel()), *rest.columns, *sketch], ["key", "place", "size", "root", *_SKETCH]
            )


_SKETCH = [f"s{i}" for i in range(SKETCHED // 32)]


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places two sketches differ."""
    apart = (x ^ y).view(np.uint64)
    half = SKETCHED // 64
    return np.bitwise_count(apart[..., :half] | apart[..., half:]).sum(axis=-1)


def _mixed(table: pa.Table, keys: list[str]) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, block of each row) of every group of a sorted table that holds several roots.

    In a group of two blocks a row counts as of block -1 where rows of its own block meet as well: these
    come together in many groups and count in one.
    """
    cols = [table[k].to_numpy() for k in keys]
    own, root = table["own"].to_numpy(), table["root"].to_numpy()
    edge = np.ones(len(own) + 1, bool)
    edge[1:-1] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    bounds = np.flatnonzero(edge)
    mixed = np.minimum.reduceat(root, bounds[:-1]) < np.maximum.reduceat(root, bounds[:-1])
    for lo, hi in zip(bounds[:-1][mixed], bounds[1:][mixed]):
        rows = slice(lo, hi)
        here = _counted(cols[1][rows], cols[2][rows], own[rows])
        yield rows, np.where(here, -1, own[rows])


def _joined(group: np.ndarray, at: int, found: np.ndarray) -> np.ndarray:
    """Of the rows ``found`` one of each group other than ``at``'s; all these groups become one."""
    others, first = np.unique(group[found], return_index=True)
    new = others != group[at]
    if not new.any():
        return found[:0]
    group[np.isin(group, others[new])] = group[at]
    return found[first[new]]


def _edges(x: list[np.ndarray], y: list[np.ndarray]) -> pa.RecordBatch:
    x, y = (np.concatenate([np.empty(0, np.int64), *c]) for c in (x, y))
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _strangers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b), a < b: a spanning forest of the places under a key that may be alike and whose roots differ."""
    keys = ["key", "i", "j"]
    for table in whole_groups(batches, keys):
        place, size, root = (table[c].to_numpy() for c in ("place", "size", "root"))
        sketch = np.stack([table[c].to_numpy() for c in _SKETCH], axis=1)
        x, y = [], []
        for rows, own in _mixed(table, keys):
            p, n, r, s = place[rows], size[rows], root[rows], sketch[rows]
            group = np.arange(len(p))
            for at in range(len(p) - 1):
                rest = slice(at + 1, None)
                least, most = np.minimum(n[rest], n[at]), np.maximum(n[rest], n[at])
                good = (r[rest] != r[at]) & (SHARED * least >= ALL * most) & ((own[rest] != own[at]) | (own[at] < 0))
                good &= _differing(s[rest], s[at]) <= DIFFERING
                _joined(group, at, np.flatnonzero(good) + at + 1)
            # every row names the least of its component: groups that hold much the same rows name the same pairs
            found, at = np.unique(group, return_inverse=True)
            least = np.full(len(found), np.iinfo(np.int64).max)
            np.minimum.at(least, at, p)
            other = least[at] != p
            x.append(least[at][other])
            y.append(p[other])
        yield _edges(x, y)


def _components_of(edges: DataFrame, name: str) -> DataFrame:
    """``stars`` of ``edges`` (a, b), of which forests are made first: lists name many pairs of the same rows.

    The links of a node ``b`` meet in one task, whose components each name their least node; so a node has
    one link, and those that name others have one a task. Components stay as they are.
    """
    edges = stored(edges, name)
    parts = max(FORESTS, -(-edges.count() // LINKS))

    def forest(table: pa.Table) -> pa.Table:
        a, b = table["a"].to_numpy(), table["b"].to_numpy()
        node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        least = node.copy()
        _spread(least, at[: len(a)], at[len(a) :])
        other = least != node
        return pa.table({"a": least[other], "b": node[other]})

    cut = edges.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(parts)).alias("part")).groupBy("part")
    forests = cut.applyInArrow(forest, "a long, b long")
    return stars(forests.distinct())


def _shingles(texts: pa.Array) -> pa.Array:
    return pa.array([_set(*_digests(t.as_py(), CHECKED_WORDS)).tobytes() for t in texts], pa.binary())


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b), a < b: a spanning forest of the roots of a group that sets of Jaccard 0.8 or more link."""
    keys = ["key", "i", "j"]
    for table in whole_groups(batches, keys):
        root, held = table["root"].to_numpy(), table["held"].combine_chunks()
        x, y = [], []
        for rows, own in _mixed(table, keys):
            sets = [np.frombuffer(v.as_py(), np.uint64) for v in held[rows.start : rows.stop]]
            r, n = root[rows], np.array([len(v) for v in sets])
            starts = np.cumsum(n) - n
            known, shingle = np.unique(np.concatenate(sets), return_inverse=True)
            group = np.unique(r, return_inverse=True)[1]
            for at in range(len(r) - 1):
                rest = slice(at + 1, None)
                least, most = np.minimum(n[rest], n[at]), np.maximum(n[rest], n[at])
                good = (group[rest] != group[at]) & (SHARED * least >= ALL * most) & ((own[rest] != own[at]) | (own[at] < 0))
                if not good.any():
                    continue
                among = np.zeros(len(known), bool)
                among[shingle[starts[at] : starts[at] + n[at]]] = True
                first = starts[at + 1]
                shared = np.add.reduceat(among[shingle[first:]], starts[rest] - first, dtype=np.int64)
                good &= SHARED * shared >= ALL * (n[rest] + n[at] - shared)
                found = _joined(group, at, np.flatnonzero(good) + at + 1)
                x.append(np.full(len(found), r[at]))
                y.append(r[found])
        yield _edges(x, y)


def set_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that span what pairs of ``sets`` (place, size, root) that meet the threshold join of
    their roots; ``rows`` (place, text, bands) hold the texts."""
    kinds = ", ".join(f"{c} long" for c in _SKETCH)
    lists = rows.select("place", "bands").join(shippable(sets), "place")
    lists = lists.mapInArrow(_keyed, f"key long, place long, size int, root long, {kinds}")
    hot = lists.select("key").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    hot = hot.select(F.col("key").alias("hot"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = _blocked(lists, hot, "place", ["size", "root", *_SKETCH])
    near = _components_of(met.mapInArrow(_strangers, "a long, b long").distinct(), "strangers")
    near = near.unionByName(near.select(F.col("root").alias("node"), "root")).distinct()
    near = stored(near.select(F.col("node").alias("place"), F.col("root").alias("key")).join(sets, "place"), "near")
    n = F.count("*")
    blocks = F.greatest(F.ceil(n / BLOCK), F.ceil(F.sum("size") / ROOM), F.least(F.ceil(n / PART), F.lit(PARTS))).cast("int")
    near = stored(near.join(near.groupBy("key").agg(blocks.alias("blocks")), "key").select("key", "blocks", "place", "root"), "cut")
    held = F.arrow_udf(_shingles, T.BinaryType())(F.col("text")).alias("held")
    lists = rows.select("place", "text").join(shippable(near), "place").select("key", "blocks", "place", "root", held)
    return _cut(stored(lists, "held"), "place", ["root", "held"]).mapInArrow(_meeting, "a long, b long").distinct()


def _components(rows: DataFrame, nodes: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
    """(node, root) by links of prints and of equal sets, and (root, joined) by the other pairs that meet the threshold."""
    # texts of one set of shingles may repeat them unequally often, and then have several prints
    sets = rows.groupBy("mark", "fp").agg(F.min("place").alias("place"), F.min("size").alias("size"))
    sets = stored(sets.join(nodes.select("fp", "node"), "fp").drop("fp"), "sets")
    least = sets.groupBy("mark").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    equal = sets.select("mark", "node").join(least, "mark").where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    star = stored(_components_of(links(nodes).unionByName(equal), "print-links"), "star")
    once = sets.groupBy("mark").agg(F.min("place").alias("place"), F.min("size").alias("size"), F.min("node").alias("node"))
    once = once.where("size > 0").join(star, "node", "left")
    once = stored(once.select("place", "size", F.coalesce("root", "node").alias("root")), "once")
    joined = _components_of(set_links(rows.select("place", text.alias("text"), "bands"), once), "set-links")
    return star, joined.toDF("root", "joined")


def drop_near(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Rows of ``docs`` with one row of every component of near-duplicates, all columns.

    Links are those of the prints; with ``whole`` also all pairs of Jaccard 0.8 or more. The
    rows are written once with their place, prints and bands, and told apart by the place from then on.
    """
    session(docs)
    place = F.monotonically_increasing_id().alias("place")
    text = lambda c: F.col(c).cast("string").cast("binary")
    read = (_banded, BANDED) if whole else (_printed, T.BinaryType())
    fp = F.arrow_udf(*read)(text("text")).alias("fp")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), fp, place)
    rows = stored(rows.select("row", "fp.*" if whole else "fp", "place"), "printed")
    rank = F.struct(F.col("row.doc_id").isNull().alias("unnamed"), F.col("row.doc_id").alias("doc_id"), "place")
    nodes = rows.groupBy("fp").agg(F.min("place").alias("node"), F.min(rank).alias("best"))
    nodes = stored(nodes, "prints")
    star, joined = _components(rows, nodes, text("row.text")) if whole else (_components_of(links(nodes), "print-links"), None)
    root = F.coalesce("root", "node").alias("root")
    best = nodes.join(star.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("best", root)
    if whole:
        best = best.join(joined, "root", "left").select("best", F.coalesce("joined", "root").alias("root"))
    kept = best.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.place").alias("place"))
    dropped = stored(rows.select("place").join(kept, "place", "left_anti"), "dropped")
    return rows.join(shippable(dropped), "place", "left_anti").select("row.*")
