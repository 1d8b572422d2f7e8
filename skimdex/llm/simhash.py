"""Near-duplicates by SimHash fingerprints.

Two fingerprints of 64 bits with at most three differing bits differ in at most three of their
eight bytes, so they share at least five positional bytes. The index posts every distinct
fingerprint under quadruples of byte positions: any three positions lie in one block of the Steiner
system SQS(8), whose complement is a block as well, so every linked pair meets in at least one of
the 14 lists. Pairs that meet are tallied by shared positional bytes, kept from five on, and
verified by their differing bits. Posting lists longer than ``BLOCK`` are cut into blocks and every
two blocks meet in one group; a group returns a spanning forest of its links, never all pairs.

Defined results: null and wordless texts have fingerprint zero and link like any other; equal
fingerprints link; rows may repeat; a null doc_id never names a component unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimdex.llm.common import session, stored, whole_groups

SHINGLE, BITS_APART, SEED = 3, 3, 42
BYTES_SHARED = 8 - BITS_APART
#: blocks of the Steiner system: quadruples of positions whose exclusive-or is zero
QUADS = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
BLOCK = 2048
#: groups up to this size compare by shifts, all groups at once
FEW = 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of a UTF-8 text."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    values, ones = np.array(hashes, dtype=np.uint64), np.zeros(64, np.int64)
    for at in range(0, len(values), 8192):  # the bit matrix of a long text stays small
        part = values[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.col("text").cast("string"))
    return slim.mapInArrow(run, f"doc_id {kind}, fp long")


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one group: one search per component."""
    left = np.ones(len(fps), bool)
    ends: list[np.ndarray] = []
    tails: list[np.ndarray] = []
    for seed in range(len(fps)):
        if not left[seed]:
            continue
        left[seed] = False
        front = [seed]
        while front:
            at = front.pop()
            rest = np.flatnonzero(left)
            found = rest[_linked(fps[rest] ^ fps[at])]
            left[found] = False
            ends.append(np.full(len(found), fps[at], np.int64))
            tails.append(fps[found])
            front.extend(found.tolist())
    return np.concatenate(ends), np.concatenate(tails)


def _linked(differing: np.ndarray) -> np.ndarray:
    """Count filter on shared positional bytes, then the exact check."""
    shared = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    good = shared >= BYTES_SHARED
    good[good] = np.bitwise_count(differing[good].view(np.uint64)) <= BITS_APART
    return good


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["quad", "key", "i", "j"]
    for table in whole_groups(batches, keys):
        cols = [table[k].to_numpy() for k in keys]
        fps = np.ascontiguousarray(table["fp"].to_numpy())
        edge = np.ones(len(fps) + 1, bool)
        edge[1:-1] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        bounds = np.flatnonzero(edge)
        sizes = np.diff(bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        a, b = [], []
        few = np.repeat(sizes <= FEW, sizes)
        fp, gid = fps[few], group[few]
        for shift in range(1, min(FEW, len(fp))):
            same = gid[shift:] == gid[:-shift]
            x, y = fp[:-shift][same], fp[shift:][same]
            good = _linked(x ^ y)
            a.append(x[good])
            b.append(y[good])
        for g in np.flatnonzero(sizes > FEW):
            x, y = _forest(fps[bounds[g] : bounds[g + 1]])
            a.append(x)
            b.append(y)
        a, b = np.concatenate([*a, fps[:0]]), np.concatenate([*b, fps[:0]])
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Links (a < b) among distinct fingerprints that span every component of the link graph."""
    masks = [sum(0xFF << 8 * p for p in q) for q in QUADS]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posted = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])
    lists = fps.select("fp").distinct().select("fp", F.posexplode(posted).alias("quad", "key"))
    shared = lists.groupBy("quad", "key").agg(F.count("*").alias("n")).where("n > 1")
    lists = lists.join(shared, ["quad", "key"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    lists = lists.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (F.col("blocks") == 1) | (o != F.col("own")))
    met = lists.select("quad", "key", "fp", "own", F.explode(others).alias("other"))
    met = met.select("quad", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    order = ["quad", "key", "i", "j"]
    return met.repartition(*order).sortWithinPartitions(*order).mapInArrow(_links, "a long, b long").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; the root is the smallest node of its component.

    Alternating large-star and small-star rounds; every round is written, so none is run again.
    """
    now = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(moved.union(least.select("u", "m")).distinct(), "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def components(prints: DataFrame) -> DataFrame:
    """(doc_id, fp, root, component_id) for a written table of (doc_id, fp).

    ``root`` is the smallest fingerprint of the component, ``component_id`` its smallest doc_id.
    """
    named = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    star = stars(links(prints))
    member = star.select(F.col("node").alias("fp"), "root").union(star.select("root", "root").distinct())
    best = named.join(member, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = member.join(best, "root")
    label = named.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id")
    )
    return prints.join(label, "fp", "left")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, root, component_id."""
    session(docs)
    return components(stored(fingerprints(docs), "fingerprints"))


def drop_near(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with one row of every component, all columns: that of the smallest doc_id.

    Where doc_ids repeat or are null, rows of one component are told apart by their texts instead.
    """
    session(docs)
    prints = stored(fingerprints(docs), "fingerprints")
    grouped = stored(components(prints), "near-groups")
    if not prints.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        kept = grouped.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id"))
        return docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")
    ranked = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text")
    rows = docs.select(F.struct(*docs.columns).alias("row"), ranked.alias("rank"), "doc_id", F.col("text").alias("body"))
    sets = grouped.groupBy("doc_id").agg(F.collect_set("root").alias("roots")).withColumnRenamed("doc_id", "id")
    plain = rows.join(sets, rows["doc_id"].eqNullSafe(sets["id"])).where(F.size("roots") == 1)
    mixed = rows.join(sets, rows["doc_id"].eqNullSafe(sets["id"])).where(F.size("roots") > 1)
    by_fp = grouped.select("fp", "root").distinct()
    again = _refingerprint(mixed.select("row", "rank", "body")).join(by_fp, "fp")
    both = plain.select("row", "rank", F.element_at("roots", 1).alias("root")).union(again.select("row", "rank", "root"))
    return both.groupBy("root").agg(F.min_by("row", "rank").alias("row")).select("row.*")


def _refingerprint(rows: DataFrame) -> DataFrame:
    """(row, rank, body) with the fingerprint of body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column(2).cast(pa.binary())], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], [*batch.schema.names, "fp"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())]))
