"""Merkle manifest of a dataset: every row gets its proof by a butterfly exchange of subtree roots.

Leaves are placed in order, group by group, and cut into aligned blocks of ``FANOUT ** LEVELS``, each
a whole subtree that one task hashes. Then blocks trade roots: in round ``r`` a block meets one block
of each subtree of its run, so at most ``FANOUT`` rows meet, and every one of them hashes the parent
itself and notes its siblings. After the last round each block holds the root and the upper part of
the proof of all its rows; nothing is handed down the tree again. The last subtree of a run may have
fewer blocks than the others; its blocks then answer for several places. The subroots of the groups
are the leaves of one more tree, traded the same way, and a block's rows read both parts at the end.

A digest is SHA-256 in lower-case hex; a node hashes the hex text of its children. Only identifiers
and digests are shuffled, never texts. Leaves ascend by identifier, then by digest.

Defined results: a null field counts as ``-``, a null identifier sorts first and is never tampered
with, a null group is a group of its own and sorts first; rows that repeat an identifier are leaves
each, equal rows are interchangeable; a lone leaf is its group's subroot, and a lone group's subroot
the root; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimdex.llm.common import ascii_lower, session, shippable, stored

FANOUT = 8
#: levels of a block: 4,096 leaves, some 300 KB, whatever the table
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<at: int, others: array<string>>>"


def leaf_of(values: list[Column]) -> Column:
    """Digest of a row: each value as byte count, colon and text, ``-`` where null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``pos``, the place of a row in its ``grp``, and ``size``, the rows of that group.

    Rows are range-partitioned by group and ``order``; equal rows are told apart by where they lay, so
    a row with any number of copies is spread as well. The driver adds up one count a partition.
    """
    rows = stored(rows.withColumn("lay", F.monotonically_increasing_id()), name)
    keys = ["grp", *order, "lay"]
    seen = F.monotonically_increasing_id()  # partition in the upper bits, place in the partition in the lower 33
    ranked = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("seen", seen).drop("lay")
    ranked = stored(ranked, name + "_ranked").withColumn("part", F.shiftright("seen", 33))
    counts = ranked.groupBy("part").count().orderBy("part").collect()
    offsets, before = [], 0
    for r in counts:
        offsets.append((r["part"], before - (r["part"] << 33)))
        before += r["count"]
    shift = rows.sparkSession.createDataFrame(offsets, "part long, shift long")
    ranked = ranked.join(F.broadcast(shift), "part").withColumn("at", F.col("seen") + F.col("shift"))
    sizes = ranked.groupBy("grp").agg(F.min("at").alias("start"), F.count("*").alias("size"))
    sizes = sizes.withColumnRenamed("grp", "_grp")
    found = ranked.join(shippable(sizes), F.col("grp").eqNullSafe(F.col("_grp")))
    return found.withColumn("pos", F.col("at") - F.col("start")).drop("_grp", "part", "seen", "shift", "at", "start")


def _tree(leaves: list[bytes], levels: int | None) -> list[list[bytes]]:
    """Nodes by level from the leaves up: ``levels`` of them, or until one node remains."""
    out = [leaves]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        low = out[-1]
        out.append([sha256(b"".join(low[i : i + FANOUT])).hexdigest().encode() for i in range(0, len(low), FANOUT)])
    return out


def _height(size: int, levels: int) -> int | None:
    """A block of a larger group is hashed to its full height, even if it is the last and short."""
    return levels if size > FANOUT**levels else None


def blocks(rows: DataFrame, ident: str, name: str, levels: int = LEVELS) -> DataFrame:
    """One row per aligned block of placed ``rows``: grp, block, size, node, and its leaves in order.

    ``leaf`` and ``shown`` are 32 bytes a leaf one after another; ``idents`` are the identifiers.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        leaf = table["leaf"].to_pylist()
        size = table["size"][0].as_py()
        node = _tree([x.hex().encode() for x in leaf], _height(size, levels))[-1][0]
        one = [
            table["grp"].slice(0, 1), table["block"].slice(0, 1), [size], [node.decode()],
            [table[ident].to_pylist()], [b"".join(leaf)], [b"".join(table["shown"].to_pylist())],
        ]
        names = ["grp", "block", "size", "node", "idents", "leaf", "shown"]
        types = [table.schema.field("grp").type, pa.int64(), pa.int64(), pa.string(),
                 pa.list_(table.schema.field(ident).type), pa.binary(), pa.binary()]
        columns = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else pa.array(x, t) for x, t in zip(one, types)]
        return pa.Table.from_arrays(columns, names)

    cut = rows.withColumn("block", F.expr(f"pos div {FANOUT**levels}"))
    schema = f"grp {kinds['grp']}, block long, size long, node string, idents array<{kinds[ident]}>, leaf binary, shown binary"
    return stored(cut.groupBy("grp", "block").applyInArrow(fold, schema), name)


def exchange(held: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Butterfly rounds over (grp, block, size, node): grp, block, root of the group, steps.

    ``steps`` lists, from the blocks up, a node's place in its run and its siblings from left to
    right. A group takes part until one node of it remains.
    """
    state = held.select(
        "grp", "block", F.expr(f"(size + {FANOUT**levels - 1}) div {FANOUT**levels}").alias("n"),
        "node", F.expr(f"cast(array() AS {STEP})").alias("steps"),
    )
    most = state.agg(F.max("n")).head()[0] or 1
    span = 1  # blocks of a full subtree in this round
    while span < most:
        state = _round(state, span)
        span *= FANOUT
    return state.select("grp", "block", F.col("node").alias("root"), "steps")


def _round(state: DataFrame, span: int) -> DataFrame:
    wide = span * FANOUT
    run, at = F.expr(f"block div {wide}"), F.expr(f"cast(block div {span} % {FANOUT} AS int)")
    here = F.col("block") % span
    own = F.expr(f"least({span}L, n - block div {span} * {span})")  # blocks of this subtree
    first = F.expr(f"least({span}L, n - block div {wide} * {wide})")  # and of the first, largest one of the run
    going = F.col("n") > span
    sent = state.where(going).withColumn("place", F.explode(F.sequence(here, first - 1, own)))
    message = F.struct(at.alias("at"), "block", "n", "node", "steps", (F.col("place") == here).alias("stays"))
    met = sent.groupBy("grp", run.alias("run"), "place").agg(F.array_sort(F.collect_list(message)).alias("peers"))
    met = met.withColumn("nodes", F.expr("transform(peers, p -> p.node)"))
    met = met.withColumn("up", F.sha2(F.array_join("nodes", ""), 256))
    each = met.select("grp", "nodes", "up", F.explode(F.expr("filter(peers, p -> p.stays)")).alias("p"))
    others = F.filter("nodes", lambda x, i: i != F.col("p.at"))
    step = F.array(F.struct(F.col("p.at").alias("at"), others.alias("others")))
    swapped = each.select(
        "grp", F.col("p.block").alias("block"), F.col("p.n").alias("n"), F.col("up").alias("node"),
        F.concat("p.steps", step).alias("steps"),
    )
    return swapped.unionByName(state.where(~going))


def _trees(held: pa.RecordBatch, levels: int) -> Iterator[tuple]:
    """Per block: its row, leaves, shown leaves, inner tree and upper steps."""
    for i in range(held.num_rows):
        at = lambda c: held.column(c)[i].as_py()  # noqa: B023,E731
        cut = lambda b: [b[j : j + 32].hex().encode() for j in range(0, len(b), 32)]
        leaf, shown = cut(at("leaf")), cut(at("shown"))
        upper = [(s["at"], [x.encode() for x in s["others"]]) for s in at("steps")]
        yield i, leaf, shown, _tree(leaf, _height(at("size"), levels)), upper


def prove(held: DataFrame, paths: DataFrame, ident: str, steps: bool = False, levels: int = LEVELS) -> DataFrame:
    """Per leaf of the blocks: identifier, leaf, proof_sha256, folded_root, and its ``steps`` if asked for.

    ``paths`` carries the upper steps by grp and block. Every folded root is hashed anew from the
    shown leaf and the siblings; nothing is taken over from the tree's own root.
    """
    kind = next(f.dataType.elementType.simpleString() for f in held.schema if f.name == "idents")
    extra = f", steps {STEP}" if steps else ""
    paths = paths.select(F.col("grp").alias("_grp"), F.col("block").alias("_block"), "steps", "root", "subroot")
    same = F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_block"))
    both = held.drop("node").join(shippable(paths), same).drop("_grp", "_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, leaf, shown, tree, upper in _trees(batch, levels):
                tail = b"".join(x for _, others in upper for x in others)
                inner = []  # per level: what stands left and right of a node in its run
                for level in tree[:-1]:
                    runs = [level[j : j + FANOUT] for j in range(0, len(level), FANOUT)]
                    inner.append([(b"".join(r[:k]), b"".join(r[k + 1 :])) for r in runs for k in range(len(r))])
                above = [(b"".join(others[:at]), b"".join(others[at:])) for at, others in upper]
                proofs, folded = [], []
                for j, node in enumerate(shown):
                    digest, at = sha256(), j
                    for level in inner:
                        left, right = level[at]
                        digest.update(left + right)
                        node = sha256(left + node + right).hexdigest().encode()
                        at //= FANOUT
                    digest.update(tail)
                    for left, right in above:
                        node = sha256(left + node + right).hexdigest().encode()
                    proofs.append(digest.hexdigest())
                    folded.append(node.decode())
                n = len(leaf)
                columns = [
                    batch.column("idents")[i].values, pa.array([x.decode() for x in leaf]),
                    pa.array([batch.column("subroot")[i].as_py()] * n), pa.array([batch.column("root")[i].as_py()] * n),
                    pa.array(proofs), pa.array(folded),
                ]
                names = [ident, "leaf", "subroot", "root", "proof_sha256", "folded_root"]
                if steps:
                    columns.append(_listed(tree, upper, n))
                    names.append("steps")
                yield pa.RecordBatch.from_arrays(columns, names)

    shape = f"{ident} {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string{extra}"
    return both.mapInArrow(run, shape)


def _listed(tree: list[list[bytes]], upper: list[tuple[int, list[bytes]]], n: int) -> pa.Array:
    rows = []
    for j in range(n):
        steps, at = [], j
        for level in tree[:-1]:
            run = level[at // FANOUT * FANOUT :][:FANOUT]
            k = at % FANOUT
            steps.append({"at": k, "others": [x.decode() for x in run[:k] + run[k + 1 :]]})
            at //= FANOUT
        rows.append(steps + [{"at": k, "others": [x.decode() for x in others]} for k, others in upper])
    kind = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))
    return pa.array(rows, kind)


def manifest(
    docs: DataFrame, shown: Column | None = None, ident: str = "doc_id", group: str = "lang",
    fields: tuple[str, ...] = FIELDS, steps: bool = False, levels: int = LEVELS,
) -> DataFrame:
    """Per row: identifier, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``shown`` is the leaf that a holder of the row presents (default: the row's own); it is folded
    with the siblings of the original. ``steps`` adds the proof itself; ``levels`` sets the block size.
    """
    session(docs)
    leaf = leaf_of([F.col(c) for c in fields])
    given = leaf if shown is None else F.coalesce(shown, leaf)
    rows = docs.select(
        F.col(ident).alias("ident"), F.col(group).alias("grp"), F.unhex(leaf).alias("leaf"), F.unhex(given).alias("shown")
    )
    held = blocks(placed(rows, ["ident", "leaf"], "leaves"), "ident", "blocks", levels)
    lower = stored(exchange(held, levels), "block_paths")
    # the groups' subroots, in order of the group, are the leaves of the tree above
    root = F.unhex("root")
    tops = lower.where("block = 0").select(F.lit(0).alias("grp"), F.col("grp").alias("ident"), root.alias("leaf"), root.alias("shown"))
    above = blocks(placed(tops, ["ident", "leaf"], "subroots"), "ident", "top_blocks", levels)
    paths = exchange(above, levels).withColumn("subroot", F.col("root"))
    top = prove(above, paths, "ident", True, levels).select(F.col("ident").alias("_grp"), "root", F.col("steps").alias("top"))
    same = F.col("grp").eqNullSafe(F.col("_grp"))
    joined = lower.withColumnRenamed("root", "subroot").join(shippable(stored(top, "tops")), same)
    joined = joined.select("grp", "block", "subroot", "root", F.concat("steps", "top").alias("steps"))
    found = prove(held, stored(joined, "paths"), "ident", steps, levels)
    return found.withColumnRenamed("ident", ident).withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_text(docs: DataFrame, fields: tuple[str, ...] = FIELDS, ident: str = "doc_id", text: str = "text") -> Column:
    """The leaf of a row whose text lost its capitals, where 3 divides the identifier's CRC-32; else null."""
    changed = [ascii_lower(F.col(c)) if c == text else F.col(c) for c in fields]
    return F.when(F.crc32(F.col(ident).cast("string")) % 3 == 0, leaf_of(changed))
