"""Block scoring of vectors against query vectors, with a running top-k per partition.

Vectors reach Python as Arrow batches and are scored as one matrix product per batch, so no pair of
(vector, query) ever becomes a row: each partition hands back at most ``k`` rows per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: upper bound on the numbers in one matrix (rows x dimensions or rows x queries) of a task
BLOCK_CELLS = 4_000_000
#: a tile of cosines stays in a core's cache
TILE_QUERIES, TILE_ROWS = 512, 2048
#: rows that a task may gather before it cuts them to the best, or twice its result rows if that is more
HELD_ROWS = 100_000
#: cosines rank at this many decimals: equal vectors tie wherever their row happens to sit
COSINE_DECIMALS = 12


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list array as a float64 matrix; a null entry becomes NaN."""
    flat = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim)


def usable_slices(vectors: pa.Array, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and values of the vectors with ``dim`` entries, in slices of bounded size.

    Wide vectors make an Arrow batch large, so it is never turned into one matrix.
    """
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    step = max(1, BLOCK_CELLS // dim)
    for lo in range(0, len(rows), step):
        chosen = rows[lo : lo + step]
        yield chosen, matrix(vectors.take(pa.array(chosen)), dim)


def unit_rows(block: np.ndarray) -> np.ndarray:
    """Scale rows to length 1; zero rows become NaN so they never rank."""
    norms = np.sqrt(np.einsum("ij,ij->i", block, block))
    with np.errstate(divide="ignore", invalid="ignore"):
        return block / norms[:, None]


class TopK:
    """The ``k`` best rows per query seen so far: cosine descending, then id and path ascending.

    Blocks are screened by cosines in single precision, which lie within ``slack`` of the true ones; what
    passes is scored again in double precision. Found rows are gathered and cut together, so the cost of
    a cut is shared by all queries of a task.
    """

    def __init__(self, unit: np.ndarray, k: int):
        self.k, self.unit, self.near = k, unit, unit.astype(np.float32)
        self.slack = (unit.shape[1] + 8) * 2.0**-23
        self.floor = np.full(len(unit), -np.inf)
        self.leads = np.full((len(unit), k), -np.inf, np.float32)  # the nearest in single precision
        self.room = max(HELD_ROWS, 2 * len(unit) * k)
        self.found: list[pa.Table] = []
        self.held = 0

    def offer(
        self, block: np.ndarray, single: np.ndarray, queries: np.ndarray, payload: pa.RecordBatch, barred: np.ndarray | None = None
    ) -> None:
        """Merge a block of unit rows, given in both precisions, against ``queries``.

        ``barred`` says for queries x rows which may not meet.
        """
        near = self.near[queries] @ single.T
        if barred is not None:
            near[barred] = -np.inf
        floor = self.floor[queries]
        blank = np.flatnonzero(~np.isfinite(floor))
        if len(block) > self.k and len(blank):
            filled = np.where(np.isnan(near[blank]), -np.inf, near[blank])
            floor[blank] = np.partition(filled, len(block) - self.k, axis=1)[:, len(block) - self.k] - self.slack
        # ties with the k-th best stay in until the id decides
        bound = np.maximum(floor - self.slack, np.finfo(np.float32).min).astype(np.float32)
        passed = np.flatnonzero(near >= bound[:, None])
        if not len(passed):
            return
        floor = self.floor[queries] = np.maximum(floor, self._lead(near, passed, queries) - self.slack)
        step = max(1, BLOCK_CELLS // block.shape[1])
        for lo in range(0, len(passed), step):
            cols, rows = np.divmod(passed[lo : lo + step], len(block))
            cosines = np.einsum("ij,ij->i", block[rows], self.unit[queries[cols]])
            ranks = np.round(cosines, COSINE_DECIMALS)
            good = ranks >= floor[cols]  # a NaN is not
            rows, cols = rows[good], cols[good]
            found = pa.Table.from_batches([payload]).take(pa.array(rows))
            found = found.add_column(0, "_q", pa.array(queries[cols].astype(np.int32)))
            found = found.append_column("_cos", pa.array(cosines[good]))
            self.found.append(found.append_column("_key", pa.array(ranks[good])))
            self.held += len(rows)
            if self.held > self.room:
                self.best()

    def _lead(self, near: np.ndarray, passed: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The k-th nearest of each query in single precision, after what ``passed`` of a block."""
        cols, value = passed // near.shape[1], near.ravel()[passed]
        order = np.lexsort((-value, cols))
        cols, value = cols[order], value[order]
        at = np.arange(len(cols)) - np.searchsorted(cols, cols)
        first = at < self.k
        both = np.full((len(queries), 2 * self.k), -np.inf, np.float32)
        both[:, : self.k] = self.leads[queries]
        both[cols[first], self.k + at[first]] = value[first]
        self.leads[queries] = np.partition(both, self.k, axis=1)[:, self.k :]
        return self.leads[queries].min(axis=1)

    def best(self) -> pa.Table | None:
        """The best rows of everything offered; None if nothing was found."""
        if self.held:
            self.found = [self._cut(pa.concat_tables(self.found).combine_chunks())]
            self.held = self.found[0].num_rows
        return self.found[0] if self.held else None

    def _cut(self, table: pa.Table) -> pa.Table:
        ties = [(c, "ascending") for c in ("id", "file_path") if c in table.schema.names]
        sort = [("_q", "ascending"), ("_key", "descending"), *ties]
        table = table.take(pc.sort_indices(table, sort_keys=sort))
        query = table.column("_q").to_numpy()
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        table = table.filter(pa.array(rank < self.k))
        last = rank == self.k - 1
        if last.any():
            at_k = rank[rank < self.k] == self.k - 1
            queries = table.column("_q").to_numpy()[at_k]
            self.floor[queries] = table.column("_key").to_numpy()[at_k]
        return table


def partition_topk(
    batches: Iterator[pa.RecordBatch],
    query_rows: np.ndarray,
    k: int,
    query_ids: list[str] | None = None,
    probes: dict[int, np.ndarray] | None = None,
    allowed: Callable[[pa.RecordBatch], np.ndarray] | None = None,
) -> Iterator[pa.RecordBatch]:
    """Top-k per query over one partition.

    ``query_ids`` excludes a row from the query that carries the same id. ``probes`` maps a cell to
    the queries that look into it; rows of other cells are not scored for a query. ``allowed`` says
    for rows x queries which may meet; columns that start with an underscore serve it alone.
    """
    n_queries, dim = query_rows.shape
    queries = unit_rows(query_rows)
    column_of: dict[str, list[int]] = {}
    for j, qid in enumerate(query_ids or []):
        column_of.setdefault(qid, []).append(j)
    everyone = np.arange(n_queries)
    top = TopK(queries, k)
    kept: list[str] = []

    def score(part: pa.RecordBatch, wanted: np.ndarray, meet: np.ndarray | None = None) -> None:
        for rows, values in usable_slices(part.column("vector"), dim):
            offer(part.select(kept).take(pa.array(rows)), unit_rows(values), wanted, None if meet is None else meet[rows])

    def offer(payload: pa.RecordBatch, block: np.ndarray, wanted: np.ndarray, meet: np.ndarray | None) -> None:
        ids = payload.column("id").to_pylist() if column_of else []
        own = [(i, j) for i, rid in enumerate(ids) for j in column_of.get(rid, ())]
        own_rows, own_queries = np.array(own, dtype=np.int64).reshape(-1, 2).T
        single = block.astype(np.float32)
        for lo in range(0, len(wanted), TILE_QUERIES):
            chosen = wanted[lo : lo + TILE_QUERIES]  # ascending
            for at in range(0, len(block), TILE_ROWS):
                end = min(at + TILE_ROWS, len(block))
                barred = None if meet is None else ~meet[at:end, chosen].T
                few = slice(*np.searchsorted(own_rows, (at, end)))
                column = np.minimum(np.searchsorted(chosen, own_queries[few]), len(chosen) - 1)
                here = chosen[column] == own_queries[few]
                if here.any():
                    barred = np.zeros((len(chosen), end - at), bool) if barred is None else barred
                    barred[column[here], own_rows[few][here] - at] = True
                top.offer(block[at:end], single[at:end], chosen, payload.slice(at, end - at), barred)

    for batch in batches:
        kept = [n for n in batch.schema.names if n not in ("vector", "cell") and n[0] != "_"]
        if allowed is not None:
            step = max(1, BLOCK_CELLS // max(1, n_queries))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                meet = allowed(part)
                some = meet.any(axis=1)
                score(part.filter(pa.array(some)), everyone, meet[some])
            continue
        if probes is None:
            score(batch, everyone)
            continue
        cells = batch.column("cell").to_numpy(zero_copy_only=False)
        for cell in np.unique(cells):
            wanted = probes.get(int(cell))
            if wanted is not None:
                score(batch.filter(pa.array(cells == cell)), wanted)
    best = top.best()
    if best is not None:
        yield from best.drop_columns("_key").combine_chunks().to_batches(max_chunksize=10_000)


def payload_schema(df: DataFrame) -> T.StructType:
    """Schema of ``partition_topk`` output for an input frame."""
    kept = [f for f in df.schema.fields if f.name not in ("vector", "cell") and f.name[0] != "_"]
    return T.StructType(
        [T.StructField("_q", T.IntegerType()), *kept, T.StructField("_cos", T.DoubleType())]
    )


def best_of_each(rows: pa.RecordBatch, key: str) -> pa.RecordBatch:
    """The nearest row per ``key`` value within a batch; rows without a key are dropped."""
    near = pc.round(rows.column("cosine"), COSINE_DECIMALS)
    keyed = pa.table({"key": rows.column(key), "near": near, "id": rows.column("id")})
    sort = [("key", "ascending"), ("near", "descending"), ("id", "ascending")]
    rows = rows.take(pc.sort_indices(keyed, sort_keys=sort))
    rows = rows.filter(rows.column(key).is_valid())
    values = rows.column(key)
    if len(values) < 2:
        return rows
    first = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1))
    return rows.filter(pa.concat_arrays([pa.array([True]), first]))


def score_rows(vectors: DataFrame, query: list[float], best_by: str | None = None) -> DataFrame:
    """Every usable row with its ``cosine`` to one query vector; the vector itself is dropped.

    With ``best_by`` a batch keeps only its nearest row per value of that column, which thins out
    the rows ahead of a per-value aggregate.
    """
    row = np.asarray(query, dtype=np.float64)[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = unit_rows(row)[0]
        for batch in batches:
            rest = batch.select([n for n in batch.schema.names if n != "vector"])
            for rows, values in usable_slices(batch.column("vector"), row.shape[1]):
                cosines = unit_rows(values) @ unit
                ranked = ~np.isnan(cosines)
                part = rest.take(pa.array(rows[ranked]))
                out = pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cosines[ranked])], [*part.schema.names, "cosine"]
                )
                yield best_of_each(out, best_by) if best_by else out

    kept = [f for f in vectors.schema.fields if f.name != "vector"]
    return vectors.mapInArrow(run, T.StructType([*kept, T.StructField("cosine", T.DoubleType())]))
