"""Access to large listings: substring filters by trigram postings, deep pages by order statistics.

Both answer exactly what ``maintain.filter_index`` and ``maintain.list_index`` answer over the same
rows. A trigram index is a snapshot: build it again when the listing has changed.

Defined results: null paths match no filter and sort first among equal times; null times pass no
time bound and sort last; repeated rows are repeated in the answer; empty listings give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimdex.operators.maintain import DEFAULT_PAGE_SIZE, When, filter_index

GRAM = 3
#: folders of postings and of rows
FOLDERS = 64
#: so many row keys are a pushed filter of the scan; more are joined
KEYS = 10_000
#: a gram in more than this share of the rows does not pay: the rows are scanned
SCAN_SHARE = 0.125
#: a page is sorted out of at most about so many rows
SORT_ROWS = 200_000
#: bands that a pass over the rows tells apart
BANDS = 64
#: bytes of a path that are compared at a time
SLICE = 7
LAST = (1 << 63) - 1


# -- substrings


def _folder(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(FOLDERS)).cast("int")


def _grams(text: Column) -> Column:
    """Distinct runs of three characters of lower-cased text; none of shorter text."""
    low = F.lower(text)
    every = F.transform(F.sequence(F.lit(1), F.length(low) - GRAM + 1), lambda i: F.substr(low, i, F.lit(GRAM)))
    return F.array_distinct(F.when(F.length(low) >= GRAM, every).otherwise(F.array().cast("array<string>")))


def build_path_index(listing: DataFrame, path: str) -> PathIndex:
    """Write the rows of ``listing`` and the postings of their paths below ``path``.

    Rows lie in folders of their key, a hash of the path, and are sorted by it; postings in folders of
    their gram, sorted by gram and key, so equal grams pack into few bytes. A gram that all paths share
    is split over tasks by the rebalance hint.
    """
    rows = listing.withColumn("_key", F.xxhash64("file_path"))
    rows = rows.withColumn("_folder", F.pmod("_key", F.lit(FOLDERS)).cast("int"))
    rows.hint("rebalance", "_folder").sortWithinPartitions("_folder", "_key").write.partitionBy("_folder").parquet(f"{path}/rows")
    posts = listing.select(F.xxhash64("file_path").alias("_key"), F.explode(_grams(F.col("file_path"))).alias("gram"))
    posts = posts.withColumn("_folder", _folder(F.col("gram")))
    posts = posts.hint("rebalance", "_folder").sortWithinPartitions("_folder", "gram", "_key")
    posts.write.partitionBy("_folder").parquet(f"{path}/posts")
    index = PathIndex(listing.sparkSession, path, rows.schema)
    counts = index._read("posts").groupBy("gram").agg(F.count("*").alias("n"))
    counts = counts.withColumn("_folder", _folder(F.col("gram")))
    counts.repartition("_folder").sortWithinPartitions("gram").write.partitionBy("_folder").parquet(f"{path}/counts")
    return index


class PathIndex:
    """Trigram postings of a listing's paths, kept under ``path``.

    ``schema`` is that of the listing, for an index of no rows, whose files cannot tell it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None):
        self.spark, self.path, self.schema = spark, path, schema

    def _read(self, name: str) -> DataFrame:
        known = {"rows": self.schema, "posts": "_key long, gram string, _folder int", "counts": "gram string, n long, _folder int"}[name]
        reader = self.spark.read.schema(known) if known else self.spark.read
        return reader.parquet(f"{self.path}/{name}")

    def rows(self) -> DataFrame:
        """All rows of the listing the index was built of."""
        return self._read("rows").drop("_key", "_folder")

    def _part(self, name: str, grams: list[str]) -> DataFrame:
        """Rows of a table for some grams; folders and grams are literal filters of the scan."""
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        folders = sorted({r[0] for r in asked.select(_folder(F.col("gram"))).collect()})
        return self._read(name).where(F.col("_folder").isin(folders) & F.col("gram").isin(grams))

    def rarest(self, text: str) -> tuple[str | None, int]:
        """The gram of ``text`` in the fewest rows, and their number; None for text without a gram."""
        low = text.lower()  # as the filter itself compares
        grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        if not grams:
            return None, 0
        known = {r.gram: r.n for r in self._part("counts", grams).select("gram", "n").collect()}
        return min(((g, known.get(g, 0)) for g in grams), key=lambda x: (x[1], x[0]))

    def filter(self, path: str | None = None, after: When = None, before: When = None) -> DataFrame:
        """``filter_index`` of the indexed rows.

        The rarest gram of the text proposes row keys; the rows behind them are checked in full. Text
        shorter than a gram, and text whose rarest gram is common, is looked for in all rows.
        """
        every = self._read("rows")
        found = every
        gram, n = self.rarest(path) if path else (None, 0)
        if gram is not None and n <= max(KEYS, SCAN_SHARE * every.count()):
            keys = self._part("posts", [gram]).select("_key")
            if n <= KEYS:
                few = sorted({r[0] for r in keys.collect()})
                found = every.where(F.col("_folder").isin(sorted({k % FOLDERS for k in few})) & F.col("_key").isin(few))
            else:
                found = every.join(keys.distinct(), "_key", "left_semi")
        return filter_index(found, path, after, before).drop("_key", "_folder")


# -- pages


def _slice(level: int) -> Column:
    """Bytes of the path at a level as a number, in the order of the bytes; null paths first."""
    part = F.hex(F.substring(F.encode("file_path", "UTF-8"), 1 + level * SLICE, SLICE))
    return F.coalesce(F.conv(F.rpad(part, 2 * SLICE, "0"), 16, 10).cast("long"), F.lit(-1))


def _key(level: int) -> Column:
    """Ascending number of a level: the newest time first, then the path slice by slice."""
    return F.coalesce(-F.unix_micros("indexed_at"), F.lit(LAST)) if level == 0 else _slice(level - 1)


def _within(level: int, low: int, high: int) -> Column:
    """Rows whose key lies in [low, high]; times are told to the scan as well."""
    held = _key(level).between(low, high)
    if level == 0 and high < LAST:
        newest, oldest = F.timestamp_micros(F.lit(-low)), F.timestamp_micros(F.lit(-high))
        held = (F.col("indexed_at") >= oldest) & (F.col("indexed_at") <= newest)
    return held


def _bands(rows: DataFrame, level: int) -> list[tuple[int, int, int, int]]:
    """(count, smallest key, largest key, bytes of the longest path) of consecutive bands of ``rows``.

    Their bounds come from a quantile sketch, their counts are exact: one row per band and task is
    shuffled, and at most two rows per bound come back.
    """
    keyed = rows.select(_key(level).alias("key"), F.coalesce(F.octet_length("file_path"), F.lit(0)).alias("size"))
    cuts = keyed.agg(F.percentile_approx("key", [i / BANDS for i in range(1, BANDS)], 2000)).head()[0] or []
    # a cut is a band of its own, so every pass leaves less, also of a key that most rows share
    marks = F.array(*[F.lit(c) for c in sorted({*cuts, *(c - 1 for c in cuts)})]).cast("array<long>")
    band = F.size(F.filter(marks, lambda c: c < F.col("key")))
    found = keyed.groupBy(band.alias("band")).agg(
        F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.max("size").alias("size")
    )
    return [(r.n, r.low, r.high, r.size) for r in sorted(found.collect())]


def _pieces(rows: DataFrame, level: int, skip: int, size: int, most: int) -> list[tuple[DataFrame, int, int]]:
    """(rows, skip, size) of small sets of rows that together hold the page, in order."""
    out: list[tuple[DataFrame, int, int]] = []
    at = 0
    bands = _bands(rows, level)
    if sum(n for n, *_ in bands) <= most:
        return [(rows, skip, size)]
    for n, low, high, longest in bands:
        first, past = max(skip - at, 0), min(skip + size - at, n)
        at += n
        if first >= past:
            continue
        part = rows.where(_within(level, low, high))
        deeper = level + (low == high)
        # equal in all compared bytes: such rows differ in other columns at most
        settled = n <= most or deeper > level and level * SLICE >= longest
        out += [(part, first, past - first)] if settled else _pieces(part, deeper, first, past - first, most)
    return out


def seek_page(
    listing: DataFrame, path: str | None = None, after: When = None, before: When = None,
    page: int = 1, page_size: int = DEFAULT_PAGE_SIZE, most: int = SORT_ROWS,
) -> DataFrame:
    """``maintain.list_index`` without sorting what lies ahead of the page.

    Passes over the listing count bands of times, bounded by a quantile sketch, until the bands of the page
    hold at most ``most`` rows; only these are sorted. Rows of one time, however many, are told apart by
    their paths, some bytes at a time.
    """
    size = max(page_size, 1)
    skip = (max(page, 1) - 1) * size
    order = [F.desc("indexed_at"), F.col("file_path")]
    rows = filter_index(listing, path, after, before)
    parts = [r.orderBy(*order).offset(a).limit(n) for r, a, n in _pieces(rows, 0, skip, size, most)]
    if not parts:
        return rows.limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(*order)

