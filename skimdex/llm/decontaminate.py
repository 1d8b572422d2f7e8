"""Benchmark decontamination by a prefix-filtered set join over word shingles.

Items are cut into windows of ten words. A window is the set of its five-word shingles with their
offsets. One pass over the corpus finds every occurrence of a benchmark shingle; their frequencies
order the shingles by rarity. Containment is asked for in full, so the necessary prefix of a window
is its single rarest shingle: occurrences of it propose a start, the length and positional bounds
of document and window discard impossible starts, and the shingles that tile the window verify the
exact words at the remaining ones.

Defined results: null texts have no words; items without words have no windows; items of fewer than
ten words are one window; rows that repeat a doc_id are judged each by its own text; item ids may
repeat; either table may be empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skimdex.llm.common import ascii_lower, session, small, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 5


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _runs(array: Column, length: Column | int) -> Column:
    """All runs of ``length`` consecutive words, each joined by single spaces, in order."""
    last = F.size(array) - length + 1
    every = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(array, i, length), " "))
    return F.when(last >= 1, every).otherwise(F.array().cast("array<string>"))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, window): distinct windows of every item as space-joined words."""
    array = items.select("item_id", words(F.col("text")).alias("words")).where("size(words) > 0")
    length = F.least(F.lit(WINDOW), F.size("words"))
    return array.select("item_id", F.explode(_runs(F.col("words"), length)).alias("window")).distinct()


def _offsets(windows: DataFrame) -> DataFrame:
    """(win, size, step, off, shingle): the shingles of every window."""
    cut = windows.withColumn("words", F.split("window", " "))
    cut = cut.withColumn("size", F.size("words")).withColumn("step", F.least(F.lit(SHINGLE), F.col("size")))
    return cut.select("win", "size", "step", F.posexplode(_runs(F.col("words"), F.col("step"))).alias("off", "shingle"))


def occurrences(docs: DataFrame, shingles: DataFrame, steps: list[int]) -> DataFrame:
    """(row, doc_id, mark, n_words, pos, sid): one row per occurrence of a known shingle, and one with
    ``sid`` -1 per document."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"),
        words(F.col("text")).alias("words"),
    )
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    nothing = F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("shingle")))
    lists = [F.transform(_runs(F.col("words"), s), lambda x, i: F.struct(i.alias("pos"), x.alias("shingle"))) for s in steps]
    found = rows.select("row", "doc_id", "mark", "n_words", F.explode(F.concat(nothing, *lists)).alias("at"))
    known = shingles.select("shingle", "sid").union(shingles.sparkSession.sql("SELECT '', -1L"))
    found = found.select("row", "doc_id", "mark", "n_words", "at.pos", "at.shingle").join(small(known), "shingle")
    return found.drop("shingle")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, mark, n_words, n_hit, n_items, items (sorted strings, comma-joined).

    ``mark`` is XXH64 of the text and tells rows of equal doc_id apart.
    """
    session(docs)
    owners = stored(item_windows(items), "windows")
    windows = stored(owners.select("window").distinct().withColumn("win", F.monotonically_increasing_id()), "window-ids")
    offsets = _offsets(windows)
    shingles = offsets.select("shingle", "step").distinct().withColumn("sid", F.monotonically_increasing_id())
    shingles = stored(shingles, "shingles")
    steps = sorted(r.step for r in shingles.select("step").distinct().collect())  # at most five numbers
    found = stored(occurrences(docs, shingles, steps), "occurrences")
    hits = found.where("sid >= 0").select("row", "n_words", "pos", "sid")

    rarity = hits.groupBy("sid").agg(F.count("*").alias("df"))
    tiles = offsets.join(shingles.select("shingle", "sid"), "shingle").select("win", "size", "step", "off", "sid")
    ranked = tiles.join(rarity, "sid", "left")
    prefix = ranked.groupBy("win", "size").agg(
        F.min_by(F.struct("sid", "off"), F.struct("df", "sid", "off")).alias("rarest"),
        F.count_if(F.col("df").isNull()).alias("unseen"),
    )
    prefix = prefix.where("unseen = 0").select("win", "size", "rarest.sid", "rarest.off")
    start = F.col("pos") - F.col("off")
    asked = hits.join(small(prefix), "sid").select("row", "n_words", "win", "size", start.alias("start"))
    asked = asked.where("start >= 0 AND start + size <= n_words")
    tiling = tiles.where("off % step = 0 OR off = size - step").select("win", "off", "sid")
    tiling = tiling.join(prefix.select("win"), "win", "left_semi")
    count = tiling.groupBy("win").agg(F.count("*").alias("parts"))
    tiling = tiling.join(count, "win")
    parts = asked.join(small(tiling), "win").select(
        "row", "win", "size", "start", "parts", (F.col("start") + F.col("off")).alias("pos"), "sid"
    )
    seen = parts.join(hits.select("row", "pos", "sid"), ["row", "pos", "sid"])
    sure = seen.groupBy("row", "win", "size", "start").agg(F.count("*").alias("n"), F.first("parts").alias("parts"))
    sure = stored(sure.where("n = parts").select("row", "win", "size", "start"), "contained")

    before = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    ends = sure.select("row", "start", "size").distinct().withColumn("reached", F.coalesce(F.max(end).over(before), F.lit(0)))
    fresh = F.greatest(F.lit(0), end - F.greatest("start", "reached"))
    covered = ends.groupBy("row").agg(F.sum(fresh).cast("long").alias("n_hit"))
    whose = sure.select("row", "win").distinct().join(small(windows.join(owners, "window").select("win", "item_id")), "win")
    named = whose.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    one = found.where("sid = -1").select("row", "doc_id", "mark", "n_words")
    return one.join(covered.join(named, "row", "left"), "row", "left").select(
        "doc_id", "mark", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which no window of an item occurs, all columns."""
    bad = stored(contamination(docs, items).where("n_hit > 0").select("doc_id", "mark").distinct(), "contaminated")
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (own == bad["mark"]), "left_anti")
