"""Chat formatting into budgeted windows.

Prefix sums of turn tokens cut a conversation into windows at turn borders: a turn of more than half
the room stands alone, and the others are cut wherever their running sum passes another half, so
that a window never holds more than the room unless one turn alone does. Every window begins with
the system turn, repeats the last turns of the window before up to ``history`` tokens, and carries
a loss mask over the assistant texts that appear for the first time.

Text cannot forge a marker: ``~``, ``<`` and ``[`` inside roles and texts become ``~0``, ``~1`` and
``~2``, which is undone in the opposite order.

Defined results: null texts and roles are empty; a null conv_id is a conversation of its own; equal
or null turns are ordered by turn (nulls first), role and text; repeated rows are turns of their
own; only a system turn in first place is retained; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skimdex.llm.common import session

BUDGET, HISTORY = 1024, 256
START, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPES = [("~", "~0"), ("<", "~1"), ("[", "~2")]


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def token_count(text: Column) -> Column:
    """Words and punctuation marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")).cast("long")


def _turns(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """One row per turn and window it appears in: conv_id, window, at, again, role, text."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), token_count(text).alias("tokens"))
    by = Window.partitionBy("conv_id")
    order = by.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.row_number().over(order))
    system = (F.col("at") == 1) & (F.col("role") == "system")
    rows = rows.withColumn("system", system)
    held = F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(running)
    rows = rows.withColumn("half", F.greatest(F.lit(1), ((budget - history - held) / 2).cast("long")))
    rows = rows.withColumn("long", (F.col("tokens") > F.col("half")) & ~F.col("system"))
    walk = by.orderBy("at")
    ran = walk.rowsBetween(Window.unboundedPreceding, 0)
    # a run of short turns ends at every long turn, which is a run of its own
    rows = rows.withColumn("after", F.coalesce(F.lag("long").over(walk), F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("long") | F.col("after"), 1).otherwise(0)).over(ran))
    cost = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    within = Window.partitionBy("conv_id", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cell", F.floor((F.sum(cost).over(within) - cost) / F.col("half")))
    rows = rows.withColumn("cell", F.when(F.col("long"), F.lit(0)).otherwise(F.col("cell")))
    fresh = (F.lag("run").over(walk) != F.col("run")) | (F.lag("cell").over(walk) != F.col("cell"))
    fresh = fresh & ~F.lag("system").over(walk)  # a system turn is never a window of its own
    rows = rows.withColumn("window", F.sum(F.when(fresh, 1).otherwise(0)).over(ran))
    rows = rows.withColumn("windows", F.max("window").over(by))
    back = Window.partitionBy("conv_id", "window").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("tail", F.sum("tokens").over(back))
    repeats = (F.col("tail") <= history) & (F.col("window") < F.col("windows"))
    places = (
        F.when(F.col("system"), F.sequence(F.lit(0), F.col("windows").cast("int")))
        .when(repeats, F.array(F.col("window").cast("int"), (F.col("window") + 1).cast("int")))
        .otherwise(F.array(F.col("window").cast("int")))
    )
    placed = rows.select("conv_id", "at", "role", "text", F.col("window").alias("own"), F.explode(places).alias("window"))
    return placed.select("conv_id", "window", "at", (F.col("own") != F.col("window")).alias("again"), "role", "text")


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_repeated, loss.

    ``n_repeated`` counts the leading turns that an earlier window holds already. ``loss`` lists the
    (start, length) of masked-in text in code points of ``formatted``.
    """
    session(turns)
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(BODY))
    body = escape(F.col("text"))
    pieces = _turns(turns, budget, history).select("conv_id", "window", "at", "again", "role", head.alias("head"), body.alias("body"))
    whole = F.length("head") + F.length("body") + len(END)
    order = Window.partitionBy("conv_id", "window").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("begin", F.sum(whole).over(order) - whole)
    target = (F.col("role") == "assistant") & ~F.col("again")
    span = F.struct((F.col("begin") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))
    listed = F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"))
    return pieces.groupBy("conv_id", "window").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(listed)), lambda p: p["piece"]), "").alias("formatted"),
        F.count_if("again").alias("n_repeated"),
        F.sort_array(F.collect_list(F.when(target, span))).alias("loss"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """The turns of formatted windows, each once: conv_id, window, idx, role, text."""
    parts = F.split("formatted", F.lit(r"\Q" + END + r"\E"), F.lit(-1))
    turn = windows.select("conv_id", "window", "n_repeated", F.posexplode(parts).alias("idx", "part"))
    turn = turn.where("idx >= n_repeated AND part <> ''")
    cut = F.split("part", F.lit(r"\Q" + BODY + r"\E"), F.lit(2))
    role = F.substring(cut[0], F.lit(len(START) + 1), F.length(cut[0]))
    return turn.select("conv_id", "window", "idx", unescape(role).alias("role"), unescape(cut[1]).alias("text"))


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    joined = lambda rows: F.array_join(F.transform(F.sort_array(rows), lambda r: r["text"]), "")
    line = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    turns = read_turns(windows).groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sha2(joined(F.collect_list(F.struct("window", "idx", line.alias("text")))), 256).alias("turns_sha256"),
    )
    masked = F.transform("loss", lambda s: F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))
    loss = windows.select("conv_id", "window", F.length("formatted").alias("chars"), unescape(F.array_join(masked, "")).alias("text"))
    loss = loss.groupBy("conv_id").agg(
        joined(F.collect_list(F.struct("window", "text"))).alias("lost"), F.sum("chars").cast("long").alias("formatted_chars")
    )
    both = turns.withColumnRenamed("conv_id", "other").join(loss, F.col("other").eqNullSafe(F.col("conv_id")))
    return both.select(
        "conv_id", "n_turns", "turns_sha256", F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars",
    )
