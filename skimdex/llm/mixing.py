"""Mixing sources to target weights by Poisson replication.

Every source has a rate: how often a document of it should appear on average, its target share of
the output divided by its present share. A document's count is drawn by inverting the Poisson
distribution of that mean at a uniform number hashed from seed and doc_id, so it never depends on
partitioning or retries. Copies are dealt over partitions and ordered by a hash of their own.

Defined results: null sources form one source of their own; null texts have size zero; sources
without a target weight or without any text give no rows; rows that repeat a doc_id draw alike;
columns of the input named ``copy`` or ``shuffle_key`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skimdex.llm.common import session, small, stored

SEED = 17
#: up to so many sources are broadcast; their steps come to some 500 bytes each
SOURCES = 20_000
#: exponent on source sizes for the default targets: 1 keeps the mix, 0 makes sources equal
TEMPER = 0.5


def uniform(*parts: Column | str) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of an MD5 digest."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, size): code points per source, combined before the shuffle."""
    return docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size"))


def tempered(sizes: DataFrame, exponent: float = TEMPER) -> DataFrame:
    """(source, weight): default targets, sizes to a power."""
    return sizes.select("source", F.pow(F.col("size").cast("double"), F.lit(exponent)).alias("weight"))


def poisson_steps(sizes: DataFrame, targets: DataFrame, epochs: float = 1.0) -> DataFrame:
    """(source, steps): the cumulative Poisson probabilities of each source's rate, in order.

    ``epochs`` scales the expected output size relative to the input. The steps end twelve standard
    deviations above the mean, where nothing of a double is left.
    """
    total = sizes.agg(F.sum("size").alias("all_size"))
    weights = sizes.where("size > 0").join(targets.withColumnRenamed("source", "target"),
                                           F.col("source").eqNullSafe(F.col("target"))).drop("target")
    share = weights.agg(F.sum("weight").alias("all_weight"))
    one = weights.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(share))  # single rows
    rate = F.lit(float(epochs)) * (F.col("weight") / F.col("all_weight")) * (F.col("all_size") / F.col("size"))
    one = one.select("source", rate.alias("rate")).where("rate > 0")
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    ks = one.select("source", "rate", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    order = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    factorial = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(F.lit(0.0))).over(order)
    ks = ks.withColumn("p", F.exp(F.col("k") * F.log("rate") - F.col("rate") - factorial))
    ks = ks.withColumn("cdf", F.sum("p").over(order))
    steps = F.transform(F.sort_array(F.collect_list(F.struct("k", "cdf"))), lambda s: s["cdf"])
    return ks.groupBy("source").agg(steps.alias("steps"))


def mix_sources(docs: DataFrame, targets: DataFrame | None = None, seed: int = SEED, epochs: float = 1.0) -> DataFrame:
    """Columns of ``docs`` with ``copy`` (1..count) and ``shuffle_key``, in globally random order.

    ``targets``: (source, weight) with distinct sources; default ``tempered`` sizes.
    """
    session(docs)
    sizes = source_sizes(docs)
    steps = poisson_steps(sizes, tempered(sizes) if targets is None else targets, epochs)
    steps = small(stored(steps, "poisson-steps"), SOURCES)  # documents stay where they are unless sources abound
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source")
    drawn = rows.join(steps, rows["source"].eqNullSafe(steps["source"])).select("row", "doc_id", "steps")
    u = uniform(F.lit(str(seed)), "doc_id")
    times = F.size(F.filter("steps", lambda c: c <= u))
    drawn = drawn.select("row", "doc_id", times.alias("times")).where("times > 0")
    copies = drawn.select("row", "doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")))
    dealt = copies.select("row", "copy", key.alias("shuffle_key"))
    dealt = dealt.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("copy", "shuffle_key")]
    return dealt.select(*own, "copy", "shuffle_key")
