"""URL filtering by mined association rules under fixed host rules.

Tokens that occur in exactly the same labelled URLs count as one item, named by the smallest of them;
a URL has the item if it has any of them, which is what the rules of all their subsets would say.
Items that are certain enough alone are rules, and leave. FP-growth finds the sets of the other items
that enough bad URLs share, and each is counted over all labelled URLs. Rules are pruned by count and
confidence and where a shorter one implies them, and matched through an inverted index: a rule is
posted under its rarest item, and a URL that has the item is checked for the others. Rules may have any
length; what is mined grows with the sets of distinguishable items that the bad URLs share.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is
allowed; rows may repeat; without labels no rule is mined; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimdex.llm.common import ascii_lower, session, shippable, stored

#: a rule holds for at least so many of the labelled URLs, whatever their number
MIN_COUNT = 10
MIN_CONFIDENCE = 0.6


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def tokens_of(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels with their depth from the right, path segments with their place,
    query keys and whether there is a fragment. Digits count as one token form."""
    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    segments = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda x: x != "")
    segments = F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit("="), x))
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#?]+)"), F.lit(1))
    keys = F.transform(keys, lambda x: F.concat(F.lit("q="), x))
    mark = F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(labels, segments, keys, mark))


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule of a short fixed list; null where none fits."""
    best = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    for site, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(prefix)
        one = F.struct(F.lit(len(site + prefix)).alias("n"), F.lit(site + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, one).otherwise(best)
    return best["rule"], best["verdict"]


def fold_tokens(labelled: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(token, item, n, n_bad) of the tokens that enough bad rows hold, from rows of (row, tokens, bad).

    Tokens are one item where they occur in the same rows: equally often, with equal sums over two
    64-bit hashes of the rows.
    """
    seen = labelled.select("row", "bad", F.explode(F.array_distinct("tokens")).alias("token"))
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "row")).alias(f"mark{seed}") for seed in (1, 2)]
    found = seen.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), *marks)
    found = stored(found.where(F.col("n_bad") >= min_count), "tokens")
    same = ["n", "n_bad", "mark1", "mark2"]
    items = found.groupBy(*same).agg(F.min("token").alias("item"))
    return stored(found.join(items, same).select("token", "item", "n", "n_bad"), "items")


def _with_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(row, tokens) of the rows that hold any item, ``tokens`` being their items."""
    seen = rows.select("row", F.explode("tokens").alias("token")).join(shippable(items.select("token", "item")), "token")
    return seen.groupBy("row").agg(F.collect_set("item").alias("tokens"))


def mine_rules(
    labelled: DataFrame, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """(rule_id, tokens, confidence, support) from rows of (tokens, bad), without rules that a shorter one implies."""
    return _mined(labelled, min_count, min_confidence)[0]


def _mined(labelled: DataFrame, min_count: int, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """The rules, whose tokens are items, and (token, item)."""
    known = labelled.where("bad IS NOT NULL AND tokens IS NOT NULL")
    known = stored(known.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled")
    n = known.count()
    items = fold_tokens(known, min_count)
    certain = F.col("n_bad") / F.col("n") >= min_confidence
    alone = items.where(certain).where("token = item").select(
        F.array("item").alias("tokens"), (F.col("n_bad") / F.col("n")).alias("confidence"), F.col("n_bad").alias("freq")
    )
    rest = items.where(~certain)
    baskets = stored(_with_items(known.where("bad"), rest), "baskets")
    held = baskets.count()
    found = alone
    if held >= min_count:
        # half a row below, so that rounding never asks for one more
        model = FPGrowth(itemsCol="tokens", minSupport=(min_count - 0.5) / held).fit(baskets)
        sets = model.freqItemsets.where(F.size("items") > 1)
        sets = sets.select(F.monotonically_increasing_id().alias("rule_id"), F.sort_array("items").alias("tokens"), "freq")
        sets = stored(sets, "sets")
        good = stored(_with_items(known.where("NOT bad"), rest), "good")
        met = match_rules(good, sets).groupBy("rule_id").agg(F.count("*").alias("n_good"))
        judged = sets.join(met, "rule_id", "left")
        confidence = F.col("freq") / (F.col("freq") + F.coalesce("n_good", F.lit(0)))
        judged = stored(judged.select("tokens", "freq", confidence.alias("confidence")), "judged")
        found = found.unionByName(_shortest(judged, min_confidence).select("tokens", "confidence", "freq"))
    rules = found.select(
        F.monotonically_increasing_id().alias("rule_id"), "tokens", "confidence", (F.col("freq") / max(n, 1)).alias("support")
    )
    return stored(rules, "rules"), items.select("token", "item")


def _shortest(judged: DataFrame, min_confidence: float) -> DataFrame:
    """Certain sets none of whose subsets is certain, a length at a time.

    ``judged`` holds all subsets of a set but single items, so a certain one is passed up through them.
    """
    sure = judged.where(F.col("confidence") >= min_confidence)
    sizes = [r[0] for r in judged.select(F.size("tokens").alias("s")).distinct().orderBy("s").collect()]
    kept, below = sure.where("false"), None  # of the length below: certain, or holding a certain one
    if not sure.limit(1).count():
        return kept
    for size in sizes:
        here = judged.where(F.size("tokens") == size)
        covered = here.select("tokens").where("false")
        if below is not None:
            at = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
            parts = here.select("tokens", at.alias("at"))
            parts = parts.select("tokens", F.filter("tokens", lambda x, i: i != F.col("at")).alias("part"))
            covered = parts.join(below.withColumnRenamed("tokens", "part"), "part", "left_semi").select("tokens").distinct()
        covered = stored(covered, "covered")
        fresh = stored(here.where(F.col("confidence") >= min_confidence).join(covered, "tokens", "left_anti"), "shortest")
        kept = kept.unionByName(fresh)
        below = covered.unionByName(fresh.select("tokens"))
    return kept


def match_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule_id) for every mined rule whose tokens all occur in the row's ``tokens``."""
    seen = rows.select("row", "tokens", F.explode("tokens").alias("token"))
    wanted = rules.select("rule_id", "tokens", F.explode("tokens").alias("token"))
    often = seen.join(shippable(wanted.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    index = wanted.join(often, "token", "left").groupBy("rule_id").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"), F.first("tokens").alias("asked")
    )
    met = seen.join(shippable(stored(index, "index")), "token")
    return met.where(F.size(F.array_except("asked", "tokens")) == 0).select("row", "rule_id")


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None,
    number: str = r"([0-9]+)[^0-9/]*/?$",
) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, mined (rules that fired).

    ``labels``: (doc_id, quality); a URL is labelled by the document whose number its path names.
    """
    session(pages)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tokens", tokens_of(F.col("host"), F.col("path"), F.col("url")))
    rows = stored(rows.drop("url"), "urls")
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    if labels is None:
        return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.lit("allow")).alias("verdict"), F.lit(0).cast("long").alias("mined"))
    named = rows.where("host <> ''").select("tokens", F.expr(f"try_cast(regexp_extract(path, r'{number}', 1) AS bigint)").alias("doc_id"))
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    mined, items = _mined(named.join(judged, "doc_id").select("tokens", "bad"), MIN_COUNT, MIN_CONFIDENCE)
    used = items.join(mined.select(F.explode("tokens").alias("item")).distinct(), "item", "left_semi")
    fired = match_rules(_with_items(rows, used), mined).groupBy("row").agg(F.count_distinct("rule_id").alias("mined"))
    own = F.when(F.col("mined") > 0, "block").otherwise("allow")
    return rows.join(fired, "row", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.coalesce("mined", F.lit(0)).cast("long").alias("mined"),
    )
