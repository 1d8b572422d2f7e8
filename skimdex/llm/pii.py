"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Positions come from the pieces between matches: the start of a match is the length of all pieces and
matches ahead of it. Every document gives one row per proposal and one row of its own, so a single
shuffle by document serves prefix sums, order and digests.

Base kinds (email, ip, card, phone) are kept exactly when their check passes. The further kinds are
kept from a score of ``KEEP`` on: an IBAN confirmed by mod-97, and a national number of the form
ddd-dd-dddd, which no checksum confirms, only next to one of its context words. A context word counts
when it lies within ``NEAR`` code points of the text before or after a span, other matches included.

Defined results: null texts count as empty; rows that repeat a doc_id give one result each; overlaps
between kinds are all reported; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skimdex.llm.common import session

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = 4
#: Matches as the contract's patterns find them. Possessive repeats keep the matcher iterative, and a
#: match may only start where a run starts or the last match ended, so no run is scanned twice.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: a text without this character class has no match of the kind
NEEDS = {"email": "@", "phone": "+"}
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|mastercard|credit|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|telefon|teléfono|téléphone",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social|security|national|id",
}
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
NEAR, BONUS, KEEP = 100, 0.3, 0.5
#: code points that a match of the kind has at least: so many neighbours fill the context
SHORTEST = {"email": 5, "ip": 7, "card": 2, "phone": 3, "iban": 12, "ssn": 11}
SPAN = "struct<kind: int, idx: int, ahead: int, ok: boolean, heard: boolean, value: string>"


def _proposals(text: Column, number: int, kind: str) -> Column:
    """Array of SPAN: ``ahead`` is the length of the piece before a match, ``heard`` a context word near it."""
    pattern = PATTERNS[kind]
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # piece, match, piece, ..., piece: what lies further from a match than NEAR is cut off
    links = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("piece"), values.alias("value")),
        lambda z: F.struct(
            F.length(z["piece"]).alias("ahead"), z["value"].alias("value"),
            _ends(z["piece"]).alias("piece"), _ends(F.coalesce(z["value"], F.lit(""))).alias("match"),
        ),
    )
    reach = -(-NEAR // SHORTEST[kind]) + 1

    def judged(chain: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            earlier = F.slice(chain, F.greatest(F.lit(1), i + 1 - reach), F.least(i, F.lit(reach)))
            later = F.slice(chain, i + 2, F.lit(reach + 1))
            before = F.concat(F.array_join(F.transform(earlier, lambda z: F.concat(z["piece"]["tail"], z["match"]["tail"])), ""), r["piece"]["tail"])
            after = F.array_join(F.transform(later, lambda z: F.concat(z["piece"]["head"], z["match"]["head"])), "")
            cue = rf"(?i)(?:^|[^\p{{L}}])(?:{CONTEXT[kind]})(?:$|[^\p{{L}}])"
            heard = F.right(before, F.lit(NEAR)).rlike(cue) | F.left(after, F.lit(NEAR)).rlike(cue)
            ok = F.coalesce(_valid(kind, r["value"]), F.lit(False))
            return F.struct(
                F.lit(number).alias("kind"), i.alias("idx"), r["ahead"].alias("ahead"), ok.alias("ok"),
                F.when(ok, heard).otherwise(F.lit(False)).alias("heard"), r["value"].alias("value"),
            )

        return F.filter(F.transform(chain, one), lambda s: s["value"].isNotNull())

    # bound once as a lambda's argument, so that the text is searched once however many matches there are
    rows = F.element_at(F.transform(F.array(links), judged), 1)
    has = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(has, rows)


def _ends(piece: Column) -> Column:
    """First and last ``NEAR`` code points."""
    return F.struct(F.left(piece, F.lit(NEAR)).alias("head"), F.right(piece, F.lit(NEAR)).alias("tail"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    order = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return (F.length(digits) > 0) & (F.aggregate(order, F.lit(0), add) % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves the remainder one."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    order = F.sequence(F.lit(1), F.length(iban))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 65, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(order, F.lit(0), add) == 1


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    squeezed = F.regexp_replace(value, " ", "")
    if kind == "ip":
        return F.forall(
            F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        )
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return F.length(squeezed).between(15, 34) & mod97(squeezed)
    return value.isNotNull()


def _per_kind(kind: Column, values: dict) -> Column:
    out = F.lit(None)
    for number, name in enumerate(KINDS, 1):
        out = F.when(kind == number, F.lit(values[name])).otherwise(out)
    return out


def _scored(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end, value, score): kept spans, and one row of kind 0 per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    own = F.expr(f"array(cast(named_struct('kind', 0, 'idx', 0, 'ahead', 0, 'ok', true, 'heard', false, 'value', '') AS {SPAN}))")
    lists = [F.coalesce(_proposals(F.col("text"), n, k), F.filter(own, lambda x: F.lit(False))) for n, k in enumerate(KINDS, 1)]
    flat = rows.select("row", "doc_id", F.inline(F.concat(own, *lists)))
    order = Window.partitionBy("row", "kind").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("ahead") + F.length("value")).over(order)
    flat = flat.repartition("row").withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    score = _per_kind(F.col("kind"), SCORES) + F.when(F.col("heard"), F.lit(BONUS)).otherwise(F.lit(0.0))
    flat = flat.where("ok")
    flat = flat.withColumn("score", F.least(F.lit(1.0), score))
    return flat.where(f"kind <= {BASE} OR score >= {KEEP}")


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, value, score): one row per span kept; positions in code points."""
    session(docs)
    names = F.array(*[F.lit(k) for k in KINDS])
    found = _scored(docs).where("kind > 0")
    return found.select("doc_id", F.element_at(names, F.col("kind")).alias("kind"), "start", "end", "value", "score")


def summarise(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, counts of base kinds, base and all spans as joined text."""
    session(docs)
    names = F.array(*[F.lit(k) for k in KINDS])
    label = F.concat_ws(":", F.element_at(names, F.col("kind")), "start", "end")
    rows = _scored(docs).withColumn("label", F.when(F.col("kind") > 0, label))
    spot = F.struct("start", "kind", "end", "label")
    counts = [F.count_if(F.col("kind") == n).alias(f"n_{k}") for n, k in enumerate(KINDS[:BASE], 1)]
    text = lambda when: F.array_join(
        F.transform(F.sort_array(F.collect_list(F.when(when, spot))), lambda s: s["label"]), ","
    )
    return rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), *counts,
        text(F.col("kind").between(1, BASE)).alias("base"), text(F.col("kind") > 0).alias("spans"),
    ).drop("row")
