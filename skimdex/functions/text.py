"""Word splitting and token estimates."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: ideograph blocks, Unicode white space, punctuation, token weights ---
CJK = "\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff"
SPACES = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PUNCTUATION = ",.!?;:\"'()[]{}，。！？；：「」『』（）【】《》…—～"
CHUNK_SIZE = 512
CHUNK_OVERLAP = 50
# in thirtieths of a token: an ideograph is 1/1.5, a byte of any other word 0.3
UNITS_PER_TOKEN = 30
CJK_UNITS = 20
BYTE_UNITS = 9
# --- end of fixed values ---

_MARKS = PUNCTUATION.replace("[", r"\[").replace("]", r"\]")

#: One ideograph, or a run of anything that is neither ideograph nor delimiter. Characters stand
#: literally in the classes, so Java, Python and RE2 read the same pattern.
WORD_PATTERN = f"[{CJK}]|[^{CJK}{SPACES}{_MARKS}]+"
DELIMITER_PATTERN = f"[{SPACES}{_MARKS}]+"


def _listed(ranges: str) -> str:
    """All characters of a class body such as ``a-cx``."""
    spans = re.findall(r"(.)-(.)|(.)", ranges, flags=re.DOTALL)
    return "".join(one or "".join(map(chr, range(ord(lo), ord(hi) + 1))) for lo, hi, one in spans)


def tokenize_words(text: Column) -> Column:
    """Array of words in text order, as ``WORD_PATTERN`` finds them.

    Java matches classes of many ranges very slowly. So delimiters become spaces by a table lookup,
    texts with ideographs get a space on both sides of each, and what remains is split at spaces.
    """
    delimiters = _listed(SPACES) + PUNCTUATION
    spaced = F.translate(text, delimiters, " " * len(delimiters))
    apart = spaced
    for block in (CJK[:6], CJK[6:]):
        apart = F.regexp_replace(apart, f"([{block}])", " $1 ")
    any_east_asian = spaced.rlike(f"[{min(CJK.replace('-', ''))}-{max(CJK)}]")
    return F.regexp_extract_all(F.when(any_east_asian, apart).otherwise(spaced), F.lit("[^ ]+"), 0)


def token_units(words: Column) -> Column:
    """Estimated length of a word array in thirtieths of a token (exact integer)."""
    # binary order of UTF-8 follows code points, so comparing with block ends tests the first one
    blocks = [(CJK[i], CJK[i + 2]) for i in range(0, len(CJK), 3)]

    def is_ideograph(word: Column) -> Column:
        inside = [(word >= lo) & (word < chr(ord(hi) + 1)) for lo, hi in blocks]
        return functools.reduce(operator.or_, inside)

    per_word = lambda w: F.when(is_ideograph(w), CJK_UNITS).otherwise(
        F.octet_length(w) * BYTE_UNITS
    )
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + per_word(w))


def estimate_tokens(words: Column) -> Column:
    """Estimated tokens in a word array."""
    return token_units(words) / F.lit(float(UNITS_PER_TOKEN))
