"""Text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[^a-z0-9_]+"


def ascii_lower(x: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(x, UPPER, LOWER)


@F.pandas_udf(StringType())
def _decomposed(x: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; Spark has no function for it."""
    import unicodedata

    return x.map(lambda s: s if s is None or s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.category(c).startswith("M")))


def normalize(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_decomposed(x)), r"\s+", " "))


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_decomposed(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def snippet_around(text: Column, term: str, before: int = 80, after: int = 120) -> Column:
    """The text around the first match of term in any case; without a match its head."""
    at = F.instr(F.lower(text), term.lower())
    start = F.greatest(F.lit(1), at - before)
    end = F.least(F.length(text), at - 1 + len(term) + after)
    cut = F.concat(F.when(start > 1, F.lit("...")).otherwise(F.lit("")), F.substring(text, start, end - start + 1), F.when(end < F.length(text), F.lit("...")).otherwise(F.lit("")))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, before + after))


def quote_phrase(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))


def strip_control(x: Column) -> Column:
    return F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def format_size(n: Column) -> Column:
    """Bytes below 1024 as they are, else one decimal of KB, MB, GB or TB."""
    out = F.concat(F.format_string("%.1f", n / 1024.0**4), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024 ** (power + 1), F.concat(F.format_string("%.1f", n / 1024.0**power), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(F.lower(a), F.lower(b))


def word_set(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), NOT_WORD), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; two texts without words are alike."""
    both, either = F.size(F.array_intersect(word_set(a), word_set(b))), F.size(F.array_union(word_set(a), word_set(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.nullif(either.cast("double"), F.lit(0.0)))


def strip_bold(x: Column) -> Column:
    return F.regexp_replace(x, "</?b>", "")


def clip(x: Column, n: int = 150) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)
