"""Column functions on text, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything but Han characters, letters of any script and digits.
NOT_ALNUM = r"[^\p{L}\p{N}\p{IsHan}]+"


def alnum_key(c: Column | str) -> Column:
    """Letters and digits of a text in lower case, everything else dropped; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), NOT_ALNUM, "")


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only texts (any Unicode space)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~c.rlike(r"[^\s\p{Z}]"), F.lit(True))


def one_space(c: Column) -> Column:
    """Runs of white space become one space, and the ends are cut."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def han_only(c: Column) -> Column:
    """Characters between U+4E00 and U+9FFF only."""
    return F.regexp_replace(c, r"[^一-鿿]", "")


def grams(text: Column, low: int, high: int) -> Column:
    """ARRAY<STRUCT<pos, term>> of all runs of low to high characters; pos from 1. Null gives none.

    The text is cut into characters once and bound to a lambda variable: `substring` would count from the text's begin for
    every place, which is quadratic in long texts.
    """

    def of(chars: Column) -> Column:
        def size(k: int) -> Column:
            return F.when(F.size(chars) >= k, F.transform(F.sequence(F.lit(1), F.size(chars) - k + 1), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(chars, i, F.lit(k)), "").alias("term"))))

        return F.flatten(F.array_compact(F.array(*[size(k) for k in range(low, high + 1)])))

    return F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), of)[0]
