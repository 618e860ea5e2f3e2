"""Traditional and Simplified forms of the characters that catalogues and label lists mix."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Blocks of ideographs, first and last code point.
IDEOGRAPHS = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))
_TABLES: dict[tuple[str, str], dict[int, str]] = {}


def _table(spark: SparkSession, rule: str) -> dict[int, str]:
    """One character for another, by a rule of the Unicode library among Spark's own jars; empty where it is missing.

    Some 3,000 entries, however much text there is: asked once for each application, with all ideographs in one call.
    """
    key = (spark.sparkContext.applicationId, rule)
    if key not in _TABLES:
        chars = [chr(c) for lo, hi in IDEOGRAPHS for c in range(lo, hi + 1)]
        try:
            out = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance(rule).transliterate("\n".join(chars)).split("\n")
        except (TypeError, AttributeError):  # no such library
            out = chars
        if len(out) != len(chars):
            raise ValueError(f"{rule} does not keep lines")
        _TABLES[key] = {ord(a): b for a, b in zip(chars, out) if a != b and len(b) == 1}
    return _TABLES[key]


def to_simplified_table(spark: SparkSession) -> dict[int, str]:
    """For str.translate: Traditional to Simplified."""
    return _table(spark, "Traditional-Simplified")


def to_traditional_table(spark: SparkSession) -> dict[int, str]:
    """For str.translate: Simplified to Traditional, the commonest form where there are several."""
    return _table(spark, "Simplified-Traditional")


# Numerals in order.
NUMERALS = ["零", "一", "二", "三", "四", "五", "六", "七", "八", "九", "十"]


def number(text: str) -> int | None:
    """A number below 100 in Chinese or Arabic figures; 正 is one, 廿 twenty, 卅 thirty, 兩 two. None if it is none."""
    t = text.strip().replace("廿", "二十").replace("卅", "三十").replace("兩", "二").replace("两", "二").replace("正", "一").replace("〇", "零")
    if t.isdigit() and t.isascii():
        return int(t)
    tens, ten, ones = t.partition("十")
    try:
        if ten:
            return (NUMERALS.index(tens) if tens else 1) * 10 + (NUMERALS.index(ones) if ones else 0)
        return NUMERALS.index(t) if t and len(t) == 1 and t != "十" else None
    except ValueError:
        return None
