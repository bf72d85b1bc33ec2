"""Digit, fraction, key and label expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number in running text: not glued to a word, thousands groups, decimals, exponent, percent sign.
NUMBER = r"(?<![\w.\-])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?%?"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def parse_decimal(raw: Column) -> Column:
    """Trimmed literal without thousands commas as a decimal; null if it is none."""
    return F.regexp_replace(F.trim(raw), ",", "").try_cast("decimal(38,18)")


def number_key(v: Column) -> Column:
    """Text by which equal decimals are equal: no trailing zeros."""
    text = v.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def terminal_digit_cell(raw: Column) -> Column:
    """Last digit of a cell's literal, an all-zero fraction ignored."""
    return blank_to_null(F.regexp_extract(F.trim(raw), r"(\d)(?:\.0+)?$", 1))


def terminal_digit_text(raw: Column) -> Column:
    """Last digit of a literal in text (an exponent's digits count)."""
    return blank_to_null(F.regexp_extract(raw, r"(\d)[^\d]*$", 1))


def fraction_cell(raw: Column) -> Column:
    """Digits after the point without trailing zeros, ``0`` if none are left; null without a point."""
    digits = F.regexp_replace(F.regexp_extract(raw, r"\.(\d*)", 1), "0+$", "")
    return F.when(raw.contains("."), F.when(digits == "", "0").otherwise(digits))


def fraction_text(raw: Column) -> Column:
    """What stands after the point up to an exponent or percent sign, zeros kept."""
    return blank_to_null(F.regexp_extract(F.lower(raw), r"\.([^e%]*)", 1))


def first_digit(v: Column) -> Column:
    """First significant digit; null for zero."""
    return blank_to_null(F.regexp_extract(F.abs(v).cast("string"), "[1-9]", 0)).cast("int")


def decimal_places(raw: Column) -> Column:
    """Places after the point in a literal, trailing zeros and a negative exponent counted."""
    places = F.length(F.regexp_extract(raw, r"\.(\d+)", 1))
    power = F.coalesce(blank_to_null(F.regexp_extract(raw, r"[eE]([-+]?\d+)", 1)).cast("int"), F.lit(0))
    return F.greatest(F.lit(0), places - power)


def scaled(v: Column, places: int) -> Column:
    """A double as an integer number of 10**-places, half to even; null if not finite."""
    return F.rint(v * float(10**places)).try_cast("bigint")


def ratio_key(n: Column, d: Column, places: int) -> Column:
    """n / d in units of 10**-places, half to even; null on a zero denominator."""
    return scaled(n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0)), places)


def column_index(letters: Column) -> Column:
    """Spreadsheet letters to a 1-based index."""
    chars = F.filter(F.split(F.upper(letters), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)


def column_letters(index: Column) -> Column:
    """1-based index (up to three letters) to spreadsheet letters."""
    def letter(n):
        return F.char((n + 65).cast("bigint"))

    i = index - 1
    one, two = letter(i % 26), F.floor(i / 26) - 1
    return F.when(i < 26, one).when(two < 26, F.concat(letter(two % 26), one)).otherwise(F.concat(letter(F.floor(two / 26) - 1), letter(two % 26), one))


def formula_pattern(f: Column) -> Column:
    return F.regexp_replace(f, r"\$?([A-Z]+)\$?(\d+)", "$1<row>")


def clean_text(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, r"(?U)\s+", " "))


#: Ranks of the risk levels.
RISKS = ("info", "low", "medium", "high", "critical")


def risk_rank(risk: Column) -> Column:
    return F.coalesce(*[F.when(risk == r, i) for i, r in enumerate(RISKS)], F.lit(0))


def safe_id(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(v), r"[^\p{Alnum}]+", "-"), "^-+|-+$", "")


#: Figure and table labels in English and Chinese.
LABEL = r"(?iu)\b((?:extended data |supplementary )?(?:fig(?:ure)?s?\.?|tables?)\s*s?\d+[a-z]?)"
LABEL_CJK = r"([图表]\s*\d+)"


def label(text: Column) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(text, LABEL, 1)), blank_to_null(F.regexp_extract(text, LABEL_CJK, 1)))


def label_key(v: Column) -> Column:
    return F.regexp_replace(F.lower(v), "[^a-z0-9一-龥]+", "")


def line_kind(text: Column) -> Column:
    """blank, image, table, caption, heading or text, the first that holds."""
    t = F.trim(text)
    return (F.when(t == "", "blank").when(t.rlike(r"!\[[^\]]*\]\([^)]+\)"), "image").when(t.contains("|"), "table")
            .when(t.rlike(r"(?i)^(fig(ure)?\.?|table)\s*s?\d+") | t.rlike(r"^[图表]\s*\d+"), "caption").when(t.startswith("#"), "heading").otherwise("text"))
