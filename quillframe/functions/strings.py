"""String functions that need more than a built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType



def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


def nfkc(text: Column | str) -> Column:
    """Compatibility composition, runs of white space to one space, trimmed (Spark has no built-in for it)."""
    return F.pandas_udf(_composed, StringType())(text)


def roman(n: Column) -> Column:
    """Lower-case Roman numeral of a positive number (a chain of built-ins over its decimal parts)."""
    digits = {1: ("i", "v", "x"), 10: ("x", "l", "c"), 100: ("c", "d", "m")}

    def part(unit: int) -> Column:
        one, five, ten = digits[unit]
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.element_at(F.array(*map(F.lit, forms)), (F.floor(n / unit) % 10 + 1).cast("int"))

    return F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), part(100), part(10), part(1))


def alphabetic(n: Column) -> Column:
    """a, b, ..., z, aa, bb, ... page labels."""
    letter = F.element_at(F.array(*[F.lit(chr(97 + k)) for k in range(26)]), ((n - 1) % 26 + 1).cast("int"))
    return F.repeat(letter, (F.floor((n - 1) / 26) + 1).cast("int"))


def ascii_folded(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaders_collapsed(text: Column) -> Column:
    """Twenty or more dots, commas or spaces in a row become one dot."""
    return F.regexp_replace(text, r"[. 。…，]{20,}", ".")


def without_surrogates(text: Column) -> Column:
    return F.regexp_replace(text, r"[\uD800-\uDFFF]", "")


def safe_message(text: Column, default: str = "unknown error") -> Column:
    """The first line of a message, at most 500 characters, or the default."""
    first = F.substring(F.split(F.trim(text), "\n")[0], 1, 500)
    return F.when(first.isNull() | (first == ""), default).otherwise(first)


def without_controls(text: Column) -> Column:
    """A text without characters of the categories control, format, surrogate, private and unassigned."""
    return F.regexp_replace(text, r"\p{C}", "")
