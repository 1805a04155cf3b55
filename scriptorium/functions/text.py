"""Column helpers with the semantics of Python's string functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.patterns import WS


def rx(pattern: str) -> str:
    """A pattern whose dot and line ends know the line feed only."""
    return "(?d)" + pattern


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def matches(c: Column, *patterns: str) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(rx(p)) for p in patterns))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(rx(pattern)))


def count_chars(c: Column, cls: str) -> Column:
    """Characters of a class (written in brackets): what is gone when runs of it are, with no match for each."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{cls}+", ""))


def fixed(v: Column, digits: int) -> Column:
    """A number from 0 to 100 with so many decimals, rounded as its exact binary value is, a tie to the even digit; the JVM's own formatting rounds its shortest decimal form."""
    n = F.floor(v * F.lit(float(2**56))).cast("decimal(38,0)") * F.lit(10**digits)
    q = F.floor(n / F.lit(2**56).cast("decimal(38,0)")).cast("decimal(20,0)")
    twice = (n - q * F.lit(2**56).cast("decimal(20,0)")) * 2
    up = (twice > F.lit(2**56)) | ((twice == F.lit(2**56)) & (q % 2 == 1))
    return F.format_string(f"%.{digits}f", (q + F.when(up, 1).otherwise(0)).cast("double") / F.lit(float(10**digits)))


def count_any(c: Column, chars: str) -> Column:
    """Occurrences of any of a few characters."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def count_sub(c: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("bigint")


def count_subs(c: Column, words: tuple[str, ...]) -> Column:
    """The sum of the occurrences of each word, each counted on its own."""
    return reduce(lambda a, b: a + b, (count_sub(c, w) for w in words))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def pieces(c: Column, pattern: str) -> Column:
    """Non-blank pieces between matches."""
    return F.filter(F.split(c, rx(pattern), -1), lambda x: strip(x) != "")


def distinct_chars(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.size(F.array_distinct(F.split(c, "", -1)))).otherwise(0)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def newlines(c: Column) -> Column:
    """Universal line ends."""
    return F.regexp_replace(c, "\r\n?", "\n")


def r6(c: Column) -> Column:
    return F.round(c, 6)
