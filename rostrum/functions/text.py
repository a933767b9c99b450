"""Text expressions with the blank set of Unicode plus the four ASCII separators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rostrum.functions.numeric import col
from rostrum.vocab import MAX_TOKENS

BLANKS = r"(?U)[\s\x1c-\x1f]+"


def fill_text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(col(c), BLANKS), lambda t: t != "")


def word_count(c: Column | str) -> Column:
    """Number of blank-separated words; missing or blank text has none."""
    return F.size(tokens(fill_text(c)))


def clean_transcript(c: Column | str) -> Column:
    """Drop every span from `(` to the next `)` on the same line. Only a line feed ends a
    line; the pattern says so itself, for Java's dot also stops at other line ends."""
    return F.regexp_replace(col(c), r"\([^)\n]*+\)", "")


def truncate_tokens(c: Column | str, n: int = MAX_TOKENS) -> Column:
    """At most the first n words, joined by single blanks."""
    return F.array_join(F.slice(tokens(c), 1, n), " ")


def strip(c: Column | str) -> Column:
    """Remove blanks of any kind at both ends."""
    left = F.regexp_replace(col(c).cast("string"), "^" + BLANKS, "")
    return F.regexp_replace(left, BLANKS + r"\z", "")


def join_key(c: Column | str, null_as_text: bool = False) -> Column:
    """Stripped text of a key. With `null_as_text` missing keys become `nan`
    and so match each other."""
    key = strip(c)
    return F.coalesce(key, F.lit("nan")) if null_as_text else key
