"""Text functions as Column expressions; all of them stay inside codegen."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Every single Latin letter that decomposes to an ASCII letter plus marks, and that letter."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base.isascii() and base.isalpha():
            src.append(chr(cp))
            dst.append(base)
    return "".join(src) + "đĐ", "".join(dst) + "dD"


ACCENT_FROM, ACCENT_TO = _accent_table()


def strip_accents(c: Column) -> Column:
    """Accented Latin letters to their base letters, combining marks removed; đ becomes d."""
    return F.translate(F.regexp_replace(c, r"\p{M}+", ""), ACCENT_FROM, ACCENT_TO)


def collapse_spaces(c: Column) -> Column:
    """Unicode white space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s​﻿]+", " "))


def normalise(c: Column) -> Column:
    """Lower case, accents removed, single spaces; null becomes the empty string."""
    return F.coalesce(collapse_spaces(F.lower(strip_accents(c))), F.lit(""))


def fold_key(c: Column) -> Column:
    """Letters and digits only, lower case without accents: the identity of a freely spelt name."""
    return F.regexp_replace(F.lower(strip_accents(c)), r"[^\p{L}\p{N}]+", "")


def tokens(c: Column) -> Column:
    """Distinct letter and digit runs of the normalised text, in order of appearance."""
    return F.array_distinct(F.filter(F.split(normalise(c), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


NUMBER = r"(\d+(?:[.,]\d+)*)"


def plain_number(raw: Column, three_is_thousands: Column) -> Column:
    """A number in the Vietnamese or the English manner as plain decimal text.

    Of several separators the last one is the decimal one, unless every one stands before
    three digits. A single separator before exactly three digits groups thousands where
    ``three_is_thousands`` holds and the whole part isn't 0."""
    grouped = F.rlike(raw, F.lit(r"^[1-9]\d{0,2}([.,]\d{3}){2,}$")) | (three_is_thousands & F.rlike(raw, F.lit(r"^[1-9]\d{0,2}[.,]\d{3}$")))
    return F.when(grouped, F.regexp_replace(raw, "[.,]", "")).otherwise(F.regexp_replace(F.regexp_replace(raw, r"[.,](?=.*[.,])", ""), ",", "."))


def contains_tokens(haystack: Column, needle: Column) -> Column:
    """True if the tokens of ``needle`` stand side by side, as whole tokens, in ``haystack``; false for no token."""
    pad = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return (F.size(needle) > 0) & F.contains(pad(haystack), pad(needle))


def all_tokens(text: Column) -> Column:
    """Every letter and digit run of the normalised text in order, repetitions kept."""
    return F.filter(F.split(normalise(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def matches_all(keyword: str, haystack: Column) -> Column:
    """True if every token of the keyword is a part of the normalised haystack; false for a keyword without token."""
    from lodeweave.functions.plain import tokens_of

    words = tokens_of(keyword)
    out = F.lit(bool(words))
    for w in words:
        out = out & F.contains(normalise(haystack), F.lit(w))
    return out


def clean_line(c: Column) -> Column:
    """A line without leading numbering (1. 1) 1.2) and without colons, dashes and spaces around it."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s*\d+(?:\.\d+)*[.)]?\s+", ""), r"^[ :–—\-]+|[ :–—\-]+$", "")


def shorten(c: Column, limit: int, notice: str) -> Column:
    """Texts over ``limit`` characters cut there and followed by ``notice``."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(notice))).otherwise(c)


def squeeze(c: Column) -> Column:
    """Lower case without any white space: the form in which groundedness is tested."""
    return F.regexp_replace(F.lower(c), r"(?U)[\s ]+", "")


def slug(c: Column, limit: int = 100) -> Column:
    """The last part of a path as a file name of ASCII letters, digits, dots, dashes and underscores."""
    last = F.regexp_extract(F.regexp_replace(c, "/+$", ""), r"([^/]*)$", 1)
    return F.left(F.regexp_replace(F.regexp_replace(strip_accents(last), r"[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), F.lit(limit))
