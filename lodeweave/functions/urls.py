"""URL functions as Column expressions. A URL is kept verbatim; a final slash is part of its
identity and is dropped only in keys for joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of paths that hold no page.
FILE_SUFFIXES = ("jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "bmp", "pdf", "zip", "rar", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "mp3", "mp4", "avi", "css", "js")


def host(url: Column) -> Column:
    """The authority with its port, in the letters of the URL; empty for a URL without one."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    """The path, without query and fragment."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def slash_key(url: Column) -> Column:
    """The URL without closing slashes: a key for joins, never an identity."""
    return F.regexp_replace(url, "/+$", "")


def shape(url: Column) -> Column:
    """The form of a URL: its last path segment becomes * with its suffix, its query the sorted
    names of the parameters that have a value."""
    p = F.regexp_replace(path(url), "/+$", "")
    head = F.regexp_extract(p, r"^(.*/)?[^/]*$", 1)
    suffix = F.regexp_extract(p, r"(\.[A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda x: F.rlike(x, F.lit("^[^=]+=.+"))), lambda x: F.regexp_extract(x, "^([^=]+)=", 1))))
    return F.concat(head, F.lit("*"), suffix, F.when(F.size(names) > 0, F.concat(F.lit("?"), F.array_join(names, "&"))).otherwise(F.lit("")))


def is_dated(url: Column) -> Column:
    """True for a path with a date in it, as of news."""
    return F.rlike(path(url), F.lit(r"/(?:19|20)\d{2}[/\-](?:0?[1-9]|1[0-2])(?:[/\-]|$)"))


def is_file(url: Column) -> Column:
    """True for a path that ends in a file that is no page."""
    return F.rlike(F.lower(path(url)), F.lit(rf"\.(?:{'|'.join(FILE_SUFFIXES)})$"))


def admits(url: Column, pattern: Column) -> Column:
    """True if the URL without closing slashes holds the pattern, or if there is no pattern."""
    return F.coalesce(F.contains(slash_key(url), pattern), F.lit(True))
