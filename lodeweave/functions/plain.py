"""The text functions for single strings on the driver, such as a typed keyword."""

from __future__ import annotations

import re
import unicodedata


def normalise_text(text: str | None) -> str:
    """Lower case, accents removed, single spaces; null becomes the empty string."""
    d = unicodedata.normalize("NFD", (text or "").lower().replace("đ", "d"))
    return " ".join("".join(c for c in d if not unicodedata.combining(c)).split())


def _fold_table() -> dict[int, str | None]:
    """Latin letters to their lower base letters, combining marks to nothing."""
    table: dict[int, str | None] = {cp: None for cp in range(0x300, 0x370)}
    for cp in [*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base.isascii() and base.isalpha():
            table[cp] = base.lower()
    return table | {ord("đ"): "d", ord("Đ"): "d"}


_FOLD = _fold_table()


def fold_text(text: str) -> str:
    """Lower case without accents; spaces and signs stay."""
    return text.translate(_FOLD).lower()


def tokens_of(text: str | None) -> list[str]:
    """Letter and digit runs of the normalised text."""
    return [t for t in re.split(r"[^\w]+|_+", normalise_text(text)) if t]


def fold_key_text(text: str | None) -> str:
    """Letters and digits only, lower case without accents; as ``text.fold_key`` does for columns."""
    return "".join(c for c in normalise_text(text) if unicodedata.category(c)[0] in "LN")
