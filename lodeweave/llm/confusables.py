"""Visually identical text with different characters: skeletons and one consistent form.

The look-alike table is the public data of Unicode's confusables, which Spark brings along
in its ICU library. Skeletons take all of it, prototypes of several characters included.
The consistent form takes what stands for a Latin letter or an ordinary digit: letters by
compatibility (mathematical, of full width, Roman numerals), small capitals, and twins of
other scripts. Accents, signs (², Ø, –) and words of other scripts stay.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Look-alike letters that are always brought to their Latin twins, by script.
_TWINS = {
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",  # Greek capitals
    "οϲϳ": "ocj",  # Greek small letters
    "АВЕЅІЈКМНОРСТУҮХԌԚԜҺӀ": "ABESIJKMHOPCTYYXGQWHI",  # Cyrillic capitals
    "аесоруүхѕіјԁԛԝһѵӏ": "aecopyyxsijdqwhvl",  # Cyrillic small letters
    "ÐƉɖðɑɡı": "ĐĐđđagi",  # Latin letters that look like others
}
_SMALL_CAPITAL = "LATIN LETTER SMALL CAPITAL "


def public_table(path: str | None = None) -> dict[int, str]:
    """Code point -> prototype, of Unicode's public confusables: the file confusables.cfu of an ICU
    library, by default that of the Spark installation. FileNotFoundError if there is none."""
    if path is None:
        places = [*Path(pyspark.__file__).parents, *([Path(os.environ["SPARK_HOME"])] if "SPARK_HOME" in os.environ else [])]
        path = next((str(jar) for place in places for jar in sorted(place.glob("jars/icu4j-*.jar"))), None)
        if path is None:
            raise FileNotFoundError("no ICU library in the Spark installation")
    with zipfile.ZipFile(path) as jar:
        raw = jar.read("com/ibm/icu/impl/data/icudata/confusables.cfu")
    order, coding = (">", "utf-16-be") if raw[8] else ("<", "utf-16-le")
    data = raw[struct.unpack_from(order + "H", raw)[0] :]
    # Offsets and sizes of the keys, their values and the strings, in the header of the data.
    keys_at, n, values_at, _, strings_at, units = struct.unpack_from(order + "6I", data, 12)
    strings = data[strings_at : strings_at + 2 * units]
    table = {}
    for key, value in zip(struct.unpack_from(f"{order}{n}I", data, keys_at), struct.unpack_from(f"{order}{n}H", data, values_at)):
        size = (key >> 24) + 1
        table[key & 0xFFFFFF] = chr(value) if size == 1 else strings[2 * value : 2 * (value + size)].decode(coding)
    return table


def _always(cp: int) -> str | None:
    """The Latin letter or digit a code point is by its compatibility or as a small capital."""
    c = chr(cp)
    kind = unicodedata.category(c)
    if kind in ("Lu", "Ll", "Nd", "Nl") and c != "ſ":
        plain_letter = unicodedata.normalize("NFKC", c)
        if plain_letter != c and len(plain_letter) == 1 and plain_letter.isascii():
            return plain_letter
    name = unicodedata.name(c, "")
    return name[-1].lower() if kind == "Ll" and name.startswith(_SMALL_CAPITAL) and len(name) == len(_SMALL_CAPITAL) + 1 else None


PUBLIC = public_table()
PROTOTYPES = {cp: letter for cp in [*range(0x1D00, 0x1D30), *range(0x250, 0x2B0), *range(0x2100, 0x2190), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)] if (letter := _always(cp))}
PROTOTYPES |= {ord(a): b for src, dst in _TWINS.items() for a, b in zip(src, dst)}


def _twin(cp: int, prototype: str) -> str | None:
    """The Latin twin of a cased letter of another script. The data have one prototype for I, l and 1;
    a capital is taken for the capital."""
    c = chr(cp)
    kind = unicodedata.category(c)
    if kind not in ("Lu", "Ll") or not (len(prototype) == 1 and prototype.isascii() and prototype.isalpha()) or unicodedata.name(c, "LATIN").startswith("LATIN"):
        return None
    return "I" if kind == "Lu" and prototype == "l" else prototype


#: Twins that count only in words that also have Latin letters.
MIXED = {cp: twin for cp, prototype in PUBLIC.items() if cp > 127 and cp not in PROTOTYPES and (twin := _twin(cp, prototype))}

# Characters that show nothing, besides those of Unicode's category Cf.
_UNSEEN_EXTRA = "͏ᅟᅠ឴឵ㅤﾠ"
_UNSEEN = {cp for cp in range(0x20000) if unicodedata.category(chr(cp)) == "Cf"} | {ord(c) for c in _UNSEEN_EXTRA} | set(range(0xE0000, 0xE0080))
_TABLE = PROTOTYPES | {cp: None for cp in _UNSEEN}
_SPACES = re.compile(r"\s+")
_HAS_MIXED = re.compile("[" + "".join(map(chr, sorted(MIXED))) + "]")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
_LATIN = re.compile(r"[A-Za-zđĐ]")


def _replaced(text: str) -> str:
    """Decompose and replace every character that stands for a Latin letter or a digit."""
    text = unicodedata.normalize("NFD", text).translate(_TABLE)
    if _HAS_MIXED.search(text):
        text = _WORD.sub(lambda m: m.group().translate(MIXED) if _LATIN.search(m.group()) else m.group(), text)
    return text


def skeleton(text: str) -> str:
    """Decompose, replace every character by its prototype, decompose again.

    Texts that look alike have equal skeletons; characters that show nothing are gone. It
    is for comparing only: m, for one, has the prototype rn."""
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", _replaced(text)).translate(PUBLIC))


def plain(text: str) -> str:
    """The consistent form: look-alikes replaced, composed, with single ordinary spaces and none at the ends."""
    return _SPACES.sub(" ", unicodedata.normalize("NFC", _replaced(text))).strip(" ")


def _clean_ranges() -> str:
    """Characters beyond ASCII that are their own consistent form, as the ranges of a regex class.

    Letters and signs of the Latin blocks, and general punctuation that shows; few ranges
    keep the pattern fast."""
    own = [c for c in [*range(0xA1, 0x250), *range(0x1E00, 0x1F00), *range(0x2010, 0x2028), *range(0x2030, 0x205F)] if plain(chr(c)) == chr(c)]
    starts = [c for c, before in zip(own, [-1, *own]) if c != before + 1]
    ends = [c for c, after in zip(own, [*own[1:], -1]) if c + 1 != after]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends))


#: What a text that isn't its own consistent form has somewhere: another character, or a space too many.
SUSPECT = rf"[^ !-~{_clean_ranges()}]|  |^ | $"


def needs_work(c: Column) -> Column:
    """False only for texts that are certainly their own consistent form; decided in the JVM."""
    return F.rlike(c, F.lit(SUSPECT))


def inconsistent(df: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """(id, field, plain_text) of every non-null field that differs from its consistent form.

    Most texts are found to be consistent by one pattern in the JVM and never reach
    Python. A text of invisible characters alone has the empty text as its form."""
    kind = dict(df.dtypes)[id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["plain_text"] = [plain(t) for t in b["_text"]]
            yield b[b["plain_text"] != b["_text"]].drop(columns="_text")

    cells = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("_text")) for f in fields]))
    rows = df.select(F.col(id), cells).where(F.col("_text").isNotNull() & needs_work(F.col("_text")))
    return rows.mapInPandas(run, f"`{id}` {kind}, field string, plain_text string")


def lookalike_groups(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, skeleton, plain_text, forms, n_rows): texts of equal skeleton, per field.

    Rows are counted per original before anything is grouped, so a frequent text is one
    row when its group is formed; forms is the number of different originals."""
    cells = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("_text")) for f in fields]))
    originals = df.select(cells).where("_text is not null").groupBy("field", "_text").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = [(skeleton(t), plain(t)) for t in b["_text"]]
            # Spaces of any kind and number look alike.
            yield pd.DataFrame({"field": b["field"], "skeleton": [_SPACES.sub(" ", s).strip(" ") for s, _ in forms], "plain_text": [p for _, p in forms], "n": b["n"]})

    skeletons = originals.select("field", "_text", "n").mapInPandas(run, "field string, skeleton string, plain_text string, n long")
    return skeletons.groupBy("field", "skeleton").agg(F.min("plain_text").alias("plain_text"), F.count("*").alias("forms"), F.sum("n").alias("n_rows"))
