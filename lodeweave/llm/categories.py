"""Freely entered values mapped to the entries of a reference list.

A value is brought to its consistent form, freed of trimmings (counts, page numbers,
shop names, selling words), and read in several ways: as it stands, with typed accents
(telex) resolved, and with abbreviations expanded that the reference names themselves
suggest. Readings are looked up in a symmetric-delete dictionary of the names and their
rotations, which is built once, on the driver, and broadcast; abbreviated values are
compared word by word with the names that have such words. Candidates are ranked by
weighted Damerau-Levenshtein distance and by how often the reference name itself occurs.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.plain import fold_text as fold
from lodeweave.llm.confusables import plain
from lodeweave.session import small

#: Most entries of a reference list, and most keys of its dictionary (12 bytes each), which is sent
#: to every executor.
MAX_REFERENCE = 20_000
MAX_KEYS = 16_000_000
#: Largest edit distance by length of a folded name, and of a value: (shortest length, distance).
DISTANCES = ((8, 2), (5, 1), (0, 0))
VALUE_DISTANCES = ((6, 2), (4, 1), (0, 0))
#: Letters of a name's beginning whose deletions are keys. Two texts within d edits have
#: beginnings that d deletions on either side make equal, so nothing within the distance is
#: missed: d edits leave all but d letters of a beginning in common, in order.
BEGINNING = 8



@dataclass(frozen=True)
class Vocabulary:
    """What is known of the language of the values, folded: words for words of the reference's
    language, and selling or filing words after and before a name."""

    synonyms: dict[str, str] = field(default_factory=dict)
    trailing: tuple[str, ...] = ()
    leading: tuple[str, ...] = ()


# Common words of shops in this language.
VIETNAMESE_SHOPS = Vocabulary(
    {
        "indoor": "trong nha", "outdoor": "ngoai troi", "smart": "thong minh", "solar": "mat troi", "downlight": "am tran", "industrial": "cong nghiep", "nlmt": "nang luong mat troi",
        "office": "van phong", "emergency": "khan cap", "decor": "trang tri", "garden": "san vuon", "street": "duong", "floodlight": "pha", "sensor": "cam bien", "remote": "dieu khien",
    },
    ("gia re", "chinh hang", "gia tot", "gia xuong", "gia si", "cao cap", "ban si", "moi nhat", "ban chay", "hot", "sale", "khuyen mai", "tot nhat", "uy tin"),
    ("danh muc", "chuyen muc", "nhom", "loai", "category", "san pham"),
)

# Neighbours on the keyboard.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_AT = {c: (x + 0.4 * y, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}


def squeeze(text: str) -> str:
    """Letters and digits only."""
    return "".join(c for c in text if c.isalnum())


def _near(a: str, b: str) -> bool:
    p, q = _AT.get(a), _AT.get(b)
    return bool(p and q and abs(p[0] - q[0]) <= 1.1 and abs(p[1] - q[1]) <= 1)


def weighted_distance(a: str, b: str, limit: float) -> float:
    """Damerau-Levenshtein distance with weights: neighbouring keys 0.8, a doubled letter 0.7, the
    rest 1. Transposed letters may have others deleted or inserted between them. Above ``limit``
    it may return inf."""
    if abs(len(a) - len(b)) > limit / 0.7:
        return math.inf
    n, m = len(a), len(b)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for j in range(1, m + 1):
        d[0][j] = d[0][j - 1] + (0.7 if j > 1 and b[j - 1] == b[j - 2] else 1.0)
    seen: dict[str, int] = {}  # last row of each letter
    for i in range(1, n + 1):
        x = a[i - 1]
        drop = 0.7 if i > 1 and x == a[i - 2] else 1.0
        row, above = d[i], d[i - 1]
        row[0] = above[0] + drop
        at = 0  # last column of the row's letter
        for j in range(1, m + 1):
            y = b[j - 1]
            best = min(above[j - 1] + (0.0 if x == y else 0.8 if _near(x, y) else 1.0), above[j] + drop, row[j - 1] + (0.7 if j > 1 and y == b[j - 2] else 1.0))
            k = seen.get(y, 0)
            if k and at:
                best = min(best, d[k - 1][at - 1] + (i - k - 1) + 1.0 + (j - at - 1))
            if x == y:
                at = j
            row[j] = best
        seen[x] = i
        if min(row) > limit + 1:
            return math.inf
    return d[n][m]


def deletes(word: str, distance: int) -> set[str]:
    """The word and all words with up to ``distance`` letters deleted."""
    out, edge = {word}, {word}
    for _ in range(distance):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out |= edge
    return out


_TELEX = (("dd", "d"), ("aa", "a"), ("ee", "e"), ("oo", "o"))


def untelex(text: str) -> str:
    """Folded text whose accents are typed as letters (aa, ow, dd, a tone letter at the word's end)."""
    words = []
    for w in text.split():
        for a, b in _TELEX:
            w = w.replace(a, b)
        if len(w) > 2 and w[-1] in "sfrxj" and any(v in w for v in "aeiouy"):
            w = w[:-1]
        words.append(re.sub(r"(?<=[aou])w", "", w))
    return " ".join(words)


def slots_distance(slots: list[list[str]], key: str, limit: float) -> float:
    """Weighted distance of a key from the nearest text that takes one choice per slot, above
    ``limit`` perhaps inf. Row by row over all choices of a slot at once, so their number adds
    up rather than multiplies; letters aren't transposed across slots."""
    n = len(key)
    row = [0.0]
    for j in range(1, n + 1):
        row.append(row[-1] + (0.7 if j > 1 and key[j - 1] == key[j - 2] else 1.0))
    for choices in slots:
        ends = []
        for text in choices:
            rows = [row]
            for i, x in enumerate(text):
                above = rows[-1]
                drop = 0.7 if i and x == text[i - 1] else 1.0
                now = [above[0] + drop]
                for j in range(1, n + 1):
                    y = key[j - 1]
                    cost = min(above[j - 1] + (0.0 if x == y else 0.8 if _near(x, y) else 1.0), above[j] + drop, now[j - 1] + (0.7 if j > 1 and y == key[j - 2] else 1.0))
                    if i and j > 1 and x == key[j - 2] and text[i - 1] == y:
                        cost = min(cost, rows[-2][j - 2] + 1.0)
                    now.append(cost)
                rows.append(now)
                if min(now) > limit + 1:
                    break
            else:
                ends.append(rows[-1])
        if not ends:
            return math.inf
        row = [min(column) for column in zip(*ends)]
        if min(row) > limit:
            return math.inf
    return row[n]


class Dictionary:
    """The names of one level. It is built once and sent to the workers as it is."""

    def __init__(self, names: list[tuple[int, str, int]], vocabulary: Vocabulary = VIETNAMESE_SHOPS, max_keys: int = MAX_KEYS):
        """names: (entry id, name, how often the name occurs). ValueError beyond ``max_keys`` keys."""
        self.vocabulary = vocabulary
        self.exact: dict[str, set[int]] = defaultdict(set)
        self.frequency, self.full, self.words = {}, {}, {}
        #: Short form -> entry -> what of the entry's name it stands for.
        self.short: dict[str, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        translated = {v: k for k, v in vocabulary.synonyms.items()}
        for entry, name, n in names:
            self.frequency[entry], self.full[entry] = n, squeeze(plain(name).lower())
            words = self.words[entry] = [w for w in re.split(r"[^\w]+", fold(plain(name))) if w]
            for i in range(len(words)):
                self.exact["".join(words[i:] + words[:i])].add(entry)
            for size in range(1, len(words) + 1):
                for i in range(len(words) - size + 1):
                    gram = " ".join(words[i : i + size])
                    if size > 1:
                        self.short["".join(w[0] for w in words[i : i + size])][entry].add(gram)
                    if gram in translated:
                        # The name's word, or nothing where it stands beside its translation.
                        self.short[translated[gram]][entry] |= {gram, ""}
            for u, w in zip(words, words[1:]):
                for first in {u[:1], u[:2]}:
                    self.short[f"{first}.{w}"][entry].add(f"{u} {w}")
                    self.short[f"{first}/{w}"][entry].add(f"{u} {w}")
            for w in words:
                self.short[f"{w[0]}."][entry].add(w)
        self.short = {k: dict(v) for k, v in self.short.items()}
        self.exact = dict(self.exact)
        self.keys = [(key, entry) for key in self.exact for entry in sorted(self.exact[key])]
        hashes: list[int] = []
        places: list[int] = []
        for k, (key, _) in enumerate(self.keys):
            found = deletes(key[:BEGINNING], self.allowed(key))
            hashes += map(xxhash.xxh64_intdigest, found)
            places += [k] * len(found)
            if len(hashes) > max_keys:
                raise ValueError(f"a dictionary has at most {max_keys} keys")
        order = np.argsort(np.array(hashes, dtype=np.uint64), kind="stable")
        self.hashes, self.places = np.array(hashes, dtype=np.uint64)[order], np.array(places, dtype=np.int32)[order]
        self.lengths = np.array([len(k) for k, _ in self.keys], dtype=np.int32)

    @staticmethod
    def allowed(key: str, lengths: tuple = DISTANCES) -> int:
        return next(d for n, d in lengths if len(key) >= n)

    def near(self, key: str, distance: int) -> np.ndarray:
        """Places of the keys that may be within the distance."""
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, deletes(key[:BEGINNING], distance)), dtype=np.uint64)
        low, high = np.searchsorted(self.hashes, wanted), np.searchsorted(self.hashes, wanted, side="right")
        some = np.flatnonzero(high > low)
        if not len(some):
            return self.places[:0]
        found = np.unique(np.concatenate([self.places[low[i] : high[i]] for i in some]))
        return found[np.abs(self.lengths[found] - len(key)) <= distance / 0.7]

    def find(self, value: str) -> int:
        """The entry a value stands for, 0 for none."""
        texts = trimmed(value, self.vocabulary)
        keys: dict[str, float] = {}
        for text in texts:
            for reading, price in ((text, 0.0), (untelex(text), 0.1)):
                key = squeeze(reading)
                keys[key] = min(price, keys.get(key, price))
        accented = squeeze(value.lower())
        ranks = [self._rank(entry, price, accented) for key, price in keys.items() for entry in self.exact.get(key, ())]
        shortened = [found for text in texts for found in self._shortened(text)] if not ranks else []
        for distance in range(DISTANCES[0][1] + 1):
            if ranks:
                break
            ranks = [self._rank(entry, far + 0.05, accented) for far, entry in shortened if far <= distance]
            for key, price in keys.items() if distance else ():
                if self.allowed(key, VALUE_DISTANCES) < distance:
                    continue
                for k in self.near(key, distance):
                    name, entry = self.keys[k]
                    limit = min(distance, self.allowed(name))
                    far = weighted_distance(key, name, limit)
                    if far <= limit:
                        ranks.append(self._rank(entry, far + price, accented))
        return min(ranks)[-1] if ranks else 0

    def _shortened(self, text: str) -> list[tuple[float, int]]:
        """(distance, entry) of the names that the text stands for with some words shortened or
        translated: each word is itself or what it stands for in that very name."""
        words = [(w, w.strip("()[],;:")) for w in text.split()]
        forms: list[tuple[str, str, dict[int, set[str]]]] = []
        entries: set[int] = set()
        for w, bare in words:
            own = self.short.get(bare)
            head, dot, rest = bare.partition(".")
            if own is None and dot:
                own = {e: {f"{x} {rest}".strip() for x in xs} for e, xs in self.short.get(head + ".", {}).items()}
            forms.append((w, bare, own or {}))
            entries.update(own or ())
        out = []
        least = sum(min(len(squeeze(w)), 0 if own else 99) for w, _, own in forms)
        for entry in sorted(entries):
            name = self.words[entry]
            size = sum(map(len, name))
            if least > size + 3:
                continue
            slots = [[squeeze(w), *sorted({squeeze(x) for x in own.get(entry, ())})] for w, _, own in forms]
            for i in range(len(name)):
                key = "".join(name[i:] + name[:i])
                limit = self.allowed(key)
                far = slots_distance(slots, key, limit)
                if far <= limit:
                    out.append((far, entry))
        return out

    def _rank(self, entry: int, far: float, accented: str) -> tuple:
        """Smaller is better: distance, distance of the accented forms, frequency, id."""
        full = weighted_distance(accented, self.full[entry], 4.0)
        return (round(far, 6), min(full, 99.0), -self.frequency[entry], entry)


_LEAD = re.compile(r"^(?:[\s»«>›\-–—•*#·|/:.]+|\d{1,3}[.)]\s+)+")
_TAIL = re.compile(r"(?:[\s»>›\-–—•*#·|/:,]+|\(\d+\)|\|\s*trang\s*\d+|[-|–]\s*trang\s*\d+|\b20[12]\d)$")
_SHOP = re.compile(r"\s[-–|]\s[^-–|]{2,30}$")


def trimmed(value: str, vocabulary: Vocabulary = VIETNAMESE_SHOPS) -> list[str]:
    """The value, folded, freed of what isn't part of a name; with and without a shop's name at the end."""
    text = plain(html.unescape(plain(value))).replace("&", " và ")
    text = fold(text).replace("_", " ")
    out: list[str] = []
    for t in (text, _SHOP.sub("", text)):
        last = None
        while last != t:
            last = t
            t = _TAIL.sub("", _LEAD.sub("", t)).strip()
            for w in vocabulary.trailing:
                if t.endswith(" " + w):
                    t = t[: -len(w)].strip()
            for w in vocabulary.leading:
                if t.startswith((w + ":", w + " :")):
                    t = t[len(w) :].lstrip(" :")
        t = " ".join(t.replace("-", " ").split())
        if t and t not in out:
            out.append(t)
    return out


def map_values(values: DataFrame, reference: DataFrame, frequencies: DataFrame | None = None, vocabulary: Vocabulary = VIETNAMESE_SHOPS) -> DataFrame:
    """(level, value, entry) of every row of ``values`` (level, value); entry is 0 for a miss.

    ``reference`` has (level, category_id, name), at most MAX_REFERENCE rows, else
    ValueError; ``frequencies`` has (level, value, n) of the names' own occurrences. The
    dictionaries are built here, of at most MAX_KEYS keys a level, and broadcast; a worker
    process unpacks them once."""
    rows = reference.select("level", "category_id", "name").where("name is not null and level is not null and category_id is not null").limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError(f"a reference list has at most {MAX_REFERENCE} entries")
    # Occurrences of the names alone, so as many rows as the list at most.
    counts = {(r.level, r.value): r.n for r in frequencies.collect()} if frequencies is not None else {}
    by_level: dict[int, list[tuple[int, str, int]]] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.level, r.category_id, r.name)):
        by_level[r.level].append((r.category_id, r.name, counts.get((r.level, r.name), 0)))
    sent = values.sparkSession.sparkContext.broadcast({level: Dictionary(names, vocabulary) for level, names in by_level.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sent.value[level].find(value) if level in sent.value else 0 for level, value in zip(b["level"], b["value"])]
            yield pd.DataFrame({"level": b["level"], "value": b["value"], "entry": pd.Series(found, dtype="int64")})

    return values.select("level", "value").mapInPandas(run, "level int, value string, entry long")


def map_categories(df: DataFrame, reference: DataFrame, *, id: str = "id", fields: list[str], vocabulary: Vocabulary = VIETNAMESE_SHOPS) -> DataFrame:
    """(id, level, category_id) of every non-null field that isn't a name of its level as it stands.

    The n-th of ``fields`` has level n. category_id is 0 for a value that means no entry of
    its level: those are the reported misses, the empty text among them. Different values
    are mapped once each; the rows get their entries by a join on the value, which adaptive
    execution splits where one value holds many rows."""
    cells = F.inline(F.array(*[F.struct(F.lit(i + 1).alias("level"), F.col(f).alias("value")) for i, f in enumerate(fields)]))
    rows = df.select(F.col(id).alias("_id"), cells).where("value is not null")
    names = reference.select("level", F.col("name").alias("value")).where("value is not null").distinct()
    as_is = rows.join(small(names), ["level", "value"], "left_anti")
    counts = rows.join(small(names), ["level", "value"], "left_semi").groupBy("level", "value").agg(F.count("*").alias("n"))
    # A lookup costs far more than its few bytes, so the values are not brought into few tasks.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mapped = map_values(as_is.select("level", "value").distinct().repartition(tasks), reference, counts, vocabulary)
    return as_is.join(mapped, ["level", "value"]).select(F.col("_id").alias(id), "level", F.col("entry").alias("category_id"))
