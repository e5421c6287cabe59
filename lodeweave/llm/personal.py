"""Personal information inside free text: found, and replaced by keyed surrogates.

Detectors read a 1:1 normalised view of the text (composed letters, ordinary spaces, no
invisible characters) and report spans of the original. A surrogate has the type, gender,
script and format of what it replaces. It is drawn by one-to-one maps under a key, so that
in all documents equal entities get equal surrogates and different ones different ones,
without a table that grows with the data: numbers by a Feistel network, listed names by
permutations within their gender's list, other words as syllables of a permuted number.
Letters and accents are mapped apart, so a name without its accents gets the surrogate of
the name, without accents.
"""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.session import spread

KINDS = ("email", "phone", "id_number", "address", "name")

# Vietnamese family names.
SURNAMES = (
    "nguyễn trần lê phạm hoàng huỳnh phan vũ võ đặng bùi đỗ hồ ngô dương lý đào đoàn vương trịnh trương lâm mai tô hà cao "
    "châu tạ phùng quách thái lương âu lưu đinh kiều tống từ tăng doãn nghiêm chu la thạch bạch triệu"
).split()
# Vietnamese middle and given names by gender.
FEMALE = "ánh cát diệu duyên đoan đượm giao hạ hoài khuê lam liên loan luyến lựu mai miên my nga ngà nhàn nhi như oanh phượng quyên sênh thoa thơ thục thuỷ thuỵ tịnh trà trang tuyết uyên vân vi xuyến yên yến hương lan hoa hằng hạnh ngọc quỳnh thảo chi diễm giang hiền kim lệ linh".split()
MALE = "bảo bàng cường dũng đạt đức gia hải hiếu hùng huy khải khoa kiên kỳ lộc long mạnh minh nam nghiêm nghị phong phúc quân quang sơn tài tâm thạch thành thắng thịnh thoại tiến toại tuấn tường uy vĩ vĩnh việt vinh văn hữu đình".split()
EITHER = "an anh bình kha khả nhã nhiên song tuệ khánh thanh xuân thu hoà phương bích thị công tú thiên".split()
# Common English given names by gender, and family names.
EN_FEMALE = "mary anna emma olivia sophia laura julia sarah alice helen nora grace lucy ruth clara rachel hannah diana susan linda karen nancy betty sandra carol amanda melissa jessica rebecca emily".split()
EN_MALE = "john james robert michael david thomas charles daniel matthew anthony mark paul steven andrew peter george edward brian kevin jason henry frank patrick jack samuel walter arthur simon oliver martin".split()
EN_SURNAMES = "smith jones taylor brown williams wilson johnson davies robinson wright thompson evans walker white roberts green hall wood jackson clarke baker cooper morris harris king turner hill parker bennett carter".split()

_FOLD = {c: unicodedata.normalize("NFD", chr(c))[0].lower() for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if unicodedata.category(chr(c))[0] == "L"} | {ord("đ"): "d", ord("Đ"): "d"}
_FOLD |= {c: chr(c + 32) for c in range(65, 91)}


_MARK = re.compile("[\u0300-\u036f]")


def fold(text: str) -> str:
    """Lower case without accents, of the same length."""
    if text.isascii():
        return text.lower()
    # Decomposing is faster than a table; where it changes the length, as for marks that stand alone
    # or letters of other scripts, the table does it.
    bare = _MARK.sub("", unicodedata.normalize("NFD", text)).lower().replace("đ", "d")
    return bare if len(bare) == len(text) else text.translate(_FOLD)


_SURNAME = {fold(s) for s in SURNAMES}
_GIVEN = {fold(s) for s in (*FEMALE, *MALE, *EITHER)}
_EXACT = {*SURNAMES, *FEMALE, *MALE, *EITHER}

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SPACE_LIKE = re.compile("[  -  　]")


def view(text: str) -> tuple[str, list[int] | None]:
    """The normalised view, and where each of its characters begins in the text (None: the same place)."""
    text = _SPACE_LIKE.sub(" ", text)
    if not _MARK.search(text) and not _INVISIBLE.search(text):
        return text, None
    out, at = [], []
    i, n = 0, len(text)
    while i < n:
        if _INVISIBLE.match(text, i):
            i += 1
            continue
        j = i + 1
        while j < n and "̀" <= text[j] <= "ͯ":
            j += 1
        for c in unicodedata.normalize("NFC", text[i:j]):
            out.append(c)
            at.append(i)
        i = j
    at.append(n)
    return "".join(out), at


# --- detectors; each yields spans of the view ---------------------------------------------

_LOCAL = r"(?<![\w.+\-])([A-Za-z0-9][A-Za-z0-9._+\-]*)"
_AT_SURE = r"(?:@| @ |＠|\s?[\[({](?:at|a|a còng|a cong|@)[\])}]\s?)"
_AT_WORD = r"(?: (?:at|AT|a còng|a cong|A CÒNG) )"
_DOT = r"(?:\.|\s?[\[({](?:\.|dot|chấm|cham)[\])}]\s?| (?:dot|DOT|chấm|cham|CHẤM) )"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
EMAIL = re.compile(rf"{_LOCAL}(?:{_AT_SURE}|(?P<word>{_AT_WORD}))(?P<domain>{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}})(?![\w])")
_DISGUISED = re.compile(r"[\[({]| (?:dot|DOT|chấm|cham|CHẤM) ")

PHONE = re.compile(r"(?<![\w+=/@\-])(?<!\d[.,])(?:\(\+84\)|\+84|0084|\(0\d{2,3}\)|0)(?:[ .\-]{0,2}[0-9oO]){7,9}(?![\w\-])(?![.,]\d)")
ID_WORDS = re.compile(r"\b(?:cmnd|cccd|cmt|can cuoc(?: cong dan)?|chung minh(?: nhan dan| thu)?|ho chieu|passport|giay to(?: tuy than)?|id(?: card)?(?: no\.?| number)?|identity(?: card| number)?)[^\w\n]*(?:(?:so|no|number)\b)?[^\w\n]*")
ID_NUMBER = re.compile(r"(?:[A-Z]\d{7,8}|\d{3}([ .]?)\d{3}\1\d{3}(?:[ .]?\d{3})?|\d{12}|\d{9})(?!\w)")
BARE_ID = re.compile(r"(?<![\w.+=/\-])0\d{2}([ .]?)\d{3}\1\d{3}[ .]?\d{3}(?![\w\-])")
_GOODS = re.compile(r"(?:ma|don|kien|lo|sap|vach|serial|barcode|batch|order|parcel|tracking|hang|sku|van don|buu kien|hoa don)[^\w]*(?:so|no|number|code)?[^\w]*$")

_CAP = r"[A-ZÀ-ÖØ-ÞĂĐĨŨƠƯẠ-Ỹ][\w]*"
_NAME = rf"(?:{_CAP}(?: (?:{_CAP}|\d+\b))*)"
_HOUSE = r"\d+[A-Za-z]?(?:/\d+[A-Za-z]?)*"
_S = r"(?:[Ss]ố|[Ss]o|SỐ)"
_LANE = r"(?:[Nn]gõ|[Nn]go|[Nn]gách|[Nn]gach|[Hh]ẻm|[Hh]em|[Kk]iệt)"
_ROAD = r"(?:[Đđ]ường|[Dd]uong|[Pp]hố|[Pp]ho)"
_UNIT = r"(?:[Pp]hường|[Pp]huong|P\.|[Xx]ã|[Xx]a|[Qq]uận|[Qq]uan|Q\.|[Hh]uyện|[Hh]uyen|H\.|[Tt]hị xã|[Tt]hi xa|[Tt]hị trấn|[Tt]hi tran|TX\.?|[Tt]hành phố|[Tt]hanh pho|TP\.?|[Tt]ỉnh|[Tt]inh|[Kk]hu phố|[Kk]hu pho|Ward|District)"
_SEGMENT = rf"(?:, ?(?:{_UNIT} ?)?(?:{_NAME}|\d+\b))"
_EN_ROAD = rf"(?:{_CAP} )+(?:Lane|Avenue|Court|Road|Street|Drive|Close|Square|Way|Terrace|Alley|Boulevard|Hill|Row|Quay)"
_TAIL = rf"{_SEGMENT}+"
_HAMLET = r"(?:[Tt]hôn|[Tt]hon|[Xx]óm|[Xx]om|[Ấấ]p|[Ll]àng)"
ADDRESS = re.compile(
    rf"(?<![\w/.,:\-])(?:"
    rf"(?:[Cc]ăn hộ|[Cc]an ho|[Pp]hòng|[Cc]hung cư) [\w\-]+ (?:[Tt]oà|[Tt]oa|[Tt]òa|[Bb]lock) \w+, ?{_HOUSE} (?:{_ROAD} )?{_NAME}{_TAIL}"
    rf"|{_HAMLET} (?:\d+|{_NAME})(?:, ?(?:{_S} (?:nhà |nha )?{_HOUSE})?{_TAIL}|, ?{_UNIT} ?(?:{_NAME}|\d+\b){_SEGMENT}*)"
    rf"|{_S} (?:nhà|nha) {_HOUSE},? ?{_LANE} {_HOUSE},? ?(?:{_ROAD} )?{_NAME}{_TAIL}"
    rf"|{_S} {_HOUSE},? ?{_LANE} {_HOUSE},? ?(?:{_ROAD} )?{_NAME}{_TAIL}"
    rf"|{_S} (?:nhà |nha )?{_HOUSE} (?:{_ROAD} )?{_NAME}{_TAIL}"
    rf"|(?:Flat|Apartment|Apt\.?|Unit) [\w\-]+, ?{_HOUSE} {_EN_ROAD}{_TAIL}"
    rf"|{_HOUSE} {_EN_ROAD}{_TAIL}"
    rf"|{_HOUSE} {_ROAD} {_NAME}{_TAIL}"
    rf"|{_HOUSE} {_NAME}(?:, ?{_UNIT} ?(?:{_NAME}|\d+\b)){_SEGMENT}*"
    rf")(?: City\b)?"
)
#: Every address has a house number or a hamlet's word with only words up to the next comma; most
#: texts have few such places. Each branch of ADDRESS implies it.
_MAYBE_ADDRESS = re.compile(rf"(?:\d[A-Za-z]?|{_HAMLET}) \w[\w ]*,")

_FAMILY = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(sorted(_SURNAME))})(?![^\W\d_])")
_INITIALS = re.compile(r" ((?:[^\W\d_]\.){1,3})(?= )")
_NEXT = re.compile(r" ([^\W\d_]+)")
# Words after which a person is named, folded; a name there may hold any capitalised words.
_LEADS = re.compile(
    r"(?:\b(?:ho (?:va )?ten|ten|nguoi nhan|nguoi dat hang|nguoi mua|nguoi gui|ben mua|ky nhan|dat coc boi|dung ten|hoa don|tu|khach|khach hang|ky thuat vien|nhan vien tu van|minh ten|minh|em la|anh|chi|ong|ba|bac|co|goi|uy quyen cho ong|"
    r"from|contact|ordered by|signed for by|my name is|ask for (?:ms|mr|mrs)\.?|installer|shown by|name|to|attn|regards|sincerely|tran trong|than men|customer|buyer|ms|mr|mrs)\b[\"']?\s*[:,]?\s*[\"']?\s*)$"
)
_EN_PERSON = re.compile(r"(?<![\w@])([A-Z][a-z]+(?:[-'][A-Z][a-z]+)*)(?: (?:da|de|del|di|dos|la|le|van|von|der|den|bin|al))* ([A-Z][a-z]+(?:[-'][A-Z]?[a-z]+)*)(?![\w])")
# Words right before a person's name, folded. What follows in capitals is a name, whatever its words.
_ANNOUNCED = re.compile(
    r"\b(?:(?:ho (?:va )?ten|ten khach(?: hang)?|nguoi (?:nhan|dat|dat hang|mua|gui|lien he)|attn|full name|contact|customer name|signed by|ordered by)[ \t]*:|ten (?:toi|minh) la|(?:toi|minh) ten(?: la)?|my name is|(?:ong|mr|mrs|ms|dr)\.?) +\"?"
)
_CAPITALISED = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*(?: (?:(?:da|de|del|di|dos|van|von|der|den|bin) )*[^\W\d_a-z][^\W\d_]*(?:[-'][^\W\d_]+)*){1,4}(?!\w)")
# Small words inside names, which stay.
_PARTICLES = frozenset("da de del di dos von der den bin al".split())
# Folded words that stand in capitals after such words without naming a person.
_NOT_NAMED = frozenset("cong ty tnhh co phan doanh nghiep cua hang shop kho den led phong ban bo trung tam chi nhanh chieu sang viet nam giam doc giao vien truong us me our the support customer service sales team company store dien thoai email so dia quan ly khach nguoi don hang ngay".split())
_EN_AFTER = re.compile(r"(?: wrote\b| visited\b| (?:called|ordered|signed|said|asked)\b| ?[(<][^\s()<>]*(?:@|\[|\(| a| at)|,? ID no)")
_EN_LEADS = re.compile(r"(?:(?i:from|contact|ordered by|signed for by|my name is|ask for (?:ms|mr|mrs)\.?|installer|shown by|by|customer|attn|name|buyer)\s*:?\s*|(?i:regards|sincerely|thanks|yours),?\s*)$")
# Capitalised English words that begin a phrase rather than a name.
_NOT_PERSON = {"The", "Our", "Best", "Please", "Reply", "Note", "Call", "Invoice", "Warranty", "Rated", "Stock", "Shop", "Listed", "Signed", "Order", "Ordered", "Company", "Lighting", "Flat", "Passport", "Contact", "From", "Follow", "See", "Batch", "Barcode", "Lane", "Avenue", "Court", "Road", "Street", "Drive", "Close", "Square", "Way", "Terrace", "Alley", "Boulevard", "Row", "Quay"}


#: What every address has, and every identity number: texts without it are spared the patterns.
_MAYBE_EMAIL = re.compile(r"[@＠]|[\[({](?:at|a|a còng|a cong)[\])}]| (?:at|AT|a còng|a cong|A CÒNG) ")
_MAYBE_ID = re.compile(r"\d{3}[ .]?\d{3}[ .]?\d{3}|\d{7}")


def _emails(v: str) -> Iterator[tuple[int, int]]:
    if not _MAYBE_EMAIL.search(v):
        return
    for m in EMAIL.finditer(v):
        if m.group("word"):
            plain_domain = not _DISGUISED.search(m.group("domain"))
            if plain_domain and not re.search(r"[\d._+\-]", m.group(1)) and not re.search(r"mail\W*$", v[max(0, m.start() - 12) : m.start()], re.I):
                continue
        yield m.span()


def _phones(v: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(v):
        text = m.group()
        digits = "".join("0" if c in "oO" else c for c in text if c.isdigit() or c in "oO")
        if text.startswith(("+", "(+")) or digits.startswith("0084"):
            good = len(digits) - (4 if digits.startswith("0084") else 2) in (9, 10)
        else:
            good = len(digits) == 10 or (len(digits) == 11 and digits.startswith("02"))
        if good and sum(c in "oO" for c in text) <= 2:
            yield m.span()


def _ids(v: str, f: str) -> Iterator[tuple[int, int]]:
    if not _MAYBE_ID.search(v):
        return
    for w in ID_WORDS.finditer(f):
        m = ID_NUMBER.match(v, w.end())
        if m and len(re.sub(r"\W", "", m.group())) in (8, 9, 12):
            yield m.span()
    for m in BARE_ID.finditer(v):
        if not _GOODS.search(f[max(0, m.start() - 30) : m.start()]):
            yield m.span()


def _addresses(v: str) -> Iterator[tuple[int, int]]:
    if not _MAYBE_ADDRESS.search(v):
        return
    for m in ADDRESS.finditer(v):
        yield m.span()


def _led(f: str, at: int) -> bool:
    """Whether the words before a place announce a person."""
    return bool(_LEADS.search(f[max(0, at - 30) : at]))


def _names(v: str, f: str) -> Iterator[tuple[int, int]]:
    end = 0
    for w in _FAMILY.finditer(f):
        if w.start() < end:
            continue
        shown = v[w.start() : w.end()]
        low, upper = shown[0].islower(), shown.isupper() and len(shown) > 1
        at, words, known, full = w.end(), 1, 0, 0
        if low and shown not in _EXACT and shown != w.group():
            continue
        led: bool | None = None  # looked up where it decides
        while words < 5:
            m = _INITIALS.match(f, at)
            if m and v[m.start(1)].isupper():
                at, words, full = m.end(), words + 1, -1
                continue
            m = _NEXT.match(f, at)
            if not m:
                break
            word = v[m.start(1) : m.end(1)]
            if (word[0].islower() != low) or (not upper and not low and word.isupper() and len(word) > 1) or (upper and not word.isupper()):
                break
            # In small letters a word is a name's only with its very accents, or without any in a bare text.
            in_list = m.group(1) in _GIVEN and (not low or word in _EXACT or (word == m.group(1) and shown == w.group()))
            if not in_list:
                if low:
                    break
                led = _led(f, w.start()) if led is None else led
                if not led:
                    break
            at, words, known, full = m.end(), words + 1, known + in_list, 1
        # Bare small words are names only where a person is announced.
        if full != 1:
            continue
        bare = low and v[w.start() : at].isascii()
        led = _led(f, w.start()) if low and led is None else led
        if not (bare and not led) and (known >= 2 or (known and not low) or led and not low and words >= 2):
            end = at
            yield w.start(), at
    for w in _ANNOUNCED.finditer(f):
        m = _CAPITALISED.match(v, w.end())
        if m:
            shown = [x for x in re.findall(r"[^\W\d_]+", m.group()) if x not in _PARTICLES and x != "van"]
            if sum(len(x) > 1 for x in shown) > 1 and all(x[0].isupper() for x in shown) and not _NOT_NAMED.intersection(map(fold, shown)):
                yield m.span()
    for m in _EN_PERSON.finditer(v):
        if m.group(1) in _NOT_PERSON or m.group(2) in _NOT_PERSON or _NOT_NAMED.intersection(m.group().lower().split()):
            continue
        if _EN_LEADS.search(v[max(0, m.start() - 24) : m.start()]) or _EN_AFTER.match(v, m.end()):
            yield m.span()


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    end: int
    text: str


def find(text: str | None) -> list[Found]:
    """The pieces of personal information in a text, in order, without overlaps."""
    if not text:
        return []
    v, at = view(text)
    f = fold(v)
    spans: list[tuple[int, int, str]] = []
    taken = bytearray(len(v))
    for kind, found in (("email", _emails(v)), ("id_number", _ids(v, f)), ("phone", _phones(v)), ("address", _addresses(v)), ("name", _names(v, f))):
        for a, b in found:
            if any(taken[a:b]):
                continue
            taken[a:b] = b"\1" * (b - a)
            spans.append((a, b, kind))
    out = []
    for a, b, kind in sorted(spans):
        p, q = (a, b) if at is None else (at[a], at[b])
        out.append(Found(kind, p, q, text[p:q]))
    return out


# --- surrogates ----------------------------------------------------------------------------

_VIETNAMESE = {"a": "àáảãạăằắẳẵặâầấẩẫậ", "e": "èéẻẽẹêềếểễệ", "i": "ìíỉĩị", "o": "òóỏõọôồốổỗộơờớởỡợ", "u": "ùúủũụưừứửữự", "y": "ỳýỷỹỵ", "d": "đ"}
_ACCENT = {c: (base, i + 1) for base, forms in _VIETNAMESE.items() for i, c in enumerate(forms)}
_CONSONANTS, _VOWELS = "bcdghklmnprstvzf", "aeiou"
_SYLLABLES = len(_CONSONANTS) * len(_VOWELS)
#: Words that are remembered before the memory of words starts anew.
MEMO_WORDS = 50_000

# Labels of a mail domain that stay.
_TOP_LABELS = frozenset("com net org edu gov co vn test example".split())
_ADDRESS_KEEP = frozenset(
    "số so nhà nha căn can hộ ho toà toa tòa block thôn thon xóm xom ấp ngõ ngo ngách ngach hẻm hem kiệt đường duong phố pho phường phuong p xã xa quận quan q huyện huyen h thị thi trấn tran tx thành thanh tp tỉnh tinh khu chung cư cu làng lang phòng phong "
    "ward district city flat apartment apt unit lane avenue court road street drive close square way terrace alley boulevard row quay".split()
)


def one_to_one(pairs: dict[str, str]) -> dict[str, str]:
    """The map itself; ValueError if two words share a surrogate or a word stands for itself."""
    if len(set(pairs.values())) < len(pairs) or any(a == b for a, b in pairs.items()):
        raise ValueError("surrogates of words must differ")
    return pairs


class Surrogates:
    """Keyed replacements. One object serves any number of documents."""

    def __init__(self, key: bytes):
        self.key = key[:64]
        given = {name: {fold(w) for w in words} for name, words in (("female", FEMALE), ("male", MALE), ("either", EITHER))}
        # Letters that stand for names of several genders without accents are of either, but for these two.
        shared = {f for f in set().union(*given.values()) if sum(f in g for g in given.values()) > 1}
        given = {"female": given["female"] - shared | {"thi"}, "male": given["male"] - shared | {"van"}, "either": (given["either"] | shared) - {"thi", "van"}}
        all_given, family = set().union(*given.values()), {fold(w) for w in SURNAMES}
        self.accented: dict[str, dict[str, str]] = {}
        self.bare: dict[str, dict[str, str]] = {}
        first = {"family": family, "en_female": set(EN_FEMALE) - family, "en_male": set(EN_MALE) - family}
        later = {**given, "kin": family - all_given, "en_family": set(EN_SURNAMES) - family - all_given}
        self.listed = family | all_given | set(EN_FEMALE) | set(EN_MALE) | set(EN_SURNAMES)
        for place, classes in (("first", first), ("later", later)):
            self.accented[place], self.bare[place] = {}, {}
            for name, folds in classes.items():
                bare, accented = self._cycle(place + name, folds, (*SURNAMES, *FEMALE, *MALE, *EITHER))
                self.bare[place] |= bare
                self.accented[place] |= accented
            one_to_one(self.bare[place])
            one_to_one(self.accented[place])
        self.memo: dict[tuple[str, bool], str] = {}

    def _cycle(self, name: str, folds: set[str], words: tuple[str, ...]) -> tuple[dict[str, str], dict[str, str]]:
        """A cycle over the folds, and the map of their accented forms that follows it."""
        order = sorted(folds)
        random.Random(self._digest(name)).shuffle(order)
        bare = dict(zip(order, order[1:] + order[:1]))
        forms: dict[str, list[str]] = {f: [] for f in order}
        for w in dict.fromkeys(words):
            if fold(w) in forms:
                forms[fold(w)].append(w)
        accented = {}
        for f, target in bare.items():
            # A target with fewer accented forms is given others of its letters.
            more = (target[:i] + c + target[i + 1 :] for i, b in enumerate(target) for c in _VIETNAMESE.get(b, ""))
            free = (w for w in more if w not in forms[target])
            listed = iter(forms[target])
            for w in forms[f]:
                accented[w] = next(listed, None) or next(free)
        return bare, accented

    def _digest(self, text: str) -> int:
        return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), key=self.key, digest_size=16).digest(), "big")

    def _permuted(self, value: int, base: int, n: int, salt: str) -> int:
        """A keyed permutation of the numbers of n digits: a Feistel network on two halves."""
        if n < 2:
            return (value + 1 + self._digest(salt) % (base - 1)) % base if n else 0
        low, high = base ** (n // 2), base ** (n - n // 2)
        right, left = value % low, value // low
        for i in range(6):
            if i % 2:
                right = (right + self._digest(f"{salt}{i} {n} {left}")) % low
            else:
                left = (left + self._digest(f"{salt}{i} {n} {right}")) % high
        return left * low + right

    def digits(self, text: str, salt: str) -> str:
        """A keyed one-to-one map of digit strings of a length; a leading zero stays one, and
        no other comes to be one."""
        if len(text) == 1:
            return text if text == "0" else str((int(text) - 1 + 1 + self._digest(salt) % 8) % 9 + 1)
        new = text
        while True:
            new = str(self._permuted(int(new), 10, len(text), salt)).zfill(len(text))
            if (new[0] == "0") == (text[0] == "0"):
                return new

    def _poured(self, text: str, digits: str) -> str:
        """Digits in the places of a text's digits (letters O stand for 0)."""
        source = iter(digits)
        return "".join(next(source) if c.isdigit() or c in "oO" else c for c in text)

    def _spell(self, value: int, at_least: int = 2) -> str:
        out = []
        while value or len(out) < at_least:
            value, s = divmod(value, _SYLLABLES)
            out.append(_CONSONANTS[s // len(_VOWELS)] + _VOWELS[s % len(_VOWELS)])
        return "".join(out)

    def syllables(self, word: str) -> str:
        """A pronounceable word for any word in small letters, different for different words.

        Its letters come from the word's letters alone, its accents from the word's accents;
        accents that don't fit follow as syllables with x, which no other part has. Words of
        other scripts are mapped by their bytes and begin with xy."""
        letters, accents, radix = [], 0, 1
        for c in word:
            base, form = _ACCENT.get(c, (c, 0))
            if not "a" <= base <= "z":
                raw = word.encode("utf-8", "surrogatepass")
                return "xy" + self._spell(self._permuted(int.from_bytes(raw, "big"), 256, len(raw), "bytes") + sum(256**k for k in range(len(raw))))
            letters.append(base)
            accents += form * radix
            radix *= len(_VIETNAMESE.get(base, "")) + 1
        if len(letters) == 1 and not accents:
            return chr(97 + self._permuted(ord(letters[0]) - 97, 26, 1, "letter"))
        value = 0
        for c in letters:
            value = value * 26 + ord(c) - 97
        # Numbers of n letters follow those of fewer; the greatest one of n letters sets the syllables.
        before = sum(26**k for k in range(len(letters)))
        size = 2
        while _SYLLABLES**size < before + 26 ** len(letters):
            size += 1
        new = self._spell(self._permuted(value, 26, len(letters), "letters") + before, size)
        if new in self.listed or new in _ADDRESS_KEEP:
            new += "xi"
        out = ""
        for c in new:
            forms = _VIETNAMESE[c] if c in _VOWELS else ""
            accents, form = divmod(accents, len(forms) + 1)
            out += forms[form - 1] if form else c
        while accents:
            accents, rest = divmod(accents, 4)
            out += "x" + "aeou"[rest]
        return out

    def word(self, word: str, place: str, plain: bool) -> str:
        """The surrogate of a word in the form it has (small letters, composed); ``plain`` for a
        word of a text part that has no accents at all."""
        slot = (word, place, plain)
        new = self.memo.get(slot)
        if new is None:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            new = (self.bare if plain else self.accented)[place].get(word) if place else None
            # A listed word in letters without accents beside accented words, and English names.
            if new is None and place and word.isascii():
                new = self.bare[place].get(word) if word not in self.accented[place] else None
            self.memo[slot] = new = new or self.syllables(word)
        return new

    @staticmethod
    def _cased(like: str, word: str) -> str:
        if like.isupper() and len(like) > 1:
            return word.upper()
        return word.capitalize() if like[:1].isupper() else word.lower()

    def name(self, text: str) -> str:
        """Word for word: family name to family name, given names within their gender's list."""
        plain, i = text.isascii(), 0
        out = []
        for part in re.split(r"([\W\d_]+)", text):
            if i % 2 == 0 and part and not (i and part in _PARTICLES):
                place = "first" if i == 0 else "later"
                out.append(self._cased(part, self.word(part.lower(), place, plain)))
            else:
                out.append(part)
            i += 1
        return "".join(out)

    def email(self, text: str) -> str:
        """Words and numbers of the local part and the domain, without the labels at its end."""
        m = EMAIL.fullmatch(text)
        at = m.start("domain") if m else len(text)
        last = [(x.start(), x.group().lower()) for x in re.finditer(r"[A-Za-z]+", text[at:])]
        keep = {at + last[-1][0]} if last else set()
        labels = [x for x in last[:-1] if x[1] not in ("dot", "cham")]
        if len(labels) > 1 and labels[-1][1] in _TOP_LABELS:
            keep.add(at + labels[-1][0])
        between = range(m.end(1), at) if m else range(0)

        def one(x: re.Match) -> str:
            w = x.group()
            if x.start() in keep or x.start() in between or (x.start() >= at and w.lower() in ("dot", "cham", "chấm") and text[x.start() - 1 : x.start()] in (" ", "[", "(", "{")):
                return w
            return self.digits(w, "email") if w.isdigit() else self._cased(w, self.syllables(w.lower()))

        return re.sub(r"[0-9]+|[^\W\d_]+", one, text)

    def address(self, text: str) -> str:
        """House numbers, and every word that isn't part of an address's frame."""
        plain = text.isascii()

        def one(x: re.Match) -> str:
            w = x.group()
            if w.lower() in _ADDRESS_KEEP:
                return w
            return self.digits(w, "address") if w.isdecimal() and w.isascii() else self._cased(w, self.word(w.lower(), "later", plain))

        return re.sub(r"[0-9]+|[^\W_0-9]+", one, text)

    def number(self, kind: str, text: str) -> str:
        """Another number of the same length in the same format; the prefix of a phone and the first digit stay."""
        letter = text[0] if text[0].isalpha() and text[0] not in "oO" else ""
        digits = re.sub(r"\D", "", re.sub("[oO]", "0", text[len(letter) :]))
        head = 0
        if kind == "phone":
            head = 4 if digits.startswith("0084") else 2 if text.lstrip("(").startswith("+84") else 1
        new = digits[: head + 1] + self.digits(digits[head + 1 :], kind)
        shifted = chr(65 + self._permuted(ord(letter.upper()) - 65, 26, 1, "passport")) if letter else ""
        return shifted + self._poured(text[len(letter) :], new)

    def of(self, kind: str, text: str) -> str:
        """The surrogate of a composed text without invisible characters."""
        if kind in ("phone", "id_number"):
            return self.number(kind, text)
        return {"email": self.email, "address": self.address, "name": self.name}[kind](text)


def canonical(kind: str, text: str) -> str:
    """What makes two findings of a kind the same entity: the digits of a number without its
    prefix, a mail address without disguise, names and addresses in small letters."""
    text = view(unicodedata.normalize("NFC", text))[0].lower()
    if kind in ("phone", "id_number"):
        letter = text[0] if text[0].isalpha() and text[0] != "o" else ""
        digits = re.sub(r"\D", "", text[len(letter) :].replace("o", "0"))
        if kind == "phone":
            digits = digits[4:] if digits.startswith("0084") else digits[2:] if text.lstrip("(").startswith("+84") else digits[1:]
        return letter + digits
    if kind == "email":
        text = re.sub(rf"{_AT_SURE}|{_AT_WORD}", "@", text, count=1)
        local, _, domain = text.partition("@")
        return local + "@" + re.sub(_DOT, ".", domain)
    return " ".join(text.split())


def assigned(text: str | None, surrogates: Surrogates) -> list[tuple[Found, str, str, str]]:
    """Every finding of a text with its surrogate, its entity and the surrogate's entity.

    A name without accents is the one accented name of the document that has its letters,
    if there is only one. The entities are checked: should two of a document share a
    surrogate, or one have two, a ValueError is raised rather than two persons made one."""
    found = find(text)
    known = [unicodedata.normalize("NFC", view(f.text)[0]) for f in found]
    accented: dict[str, set[str]] = {}
    for f, k in zip(found, known):
        if f.kind == "name" and not k.isascii():
            accented.setdefault(fold(k), set()).add(canonical("name", k))
    out = []
    of: dict[tuple[str, str], str] = {}
    back: dict[tuple[str, str], str] = {}
    for f, k in zip(found, known):
        fits = accented.get(fold(k), ()) if f.kind == "name" and k.isascii() else ()
        if len(fits) == 1:
            who = next(iter(fits))
            new = surrogates.of("name", " ".join(map(surrogates._cased, k.split(), who.split())))
            entity, new = canonical("name", new), "".join(fold(c) if c.islower() else fold(c).upper() for c in new)
        else:
            who, new = canonical(f.kind, k), surrogates.of(f.kind, k)
            entity = canonical(f.kind, new)
        if of.setdefault((f.kind, who), entity) != entity or (back.setdefault((f.kind, entity), who) != who and fold(back[f.kind, entity]) != fold(who)):
            raise ValueError(f"surrogates of a {f.kind} collide")
        out.append((f, new, who, entity))
    return out


def surrogate_text(text: str | None, surrogates: Surrogates) -> str | None:
    """The text with every finding replaced; null for null."""
    if not text:
        return text
    out, last = [], 0
    for f, new, _, _ in assigned(text, surrogates):
        out += [text[last : f.start], new]
        last = f.end
    return "".join([*out, text[last:]])


def _secret(key: str) -> bytes:
    return hashlib.blake2b(key.encode()).digest()


def personal_pairs(df: DataFrame, key: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kind, value, surrogate, entity, surrogate_entity): the distinct findings of every
    text, as written, with what replaces them under ``key``; entities are normalised forms.

    Null and empty texts have none; a row given twice gives its findings twice."""
    kind = dict(df.dtypes)[id]
    secret = _secret(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        surrogates = Surrogates(secret)
        for b in batches:
            rows = []
            for i, t in zip(b.iloc[:, 0], b.iloc[:, 1]):
                rows += [(i, *r) for r in dict.fromkeys((f.kind, f.text, new, who, entity) for f, new, who, entity in assigned(t, surrogates))]
            columns = list(zip(*rows)) or [()] * 6
            yield pd.DataFrame({id: pd.Series(columns[0], dtype=b.iloc[:, 0].dtype), "kind": columns[1], "value": columns[2], "surrogate": columns[3], "entity": columns[4], "surrogate_entity": columns[5]})

    some = df.select(id, text).where(F.col(text).isNotNull() & (F.col(text) != ""))
    return spread(some).mapInPandas(run, f"`{id}` {kind}, kind string, value string, surrogate string, entity string, surrogate_entity string")


def find_personal(df: DataFrame, key: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kind, value): the distinct findings of every text that got a surrogate; see :func:`personal_pairs`."""
    return personal_pairs(df, key, id=id, text=text).select(id, "kind", "value")


def distinctness(pairs: DataFrame) -> DataFrame:
    """(kind, entities, split, merged) over all documents: how many entities there are, how many
    of them got several surrogates, and how many surrogates stand for several entities.

    Names without accents count apart, as their letters may stand for several names."""
    bare = F.when((F.col("kind") == "name") & ~F.rlike("entity", F.lit(r"[^\x00-\x7f]")), F.lit("bare name")).otherwise(F.col("kind"))
    one = pairs.select(bare.alias("kind"), "entity", "surrogate_entity").distinct()
    split = one.groupBy("kind", "entity").agg(F.count("*").alias("n")).groupBy("kind").agg(F.count("*").alias("entities"), F.count_if(F.col("n") > 1).alias("split"))
    merged = one.groupBy("kind", "surrogate_entity").agg(F.count("*").alias("n")).groupBy("kind").agg(F.count_if(F.col("n") > 1).alias("merged"))
    return split.join(merged, "kind")


def replace_personal(df: DataFrame, key: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text) of every row, personal information replaced by surrogates drawn with ``key``."""
    kind = dict(df.dtypes)[id]
    secret = _secret(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        surrogates = Surrogates(secret)
        for b in batches:
            yield pd.DataFrame({id: b.iloc[:, 0], text: [surrogate_text(t, surrogates) for t in b.iloc[:, 1]]})

    return spread(df.select(id, text)).mapInPandas(run, f"`{id}` {kind}, `{text}` string")
