"""Quantities written in different units, brought to one unit per quantity.

Two steps. ``stated`` reads every text into raw numbers with the unit written beside
them, if any. ``common_units`` takes the raw numbers of each source in order of time, as
they are written, splits that history by an exact penalised changepoint search on their
logarithms, and marks a shift between two segments as a change of unit where it is the
factor between known units; such segments are turned back. Written units are evidence:
they start the walk over the segments, and confirm or override what the levels say.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeweave.functions.plain import fold_text
from lodeweave.operators.store import number_rows
from lodeweave.session import cut, small, spread

# The quantities, the common unit of each, and the factor of every unit to it.
_METRES = {"mm": 1.0, "ly": 1.0, "li": 1.0, "milimet": 1.0, "mi-li-met": 1.0, "mi li met": 1.0, "millimet": 1.0, "millimeter": 1.0, "cm": 10.0, "phan": 10.0, "xentimet": 10.0, "xang-ti-met": 10.0, "xang ti met": 10.0, "xen-ti-met": 10.0, "centimet": 10.0, "dm": 100.0, "tac": 100.0, "m": 1000.0, "met": 1000.0, "in": 25.4, "inch": 25.4, "inches": 25.4, '"': 25.4, "''": 25.4, "”": 25.4, "″": 25.4, "ft": 304.8, "feet": 304.8}
UNITS = {
    "power": {"w": 1.0, "watt": 1.0, "watts": 1.0, "oat": 1.0, "kw": 1000.0, "kilowatt": 1000.0, "kilowatts": 1000.0, "kilo oat": 1000.0, "mw": 0.001, "miliwatt": 0.001, "milliwatt": 0.001},
    "luminous_flux": {"lm": 1.0, "lumen": 1.0, "lumens": 1.0, "klm": 1000.0, "kilolumen": 1000.0, "kilolumens": 1000.0},
    "length": _METRES,
    "width": _METRES,
    "height": _METRES,
    "diameter": _METRES,
    "weight": {"g": 1.0, "gr": 1.0, "gam": 1.0, "gram": 1.0, "grams": 1.0, "kg": 1000.0, "ky": 1000.0, "ki": 1000.0, "can": 1000.0, "kilogram": 1000.0, "kilograms": 1000.0, "kilo": 1000.0, "lang": 100.0, "tan": 1e6, "mg": 0.001},
    "lifetime": {"h": 1.0, "hr": 1.0, "hrs": 1.0, "hour": 1.0, "hours": 1.0, "gio": 1.0, "tieng": 1.0, "k h": 1000.0, "k": 1000.0, "k gio": 1000.0, "k hrs": 1000.0, "k hours": 1000.0, "k tieng": 1000.0, "ngan": 1000.0, "nghin": 1000.0, "ngan gio": 1000.0, "nghin gio": 1000.0, "ngan tieng": 1000.0, "nghin tieng": 1000.0, "kh": 1000.0},
    "warranty": {"thang": 1.0, "th": 1.0, "t": 1.0, "month": 1.0, "months": 1.0, "nam": 12.0, "year": 12.0, "years": 12.0, "yr": 12.0, "yrs": 12.0},
    "current": {"ma": 1.0, "miliampe": 1.0, "mili ampe": 1.0, "milliampe": 1.0, "a": 1000.0, "ampe": 1000.0, "amp": 1000.0},
}
QUANTITIES = tuple(UNITS)
_PLACE = {q: i for i, q in enumerate(QUANTITIES)}
# Names a line gives each quantity, folded to lower case without accents.
LABELS = {
    "power": ("cong suat", "cong suat danh dinh", "cong suat tieu thu", "cong suat den", "power", "p", "cs", "wattage"),
    "luminous_flux": ("quang thong", "quang thong den", "do sang", "luminous flux", "lumen", "flux"),
    "lifetime": ("tuoi tho", "tuoi tho led", "tuoi tho chip led", "tuoi tho den", "lifetime", "life time", "lifespan"),
    "warranty": ("bao hanh", "thoi gian bao hanh", "thoi han bao hanh", "bh", "warranty"),
    "weight": ("trong luong", "khoi luong", "can nang", "weight", "net weight"),
    "current": ("dong dien", "dong dinh muc", "dong dien dinh muc", "current", "rated current"),
    "length": ("dai", "chieu dai", "length"),
    "width": ("rong", "chieu rong", "width"),
    "height": ("cao", "chieu cao", "height"),
    "diameter": ("duong kinh", "phi", "diameter", "o"),
}
SIZE_LABELS = ("kich thuoc", "kt", "size", "dimension", "dimensions", "kich thuoc den", "kich thuoc san pham")
#: Units in which three digits after one separator are decimals rather than thousands.
_LARGE = {"kw", "kilowatt", "kilowatts", "kg", "ky", "ki", "kilogram", "kilo", "m", "met", "a", "ampe", "amp", "klm", "kilolumen", "kilolumens", "in", "inch", '"', "''", "k", "ngan", "nghin", "k h", "k gio", "nam", "year", "years", "tan", "ft"}

_LABEL_OF = {name: q for q, names in LABELS.items() for name in names}
_NUM = r"\d+(?:[.,]\d+)*"
_WORD = r"[a-z]+(?:[- ][a-z]+)*|\"|''|”|″"
_VALUE = re.compile(rf"^[^\w]*(?:khoang|~|>=|≥|>|<|≤)?\s*({_NUM})\s*({_WORD})?\s*\.?$")
_LINE = re.compile(rf"^([^\d:\t]*?)\s*(?:\(([^)]*)\))?\s*(?:[:\t]\s*|\s+(?=\d))(.*)$")
_TIMES = re.compile(r"\s*[x×*]\s*")
_PART = re.compile(rf"^(ø|phi|h|d|r|c|w|l)?\s*({_NUM})\s*({_WORD})?$")
_ROUND = re.compile(rf"^phi\s*({_NUM})\s*({_WORD})?\s*[,;]\s*cao\s*({_NUM})\s*({_WORD})?$")
_PHI = re.compile(rf"^ø\s*({_NUM})\s*({_WORD})?$")
_TAG = re.compile(r"<br ?/?>|</?li>")
_METRE_AND = re.compile(r"^(\d+)\s*m\s*(\d{1,2})$")


def fold(text: str) -> str:
    """Lower case without accents; Ø stays as ø."""
    return fold_text(text).replace("\xa0", " ")


def number(raw: str, unit: str | None) -> float:
    """A number in the Vietnamese or the English manner."""
    dots, commas = raw.count("."), raw.count(",")
    if dots and commas:
        last = max(raw.rfind("."), raw.rfind(","))
        if min(dots, commas) > 1 or raw.count(raw[last]) > 1:
            return float(re.sub("[.,]", "", raw))
        return float(re.sub("[.,]", "", raw[:last]) + "." + raw[last + 1 :])
    if dots + commas > 1:
        return float(re.sub("[.,]", "", raw))
    if dots + commas == 1:
        whole, part = re.split("[.,]", raw)
        if len(part) == 3 and whole.lstrip("0") and unit not in _LARGE:
            return float(whole + part)
        return float(f"{whole}.{part}")
    return float(raw)


def _scale(quantity: str, unit: str | None, raw_unit: str | None) -> float | None:
    """The unit's factor; None for no unit; ValueError for a unit of something else."""
    if not unit:
        return None
    factor = UNITS[quantity].get(unit)
    if factor is None:
        raise ValueError(unit)
    if quantity == "power" and unit == "mw" and raw_unit and raw_unit.strip().startswith("MW"):
        return 1e6
    return factor


def _one(quantity: str, folded: str, header_unit: str | None) -> list[tuple[str, float, float]]:
    if "m" in UNITS[quantity] and (m := _METRE_AND.match(folded)):
        return [(quantity, float(f"{m.group(1)}.{m.group(2)}"), 1000.0)]
    m = _VALUE.match(folded)
    if not m:
        return []
    unit = m.group(2) or header_unit
    try:
        factor = _scale(quantity, unit, None)
    except ValueError:
        return []
    return [(quantity, number(m.group(1), unit), factor or 0.0)]


def _size(folded: str, header_unit: str | None) -> list[tuple[str, float, float]]:
    """length x width x height, or diameter x height."""
    parts = [_PART.match(p.strip()) for p in _TIMES.split(folded)]
    if not all(parts) or len(parts) not in (2, 3):
        return []
    last = next((p.group(3) for p in reversed(parts) if p.group(3)), None) or header_unit
    is_round = len(parts) == 2
    if is_round and parts[0].group(1) not in ("ø", "phi", "d"):
        return []
    out = []
    for p, q in zip(parts, ("diameter", "height") if is_round else ("length", "width", "height")):
        unit = p.group(3) or last
        try:
            factor = _scale(q, unit, None)
        except ValueError:
            return []
        out.append((q, number(p.group(2), unit), factor or 0.0))
    return out


def read_line(line: str) -> list[tuple[str, float, float]]:
    """(quantity, raw number, factor of its unit or 0 if none is written) of a specification line."""
    folded = fold(line).strip()
    m = _ROUND.match(folded)
    if m:
        try:
            return [("diameter", number(m.group(1), m.group(2)), _scale("diameter", m.group(2) or m.group(4), None) or 0.0), ("height", number(m.group(3), m.group(4)), _scale("height", m.group(4), None) or 0.0)]
        except ValueError:
            return []
    head = folded.split("(")[0].split(":")[0].split("\t")[0].strip()
    for name in SIZE_LABELS:
        if head == name or head.startswith(name + " ") and head[len(name) + 1 : len(name) + 2] in "0123456789ø":
            rest = folded[len(name) :].strip()
            unit = None
            while rest.startswith("("):
                inner, _, rest = rest[1:].partition(")")
                unit = inner.strip() if inner.strip() in _METRES else unit
                rest = rest.strip()
            return _size(rest.lstrip(": \t"), unit)
    m = _LINE.match(folded)
    if not m:
        return []
    quantity = _LABEL_OF.get(m.group(1).strip())
    if quantity is None:
        return []
    header = (m.group(2) or "").strip() or None
    if header is not None and header not in UNITS[quantity]:
        return []
    found = _one(quantity, m.group(3).strip(), header)
    if found and quantity == "power" and "MW" in line:
        found = [(q, v, 1e6 if f == 0.001 else f) for q, v, f in found]
    return found


def read_short(part: str) -> list[tuple[str, float, float]]:
    """The same of a part of a summary, where the unit may stand for the name."""
    found = read_line(part)
    if found:
        return found
    folded = fold(part).strip()
    m = _PHI.match(folded)
    if m:
        return _one("diameter", folded.lstrip("ø ").strip(), None)
    m = _VALUE.match(folded)
    if m and m.group(2):
        for quantity in ("power", "luminous_flux", "lifetime"):
            if m.group(2) in UNITS[quantity]:
                return _one(quantity, folded, None)
    return []


def parts(text: str, short: bool) -> list[str]:
    """The lines of a specification, or the parts of a summary."""
    if "<" in text:
        text = _TAG.sub("\n", text)
    text = text.replace("\r", "\n").replace(" ; ", "\n").replace(" • ", "\n").replace(" | ", "\n")
    if short:
        text = text.replace("; ", "\n").replace(", ", "\n").replace(" / ", "\n")
    return text.split("\n")


#: Lines that are remembered before the memory of lines starts anew.
MEMO_LINES = 100_000


def read_text(text: str, short: bool, memo: dict, out: dict[str, tuple[float, float]]) -> None:
    """Add the first statement of each quantity in a text to ``out``; lines are remembered in ``memo``."""
    for line in parts(text, short):
        found = memo.get(line)
        if found is None:
            if len(memo) > MEMO_LINES:
                memo.clear()
            found = memo[line] = (read_short(line) if short else read_line(line)) if line else []
        for q, v, f in found:
            if q not in out or (f and not out[q][1]):
                out[q] = (v, f)


ITEMS = "items array<struct<quantity:int,number:double,factor:double>>"


def stated(df: DataFrame, *, id: str = "id", source: str = "url", keep: tuple[str, ...] = (), texts: tuple[str, ...] = ("thong_so_ky_thuat",), summaries: tuple[str, ...] = ("tom_tat_tskt",)) -> DataFrame:
    """(id, source, *keep, items) of every row whose texts state a quantity.

    An item is (quantity, number, factor): a place in QUANTITIES, the number as written and
    the written unit's factor, 0 where no unit is written. The texts come before the
    summaries; the first statement counts, one with a unit before one without. source is a
    64-bit hash of the source column; a row without source has a history of its own. Rows
    with a null id and null or empty texts give nothing."""
    columns = [*texts, *summaries]
    kinds = dict(df.dtypes)
    item = pa.struct([("quantity", pa.int32()), ("number", pa.float64()), ("factor", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: tuple[dict, dict] = ({}, {})
        for batch in batches:
            at, offsets, quantities, numbers, factors = [], [0], [], [], []
            for row, said in enumerate(zip(*(batch.column(f"t{i}").to_pylist() for i in range(len(columns))))):
                got: dict[str, tuple[float, float]] = {}
                for i, text in enumerate(said):
                    if text:
                        read_text(text, i >= len(texts), memos[i >= len(texts)], got)
                if not got:
                    continue
                at.append(row)
                for q, (v, f) in got.items():
                    quantities.append(_PLACE[q])
                    numbers.append(v)
                    factors.append(f)
                offsets.append(len(quantities))
            flat = pa.StructArray.from_arrays([pa.array(quantities, pa.int32()), pa.array(numbers, pa.float64()), pa.array(factors, pa.float64())], fields=list(item))
            others = batch.select(["id", "source", *keep]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*others.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["id", "source", *keep, "items"])

    some = F.lit(False)
    for c in columns:
        some = some | (F.col(c) != "")
    own = F.coalesce(F.when(F.col(source).isNotNull(), F.xxhash64(F.col(source))), F.xxhash64(F.lit("no source"), F.col(id)))
    rows = df.where(F.col(id).isNotNull() & some).select(F.col(id).cast("long").alias("id"), own.alias("source"), *keep, *[F.col(c).alias(f"t{i}") for i, c in enumerate(columns)])
    return spread(rows).mapInArrow(run, ", ".join(["id long", "source long", *(f"`{c}` {kinds[c]}" for c in keep), ITEMS]))


#: Values up to which the search runs on plain lists, which cost less than arrays there.
SHORT = 64


def changepoints(values: np.ndarray | list[float], penalty: float) -> list[int]:
    """Starts of the segments that minimise squared error about segment means plus
    ``penalty`` per segment: exact search with pruning of starts that can't win again."""
    n = len(values)
    if n == 0:
        return []
    if n > SHORT:
        before = _search(np.asarray(values, dtype=float), penalty)
    else:
        s1, s2 = [0.0], [0.0]
        for v in values:
            s1.append(s1[-1] + v)
            s2.append(s2[-1] + v * v)
        best, before, alive = [-penalty], [0], [0]
        for end in range(1, n + 1):
            costs = []
            for a in alive:
                total = s1[end] - s1[a]
                costs.append(best[a] + max(s2[end] - s2[a] - total * total / (end - a), 0.0))
            least = min(costs)
            best.append(least + penalty)
            before.append(alive[costs.index(least)])
            alive = [a for a, c in zip(alive, costs) if c < best[end]]
            alive.append(end)
    starts, end = [], n
    while end > 0:
        starts.append(int(before[end]))
        end = int(before[end])
    return starts[::-1]


def _search(values: np.ndarray, penalty: float) -> np.ndarray:
    """For each end the best start of its last segment."""
    n = len(values)
    s1 = np.concatenate([[0.0], np.cumsum(values)])
    s2 = np.concatenate([[0.0], np.cumsum(values * values)])
    best = np.empty(n + 1)
    best[0] = -penalty
    before = np.zeros(n + 1, dtype=np.int64)
    alive = np.array([0])
    for end in range(1, n + 1):
        total = s1[end] - s1[alive]
        cost = best[alive] + np.maximum(s2[end] - s2[alive] - total * total / (end - alive), 0.0)
        k = int(np.argmin(cost))
        best[end] = cost[k] + penalty
        before[end] = alive[k]
        alive = np.append(alive[cost < best[end]], end)
    return before


#: Longest piece of a history that is searched at once. Longer histories are searched in
#: consecutive pieces counted from their start, each exactly; the last written unit before a
#: piece, or else the first one behind it, is carried into it.
PIECE = 2048
#: Penalty per segment and the largest distance of two equal levels, on natural logs.
PENALTY = 0.05
SAME_LEVEL = 0.02

#: How a number's unit was settled. written: as written, and the level doesn't say otherwise;
#: shift: none is written, the level's shift is the factor of this unit; overridden: written,
#: while the level's shift is the factor of another unit; kept: none is written and the shift
#: is no known factor, so a real change in the unit of the segment before; assumed: nothing is
#: known of the history's unit, so the common one.
HOW = ("written", "shift", "overridden", "kept", "assumed")
_WRITTEN, _SHIFT, _OVERRIDDEN, _KEPT, _ASSUMED = range(5)
_FACTORS = {q: sorted(set(units.values())) for q, units in UNITS.items()}

Level = tuple[float, float]  # log level in the common unit, factor of the unit it is written in


def _by_level(gaps: tuple[float, float], factors: list[float]) -> float | None:
    """The known factor that explains one of the shifts, None if none does."""
    off, f = min((abs(math.log(f) - gap), f) for f in factors for gap in gaps)
    return f if off <= SAME_LEVEL else None


def resolve(numbers: list[float], factors: list[float], quantity: str, before: Level | None = None, after: Level | None = None) -> tuple[list[float], list[int]]:
    """Values in the common unit and how each one's unit was settled (places in HOW), of one
    history in order. Factors are those of the written units, 0 where none is written.

    The raw numbers are searched, written units or not. The walk over the segments starts
    at ``before``, a level known from before these numbers, else at the first segment with
    a written unit, else at ``after``, else at the longest segment, which is then taken to
    be in the common unit; from there every segment is compared with its neighbour."""
    values = [v * (f or 1.0) for v, f in zip(numbers, factors)]
    how = [_WRITTEN if f else _ASSUMED for f in factors]
    places = [i for i, v in enumerate(numbers) if v > 0]
    if not places:
        return values, how
    logs = [math.log(numbers[i]) for i in places]
    starts = changepoints(logs, PENALTY)
    ends = [*starts[1:], len(places)]
    raw, written = [], []
    for a, b in zip(starts, ends):
        ordered = sorted(logs[a:b])
        raw.append((ordered[(b - a - 1) // 2] + ordered[(b - a) // 2]) / 2)
        units = [factors[i] for i in places[a:b] if factors[i]]
        written.append(max(dict.fromkeys(units), key=units.count) if units else None)
    n = len(starts)
    unit: list[float] = [1.0] * n
    said: list[int] = [_ASSUMED] * n

    def mark(i: int, near: Level, edge: float | None, rightward: bool) -> tuple[Level, float]:
        # The shift between the two numbers at the border counts as that between the medians:
        # a segment may hold small real changes.
        mine = logs[starts[i]] if rightward else logs[ends[i] - 1]
        by_level = _by_level((near[0] - raw[i], (near[0] if edge is None else edge) - mine), _FACTORS[quantity])
        if written[i] is None:
            unit[i], said[i] = (by_level, _SHIFT) if by_level else (near[1], _KEPT)
        else:
            unit[i], said[i] = written[i], _OVERRIDDEN if by_level and by_level != written[i] else _WRITTEN
        return settled(i, rightward)

    def settled(i: int, rightward: bool) -> tuple[Level, float]:
        turned = math.log(unit[i])
        return (raw[i] + turned, unit[i]), (logs[ends[i] - 1] if rightward else logs[starts[i]]) + turned

    first = next((i for i in range(n) if written[i]), None)
    at = None
    if before is not None:
        level, right, left = before, range(n), ()
    elif first is not None or after is None:
        at = first if first is not None else max(range(n), key=lambda i: (ends[i] - starts[i], -i))
        unit[at], said[at] = written[at] or 1.0, _WRITTEN if written[at] else _ASSUMED
        level, right, left = None, range(at + 1, n), range(at - 1, -1, -1)
    else:
        level, right, left = after, (), range(n - 1, -1, -1)
    for walk, rightward in ((right, True), (left, False)):
        near = (level, None) if at is None else settled(at, rightward)
        for i in walk:
            near = mark(i, *near, rightward)
    for k, (a, b) in enumerate(zip(starts, ends)):
        for i in places[a:b]:
            if not factors[i]:
                # Beside a written unit on the same level a bare number follows that level.
                values[i], how[i] = numbers[i] * unit[k], _SHIFT if written[k] else said[k]
            else:
                how[i] = said[k] if factors[i] == unit[k] else _OVERRIDDEN
    return values, how


_HISTORY = ["source", "quantity"]
_ORDER = ["at", "id", "number", "factor"]
_LEVELS = "before struct<level:double,factor:double>, after struct<level:double,factor:double>"


def _in_pieces(flat: DataFrame) -> DataFrame:
    """Every number with its piece and the levels known before and behind that piece.

    Only histories of more than PIECE numbers have more than one piece; their numbers are
    counted over sorted ranges, so a history of any length lies in many tasks."""
    none = [F.lit(None).cast("struct<level:double,factor:double>").alias(c) for c in ("before", "after")]
    long = cut(flat.groupBy(*_HISTORY).agg(F.count("*").alias("n")).where(F.col("n") > PIECE).select(*_HISTORY))
    if long.isEmpty():
        return flat.select("*", F.lit(0).cast("long").alias("piece"), *none)
    keys = small(long)
    short = flat.join(keys, _HISTORY, "left_anti").select("*", F.lit(0).cast("long").alias("piece"), *none)
    numbered = cut(number_rows(flat.join(keys, _HISTORY, "left_semi"), -1, [*_HISTORY, *_ORDER], "_n"))
    starts = numbered.groupBy(*_HISTORY).agg(F.min("_n").alias("_start"))
    placed = numbered.join(small(starts), _HISTORY).withColumn("piece", F.floor((F.col("_n") - F.col("_start")) / PIECE)).drop("_start")
    level = F.when((F.col("factor") > 0) & (F.col("number") > 0), F.struct(F.log(F.col("number") * F.col("factor")).alias("level"), "factor"))
    known = placed.groupBy(*_HISTORY, "piece").agg(F.max_by(level, F.when(level.isNotNull(), F.col("_n"))).alias("_last"), F.min_by(level, F.when(level.isNotNull(), F.col("_n"))).alias("_first"))
    up = Window.partitionBy(*_HISTORY).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*_HISTORY).orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    levels = known.select(*_HISTORY, "piece", F.last("_last", ignorenulls=True).over(up).alias("before"), F.last("_first", ignorenulls=True).over(down).alias("after"))
    return short.unionByName(placed.drop("_n").join(levels, [*_HISTORY, "piece"]))


def common_units(rows: DataFrame, time: Column | None = None) -> DataFrame:
    """(id, quantity, value, how): the output of :func:`stated` in the common unit of each
    quantity; how is a place in HOW.

    A history is a source's numbers of one quantity in order of ``time``, then of id. Every
    history of two or more numbers is searched. The result doesn't depend on partitions or
    batches: a piece is held by one task as a whole, and no task holds more."""
    flat = rows.select("id", "source", (F.lit(0) if time is None else time).alias("at"), F.inline("items"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def done(part: pd.DataFrame) -> pd.DataFrame:
            numbers, factors = part["number"].to_numpy(), part["factor"].to_numpy()
            source, quantity, piece = part["source"].to_numpy(), part["quantity"].to_numpy(), part["piece"].to_numpy()
            values, how = numbers * np.where(factors > 0, factors, 1.0), np.where(factors > 0, _WRITTEN, _ASSUMED)
            edge = np.flatnonzero((source[1:] != source[:-1]) | (quantity[1:] != quantity[:-1]) | (piece[1:] != piece[:-1])) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(part)]])
            levels = part[["before", "after"]].to_numpy()
            # One number alone with a written unit is one segment and has no neighbour.
            for k in np.flatnonzero((ends - starts > 1) | (factors[starts] == 0)):
                a, b = int(starts[k]), int(ends[k])
                known = [None if x is None else (x["level"], x["factor"]) for x in levels[a]]
                values[a:b], how[a:b] = resolve(numbers[a:b].tolist(), factors[a:b].tolist(), QUANTITIES[quantity[a]], *known)
            return pd.DataFrame({"id": part["id"], "quantity": part["quantity"], "value": values, "how": how.astype("int32")})

        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            tail = (rows["source"] == rows["source"].iloc[-1]) & (rows["quantity"] == rows["quantity"].iloc[-1]) & (rows["piece"] == rows["piece"].iloc[-1])
            # The last piece may go on in the next batch.
            whole = len(rows) - int(tail.sum())
            held = rows.iloc[whole:]
            if whole:
                yield done(rows.iloc[:whole])
        if held is not None and len(held):
            yield done(held)

    pieces = _in_pieces(flat).repartition(*_HISTORY, "piece").sortWithinPartitions(*_HISTORY, "piece", *_ORDER)
    return pieces.select("id", *_HISTORY, "piece", "number", "factor", "before", "after").mapInPandas(run, "id long, quantity int, value double, how int")


def normalise_quantities(df: DataFrame, *, id: str = "id", source: str = "url", time: str | None = None, texts: tuple[str, ...] = ("thong_so_ky_thuat",), summaries: tuple[str, ...] = ("tom_tat_tskt",)) -> DataFrame:
    """(id, quantity, thousandths, how) of every quantity of the item itself; see the module's docstring.

    Histories run in order of the column ``time`` (nulls first), then of id; without
    ``time`` in order of id. A row stated twice under one id gives one row per quantity and
    repetition; ids are expected to be unique."""
    said = cut(stated(df, id=id, source=source, keep=(time,) if time else (), texts=texts, summaries=summaries))
    return named(common_units(said, F.col(time) if time else None), id)


def named(values: DataFrame, id: str = "id") -> DataFrame:
    """(id, quantity, thousandths, how) with names for places."""
    name = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(c) + 1)
    return values.select(F.col("id").alias(id), name(QUANTITIES, "quantity").alias("quantity"), F.round(F.col("value") * 1000).cast("bigint").alias("thousandths"), name(HOW, "how").alias("how"))
