"""Items of varying size into containers of fixed capacity, by hierarchical residual packing.

Every partition packs its own items best-fit and emits the nearly full bins. All underfull
bins go on as items: they are brought together in ever fewer partitions, and every merge is
a round of best-fit over the bins that came up. A bin carries its items, at most
``capacity`` of them, so nothing has to be looked up again at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.tokenize import Encoder, vocabulary_path
from lodeweave.session import cut, spread

#: Items packed at once in a partition. Underfull bins of one run take part in the next.
RUN_ITEMS = 100_000
#: A bin with at most this share of its capacity left is emitted.
NEARLY_FULL = 1 / 256
#: Partitions merged into one per round, and underfull bins that a partition of a round may
#: hold: with more, a round has more partitions, and rounds go on while bins are saved.
FAN_IN = 8
BINS_PER_TASK = 20_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Places of the items in bins: largest first, each into the bin that it fills best.

    Bins wait in a list per room left; a bitmap of the rooms gives the least one that is
    large enough in one step. Sizes are between 1 and the capacity."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    bins: list[list[int]] = []
    for i in order:
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        if left:
            waiting[left].append(b)
            rooms |= 1 << left
    return bins


def pieces(size: int, capacity: int) -> list[int]:
    """Sizes of an item's pieces: itself, or full containers and a rest if it exceeds the capacity."""
    full, rest = divmod(size, capacity)
    return [capacity] * full + [rest] * (rest > 0) if size > capacity else [size]


BIN = "container long, fill int, items array<struct<id:long,piece:int,tokens:int>>, done boolean"
Bin = tuple[int, int, list]


def _rows(bins: list[Bin], done: bool) -> Iterator[pd.DataFrame]:
    if bins:
        yield pd.DataFrame(
            {
                "container": pd.Series([b[0] for b in bins], dtype="int64"),
                "fill": pd.Series([b[1] for b in bins], dtype="int32"),
                "items": [[{"id": i, "piece": p, "tokens": t} for i, p, t in b[2]] for b in bins],
                "done": pd.Series([done] * len(bins), dtype=bool),
            }
        )


def _joined(bins: list[Bin], capacity: int) -> tuple[list[Bin], list[Bin]]:
    """Bins put into each other best-fit: the nearly full ones and the others. A joined bin has the
    least number of its parts."""
    full, rest = [], []
    for places in best_fit([b[1] for b in bins], capacity):
        group = [bins[i] for i in places]
        b = (min(g[0] for g in group), sum(g[1] for g in group), [x for g in group for x in g[2]])
        (full if capacity - b[1] <= capacity * NEARLY_FULL else rest).append(b)
    return full, rest


def pack(
    df: DataFrame, *, id: str, size_of: Callable[[], Callable[[pd.Series], list[int]]], column: str, capacity: int, run_items: int = RUN_ITEMS, bins_per_task: int = BINS_PER_TASK
) -> DataFrame:
    """(id, piece, tokens, container) of every row.

    ``size_of()`` is called once per task and gives a function from a batch of ``column``
    to sizes. An item over the capacity is cut into full pieces and a rest, any other is
    piece 0 as a whole. An item of size 0 takes no room; its container is null. Equal ids
    are different items. Containers are numbered without gaps being closed. ``run_items``
    and ``bins_per_task`` bound the memory of a task: all bins of an earlier run or round
    that have room left take part in a later one."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measure = size_of()
        made = TaskContext.get().partitionId() << 36
        waiting: list[Bin] = []
        for b in batches:
            none = []
            for i, n in zip(b["id"], measure(b["value"])):
                if n == 0:
                    none.append([{"id": i, "piece": 0, "tokens": 0}])
                    continue
                for p, t in enumerate(pieces(n, capacity)):
                    waiting.append((made, t, [(i, p, t)]))
                    made += 1
            if none:
                yield pd.DataFrame({"container": pd.Series([-1] * len(none), dtype="int64"), "fill": pd.Series([0] * len(none), dtype="int32"), "items": none, "done": True})
            if len(waiting) >= run_items:
                full, waiting = _joined(waiting, capacity)
                yield from _rows(full, True)
                # Half a run is kept for the next one, the emptiest bins; the others wait for the rounds.
                waiting.sort(key=lambda x: (x[1], x[0]))
                yield from _rows(waiting[run_items // 2 :], False)
                waiting = waiting[: run_items // 2]
        full, rest = _joined(waiting, capacity)
        yield from _rows(full, True)
        yield from _rows(rest, False)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins: list[Bin] = []
        for b in batches:
            bins += [(int(c), int(f), [(x["id"], x["piece"], x["tokens"]) for x in items]) for c, f, items in zip(b["container"], b["fill"], b["items"])]
        full, rest = _joined(sorted(bins, key=lambda x: (-x[1], x[0])), capacity)
        yield from _rows(full, True)
        yield from _rows(rest, False)

    rows = df.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(column).alias("value"))
    packed = cut(spread(rows).mapInPandas(local, BIN))
    parts = packed.rdd.getNumPartitions()
    emitted = [packed.where("done")]
    going = packed.where("not done")
    waiting, turn = going.count(), 0
    while waiting:
        fewer = max(1, -(-parts // FAN_IN))
        parts = max(fewer, -(-waiting // bins_per_task))
        turn += 1
        # Each round mixes the bins anew, so that those of other partitions are met.
        mixed = going.repartition(parts, F.xxhash64("container", F.lit(turn)))
        packed = cut(mixed.select("container", "fill", "items").mapInPandas(merged, BIN))
        emitted.append(packed.where("done"))
        going = packed.where("not done")
        left = going.count()
        # The last round is one that joins all bins, or, where they are too many for a task, saves none.
        if parts == 1 or (left == waiting and parts > fewer):
            break
        waiting = left
    full = emitted[0]
    for e in [*emitted[1:], going]:
        full = full.union(e)
    return full.select("container", F.inline("items")).select(F.col("id").alias(id), "piece", "tokens", F.when(F.col("container") >= 0, F.col("container")).alias("container"))


def pack_texts(df: DataFrame, *, id: str = "doc_id", text: str = "text", capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Texts, sized in tokens of the public vocabulary, in containers; see :func:`pack`. Null and
    empty texts have no tokens."""
    where = vocabulary_path(path)

    def size_of():
        encoder = Encoder(where)
        return lambda texts: [len(encoder.encode(t)) for t in texts]

    return pack(df, id=id, size_of=size_of, column=text, capacity=capacity)
