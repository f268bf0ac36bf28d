"""Filling containers of fixed capacity with texts by bin completion."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from dataclasses import dataclass
from math import inf

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.byte_bpe import VOCABULARY, count_tokens
from arbora.storage import materialize

CAPACITY = 2048
#: Texts that one task packs together; at most one container of a block is left with room to spare for want of texts.
BLOCK_TEXTS = 20_000
Filling = tuple[int, ...]


@dataclass(frozen=True)
class Bounds:
    """Bounds of the search, not of the result: partial fillings looked at per container, fillings kept per container,
    and steps back per block. When they are used up the best packing so far holds. ``None`` is no bound: ``EXACT`` searches to the end."""

    filling_steps: int | None = 96
    fillings_kept: int | None = 4
    steps_back: int | None = 5_000


BOUNDS, EXACT = Bounds(), Bounds(None, None, None)


class _Stock:
    """How many items of each size are left; the set of sizes is one integer, so the largest that fits is found by its bits."""

    def __init__(self, sizes: list[int]) -> None:
        self.count = Counter(sizes)
        self.sizes = sum(1 << s for s in self.count)
        self.total = sum(sizes)

    def take(self, items: Filling) -> None:
        for s in items:
            self.count[s] -= 1
            if not self.count[s]:
                self.sizes ^= 1 << s
        self.total -= sum(items)

    def put_back(self, items: Filling) -> None:
        for s in items:
            if not self.count[s]:
                self.sizes |= 1 << s
            self.count[s] += 1
        self.total += sum(items)


def largest_in(sizes: int, most: int) -> int:
    """The largest size of the set up to ``most``, or 0."""
    return max(0, (sizes & ((2 << most) - 1)).bit_length() - 1) if most > 0 else 0


def dominates(a: Filling, b: Filling) -> bool:
    """Whether the items of b can be put into the places of a, one or more in each: then b need not be tried. Both largest first."""
    if len(a) == 1:
        return bool(a) and sum(b) <= a[0]
    room = list(a)
    for s in b:
        for k, r in enumerate(room):
            if r >= s:
                room[k] -= s
                break
        else:
            return False
    return True


def fillings(stock: _Stock, room: int, allowed: int, bounds: Bounds = BOUNDS) -> list[Filling]:
    """Undominated ways to fill the room beside the largest item, best first, that waste no more than allowed."""
    found: list[tuple[int, int, Filling]] = []
    steps = inf if bounds.filling_steps is None else bounds.filling_steps

    def extend(room: int, most: int, chosen: Filling) -> None:
        nonlocal steps
        s = largest_in(stock.sizes, min(room, most))
        if not s:
            if room <= allowed:
                found.append((room, len(chosen), chosen))
            return
        full = True
        while s and steps > 0:
            if stock.count[s] > chosen.count(s):
                steps, full = steps - 1, False
                extend(room - s, s, (*chosen, s))
            s = largest_in(stock.sizes, s - 1)
        if full and not s and room <= allowed:  # all items that would fit are in it
            found.append((room, len(chosen), chosen))

    extend(room, room, ())
    kept: list[Filling] = []
    for _, _, filling in sorted(found):
        if len(kept) >= (inf if bounds.fillings_kept is None else bounds.fillings_kept):
            break
        if filling not in kept and not any(dominates(k, filling) for k in kept):
            kept.append(filling)
    return kept


def best_fit(sizes: list[int], capacity: int) -> list[Filling]:
    """The first incumbent: each item, largest first, goes where the least room is left."""
    rooms: list[int] = []
    at: dict[int, list[list[int]]] = defaultdict(list)
    bins: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        k = bisect_left(rooms, s)
        if k < len(rooms):
            room = rooms.pop(k)
            container = at[room].pop()
        else:
            room, container = capacity, []
            bins.append(container)
        container.append(s)
        insort(rooms, room - s)
        at[room - s].append(container)
    return [tuple(b) for b in bins]


def lower_bound(sizes: list[int], capacity: int) -> int:
    return -(-sum(sizes) // capacity)


def pack(sizes: list[int], capacity: int = CAPACITY, bounds: Bounds = BOUNDS) -> list[Filling]:
    """Containers for items of 1 to ``capacity``.

    The largest item left opens a container, which is completed by undominated fillings, best
    first. A branch ends when its waste shows that it cannot need fewer containers than the
    incumbent, and the search ends at the lower bound or when its steps back are used up. The
    first incumbent is the best fit; where that reaches the bound, it is proved optimal at the root.
    """
    best = best_fit(sizes, capacity)
    total, least = sum(sizes), lower_bound(sizes, capacity)
    stock, bins, waste, back = _Stock(sizes), [], 0, 0
    open_ways: list[list[Filling]] = []
    goal = len(best) - 1
    while goal >= least:
        if bounds.steps_back is not None and back > bounds.steps_back:
            break
        if stock.total == 0:
            best, goal = list(bins), len(bins) - 1
            if goal < least:
                break
        allowed = goal * capacity - total - waste
        if stock.total and allowed >= 0:
            first = largest_in(stock.sizes, capacity)
            stock.take((first,))
            ways = [(first, *f) for f in fillings(stock, capacity - first, allowed, bounds)]
            stock.put_back((first,))
        else:
            ways = []
        open_ways.append(ways[::-1])
        while open_ways and not open_ways[-1]:
            open_ways.pop()
            back += 1
            if bins:
                undone = bins.pop()
                stock.put_back(undone)
                waste -= capacity - sum(undone)
        if not open_ways:
            break
        filling = open_ways[-1].pop()
        stock.take(filling)
        bins.append(filling)
        waste += capacity - sum(filling)
    return best


def _pack_block(texts: pd.DataFrame, capacity: int, bounds: Bounds) -> pd.DataFrame:
    block = int(texts["block"].iloc[0])
    rows: list[tuple] = []  # container, doc_id, start, n_tokens
    waiting: dict[int, list[tuple]] = defaultdict(list)
    container = 0
    for doc_id, n in sorted(zip(texts["doc_id"], texts["n_tokens"]), key=lambda x: (-x[1], x[0] is None, x[0] or 0)):
        start = 0
        while n - start > capacity:
            rows.append((container, doc_id, start, capacity))
            container, start = container + 1, start + capacity
        waiting[n - start].append((doc_id, start))
    for filling in pack([s for s, items in waiting.items() for _ in items], capacity, bounds):
        rows.extend((container, *waiting[s].pop(), s) for s in filling)
        container += 1
    out = pd.DataFrame(rows, columns=["container", "doc_id", "start", "n_tokens"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    out.insert(0, "container_id", (block << 32) + out.pop("container").astype("int64"))
    return out


def containers(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, bounds: Bounds = BOUNDS) -> DataFrame:
    """(container_id, doc_id, start, n_tokens): the tokens start .. start + n_tokens of each text lie in that container.

    Only a text beyond the capacity is divided: into full containers and a rest that is packed
    with the other texts. Empty and null texts get no row; repeated doc_ids are packed as the
    separate rows they are. Texts are dealt to blocks of about BLOCK_TEXTS, each packed in its
    own task, so no task sees the whole collection.
    """
    sizes = materialize(count_tokens(documents, vocabulary).filter("n_tokens > 0"), "sizes")
    blocks = max(1, -(-sizes.count() // BLOCK_TEXTS))
    dealt = sizes.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    return dealt.repartitionByRange(blocks, "block").groupBy("block").applyInPandas(
        lambda texts: _pack_block(texts, capacity, bounds), "container_id bigint, doc_id bigint, start int, n_tokens int"
    )


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, n_texts, n_tokens, unused) per container."""
    return packed.groupBy("container_id").agg(
        F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), (F.lit(capacity) - F.sum("n_tokens")).alias("unused")
    )


def blocks_filled(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(block, texts, tokens, containers, least): containers used by each block, and the fewest that its tokens could fill."""
    sums = packed.groupBy(F.shiftright("container_id", 32).alias("block")).agg(
        F.count_if(F.col("start") == 0).alias("texts"), F.sum("n_tokens").alias("tokens"), F.count_distinct("container_id").alias("containers")
    )
    return sums.withColumn("least", F.ceil(F.col("tokens") / capacity))
