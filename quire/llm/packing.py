"""Best-fit packing by a grouping genetic algorithm on islands.

Items are dealt at random to cells of bounded size.  Each cell is solved by
several islands, each a task with a population of its own.  A crossover
injects whole well-filled bins of one parent into the other, removes the
receiving bins that hold an injected item twice, exchanges displaced items for
smaller ones where that fills a bin better, and best-fits the rest.  After an epoch each island sends its elite to the next island of the
cell.  The best island's bins stand, but for those with room left: their items
form the cells of the next level, until one cell holds all that is left.  So
the number of sequences approaches the total length over the capacity,
whatever the number of cells.

Lengths need not allow full bins (any two may exceed the capacity).  A level
that settles too few items therefore keeps all its bins but each cell's least
filled one, and if that settles too few as well, all of them.  So items left
fall geometrically and the levels end, whatever the lengths.
"""

from __future__ import annotations

import random
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .common import Scratch, arrow_rows, pick

#: Fixed value: the id that ends every document.
END_ID = 0

CELL_ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 8
POPULATION = 4
#: Bins filled at least so far are injected whole; bins filled less than this are packed again at the next level.
WELL_FILLED = 0.995
#: A level has stalled if it leaves more than this share of its items to the next.
STALLED = 0.75


def token_pieces(
    docs: DataFrame, tokenizer_json: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Return (id, piece, start, length, ids): every document's tokens and an end id, cut to the capacity.

    Only documents longer than the capacity are cut; their first piece takes
    the remainder, if any, and the others are full.  A null or empty text is
    its end id alone.  Rows that repeat are packed as often as they occur.
    """

    def rows():
        bpe = vocab.json_bpe(tokenizer_json)
        end = END_ID.to_bytes(4, "little")

        def one(row):
            ids = bpe.encode(row["text"] or "") + end
            n = len(ids) // 4
            starts = range(n % capacity - capacity if n % capacity else 0, n, capacity)
            for piece, start in enumerate(starts):
                start, stop = max(start, 0), start + capacity
                yield row["id"], piece, start, stop - start, ids[4 * start : 4 * stop]

        return one

    work = pick(docs, id=id_col, text=text_col)
    return arrow_rows(work, f"`{id_col}` long, piece int, start long, length long, ids binary", rows)


class Solution:
    """Bins as lists of item numbers, and the room left in each."""

    __slots__ = ("bins", "room")

    def __init__(self, bins: list[list[int]], room: list[int]):
        self.bins, self.room = bins, room

    def fitness(self, capacity: int) -> float:
        return sum((capacity - r) ** 2 for r in self.room) / max(1, len(self.room))


def best_fit(solution: Solution, items: list[int], sizes: list[int], capacity: int) -> None:
    """Put each item, in the order given, where it leaves the least room."""
    bins, room = solution.bins, solution.room
    by_room: dict[int, list[int]] = {}
    open_rooms = 0
    for k, r in enumerate(room):
        if r:
            by_room.setdefault(r, []).append(k)
            open_rooms |= 1 << r
    for item in items:
        size = sizes[item]
        fitting = open_rooms >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            k = by_room[r].pop()
            if not by_room[r]:
                open_rooms ^= 1 << r
            bins[k].append(item)
        else:
            r, k = capacity, len(bins)
            bins.append([item])
            room.append(capacity)
        left = room[k] = r - size
        if left:
            by_room.setdefault(left, []).append(k)
            open_rooms |= 1 << left


def crossover(giver: Solution, taker: Solution, sizes: list[int], capacity: int, rng: random.Random) -> Solution:
    """Whole well-filled bins of the giver in the taker; what they displace, and a few bins' items, is placed anew."""
    least = (1 - WELL_FILLED) * capacity
    injected = [b for b, r in zip(giver.bins, giver.room) if r <= least and rng.random() < 0.5]
    inside = {i for b in injected for i in b}
    child = Solution([list(b) for b in injected], [capacity - sum(sizes[i] for i in b) for b in injected])
    displaced: list[int] = []
    some = 2 + len(taker.bins) // 50
    reopened = set(sorted(range(len(taker.bins)), key=taker.room.__getitem__, reverse=True)[:some])
    reopened.update(rng.randrange(len(taker.bins)) for _ in range(some))
    for k, b in enumerate(taker.bins):
        if k in reopened or not inside.isdisjoint(b):
            displaced += [i for i in b if i not in inside]
        else:
            child.bins.append(list(b))
            child.room.append(taker.room[k])
    displaced = exchange(child, displaced, sizes, least)
    best_fit(child, displaced[::-1], sizes, capacity)
    return child


def exchange(solution: Solution, displaced: list[int], sizes: list[int], least: float) -> list[int]:
    """Swap one item of a bin with more room than ``least`` for one or two displaced ones that fill it better.

    The items displaced then come back, smallest first.
    """
    pool = sorted(displaced, key=sizes.__getitem__)
    held = [sizes[i] for i in pool]
    for own, b in enumerate(solution.bins):
        room = solution.room[own]
        if room <= least or not held or held[0] > room + max(map(sizes.__getitem__, b)):
            continue
        best, chosen = 0, None
        for at, item in enumerate(b):
            size = sizes[item]
            most = size + room
            k = bisect_right(held, most) - 1
            if k >= 0 and held[k] - size > best:
                best, chosen = held[k] - size, (at, (k,))
            low, high = 0, k
            while low < high:  # two items that together come nearest to the room
                both = held[low] + held[high]
                if both > most:
                    high -= 1
                    continue
                if both - size > best:
                    best, chosen = both - size, (at, (low, high))
                low += 1
            if best == room:
                break
        if chosen:
            at, ks = chosen
            gone = b[at]
            b[at : at + 1] = [pool[k] for k in ks]
            for k in reversed(ks):
                del pool[k], held[k]
            k = bisect_right(held, sizes[gone])
            pool.insert(k, gone)
            held.insert(k, sizes[gone])
            solution.room[own] = room - best
    return pool


def evolve(sizes: list[int], capacity: int, elites: list[Solution], seed: int, generations: int, *, decreasing: bool = True) -> Solution:
    """The fittest solution after some generations: fewest bins, then the room left in fewest bins.

    The first people are the elites, best-fit decreasing if ``decreasing``,
    and best fits of disturbed orders.  Evolution ends early only where every
    bin but one is full, which nothing can better.
    """
    rng = random.Random(seed)
    rank = lambda s: (len(s.bins), -s.fitness(capacity))
    people = list(elites)
    falling = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    while len(people) < POPULATION:
        order = list(falling)
        if people or not decreasing:
            order.sort(key=lambda i: -sizes[i] * rng.uniform(0.8, 1))
        fresh = Solution([], [])
        best_fit(fresh, order, sizes, capacity)
        people.append(fresh)
    people.sort(key=rank)
    for _ in range(generations):
        if sum(map(bool, people[0].room)) <= 1:
            break
        giver, taker = rng.sample(people, 2)
        people.append(crossover(giver, taker, sizes, capacity, rng))
        people.append(crossover(people[0], taker, sizes, capacity, rng))
        ranked = {rank(s): s for s in reversed(people)}  # equally fit people are one
        people = [ranked[r] for r in sorted(ranked)[:POPULATION]]
        if len(people) == 1:
            people.append(crossover(people[0], people[0], sizes, capacity, rng))
    return people[0]


def pack(spark: SparkSession, items: DataFrame, *, capacity: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """Return (item, sequence_id, offset) for items (item, length) of at most ``capacity``.

    ``item`` must be unique and lengths from 1 to the capacity.  Offsets are
    gapless from 0 in every sequence.
    """
    scratch = scratch or Scratch(spark, "packing")
    full = items.where(F.col("length") >= capacity)
    placed = full.select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity).select("item", F.col("length").cast("int").alias("length"))
    level, total = 0, rest.count()
    while True:
        cells = max(1, -(-total // CELL_ITEMS))
        solved = scratch.keep(_solve(rest, cells, capacity, level), f"level{level}")
        again, left = F.lit(False), 0
        if cells > 1:
            for open_bins in (F.col("loose"), F.col("loose") & F.col("least")):
                left = solved.where(open_bins).count()
                if left <= STALLED * total:
                    again = open_bins
                    break
            else:
                left = 0
        number = F.shiftleft(F.lit(level).cast("long"), 56) + F.shiftleft(F.col("cell"), 24) + F.col("bin")
        placed = placed.unionByName(solved.where(~again).select("item", number.alias("sequence_id"), "offset"))
        if not left:
            return placed
        rest, total, level = solved.where(again).select("item", "length"), left, level + 1


def _solve(items: DataFrame, cells: int, capacity: int, level: int) -> DataFrame:
    """(cell, item, length, bin, offset, loose, least) of the best island of every cell; least marks its emptiest bin."""
    dealt = items.withColumn("cell", F.pmod(F.xxhash64(F.lit(level), "item"), F.lit(cells)))
    islands = F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))
    state = dealt.select("cell", islands.alias("island"), F.lit(-1).alias("sender"), "item", "length", F.lit(-1).alias("bin"))
    schema = "cell long, island int, sender int, item long, length int, bin int"

    def step(epoch: int):
        def run(table: pa.Table) -> pa.Table:
            cell, island = table["cell"][0].as_py(), table["island"][0].as_py()
            items, sizes, elites = _population(table, capacity)
            best = evolve(sizes, capacity, elites, hash((level, cell, island, epoch)), GENERATIONS, decreasing=island == 0)
            bins = np.empty(len(items), np.int32)
            for k, b in enumerate(best.bins):
                bins[b] = k
            parts = []
            for target in {island, (island + 1) % ISLANDS}:  # the elite stays, and migrates to the next island
                n = len(items)
                parts.append(
                    pa.table(
                        {
                            "cell": pa.array(np.full(n, cell), pa.int64()),
                            "island": pa.array(np.full(n, target), pa.int32()),
                            "sender": pa.array(np.full(n, island), pa.int32()),
                            "item": pa.array(items, pa.int64()),
                            "length": pa.array(sizes, pa.int32()),
                            "bin": pa.array(bins, pa.int32()),
                        }
                    )
                )
            return pa.concat_tables(parts)

        return run

    for epoch in range(EPOCHS):
        state = state.groupBy("cell", "island").applyInArrow(step(epoch), schema)

    def choose(table: pa.Table) -> pa.Table:
        cell = table["cell"][0].as_py()
        items, sizes, elites = _population(table, capacity)
        best = min(elites, key=lambda s: (len(s.bins), -s.fitness(capacity)))
        bins, offsets, loose, least = (np.empty(len(items), t) for t in (np.int32, np.int64, bool, bool))
        emptiest = max(range(len(best.bins)), key=best.room.__getitem__)
        for k, b in enumerate(best.bins):
            at = 0
            least[b] = k == emptiest
            for i in sorted(b):
                bins[i], offsets[i], loose[i] = k, at, best.room[k] > (1 - WELL_FILLED) * capacity
                at += sizes[i]
        return pa.table(
            {
                "cell": pa.array(np.full(len(items), cell), pa.int64()),
                "item": pa.array(items, pa.int64()),
                "length": pa.array(sizes, pa.int32()),
                "bin": pa.array(bins, pa.int32()),
                "offset": pa.array(offsets, pa.int64()),
                "loose": pa.array(loose, pa.bool_()),
                "least": pa.array(least, pa.bool_()),
            }
        )

    own = state.where(F.col("island") == F.col("sender"))
    return own.groupBy("cell").applyInArrow(choose, "cell long, item long, length int, bin int, offset long, loose boolean, least boolean")


def _population(table: pa.Table, capacity: int) -> tuple[list[int], list[int], list[Solution]]:
    """Items in order of id, their lengths, and the solutions that came with them."""
    sender = table["sender"].to_numpy()
    item, length, bin_ = table["item"].to_numpy(), table["length"].to_numpy(), table["bin"].to_numpy()
    items, sizes, elites = [], [], []
    for s in np.unique(sender):
        of = np.flatnonzero(sender == s)
        of = of[np.argsort(item[of], kind="stable")]
        items, sizes = item[of].tolist(), length[of].tolist()
        if s >= 0:
            bins: list[list[int]] = [[] for _ in range(int(bin_[of].max()) + 1)]
            for i, k in enumerate(bin_[of].tolist()):
                bins[k].append(i)
            elites.append(Solution(bins, [capacity - sum(sizes[i] for i in b) for b in bins]))
    return items, sizes, elites


def pack_documents(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer_json: str,
    *,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Return (id, piece, start, length, ids_crc32, sequence_id, offset), one row
    for each piece of :func:`token_pieces`; see there for the cuts.
    """
    scratch = Scratch(spark, "packing")
    cut = token_pieces(docs, tokenizer_json, capacity=capacity, id_col=id_col, text_col=text_col)
    pieces = scratch.keep(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    numbered = scratch.keep(pieces.withColumn("item", F.monotonically_increasing_id()), "numbered")
    scratch.drop(pieces)
    placed = pack(spark, numbered.select("item", "length"), capacity=capacity, scratch=scratch)
    return numbered.join(placed, "item").drop("item")
