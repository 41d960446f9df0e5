"""Filling containers of fixed capacity by a grouping genetic algorithm on islands.

Items are dealt by hash into blocks of bounded size; each block is one packing problem. Best fit in
falling order and tight filling give its first individuals; where one of them already needs no more
containers than the sum of the sizes does, nothing can be better and the block is done. Every other
block is evolved on several islands, each a row and a task of its own with a population of its own.
An individual is a partition of the block's items into containers. The crossover injects whole
well-filled containers of the second parent into the first, removes the first parent's containers
that hold one of these items, swaps the displaced items with one or two items of a container that is
fuller that way, and puts the others where one or two of them fill a container to its last token, or
where they fit best. After each round every island's elite moves on to the next island of its block;
an island that has a packing at the bound keeps only that. What the blocks leave in badly filled containers is dealt anew and packed once
more.

Defined results: an item within the capacity is never split; one above it fills whole containers
and leaves a rest, which is packed like an item; an item of no size is put like any other; null
sizes count as none; an item key that occurs again counts once, with its largest size. Kinds with a
null or no positive capacity are left out. Other columns are not read.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from heapq import nsmallest
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

BLOCK = 2048
ISLANDS = 3
ROUNDS = 4
POPULATION = 8
WELL_FILLED = 0.98
# Children of an island in a round; small blocks, which are harder to fill, are searched longer.
CHILDREN, LEAST_WORK = 10, 8192


class Packing:
    """A partition of items into containers with their fill."""

    __slots__ = ("bins", "fills")

    def __init__(self, bins: list[list[int]], fills: list[int]) -> None:
        self.bins, self.fills = bins, fills

    def fitness(self, capacity: int) -> float:
        """Mean of squared fill, which rewards full containers over evenly filled ones."""
        if not self.bins:
            return 1.0
        f = np.array(self.fills, dtype=float) / capacity
        return float((f * f).sum() / len(self.bins))


def best_fit(bins: list[list[int]], fills: list[int], items: list[int], sizes: list[int], capacity: int) -> Packing:
    """Put each item, in the order given, into the fullest container that has room, else into a new one."""
    if not items:
        return Packing(bins, fills)
    n = len(bins)
    least = min(map(sizes.__getitem__, items))  # no item fits into less room
    shift = (n + len(items)).bit_length()  # room and container in one number, as numbers compare faster than pairs
    mask = (1 << shift) - 1
    free = sorted(((capacity - f) << shift) | k for k, f in enumerate(fills) if capacity - f >= least)
    shared = [True] * n  # containers are shared between individuals, so only new ones are changed in place
    for item in items:
        size = sizes[item]
        at = bisect_left(free, size << shift)
        if at < len(free):
            found = free.pop(at)
            k = found & mask
            room = (found >> shift) - size
            if shared[k]:
                bins[k] = [*bins[k], item]
                shared[k] = False
            else:
                bins[k].append(item)
            fills[k] += size
        else:
            k = len(bins)
            room = capacity - size
            bins.append([item])
            fills.append(size)
            shared.append(False)
        if room >= least:
            insort(free, (room << shift) | k)
    return Packing(bins, fills)


def fill_tightly(bins: list[list[int]], fills: list[int], items: list[int], sizes: list[int], capacity: int) -> Packing:
    """Fill the containers with room, the fullest first, then new ones begun with the largest item left.

    Each takes the item that fills it to the last token, else two that do, else the largest that fits, and goes on.
    """
    by_size: dict[int, list[int]] = {}
    for item in items:
        by_size.setdefault(sizes[item], []).append(item)
    nothing = [item for size in [s for s in by_size if s <= 0] for item in by_size.pop(size)]
    there = sorted(by_size)

    def take(size: int) -> int:
        same = by_size[size]
        item = same.pop()
        if not same:
            del by_size[size]
            del there[bisect_left(there, size)]
        return item

    begun = iter(sorted((k for k, f in enumerate(fills) if f < capacity), key=lambda k: -fills[k]))
    while there:
        k = next(begun, None)
        if k is None:
            room, got = capacity - there[-1], [take(there[-1])]
        else:
            room, got = capacity - fills[k], []
        while room > 0 and there:
            if room in by_size:
                got.append(take(room))
                room = 0
                break
            at = bisect_right(there, room) - 1
            if at < 0:
                break
            first = at
            while first >= 0 and 2 * there[first] >= room:  # the larger one of two
                larger = there[first]
                if room - larger in by_size and (2 * larger != room or len(by_size[larger]) > 1):
                    got += [take(larger), take(room - larger)]
                    room = 0
                    break
                first -= 1
            else:
                room -= there[at]
                got.append(take(there[at]))
        if k is None:
            bins.append(got)
            fills.append(capacity - room)
        elif got:
            bins[k] = [*bins[k], *got]
            fills[k] = capacity - room
    if nothing:
        if not bins:
            bins.append([])
            fills.append(0)
        bins[0] = [*bins[0], *nothing]
        fills[0] += sum(sizes[i] for i in nothing)
    return Packing(bins, fills)


def exchange(bins: list[list[int]], fills: list[int], displaced: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Swap displaced items for one or two smaller ones of a container that becomes fuller; returns what is displaced then."""
    by_size: dict[int, list[int]] = {}
    for item in displaced:
        by_size.setdefault(sizes[item], []).append(item)
    there = sorted(by_size)
    for k, items in enumerate(bins):
        room = capacity - fills[k]
        if room <= 0 or not there:
            continue
        best: tuple[int, tuple[int, ...], int] | None = None
        short = items[:12]  # a container of many items has enough pairs among its first ones
        for out in [(x,) for x in short] + [(x, y) for i, x in enumerate(short) for y in short[:i]]:
            size = sum(sizes[x] for x in out)
            at = bisect_right(there, room + size) - 1
            if at >= 0 and there[at] > size and (best is None or there[at] - size > best[0]):
                best = (there[at] - size, out, there[at])
                if best[0] == room:
                    break
        if best is None:
            continue
        gain, out, size = best
        item = by_size[size].pop()
        if not by_size[size]:
            del by_size[size]
            there.remove(size)
        bins[k] = [x for x in items if x not in out] + [item]
        for x in out:
            if sizes[x] not in by_size:
                insort(there, sizes[x])
            by_size.setdefault(sizes[x], []).append(x)
        fills[k] += gain
    return [item for size in reversed(there) for item in by_size[size]]


def crossover(first: Packing, second: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    n, well = len(second.bins), WELL_FILLED * capacity
    full = [k for k, f in enumerate(second.fills) if f >= well] or sorted(range(n), key=lambda k: -second.fills[k])[: max(1, n // 10)]
    chosen = rng.sample(full, max(1, min(len(full), len(full) // 3 + 1)))
    bins, fills, displaced = [second.bins[k] for k in chosen], [second.fills[k] for k in chosen], []
    injected = set(chain.from_iterable(bins))
    broken = {k for _, _, k in nsmallest(max(1, len(first.bins) // 20), [(f, rng.random(), k) for k, f in enumerate(first.fills)])}
    apart = injected.isdisjoint
    for k, items in enumerate(first.bins):
        if k in broken or not apart(items):
            displaced += [i for i in items if i not in injected]
        else:
            bins.append(items)
            fills.append(first.fills[k])
    displaced = exchange(bins, fills, displaced, sizes, capacity)
    if rng.random() < 0.5:  # a little disorder lets other combinations meet
        displaced.sort(key=lambda i: -sizes[i] * rng.uniform(0.8, 1.0))
        return best_fit(bins, fills, displaced, sizes, capacity)
    return fill_tightly(bins, fills, displaced, sizes, capacity)


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing needs fewer containers than this."""
    return -(-sum(sizes) // capacity)


def best_fit_decreasing(sizes: list[int], capacity: int) -> Packing:
    return best_fit([], [], sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, capacity)


def first_population(sizes: list[int], capacity: int, rng: random.Random, first: list[Packing] | None = None) -> list[Packing]:
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = list(first or (best_fit([], [], order, sizes, capacity),))
    while len(people) < POPULATION:
        noise = rng.choice((0.1, 0.3, 0.6, 1.0))
        people.append(best_fit([], [], sorted(order, key=lambda i: -sizes[i] * rng.uniform(1 - noise, 1)), sizes, capacity))
    return people


def evolve(people: list[Packing], sizes: list[int], capacity: int, children: int, rng: random.Random) -> list[Packing]:
    """Steady state: each child replaces the worst individual if it is better; best first in the result."""
    ranked = sorted(((p.fitness(capacity), k, p) for k, p in enumerate(people)), key=lambda x: (-x[0], x[1]))
    least = least_bins(sizes, capacity)
    for number in range(children):
        if len(ranked) < 2 or len(ranked[0][2].bins) <= least:
            break
        a, b = sorted(rng.sample(range(len(ranked)), 2))
        child = crossover(ranked[a][2], ranked[b][2], sizes, capacity, rng)
        fitness = child.fitness(capacity)
        if fitness > ranked[-1][0] and all(abs(fitness - r[0]) > 1e-12 for r in ranked):
            ranked[-1] = (fitness, len(people) + number, child)
            ranked.sort(key=lambda x: (-x[0], x[1]))
    return [p for _, _, p in ranked]


def _to_bytes(packing: Packing, n: int) -> bytes:
    owner = np.zeros(n, dtype=np.int32)
    owner[list(chain.from_iterable(packing.bins))] = np.repeat(np.arange(len(packing.bins), dtype=np.int32), list(map(len, packing.bins)))
    return owner.tobytes()


def _from_bytes(blob: bytes, sizes: list[int]) -> Packing:
    owner = np.frombuffer(blob, dtype=np.int32)
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner)).tolist()
    items, begins = order.tolist(), [0, *ends[:-1]]
    until = [0, *accumulate(sizes[i] for i in items)]
    return Packing([items[a:b] for a, b in zip(begins, ends)], [until[b] - until[a] for a, b in zip(begins, ends)])


_STATE = "container_kind string, block long, island int, capacity int, keys array<string>, sizes array<int>, people array<binary>"
_STATE_TYPES = pa.schema(
    [
        ("container_kind", pa.string()),
        ("block", pa.int64()),
        ("island", pa.int32()),
        ("capacity", pa.int32()),
        ("keys", pa.list_(pa.string())),
        ("sizes", pa.list_(pa.int32())),
        ("people", pa.list_(pa.binary())),
    ]
)
DONE = -1  # the island number of a block that needs no search


def _seed(*parts: object) -> random.Random:
    return random.Random(zlib.crc32(repr(parts).encode()))


def _settle(table: pa.Table) -> pa.Table:
    """One block: done by best fit or tight filling, or one row for each of its islands with the first individuals."""
    rows = sorted(zip(table.column("key").to_pylist(), table.column("size").to_pylist()), key=lambda r: (r[0] is None, r[0] or "", r[1]))
    kind, block, capacity = (table.column(c)[0].as_py() for c in ("container_kind", "block", "capacity"))
    keys, sizes = [r[0] for r in rows], [r[1] for r in rows]
    people, least = [best_fit_decreasing(sizes, capacity)], least_bins(sizes, capacity)
    if len(people[0].bins) > least:
        people.append(fill_tightly([], [], list(range(len(sizes))), sizes, capacity))
    done = [p for p in people if len(p.bins) <= least]
    islands = [DONE] if done else range(ISLANDS)
    row = {"container_kind": kind, "block": block, "capacity": capacity, "keys": keys, "sizes": sizes, "people": [_to_bytes(p, len(sizes)) for p in done or people]}
    return pa.Table.from_pylist([row | {"island": island} for island in islands], schema=_STATE_TYPES)


def _state_rows(own: dict, people: list[Packing]) -> list[dict]:
    """The island's own state, and its elite on the way to the next island."""
    n = len(own["sizes"])
    migrant = own | {"island": (own["island"] + 1) % ISLANDS, "keys": None, "sizes": None, "people": [_to_bytes(people[0], n)]}
    return [own | {"people": [_to_bytes(p, n) for p in people]}, migrant]


def evolve_island(own: dict, migrants: list[bytes], number: int) -> list[Packing]:
    """One round of one island; its population is drawn in the first one. A packing at the bound ends the search."""
    sizes, capacity = own["sizes"], own["capacity"]
    rng = _seed(own["container_kind"], own["block"], own["island"], number)
    blobs, least = [*own["people"], *migrants], least_bins(sizes, capacity)
    for blob in blobs:
        if np.frombuffer(blob, dtype=np.int32).max(initial=-1) < least:
            return [_from_bytes(blob, sizes)]
    people = [_from_bytes(p, sizes) for p in blobs]
    if number == 0:
        people = first_population(sizes, capacity, rng, people)
    return evolve(people, sizes, capacity, max(CHILDREN, LEAST_WORK // max(1, len(sizes))), rng)[:POPULATION]


def _round(number: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["keys"] is not None)
        migrants = [p for r in rows if r["keys"] is None for p in r["people"]]
        return pa.Table.from_pylist(_state_rows(own, evolve_island(own, migrants, number)), schema=_STATE_TYPES)

    return run


_OUT = "container_kind string, block long, bin int, key string, size int, fill int, capacity int"


def _assignment(row: dict, best: Packing) -> pa.RecordBatch:
    order = [(k, i) for k, items in enumerate(best.bins) for i in items]
    n = len(order)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row["container_kind"]] * n, pa.string()),
            pa.array([row["block"]] * n, pa.int64()),
            pa.array([k for k, _ in order], pa.int32()),
            pa.array([row["keys"][i] for _, i in order], pa.string()),
            pa.array([row["sizes"][i] for _, i in order], pa.int32()),
            pa.array([best.fills[k] for k, _ in order], pa.int32()),
            pa.array([row["capacity"]] * n, pa.int32()),
        ],
        names=["container_kind", "block", "bin", "key", "size", "fill", "capacity"],
    )


def _winner(table: pa.Table) -> pa.Table:
    rows = sorted((r for r in table.to_pylist() if r["keys"] is not None), key=lambda r: r["island"])
    best = max((_from_bytes(r["people"][0], r["sizes"]) for r in rows), key=lambda p: p.fitness(rows[0]["capacity"]))
    return pa.Table.from_batches([_assignment(rows[0], best)])


def _as_they_are(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _assignment(row, _from_bytes(row["people"][0], row["sizes"]))


def settle_blocks(items: DataFrame) -> DataFrame:
    """The state of every block of items (container_kind, block, capacity, key, size): done, or on its islands."""
    return cut(items.groupBy("container_kind", "block").applyInArrow(_settle, _STATE))


def pack_blocks(items: DataFrame) -> DataFrame:
    """(container_kind, block, bin, key, size, fill, capacity) for items with container_kind, block, capacity, key and size."""
    settled = settle_blocks(items)
    state = settled.where(F.col("island") != DONE)
    for number in range(ROUNDS):
        state = state.groupBy("container_kind", "block", "island").applyInArrow(_round(number), _STATE)
    evolved = state.groupBy("container_kind", "block").applyInArrow(_winner, _OUT)
    return settled.where(F.col("island") == DONE).mapInArrow(_as_they_are, _OUT).unionByName(evolved)


def _dealt(items: DataFrame, n_blocks: int, salt: int) -> DataFrame:
    return items.withColumn("block", F.pmod(F.xxhash64("key", "container_kind", F.lit(salt)), F.lit(n_blocks)))


def fill_containers(sizes: DataFrame, capacities: list[tuple[str, int]], key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(container_kind, container_id, key, part_no, part_start, n_tokens) of every item for every kind of container.

    ``capacities`` is the fixed list of kinds. ``part_start`` is where a part begins within its item.
    """
    sizes = sizes.groupBy(F.col(key).cast("string").alias("key")).agg(F.coalesce(F.max(size), F.lit(0)).cast("int").alias("n"))
    sizes = cut(sizes)
    n_items = sizes.count()
    kinds = F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity")) for k, c in capacities if c and c > 0))
    each = sizes.select("key", "n", F.explode(kinds).alias("kind")).select("key", "n", "kind.container_kind", "kind.capacity")
    full = F.when(F.col("n") > F.col("capacity"), F.floor(F.col("n") / F.col("capacity"))).otherwise(F.lit(0)).cast("int")
    each = each.withColumn("n_full", full).withColumn("rest", (F.col("n") - F.col("n_full") * F.col("capacity")).cast("int"))
    whole = (
        each.where("n_full > 0")
        .withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("n_full") - 1)))
        .select(
            "container_kind",
            F.concat_ws("-", "container_kind", F.lit("full"), "key", "part_no").alias("container_id"),
            "key",
            "part_no",
            (F.col("part_no") * F.col("capacity")).alias("part_start"),
            F.col("capacity").alias("n_tokens"),
        )
    )
    rests = each.where("rest > 0 or n_full = 0").select("container_kind", "capacity", "key", F.col("rest").alias("size"))
    n_blocks = max(1, -(-n_items // BLOCK))
    packed = cut(pack_blocks(_dealt(rests, n_blocks, 0)))
    poor = F.col("fill") < F.col("capacity") * F.lit(0.9)
    again = _dealt(packed.where(poor).select("container_kind", "capacity", "key", "size"), max(1, n_blocks // 16), 1)
    packed = (
        packed.where(~poor)
        .withColumn("level", F.lit("a"))
        .unionByName(pack_blocks(again).withColumn("level", F.lit("b")))
        .withColumn("container_id", F.concat_ws("-", "container_kind", "level", "block", "bin"))
    )
    lengths = each.where("n_full > 0").select("container_kind", "key", "n_full", F.col("capacity").alias("c"))
    parts = packed.join(lengths, (packed["container_kind"] == lengths["container_kind"]) & packed["key"].eqNullSafe(lengths["key"]), "left").select(
        packed["container_kind"],
        "container_id",
        packed["key"],
        F.coalesce("n_full", F.lit(0)).alias("part_no"),
        F.coalesce(F.col("n_full") * F.col("c"), F.lit(0)).alias("part_start"),
        F.col("size").alias("n_tokens"),
    )
    return whole.unionByName(parts)
