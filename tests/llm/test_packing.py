import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing as K


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=120), st.integers(0, 10_000))
def test_evolution_keeps_every_item_once_and_no_container_overflows(sizes, seed):
    rng = random.Random(seed)
    people = K.evolve(K.first_population(sizes, 100, rng), sizes, 100, 10, rng)
    first = K.best_fit([], [], sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 100)
    for p in people:
        assert sorted(i for b in p.bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) == f <= 100 for b, f in zip(p.bins, p.fills))
    assert people[0].fitness(100) >= first.fitness(100) - 1e-12


def test_frame(spark):
    rng = random.Random(3)
    rows = [(f"d{i}", rng.randint(1, 90), 7) for i in range(500)] + [("big", 250, 7), ("exact", 200, 7), ("zero", 0, 7), ("none", None, None), ("d0", rows0 := 5, 7), (None, 10, 7)]
    df = spark.createDataFrame(rows, "doc_id string, n_tokens int, block int")
    out = K.fill_containers(df, [("small", 100), ("wide", 400), ("bad", 0)]).collect()
    fills, parts = defaultdict(int), defaultdict(list)
    for r in out:
        fills[r["container_kind"], r["container_id"]] += r["n_tokens"]
        parts[r["container_kind"], r["key"]].append((r["part_no"], r["part_start"], r["n_tokens"]))
    sizes = {}
    for key, n, _ in rows:
        sizes[key] = max(sizes.get(key, 0), n or 0)
    for kind, capacity in (("small", 100), ("wide", 400)):
        used = [f for (k, _), f in fills.items() if k == kind]
        assert max(used) <= capacity and sum(used) == sum(sizes.values())
        assert sum(used) / (len(used) * capacity) > 0.9
        for key, n in sizes.items():
            got = sorted(parts[kind, key])
            assert sum(p[2] for p in got) == n and (len(got) == 1 or n > capacity)
            at = 0
            for _, start, length in got:
                assert start == at
                at += length
    assert sorted(parts["small", "big"]) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)] and {k for k, _ in parts} == {"small", "wide"}
    assert K.fill_containers(df.limit(0), [("small", 100)]).count() == 0


def planted(rng, n_bins, capacity=1000):
    """Sizes that fill the containers exactly, three in each, none of them a simple fit."""
    sizes = []
    while len(sizes) < 3 * n_bins:
        a, b = rng.randint(250, 500), rng.randint(250, 500)
        if 250 <= capacity - a - b <= 500:
            sizes += [a, b, capacity - a - b]
    rng.shuffle(sizes)
    return sizes


def test_the_search_saves_containers_where_best_fit_fails(spark):
    rows, best = [], {}
    for block in range(4):
        sizes = planted(random.Random(block), 30)
        first = K.best_fit_decreasing(sizes, 1000)
        best[block] = len(first.bins)
        assert len(first.bins) > 30
        rows += [("k", block, 1000, f"{block}-{i}", s) for i, s in enumerate(sizes)]
    rows += [("k", 9, 1000, f"9-{i}", 500) for i in range(10)]
    df = spark.createDataFrame(rows, "container_kind string, block long, capacity int, key string, size int")
    settled = {(r["block"], r["island"]) for r in K.settle_blocks(df).collect()}
    assert settled == {(b, i) for b in range(4) for i in range(K.ISLANDS)} | {(9, K.DONE)}
    bins, keys = defaultdict(set), []
    for r in K.pack_blocks(df).collect():
        bins[r["block"]].add(r["bin"])
        keys.append(r["key"])
        assert r["fill"] <= 1000
    assert sorted(keys) == sorted(r[3] for r in rows) and len(bins[9]) == 5
    assert all(len(bins[b]) < best[b] for b in range(4))
    assert sum(len(bins[b]) for b in range(4)) <= 4 * 30 + (sum(best.values()) - 4 * 30) // 3


def test_islands_get_each_others_elite():
    sizes = planted(random.Random(5), 12)
    own = {"sizes": sizes, "capacity": 1000, "container_kind": "k", "block": 0, "island": 1, "people": [K._to_bytes(K.best_fit_decreasing(sizes, 1000), len(sizes))]}
    exact = K.Packing([[i] for i in range(len(sizes))], list(sizes))
    rows = K._state_rows(own, [exact])
    assert rows[0]["island"] == 1 and rows[1]["island"] == 2 and rows[1]["keys"] is None and rows[1]["people"] == rows[0]["people"]
    perfect = K.best_fit([], [], sorted(range(len(sizes))), sizes, 10_000)
    people = K.evolve_island(own, [K._to_bytes(perfect, len(sizes))], 1)
    assert len(people[0].bins) == len(perfect.bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=120), st.integers(0, 60))
def test_tight_filling_keeps_every_item_once_and_no_container_overflows(sizes, n_begun):
    begun = K.best_fit([], [], list(range(min(n_begun, len(sizes)))), sizes, 100)
    before = [list(b) for b in begun.bins]
    p = K.fill_tightly(list(begun.bins), list(begun.fills), list(range(min(n_begun, len(sizes)), len(sizes))), sizes, 100)
    assert sorted(i for b in p.bins for i in b) == list(range(len(sizes))) and all(p.bins)
    assert all(sum(sizes[i] for i in b) == f <= 100 for b, f in zip(p.bins, p.fills))
    assert begun.bins == before and all(set(b) <= set(c) for b, c in zip(before, p.bins))


def test_tight_filling_takes_what_fills_a_container_exactly():
    sizes = [60, 55, 40, 25, 20, 30, 0]
    assert [sorted(b) for b in K.fill_tightly([], [], list(range(7)), sizes, 100).bins] == [[0, 2, 6], [1, 3, 4], [5]]
    assert K.fill_tightly([[0]], [60], [3, 4, 4, 2], sizes, 100).bins[0] == [0, 2]


def test_a_few_children_reach_the_bound_that_best_fit_misses():
    for seed in (1, 3, 17, 22, 45, 48, 54, 57):
        rng = random.Random(seed)
        sizes = [max(1, int(rng.lognormvariate(5.6, 0.8)) % 512) for _ in range(1500)]
        first = K.best_fit_decreasing(sizes, 512)
        least = K.least_bins(sizes, 512)
        assert len(first.bins) > least
        own = {"sizes": sizes, "capacity": 512, "container_kind": "k", "block": seed, "island": 0, "people": [K._to_bytes(first, len(sizes))]}
        people = K.evolve_island(own, [], 0)
        people = K.evolve_island(own | {"people": [K._to_bytes(p, len(sizes)) for p in people]}, [], 1)
        assert len(people[0].bins) == least
        there = K.evolve_island(own | {"people": [K._to_bytes(p, len(sizes)) for p in people]}, [], 2)
        assert len(there) == 1 and len(there[0].bins) == least
