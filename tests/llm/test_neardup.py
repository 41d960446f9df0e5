import itertools
import random
import re

from tessera.llm.neardup import class_table, similar_classes, similar_pairs


def shingles(text, width):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}, len(w)


def brute(rows, threshold, width, least):
    sets = {k: shingles(t, width) for k, t in rows if k is not None and t}
    out = set()
    for (a, (x, n)), (b, (y, m)) in itertools.combinations(sorted(sets.items()), 2):
        if n >= least and m >= least and x and y and len(x & y) / len(x | y) >= threshold:
            out.add((a, b))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice((20, 40, 150)))]
        rows.append((f"k{i}-0", " ".join(base)))
        for v in range(1, rng.randint(1, 4)):
            edited = list(base)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append((f"k{i}-{v}", " ".join(edited)))
    return rows


def test_pairs_equal_brute_force(spark):
    for seed, (threshold, width, least) in enumerate(((0.7, 3, 20), (0.8, 5, 5), (0.5, 1, 1))):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "chunk_id string, content string").repartition(3)
        members, links = similar_classes(df, "chunk_id", "content", threshold, width, least, cells=1 << 16)
        got = [(r[0], r[1]) for r in similar_pairs(members, links).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(rows, threshold, width, least)


def test_few_cells_lose_no_pair(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "chunk_id string, content string")
    members, links = similar_classes(df, "chunk_id", "content", 0.7, 3, 20, cells=1 << 4)
    assert {(r[0], r[1]) for r in similar_pairs(members, links).collect()} == brute(rows, 0.7, 3, 20)


def test_odd_rows(spark):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [("a", text, 1), ("b", text, 1), ("a", text, 1), ("c", None, 1), (None, text, 1), ("d", "", None), ("e", "same " * 30, 1), ("f", "same " * 50, 1), ("g", "short text", 1), ("h", "y " * 300_000, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, content string, cls int")
    members, links = similar_classes(df, "chunk_id", "content", 0.7, 3, 20, cells=1 << 16)
    assert {(r[0], r[1]) for r in similar_pairs(members, links).collect()} == {("a", "b"), ("e", "f")}
    table = {r["key"]: (r["class_id"], r["class_size"], r["n_links"]) for r in class_table(members, links).collect()}
    assert table["b"] == ("a", 2, 0) and "g" not in table
    empty_members, empty_links = similar_classes(df.limit(0), "chunk_id", "content", 0.7, 3, 20, cells=1 << 16)
    assert similar_pairs(empty_members, empty_links).count() == 0


def test_small_sets_and_low_thresholds(spark):
    rng = random.Random(4)
    rows = [(f"k{i}", " ".join(rng.sample("a b c d e f g h".split(), rng.choice((1, 2, 3, 4, 6))))) for i in range(150)]
    df = spark.createDataFrame(rows, "chunk_id string, content string")
    for threshold in (0.3, 0.4, 0.5, 0.7):
        members, links = similar_classes(df, "chunk_id", "content", threshold, 1, 1, cells=1 << 16)
        assert {tuple(r) for r in similar_pairs(members, links).collect()} == brute(rows, threshold, 1, 1)


def test_hot_keys_are_split_and_lose_no_pair(spark):
    rng = random.Random(7)
    frame = [f"b{i}" for i in range(30)]
    rows = [(f"k{i}", " ".join(frame + [f"{rng.randrange(40)}z" for _ in range(3)])) for i in range(90)]
    rows += corpus(3)
    df = spark.createDataFrame(rows, "chunk_id string, content string")
    for hot in (7, 50):
        members, links = similar_classes(df, "chunk_id", "content", 0.7, 3, 20, cells=1 << 16, hot=hot)
        got = [tuple(r) for r in similar_pairs(members, links).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 0.7, 3, 20)


def test_a_key_with_several_texts_is_no_pair_of_itself(spark):
    base = [f"x{i}" for i in range(40)]
    rows = [("a", " ".join(base)), ("a", " ".join([*base, "more"])), ("b", " ".join([*base, "else"]))]
    df = spark.createDataFrame(rows, "chunk_id string, content string")
    members, links = similar_classes(df, "chunk_id", "content", 0.7, 3, 20, cells=1 << 16)
    assert [tuple(r) for r in similar_pairs(members, links, several_texts=True).collect()] == [("a", "b")]


def test_pairs_under_a_key_wherever_batches_end():
    import numpy as np
    import pyarrow as pa

    from tessera.llm.neardup import _meet

    rng = random.Random(11)
    for hot in (2, 5, 1000):
        rows = sorted((rng.choice([-7, 0, 3, 3, 3, 3, 8, 9]), rng.randrange(-30, 30)) for _ in range(200))
        cut = sorted(rng.sample(range(1, 200), 30))
        parts = [rows[a:b] for a, b in zip([0, *cut], [*cut, 200])]
        size = lambda c: 10 + abs(c) % 3
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in p], pa.int64()), pa.array([c for _, c in p], pa.int64()), pa.array([size(c) for _, c in p], pa.int32()), pa.array([c for _, c in p], pa.int64()), pa.array([0] * len(p), pa.int64())],
                names=["index_key", "cls", "n", "high", "low"],
            )
            for p in parts
        ]
        pairs, through = [], []
        for b in _meet(0.7, hot)(iter(batches)):
            for r in b.to_pylist():
                if r["cls_b"] is None:
                    through.append((r["index_key"], r["cls_a"]))
                else:
                    pairs.append((r["cls_a"], r["cls_b"]))
        want, hot_rows = [], []
        for key in {k for k, _ in rows}:
            classes = sorted({c for k, c in rows if k == key})
            if len(classes) > hot:
                hot_rows += [(key, c) for c in classes]
                continue
            for a, b in itertools.combinations(classes, 2):
                total = size(a) + size(b)
                far = bin((a ^ b) & (2**64 - 1)).count("1")
                if min(size(a), size(b)) >= 0.7 * max(size(a), size(b)) and far <= total - 2 * int(np.ceil(total * 0.7 / 1.7 - 1e-9)):
                    want.append((a, b))
        assert sorted(pairs) == sorted(want) and sorted(through) == sorted(hot_rows)
