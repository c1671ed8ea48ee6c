"""Product codes against a plain loop."""

import hashlib
import math
import random

import numpy as np
import pytest

from terrane.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, id string, x string"


def plain(rows, parts, entries, rounds):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    if not seeds:
        return []
    dims = len(seeds[0][1])
    kept = [r for r in kept if len(r[1]) == dims]
    seeds = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    edges = codes.part_edges(dims, parts)
    books = [[v[lo:hi] for _, v in seeds] for lo, hi in edges]

    def code(v):
        out = []
        for (lo, hi), book in zip(edges, books):
            far = [sum((a - b) ** 2 for a, b in zip(v[lo:hi], e)) for e in book]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        found = [code(v) for _, v, _ in kept]
        for p, (lo, hi) in enumerate(edges):
            for e in range(len(seeds)):
                mine = [v[lo:hi] for (_, v, _), c in zip(kept, found) if c[p][0] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    done = [(i, "".join(f"{e:02x}" for e, _ in code(v)), sum(f for _, f in code(v)), lab) for i, v, lab in kept]
    return sorted(((i, c, err, sum(d[2] for d in done if d[3] == lab), sha) for i, c, err, lab in done), key=repr)


def check(spark, rows, **given):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in codes.compress(df, **given).collect()), key=repr)
    want = plain(rows, given.get("parts", 8), given.get("entries", 16), given.get("rounds", 6))
    assert got == want
    return got


def test_codes_equal_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)], rng.choice([1, 2, None])) for i in rng.sample(range(1000), 120)]
    rows += [(None, [rng.gauss(0, 0.2) for _ in range(16)], 1), rows[0], (rows[1][0], rows[2][1], 7)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [None] * 16, 1), (2003, [math.nan] * 16, 1), (2004, [math.inf] * 16, 1), (2005, [0.5] * 8, 1)]
    assert len(check(spark, rows, parts=8)) == 123
    check(spark, rows, parts=3, entries=5, rounds=2)  # parts of unequal length


def test_ties_negative_floors_and_unused_entries(spark):
    rows = [(i, [0.0, -0.0001, 1.0, -1.0], 1) for i in range(5)] + [(9, [-0.0, -1e-20, 1.0, -1.0], 1), (10, [0.25, 0.5, 1.0, 3.0], None)]
    got = check(spark, rows, parts=2)
    assert got[0][1] == "0000"


def test_large_values_are_exact(spark):
    rows = [(i, [float(2**40 + 3 * i) / 4096 / 2**15, 1e4 * i], 1) for i in range(30)]
    check(spark, rows, parts=1, entries=4)
    check(spark, [(i, [2.0**19 + i / 4096, 1.0], 1) for i in range(20)], parts=2, entries=3)


def test_empty_and_ids_missing(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.compress(spark.createDataFrame([(None, [1.0] * 8, 1, "", "")], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_partial_distances_find_the_nearest_entry(seed):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-6, 6, (400, 5)), rng.integers(-6, 6, (16, 5)).tolist()
    far = ((x[:, None, :] - np.array(book)[None]) ** 2).sum(axis=2)
    code, best = codes.nearest(x, book)
    assert (code == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
    assert codes.by_variance([[0, 5, 1], [0, 9, 2]]) == [1, 2, 0]
