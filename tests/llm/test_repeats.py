"""Repeated passages against a plain loop over all windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrane.llm import repeats

SCHEMA = "doc_id long, text string, batch string, kept int"


def plain(rows, window):
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - window + 1 if i is not None else 0):
            w = data[s : s + window]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - window + 1 if i is not None else 0):
            if first[data[s : s + window]] < i:
                gone[s : s + window] = b"\x01" * window
        left = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, **given):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in repeats.remove_repeats(df, **given).collect()), key=repr)
    assert got == plain(rows, given.get("window", 50))
    return got


def documents(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randrange(4, 40))) for _ in range(6)]
    common = "the same line of exactly forty-nine bytes in it. "  # meets only with what stands beside it
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(3)):
            passage = rng.choice(shared)
            a = rng.randrange(len(passage) // 2)
            parts.insert(rng.randrange(len(parts) + 1), passage[a : rng.randrange(len(passage) // 2, len(passage)) + 1])
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), word() + common + word())
        rows.append((rng.randrange(10_000), rng.choice([" ", "\n"]).join(parts)))
    rows += [(20_000, rows[0][1]), (20_001, rows[0][1]), (3, rows[1][1] + rows[0][1]), (rows[2][0], rows[3][1]), (rows[4][0], rows[4][1])]
    rows += [(30_000, None), (30_001, ""), (30_002, "x" * 49), (30_003, "x" * 50), (30_004, "x" * 400), (1, "x" * 50 + "y" + "x" * 120), (30_005, "ab" * 300), (30_006, "ba" * 31)]
    rows += [(None, rows[0][1]), (None, "only in a document without an id, twice over: " * 3), (30_007, "only in a document without an id, twice over: " * 2)]
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 50_000), (2, 3), (3, 0)])
def test_removal_equals_a_plain_loop(spark, seed, hot):
    got = check(spark, documents(seed), hot=hot)
    assert sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("window", [16, 30, 77, 130])
def test_other_windows(spark, window):
    check(spark, documents(9, 25), window=window)


def test_many_batches(spark):
    rng = random.Random(4)
    passage = " ".join(str(rng.random()) for _ in range(120))
    rows = [(i, "".join(rng.choice("0123456789 ") for _ in range(3000)) + passage[i % 50 : 1500 + i]) for i in range(60)]
    check(spark, rows)
    check(spark, rows, hot=2)


def test_no_rows_and_the_bytes_that_are_left(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "é" * 40), (2, "a" + "é" * 40 + "b")], "doc_id long, text string")
    left = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(df, with_text=True).select("doc_id", "kept").collect()}
    assert left == {1: ("é" * 40).encode(), 2: b"ab"}


def test_equal_windows_have_equal_anchors():
    rng = random.Random(8)
    same = bytes(rng.randrange(256) for _ in range(50))
    docs = [bytes(rng.randrange(97, 100) for _ in range(rng.randrange(200))) + same + bytes(rng.randrange(97, 100) for _ in range(90)) for _ in range(20)]
    places = []
    for d in docs:
        table = pa.table({"id": pa.array([7]), "text": pa.array([d]).cast(pa.binary())})
        texts = repeats.Texts(table)
        at, hashes = texts.anchors(50)
        start = d.index(same)
        inside = (at >= start) & (at <= start + 34)
        assert inside.any()
        places.append(set(zip((at[inside] - start).tolist(), hashes[inside].tolist())))
    assert set.intersection(*places)


def test_digits_find_exactly_the_equal_rows():
    rng = np.random.default_rng(2)
    content = rng.integers(0, 2, (3000, 11)).astype(np.uint8)
    group = rng.integers(0, 3, 3000)
    rows, found = repeats.equal_windows(content, group)
    keys = [(g, bytes(c)) for g, c in zip(group.tolist(), content)]
    want = {}
    for i, k in enumerate(keys):
        want.setdefault(k, set()).add(i)
    got = {}
    for r, g in zip(rows.tolist(), found.tolist()):
        got.setdefault(g, set()).add(r)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
