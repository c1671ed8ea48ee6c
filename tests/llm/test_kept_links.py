"""Candidates of near-duplicates: few for each text, and no link lost by that."""

import random

import numpy as np
import pytest

from terrane.llm import simhash


def test_candidates_grow_with_texts_not_with_keys(spark, monkeypatch):
    """A group of near copies shares most of its keys; before, each key sent links of its own."""
    members, kept = 120, 4
    monkeypatch.setattr(simhash, "KEPT_LINKS", kept, raising=False)
    draw = random.Random(5)
    bits = [draw.getrandbits(63) for _ in range(simhash.PRINTS)]
    rows = [(i, p, b ^ (1 << draw.randrange(60))) for i in range(members) for p, b in enumerate(bits)]
    each = spark.createDataFrame(rows, "cid long, print int, fp long")
    found = [(r.a, r.b) for r in simhash._some_links(each, simhash.WIDE_RADIUS, simhash.WIDE_BLOCKS, simhash.TILE_ROWS).collect()]
    assert len(found) <= kept * members and len(set(found)) == len(found)
    assert {x for pair in found for x in pair} == set(range(members))  # whoever has a link is in one


@pytest.mark.parametrize("kept", [1, 16])
def test_links_that_were_not_kept_are_found(spark, monkeypatch, kept):
    monkeypatch.setattr(simhash, "KEPT_LINKS", kept, raising=False)
    draw = random.Random(9)
    texts, base = [], [f"w{i}" for i in range(60)]
    for i in range(70):  # a chain of small edits: neighbours are similar, far ones are not
        if i % 2:
            base[draw.randrange(60)] = f"e{i}"
        texts.append(" ".join(base))
    prints = [simhash._sketch(t, simhash.SHINGLE_WORDS, simhash.PRINTS, simhash.SIMILAR_WORDS) for t in texts]
    low = list(range(len(texts)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, (fi, si, _) in enumerate(prints):
        for j, (fj, sj, _) in enumerate(prints[:i]):
            near = any((x ^ y).bit_count() <= simhash.WIDE_RADIUS for x, y in zip(fi, fj))
            shared = len(np.intersect1d(si, sj))
            if near and shared >= simhash.SIMILARITY * (len(si) + len(sj) - shared):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert found == {i: root(i) for i in range(len(texts))}
    assert len(set(found.values())) < len(texts) / 2


def test_bitmaps_never_rule_out_similar_sets():
    draw = np.random.default_rng(3)
    for size in (3, 40, 600, 5000):
        a = np.unique(draw.integers(-(2**31), 2**31, size)).astype(np.int32)
        b = np.unique(np.concatenate([a[draw.random(len(a)) < 0.9], draw.integers(-(2**31), 2**31, size // 10).astype(np.int32)]))
        maps = [np.frombuffer(simhash._bitmap(s), dtype=np.uint64) for s in (a, b)]
        most = simhash._shared_at_most(np.array([len(a)]), maps[0][None], len(b), maps[1])
        assert len(np.intersect1d(a, b)) <= most[0] <= min(len(a), len(b))
