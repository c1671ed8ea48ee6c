"""Frequent phrases against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from terrane.llm import phrases


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def pieces(text):
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text or "")):
        words = re.findall("[^ \t]+", piece)
        if words:
            yield words


def plain(rows, least, top, percent=80, longest=4):
    out = []
    by = {}
    for lang, text in rows:
        by.setdefault("und" if lang is None else lang, []).append(text)
    for lang, texts in by.items():
        count = Counter()
        for t in texts:
            for words in pieces(t):
                for k in range(1, longest + 1):
                    count.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        n = sum(c for p, c in count.items() if len(p) == 1)
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        held = {}
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        held[p[i:j]] = max(held.get(p[i:j], 0), a)
        kept = []
        for p, a in candidates.items():
            if 100 * held.get(p, 0) >= percent * a:
                continue
            score, _, left, right = min((2000000 * a // (count[p[:c]] + count[p[c:]]), c, count[p[:c]], count[p[c:]]) for c in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def check(spark, rows, least, top):
    df = spark.createDataFrame([(lang, text, "clash", 1) for lang, text in rows], "lang string, text string, phrase string, n int")
    got = sorted(tuple(r) for r in phrases.collocations(df, least=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain(rows, least, top)
    return got


def test_collocations_equal_plain_counting(spark):
    rng = random.Random(5)
    words = ["a", "b", "Été", "the", "The", "x y", "\U0001f600", "ß", "of"]
    breaks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x0c", "\r", "! "]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(breaks) for _ in range(rng.randrange(60)))) for _ in range(80)]
    rows += [("en", None), ("fr", ""), ("fr", " \t.;"), ("en", "one two three four five " * 400), rows[0], rows[0]]
    assert len(check(spark, rows, 4, 25)) > 60
    check(spark, rows, 3, 2000)


def test_words_run_over_neither_texts_nor_pieces(spark):
    rows = [("en", "ab"), ("en", "cd"), ("en", "ab"), ("en", "cd"), ("en", "ab.cd"), ("en", "ab cd ab cd ab")]
    got = check(spark, rows, 2, 9)
    assert all(a == 2 for _, _, _, a, *_ in got)  # only the last text has phrases


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


@pytest.mark.parametrize("held", [1 << 20, 40])
def test_held_counts_are_merged_and_flushed(monkeypatch, held):
    monkeypatch.setattr(phrases, "_HELD", held)
    rng = np.random.default_rng(1)
    counts, buckets, holder, rows = Counter(), Counter(), phrases.Held(30), []
    for _ in range(20):
        some = rng.integers(0, 300, 50)
        counts.update(some.tolist())
        rows += holder.phrases(pa.array(["en"] * 50), pa.array([str(v) for v in some]), pa.array(np.ones(50, dtype=np.int64)))
        ids = rng.integers(0, 1 << 18, 60) // 4096 * 4096
        buckets.update(ids.tolist())
        rows += holder.hashed(ids)
    rows += [*holder.phrase_rows(), *holder.bucket_rows()]
    got, summed = Counter(), Counter()
    for batch in rows:
        for r in batch.to_pylist():
            if r["part"] is None:
                got[int(r["phrase"])] += r["count"]
            else:
                for i, c in zip(np.frombuffer(r["ids"], "uint16"), np.frombuffer(r["sums"], "uint8")):
                    summed[(r["part"] << 16) + int(i)] += int(c)
    assert got == counts
    assert {b: min(30, c) for b, c in summed.items()} == {b: min(30, c) for b, c in buckets.items()}


def test_hashes_don_t_depend_on_the_slice():
    texts = pa.array(["", "zebra", "a", "é", "zebra a"])
    whole = phrases.text_hashes(texts)
    assert len(set(whole.tolist())) == 5
    assert (phrases.text_hashes(texts.slice(2)) == whole[2:]).all()
    one, other = phrases.Words(texts, [0] * 5, ["en"]), phrases.Words(texts.slice(4), [0], ["en"])
    assert one.hashes(2, np.array([3])).tolist() == other.hashes(2, np.array([0])).tolist()
