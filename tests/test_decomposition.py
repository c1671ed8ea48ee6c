"""The decomposition in the JVM against the library's, character by character and in texts."""

import random
import unicodedata

from pyspark.sql import functions as F

from terrane.functions import text as T


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def test_every_character_of_the_scripts(spark):
    points = [p for begin, end in T._SCRIPTS for p in range(begin, end)] + list(range(1, 0xA0))
    df = spark.createDataFrame([(p, f"a{chr(p)}b") for p in points], "p int, t string")
    wrong = [r.p for r in df.select("p", "t", T.decomposed(F.col("t")).alias("d")).collect() if r.d != plain(r.t)]
    assert wrong == []


def test_texts_of_mixed_scripts(spark):
    rng = random.Random(2)
    letters = [chr(p) for begin, end in T._SCRIPTS for p in range(begin, end)] + list("abc XYZ.'\n") + ["\U0001f600", "中", "e\u0301", "\ufdfa"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", "\u0301", "ﷺ", "لا", "ﻻ", "שׁ", "ﬁx…"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", T.decomposed(F.col("t")).alias("d")).collect()}
    assert got[-1] is None and all(got[i] == plain(t) for i, t in enumerate(texts))
    both = df.select(T.normalise(F.col("t")).alias("a"), T.normalise(F.col("t"), exact_unicode=True).alias("b")).where("a <> b")
    assert both.count() == 0
