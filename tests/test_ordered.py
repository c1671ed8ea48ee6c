"""Sequential rules over dealt rows against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from terrane.operators import ordered, resolve, search


def walk(rows, radius):
    held, out = {}, []
    for key, order, x, y in sorted(rows):
        if key not in held or abs(x - held[key][0]) + abs(y - held[key][1]) > radius:
            held[key] = (x, y)
            out.append((key, order))
    return out


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_last_kept_is_one_walk(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), i, rng.uniform(0, 4), rng.uniform(0, 4)) for i in rng.sample(range(10_000), 500)]
    rows += [("still", i, 1.0, 1.0) for i in range(80)] + [("slow", i, i * 0.3, 0.0) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, ord long, x double, y double")
    got = ordered.last_kept(df, "key", ["ord"], "x", "y", lambda ax, ay, bx, by: abs(ax - bx) + abs(ay - by) > 1.0, parts)
    assert sorted((r.key, r.ord) for r in got.collect()) == walk(rows, 1.0)


def test_a_dropped_entry_hides_none_after_it(spark):
    step = 2200 / 111320
    rows = [("a", 1, "Ariel", 0.0), ("b", 2, "Ariel", step), ("c", 3, "Ariel", 2 * step), ("d", 4, "Ariel", 0.0)]
    rows += [("e", 5, "Unidentified x", 0.0), ("a", 6, "Ariel", 9.0), ("f", 7, "Ariel", None)]
    df = spark.createDataFrame([(i, o, n, 35.0, y) for i, o, n, y in rows], "id string, ord int, name string, x double, y double")
    # d is near a, but c was kept after it: the last one kept counts
    assert sorted(r.id for r in search.distinct_settlements(df).collect()) == ["a", "c", "d"]
    assert search.distinct_settlements(df.where("false")).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 11])
def test_free_slots_are_one_walk(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice("aab"), rng.choice([0, 0, 0, 1, 2, 5, 30]), i) for i in rng.sample(range(5000), 400)]
    taken, want = {}, []
    for stem, level, i in sorted(rows, key=lambda r: r[2]):
        slot = level
        while slot in taken.setdefault(stem, set()):
            slot += 1
        taken[stem].add(slot)
        want.append((i, stem + "-2" * slot))
    df = spark.createDataFrame([(s + "-2" * n, i) for s, n, i in rows] + [(None, 9999)], "key string, ord int")
    got = resolve.unique_ids(df, "key", "ord", parts=parts)
    assert sorted((r.ord, r.unique_id) for r in got.where("key is not null").collect()) == sorted(want)
    assert [r.unique_id for r in got.where("key is null").collect()] == [None]
    assert resolve.unique_ids(df.where("false"), "key", "ord").count() == 0


def test_a_large_mixed_family_is_many_parts(spark):
    n = 30_000
    df = spark.range(n).select(F.concat(F.lit("k"), F.when(F.col("id") % 7 == 0, "-2-2").otherwise("")).alias("key"), F.col("id").alias("ord"))
    got = resolve.unique_ids(df, "key", "ord", parts=6)
    slots = got.select(((F.length("unique_id") - 1) / 2).cast("int").alias("s"))
    assert slots.distinct().count() == n and slots.agg(F.max("s")).first()[0] == n - 1


@pytest.mark.parametrize("parts", [1, 4])
def test_nested_columns_stay_out_of_python(spark, monkeypatch, parts):
    rows = [("ab"[i % 2], i, [float(i)] * (i % 5), {"k": str(i)}) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, ord int, shape array<double>, facts map<string,string>")
    sent, run = [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, *a, **k: sent.append(self.columns) or run(self, *a, **k))
    got = resolve.unique_ids(df, "key", "ord", parts=parts)
    assert got.columns == [*df.columns, "unique_id"]
    assert sorted((r.ord, r["shape"], r.facts, r.unique_id) for r in got.collect()) == [(i, shape, facts, key + "-2" * (i // 2)) for key, i, shape, facts in rows]
    assert sent and not any({"shape", "facts"} & set(columns) for columns in sent)
