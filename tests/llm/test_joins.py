"""Vector, url and benchmark operators, and the pipeline, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import common, decontamination, packing, urls, vectors


@pytest.mark.parametrize("tile_rows,block_dims", [(1024, 16), (8, 4), (40, 12)])
def test_vector_links_equal_brute_force(spark, tile_rows, block_dims):
    rng = np.random.default_rng(4)
    rows = []
    centers = rng.standard_normal((12, 24))
    for i in range(260):
        c = centers[i % 12] + rng.standard_normal(24) * rng.choice([0.02, 0.08, 0.15, 1.0])
        rows.append((i, [float(np.float32(x)) for x in c], i % 3))
    rows += [(300 + k, rows[k][1], rows[k][2]) for k in range(8)]  # exact copies
    rows += [(400, [2.0 * x for x in rows[0][1]], rows[0][2]), (401, None, 1), (402, [0.0] * 24, 1), (403, [float("nan")] * 24, 1), (404, [None] + [1.0] * 23, 1)]
    rows += [(405, rows[0][1], None), (406, [], 1), (407, [float("inf")] + [1.0] * 23, 1), (408, rows[0][1][:12], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cid", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, tile_rows=tile_rows, block_dims=block_dims).collect()}
    good = [(i, np.array(v), label) for i, v, label in rows if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _, _ in rows}
    for a, x, la in good:
        for b, y, lb in good:
            if a != b and la == lb and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98:
                links[a].add(b)
    assert sum(map(len, links.values())) > 100
    for i in links:
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        assert got[i] == (len(links[i]), min(reach), i == min(reach)), i


@pytest.mark.parametrize("bits", [0, 3, 9])
def test_blocks_bring_all_close_pairs_together_once(bits):
    rng = np.random.default_rng(bits)
    x = vectors.unit(np.concatenate([rng.standard_normal((500, 32)), np.repeat(rng.standard_normal((40, 32)), 5, axis=0) + 0.05 * rng.standard_normal((200, 32))]))
    z, budget = x[:, :8], 0.012
    far = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    want = {(j, i) for i, j in np.argwhere(far <= budget) if j < i}
    assert len(want) > 200
    at, code, home = vectors.visits(z, budget, bits)
    assert len(at) == len(z) if not bits else len(at) < 0.6 * len(z) * 2**bits
    found = []
    for cell in np.unique(code):
        rows = at[code == cell]
        for i, j in vectors.near(z[rows], home[code == cell], budget, leaf=256):
            found += [tuple(sorted(p)) for p in zip(rows[i].tolist(), rows[j].tolist())]
    assert len(found) == len(set(found)) and set(found) == want


def test_vectors_without_rows_or_ids(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicates(none).count() == 0
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, None, 1)], "vec_id long, embedding array<float>, label int")
    rows = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()), key=str)
    assert rows == [(5, 1, 5, True), (None, 0, None, False), (None, 1, 5, False)]


def test_urls_are_split_and_judged(spark):
    cases = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("https://www.example.com/de/x", "www.example.com", "/de/x", "example.com/de/", "block"),
        ("https://notexample.com/de/x", "notexample.com", "/de/x", None, "allow"),
        ("ftp://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://x.net?u=http://y.org/fr/", "x.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("HTTP://ÀB.org/fr/a", "Àb.org", "/fr/a", "org/fr/", "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], "x", "y") for i, c in enumerate(cases)], "page_id long, url string, host string, rule string")
    none = spark.createDataFrame([], "page_id long, bad int")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, none).collect()}
    assert rows == {i: c[1:] for i, c in enumerate(cases)}
    assert urls.filter_urls(df.where("false"), none).count() == 0


def test_reputation_is_kept_by_the_registered_name(spark):
    hosts = ["user@Shop.example.com:8080", "example.com.", "10.0.0.1", "[::1]:80", "a.b.com.sg", "foo.github.io", "localhost", "", "x.y.co.uk.", "a@b@c.d.org", "s.x.s3.amazonaws.com"]
    df = spark.createDataFrame([(h.lower(),) for h in hosts], "host string").select("host", urls.host_name(F.col("host")).alias("name"))
    domain, suffix = urls.split_host(F.col("name"))
    got = {r.host: (r.name, r.d, r.s) for r in df.select("host", "name", domain.alias("d"), suffix.alias("s")).collect()}
    assert list(got.values()) == [
        ("shop.example.com", "example.com", "com"), ("example.com", "example.com", "com"), ("10.0.0.1", "10.0.0.1", "10.0.0.1"), ("[::1]", "[::1]", "[::1]"), ("a.b.com.sg", "b.com.sg", "com.sg"),
        ("foo.github.io", "foo.github.io", "github.io"), ("localhost", "localhost", "localhost"), ("", "", ""), ("x.y.co.uk", "y.co.uk", "co.uk"), ("c.d.org", "d.org", "org"), ("s.x.s3.amazonaws.com", "x.s3.amazonaws.com", "s3.amazonaws.com"),
    ]
    pages = spark.createDataFrame([(1, "http://u@Bad.net.:81/x"), (2, "http://bad.net/")], "page_id long, url string")
    rows = {r.page_id: r for r in urls.filter_urls(pages, spark.createDataFrame([(2, 1)], "page_id long, bad int"), rules=()).collect()}
    assert rows[1].host == "u@bad.net.:81" and rows[1].share == rows[2].share


def test_reputation_shrinks_and_blocks_bad_hosts(spark):
    pages, bad = [], []
    rng = random.Random(0)
    for i in range(900):
        host = ("spam.bad.com", "a.good.com", "b.good.com")[i % 3] if i < 880 else ("new.bad.com" if i < 890 else "tiny.other.org")
        pages.append((i, f"http://{host}/{i}"))
        if i < 880 or i == 890:
            bad.append((i, int(rng.random() < (0.97 if "spam" in host else 0.05)) if i < 880 else 1))
    out = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int"))
    by = {r.host: r for r in out.collect()}
    assert by["spam.bad.com"].verdict == "block" and by["a.good.com"].verdict == "allow"
    assert by["tiny.other.org"].verdict == "allow" and by["tiny.other.org"].share < 1  # one bad page proves little
    assert by["new.bad.com"].share > by["a.good.com"].share  # it stands by its domain


BENCH = [
    (1, "A train leaves Boston with 120 passengers and travels 35 km in one hour before it meets Alice at the old bridge near the river"),
    (2, "how many apples remain in the basket when four children each take two of them and then return one apple to the farmer"),
    (3, "too short"),
]
LEAK = BENCH[0][1].replace("120", "77").replace("35 km", "90 miles").replace("Boston", "Berlin").replace("Alice", "Marta")
MIXED = "the basket holds fruit. " + " ".join(BENCH[1][1].split()[:7])


def test_templates_catch_reparameterised_questions(spark):
    texts = [
        ("exact", "before " + BENCH[1][1] + " after", "2"),
        ("changed numbers and names", "Some words first. " + LEAK + ". And more.", "1"),
        ("upper case differs in form", BENCH[1][1].replace(" ", "  \n"), "2"),
        ("a part only", MIXED, ""),
        ("clean", "nothing of the kind is asked in this text about trains and apples and children", ""),
        ("null", None, ""),
        ("empty", "", ""),
        ("both", BENCH[0][1] + " " + BENCH[1][1] + " " + LEAK, "1,2"),
    ]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, (_, t, _) in enumerate(texts)], "doc_id long, text string, items string, _k1 int")
    bench = spark.createDataFrame([*BENCH, (4, None)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.decontaminate(df, bench).collect()}
    for i, (name, _, want) in enumerate(texts):
        assert rows[i].items == want, name
        assert rows[i].contaminated == bool(want)
    assert decontamination.decontaminate(df.where("false"), bench).count() == 0
    assert not any(r.contaminated for r in decontamination.decontaminate(df, bench.where("false")).collect())
    kept = decontamination.clean(df, decontamination.contaminated_texts(df, bench))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def test_slots_must_be_filled_alike(spark):
    item = "if Tom has 5 coins and gives 5 of them to Ann then Tom keeps the rest and Ann counts 5 new coins for the family"
    other = item.replace("5 coins", "8 coins").replace("gives 5", "gives 31").replace("counts 5", "counts 64").replace("Tom keeps", "Eve keeps").replace("Ann counts", "Joe counts")
    same = item.replace("5", "9").replace("Tom", "Eve").replace("Ann", "Joe")
    df = spark.createDataFrame([(0, other), (1, same)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = {r.doc_id: r.contaminated for r in decontamination.decontaminate(df, bench, literals=3).collect()}
    assert rows == {0: False, 1: True}


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    prose = lambda n=80: " ".join(rng.choices(words, k=n))
    docs = [(i, prose() if i % 4 else " ".join(["BUY!!"] * 60), "en", "s", 0) for i in range(120)]
    base = docs[1][1]
    docs += [(200, base, "en", "s", 0), (201, prose() + " " + BENCH[1][1], "en", "s", 0), (202, "mail jo.do@mail.example.com " + prose(), None, None, None), (203, None, "en", "s", 0), (1, base, "en", "s", 0), (None, "no id " + prose(), "en", "s", 0)]
    d = str(tmp_path)
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("grade", F.lit("own"))
    table.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]
    current, ids = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        current = stage(spark, current, d)
        current.write.parquet(f"{d}/stage{k}")
        current = spark.read.parquet(f"{d}/stage{k}")
        assert current.schema == table.schema or current.columns == table.columns
        ids.append(sorted((r.doc_id for r in current.collect()), key=str))
    assert not {i for i in range(0, 120, 4)} & set(ids[0]) and {i for i in range(120) if i % 4} <= set(ids[0])
    assert 200 in ids[0] and 200 not in ids[1] and ids[1].count(1) == 1
    assert 201 in ids[1] and 201 not in ids[2]
    last = {r.doc_id: r for r in current.collect()}
    assert "jo.do@" not in last[202].text and last[202].grade == "own" and last[202].n_chars == len(last[202].text)
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} == set(ids[3])
    assert max(r.offset + r.length for r in packed) <= packing.CAPACITY


@pytest.mark.parametrize("kind", ["path", "random", "two_hubs", "none"])
def test_components_stop_only_when_done(spark, kind):
    """The early stop never leaves a component in parts: against a plain union-find."""
    draw = random.Random(kind)
    edges = {
        "path": [(i, i + 1) for i in range(60)],
        "random": [(draw.randrange(90), draw.randrange(90)) for _ in range(55)],
        # every node but one has a single smaller neighbour; 50 hangs on both hubs
        "two_hubs": [(0, i) for i in range(40, 51)] + [(1, i) for i in range(50, 60)],
        "none": [],
    }[kind]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_joined_rules_fit_like_rules_in_the_plan(spark):
    rng = random.Random(12)
    hosts = ["a.org", "b.a.org", "org", "x.b.a.org", "net", "a..net", "net.", "", "aorg"]
    paths = ["", "/", "/en/", "/en/x", "/e"]
    rules = sorted({(h, p) for h in hosts for p in paths if rng.random() < 0.5})
    rules = [(rng.choice(["allow", "block"]), h, p) for h, p in rules]
    urls_ = [f"http://{h}{p}{q}" for h in [*hosts, "z.net", "c.d.org", "b.aorg"] for p in paths for q in ("", "x/y")] + ["none", None]
    df = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    few = sorted(map(tuple, urls.filter_urls(df, none, rules=rules).collect()))
    table = spark.createDataFrame(rules, "action string, host string, path string")
    assert sorted(map(tuple, urls.filter_urls(df, none, rules=table).collect())) == few and any(r[3] for r in few)
    many = rules + [("block", f"h{i}.example", "/") for i in range(600)]
    assert sorted(map(tuple, urls.filter_urls(df, none, rules=many).collect())) == few


@pytest.mark.parametrize("most,tile_rows", [(500_000, 10), (20, 10), (0, 10), (0, 1000)])
def test_tiles_bring_every_pair_of_a_key_together_once(spark, tmp_path, monkeypatch, most, tile_rows):
    rows = [(k, 1000 * k + i) for k, n in enumerate([1, 2, 35, 9, 1, *[3] * 30, 12]) for i in range(n)]
    spark.createDataFrame(rows, "k long, node long").write.parquet(f"{tmp_path}/rows")
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    keyed = spark.read.parquet(f"{tmp_path}/rows").select("node", F.explode(F.array(F.col("k"), F.col("k") + 100)).alias("key"))
    tiles = common.tiled(keyed, "node", tile_rows)
    plan = tiles._jdf.queryExecution().sparkPlan().toString()  # what is exploded is never broadcast, nor are many counts
    assert "BuildLeft" not in plan and ("BuildRight" in plan) == (most > 0 or tile_rows == 1000)
    pairs = []
    for (key, _), part in tiles.toPandas().groupby(["key", "tile"]):
        members = list(zip(part["node"], part["chunk"], part["cross"]))
        pairs += [(key, *sorted((a, b))) for i, (a, c, cross) in enumerate(members) for b, d, _ in members[:i] if not cross or c != d]
    want = {(k + more, a, b) for k, a in rows for j, b in rows for more in (0, 100) if j == k and a < b}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
