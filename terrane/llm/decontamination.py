"""Benchmark decontamination by templates: a question stays itself when its numbers and names change.

Words are runs of letters and digits, points and commas between digits included. A number in digits or words becomes
``#``, a word with a capital ``@``, a unit of measure ``%``; others are lower-cased. A value is one slot
whatever words it takes: runs of number words, of names, and a number with its unit are one token of the template.
Windows of ``window`` tokens are hashed and joined with those of the benchmark; windows with fewer than ``literals``
tokens that are no placeholder prove nothing and are left out. Where windows of one item cover
``coverage`` of it, the slots are compared: along each alignment, one value of the item must
always be filled by one value of the document. Alignments that fail this by themselves cannot
cancel others that cover the item alone. Windows of equal words (case aside) are a second way, for
items or copies whose words are mostly placeholders; they cover every item. Items of fewer than
``MIN_WORDS`` words say too little inside a text and are found where they are the whole of it.
DataFrame functions only.

What is found depends on the text alone, so documents are told apart by two hashes of their text,
and copies share one verdict. Most texts hold nothing of a benchmark, so texts without a clue are left out first: each window has
literal words that stand together in it, and a text that holds the window holds these too, whatever fills its slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 8
LITERALS = 5
MIN_WORDS = 4
COVERAGE = 0.6
CONSISTENT = 0.8
# Clues that are part of the plan; more are joined.
CLUES_IN_PLAN = 5_000
# Units of measure.
UNITS = (
    "mm cm km kg mg ml cl dl lb lbs oz ft inch inches feet foot yard yards mile miles meter meters metre metres kilometer kilometers"
    " gram grams kilogram kilograms ton tons liter liters litre litres gallon gallons second seconds minute minutes hour hours day days"
    " week weeks month months year years percent dollar dollars cent cents euro euros pound pounds degree degrees mph kmh kw kwh mb gb"
).split()


# Numbers in words ("second" is a unit here).
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    " thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen first third fourth fifth sixth seventh eighth ninth tenth"
).split()


_POINT = "\ue000"  # a private character: stands for a point or comma between digits


def words_of(text):
    """Words of a text; an empty list for null and for texts without letters and digits."""
    joined = F.replace(F.coalesce(text, F.lit("")), F.lit(_POINT), F.lit(" "))
    joined = F.regexp_replace(joined, r"(\p{N})[.,](?=\p{N})", f"$1{_POINT}")  # neighbours share a digit
    return F.filter(F.split(joined, rf"[^\p{{L}}\p{{N}}{_POINT}]+"), lambda w: w != "")


def placeholder(word):
    """The type of slot that a word is, or null for a literal word."""
    first = F.substring(word, 1, 1)
    return (
        F.when(((first >= "0") & (first <= "9")) | F.lower(word).isin(*NUMBER_WORDS), F.lit("#"))
        .when(first != F.lower(first), F.lit("@"))
        .when(word.isin(*UNITS), F.lit("%"))
    )


def _continues(before, here):
    """Whether a word of this type belongs to the value that its predecessor's type began."""
    return F.coalesce((before == here) | ((before == "#") & (here == "%")), F.lit(False))


def _typed(words):
    return F.transform(words, lambda w: F.struct(w.alias("w"), placeholder(w).alias("p")))


def _templates(typed: str):
    """Hashes of the template's tokens, of a column of words with their types."""
    before = F.concat(F.array(F.lit(None).cast("struct<w:string,p:string>")), F.slice(typed, 1, F.greatest(F.size(typed) - 1, F.lit(0))))
    pairs = F.filter(F.arrays_zip(F.col(typed).alias("here"), before.alias("before")), lambda z: ~_continues(z["before"]["p"], z["here"]["p"]))
    return F.transform(pairs, lambda z: F.xxhash64(F.coalesce(z["here"]["p"], F.lower(z["here"]["w"]))))


def with_tokens(rows: DataFrame, words: str, out: str) -> DataFrame:
    """Rows with the template's tokens (``p`` type or null, ``v`` value in lower case) of a column of words."""
    typed = rows.withColumn("_typed", _typed(F.col(words)))
    begins = F.filter(F.sequence(F.lit(0), F.size("_typed") - 1), lambda i: (i == 0) | ~_continues(F.get("_typed", i - 1)["p"], F.get("_typed", i)["p"]))
    begun = common.materialize(typed.withColumn("_begins", F.when(F.size("_typed") > 0, begins).otherwise(F.array().cast("array<int>"))))
    run = lambda i, j: F.slice("_typed", i + 1, F.coalesce(F.get("_begins", j + 1), F.size("_typed")) - i)
    value = lambda i, j: F.array_join(F.transform(run(i, j), lambda t: F.lower(t["w"])), " ")
    return begun.withColumn(out, F.transform("_begins", lambda i, j: F.struct(F.get("_typed", i)["p"].alias("p"), value(i, j).alias("v")))).drop("_typed", "_begins")


def _literals(words):
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _windows(templates, size, *seed):
    """Hash of each window of ``size`` template words; none if there are fewer words."""
    last = F.size(templates) - size + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*seed, F.lit(size), F.slice(templates, i, size)))


def text_key(text):
    """Two independent hashes of a text."""
    return F.xxhash64(text).alias("_k1"), F.hash(text, F.length(text)).alias("_k2")


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint for a written table of few rows; larger ones are joined by a shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= common.BROADCAST_ROWS else df


def benchmark_windows(items: DataFrame, literals: int = LITERALS) -> DataFrame:
    """``ik, size, n_windows, at, w``: the telling windows of each item.

    Items of fewer than ``window`` tokens have one window of their own length; those without a
    telling window are recognised by their literal windows alone.
    """
    hashes = F.transform("item_tokens", lambda t: F.xxhash64(F.coalesce(t["p"], t["v"])))
    typed = items.where("not whole").select("ik", "item_tokens", F.col("token_size").alias("size"), hashes.alias("t"))
    each = typed.select("ik", "item_tokens", "size", F.posexplode(_windows(F.col("t"), F.col("size"))).alias("at", "w"))
    literal = F.size(F.filter(F.slice("item_tokens", F.col("at") + 1, F.col("size")), lambda t: t["p"].isNull()))
    each = each.where(literal >= F.least(F.lit(literals), F.col("size") - 1)).drop("item_tokens")
    return each.withColumn("n_windows", F.count("*").over(Window.partitionBy("ik")))  # the windows of one item


def literal_windows(items: DataFrame) -> DataFrame:
    """``ik, size, n_windows, at, w``: all windows of each item, of its words with case folded; short items as a whole."""
    words = _literals(F.col("item_words"))
    hashes = F.when(F.col("whole"), F.array(_whole(words))).otherwise(_windows(words, F.col("size"), F.lit("=")))
    n = F.when(F.col("whole"), 1).otherwise(F.size("item_words") - F.col("size") + 1)
    return items.select("ik", "size", n.cast("long").alias("n_windows"), F.posexplode(hashes).alias("at", "w"))


def _whole(literals):
    """Hash of a whole text's words."""
    return F.xxhash64(F.lit("whole"), literals)


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``ik, item, item_words, item_tokens, size, token_size, whole``: ``ik`` stands for an id and its words.

    Repeated rows are one item, one id with two texts is two. Items without words can't be found and go.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(text).cast("string")).alias("item_words")).where(F.size("item_words") > 0)
    items = items.select(F.xxhash64("item", "item_words").alias("ik"), "item", "item_words", F.least(F.lit(window), F.size("item_words")).alias("size"), (F.size("item_words") < MIN_WORDS).alias("whole"))
    items = with_tokens(items.dropDuplicates(["ik"]), "item_words", "item_tokens")
    return items.withColumn("token_size", F.least(F.lit(window), F.size("item_tokens")))


def _beside(left, right, by: int, checked: bool = False):
    """Hash of each element of ``left`` with the one ``by`` places on in ``right``; ``checked``: null where one is null or missing."""
    both = lambda x, y: F.xxhash64(x, y)
    return F.zip_with(left, F.slice(right, by + 1, 1 << 30), (lambda x, y: F.when(x.isNotNull() & y.isNotNull(), both(x, y))) if checked else both)


def _let(value, then):
    """``then`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _by_length(hashes, then, checked: bool = False):
    """``then`` of the hashes of 1, 2, 3 and 4 neighbours."""
    fours = lambda h, h2: then(h, h2, _beside(h2, h, 2, checked), _beside(h2, h2, 2, checked))
    return _let(hashes, lambda h: _let(_beside(h, h, 1, checked), lambda h2: fours(h, h2)))


def clues(items: DataFrame, windows: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``n, key``, once each: hashes of ``n`` neighbouring literal words, one of which every text has that holds an item.

    A window's clue are as many of its words as stand together, four at most; of several places the one with the smallest hash, so
    that windows share clues. An item is found where ``coverage`` of its windows are, so any windows that are more than the rest have one
    of these among them; those with the longest clues are taken. ``n`` is null for a window without literal words, and 0 for a whole text.
    """
    literal = F.transform("item_tokens", lambda t: F.when(t["p"].isNull(), F.xxhash64(t["v"])))
    rows = windows.join(items.select("ik", "whole", literal.alias("_t"), _literals(F.col("item_words")).alias("_l")), "ik")

    def best(*hashes):
        found = F.lit(None).cast("struct<n:int,key:bigint>")
        for n, h in enumerate(hashes, 1):
            key = F.array_min(F.slice(h, F.col("at") + 1, F.greatest(F.col("size") - n + 1, F.lit(0))))
            found = F.when(key.isNotNull(), F.struct(F.lit(n).alias("n"), key.alias("key"))).otherwise(found)
        return found

    words = F.when(F.col("exact"), F.col("_l")).otherwise(F.col("_t"))
    whole = F.struct(F.lit(0).alias("n"), F.col("w").alias("key"))
    rows = rows.select("ik", "exact", "n_windows", F.when(F.col("whole"), whole).otherwise(_by_length(words, best, checked=True)).alias("c"))
    place = F.row_number().over(Window.partitionBy("ik", "exact").orderBy(F.col("c.n").desc_nulls_last(), "c.key"))  # the windows of one item
    enough = F.floor((1 - coverage) * F.col("n_windows") + 1e-9) + 1
    return rows.withColumn("_place", place).where(F.col("_place") <= enough).select("c.n", "c.key").distinct()


def suspects(body: DataFrame, found: DataFrame, in_plan: int = CLUES_IN_PLAN) -> DataFrame:
    """The rows of ``body`` (column ``_text``) whose text holds a clue; all of them if a clue has no word.

    Few clues are part of the plan, more are joined.
    """
    found = common.materialize(found)
    few = found.limit(in_plan + 1).collect()
    lengths = {r.n for r in (few if len(few) <= in_plan else found.select("n").distinct().collect())}  # a few numbers
    if None in lengths:
        return body
    literals = _literals(words_of(F.col("_text")))
    whole = lambda h: F.when((F.size(h) > 0) & (F.size(h) < MIN_WORDS), F.array(_whole(h))).otherwise(F.array().cast("array<bigint>"))
    used = lambda *hashes: [(n, h) for n, h in enumerate((whole(hashes[0]), *hashes)) if n in lengths]
    if len(few) <= in_plan:

        def holds(*hashes):
            held = F.lit(False)
            for n, h in used(*hashes):
                keys = [r.key for r in few if r.n == n]
                held = held | F.exists(h, lambda k: k.isin(keys))  # noqa: B023 - made at once
            return held

        return body.where(_by_length(literals, holds))
    all_keys = _by_length(literals, lambda *hashes: F.concat(*[h for _, h in used(*hashes)]))
    # not a column but an expression is exploded: for a column Spark adds a filter on its size, which works it all out again
    hits = body.select(*text_key(F.col("_text")), F.explode(all_keys).alias("key")).join(_small(found.select("key").distinct()), "key", "left_semi")
    keyed = common.materialize(hits.select("_k1", "_k2").distinct())
    return body.select(*text_key(F.col("_text")), "_text").join(_small(keyed), ["_k1", "_k2"], "left_semi").select("_text")


def contaminated_texts(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    literals: int = LITERALS,
    coverage: float = COVERAGE,
    consistent: float = CONSISTENT,
) -> DataFrame:
    """``_k1, _k2, item, covered, consistency``: texts (by their key) that hold a benchmark item."""
    items = common.materialize(benchmark_items(benchmark, item_col, item_text, window))
    slim = benchmark_windows(items, literals).withColumn("exact", F.lit(False)).unionByName(literal_windows(items).withColumn("exact", F.lit(True)))
    slim = common.materialize(slim)  # numbers only: some 50 bytes a row
    sizes = {kind: sorted(r.size for r in slim.select("exact", "size").distinct().collect() if r.exact == kind) for kind in (False, True)}  # at most ``window`` numbers each
    body = docs.select(F.col(text).cast("string").alias("_text")).where("_text is not null")
    worded = suspects(body, clues(items, slim, coverage)).select(*text_key(F.col("_text")), _typed(words_of(F.col("_text"))).alias("typed"))
    hashed = worded.select("_k1", "_k2", _templates("typed").alias("t"), _literals(F.transform("typed", lambda t: t["w"])).alias("l"))
    none = F.array().cast("array<bigint>")
    short = F.when((F.size("l") > 0) & (F.size("l") < MIN_WORDS), F.array(_whole(F.col("l")))).otherwise(none)
    # windows of all sizes and kinds that some item has, in one pass over the documents
    arrays = [_windows(F.col("t"), F.lit(n)) for n in sizes[False]] + [_windows(F.col("l"), F.lit(n), F.lit("=")) for n in sizes[True]]
    exploded = hashed.select("_k1", "_k2", F.explode(F.array(short, *arrays)).alias("ws")).select("_k1", "_k2", F.posexplode("ws").alias("p", "w"))
    hits = exploded.join(_small(slim.drop("size")), "w").select("_k1", "_k2", "ik", "n_windows", "exact", "at", (F.col("p") - F.col("at")).alias("shift"))
    both = hits.groupBy("_k1", "_k2", "ik", "n_windows", "exact", "shift").agg(F.collect_set("at").alias("ats"))  # at most an item's windows
    both = common.materialize(both)
    aligned = both.where("not exact").drop("exact")
    covered = aligned.groupBy("_k1", "_k2", "ik", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_set("ats")))).alias("seen"))
    covered = covered.select("_k1", "_k2", "ik", (F.col("seen") / F.col("n_windows")).alias("covered")).where(F.col("covered") >= coverage)
    covered = common.materialize(covered)
    keys = common.materialize(covered.select("_k1", "_k2").distinct())
    texts = body.select(*text_key(F.col("_text")), "_text").join(_small(keys), ["_k1", "_k2"], "left_semi")
    texts = texts.groupBy("_k1", "_k2").agg(F.min("_text").alias("_text")).select("_k1", "_k2", words_of(F.col("_text")).alias("words"))
    texts = with_tokens(texts, "words", "tokens").drop("words")
    hit = items.join(covered.select("ik").distinct(), "ik", "left_semi").select("ik", "item_tokens", F.col("token_size").alias("size"))
    pairs = aligned.join(covered, ["_k1", "_k2", "ik"]).join(hit, "ik").join(texts, ["_k1", "_k2"])
    # the slots under the windows of one alignment, as (value in the item, value in the document)
    under = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("size") - 1))))
    slots = F.filter(under, lambda i: F.get("item_tokens", i)["p"].isNotNull())
    filled = F.array_distinct(F.transform(slots, lambda i: F.struct(F.get("item_tokens", i)["v"].alias("item"), F.get("tokens", i + F.col("shift"))["v"].alias("doc"))))
    pairs = pairs.select("_k1", "_k2", "ik", "n_windows", "covered", "ats", filled.alias("filled"))
    values = F.size(F.array_distinct(F.transform("filled", lambda s: s["item"])))
    pairs = pairs.withColumn("values", values).withColumn("extra", F.size("filled") - values)
    # all alignments together, and those that are consistent by themselves
    alone = _consistency("values", "extra") >= consistent
    scored = pairs.groupBy("_k1", "_k2", "ik", "n_windows", "covered").agg(
        F.sum("values").alias("values"),
        F.sum("extra").alias("extra"),
        F.sum(F.when(alone, F.col("values"))).alias("own_values"),
        F.sum(F.when(alone, F.col("extra"))).alias("own_extra"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.when(alone, F.col("ats")))))).alias("own_seen"),
    )
    together = _consistency("values", "extra") >= consistent
    own_covered = F.col("own_seen") / F.col("n_windows")
    found = scored.where(together | (own_covered >= coverage)).select(
        "_k1", "_k2", "ik",
        F.when(together, F.col("covered")).otherwise(own_covered).alias("covered"),
        F.when(together, _consistency("values", "extra")).otherwise(_consistency("own_values", "own_extra")).alias("consistency"),
    )
    found = common.materialize(found)
    same = both.where("exact").groupBy("_k1", "_k2", "ik", "n_windows").agg((F.size(F.array_distinct(F.flatten(F.collect_set("ats")))) / F.col("n_windows")).alias("covered"))
    same = same.where(F.col("covered") >= coverage).join(found.select("_k1", "_k2", "ik"), ["_k1", "_k2", "ik"], "left_anti")
    same = same.select("_k1", "_k2", "ik", "covered", F.lit(1.0).alias("consistency"))
    return found.unionByName(same).join(items.select("ik", "item"), "ik").select("_k1", "_k2", "item", "covered", "consistency")


def _consistency(values: str, extra: str):
    return F.when(F.col(values) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.col(extra) / F.col(values)))


def verdicts(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``contaminated, n_items, items, coverage``.

    Null and empty texts are clean. Columns of ours that the input also has are replaced; repeated
    rows and nulls elsewhere pass; an empty table gives no rows.
    """
    ours = ("contaminated", "n_items", "items", "coverage", "_k1", "_k2")
    items = F.array_join(F.transform(F.array_sort(F.collect_set("item")), lambda i: i.cast("string")), ",")
    by_text = found.groupBy("_k1", "_k2").agg(F.countDistinct("item").alias("n_items"), items.alias("items"), F.max("covered").alias("coverage"))
    by_text = _small(common.materialize(by_text))
    names = [c for c in docs.columns if c not in ours]
    keyed = docs.select(*names, *text_key(F.col(text).cast("string")))
    out = keyed.join(by_text, ["_k1", "_k2"], "left")
    return out.select(
        *names,
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """Find benchmark items in every document: ``verdicts`` of ``contaminated_texts``."""
    return verdicts(docs, contaminated_texts(docs, benchmark, text, **options), text)


def clean(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns."""
    keys = _small(common.materialize(found.select("_k1", "_k2").distinct()))
    k1, k2 = text_key(docs[text].cast("string"))
    return docs.join(keys, (k1 == keys["_k1"]) & (k2 == keys["_k2"]), "left_anti")
