"""License scans: ordered signature rules behind a keyword filter.

Texts that hold none of a few words, one of which every rule needs, are done at once. Others are
folded (lower case, runs of white space and comment signs one space) and cut into chunks that
overlap by more than the longest match, so a text of any length is read in linear time. In a chunk
only rules run of whose keywords one occurs; keywords are read off the rules, so none is missed.
Matches are intervals. One that lies inside another is dropped ("lesser general public license"
leaves no "general public license"); of equal ones the rule of higher priority stays.
The base layer finds fixed phrases by words and always stays. DataFrame functions only.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, license_rules

# The base phrases and their labels, and what a word is.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Characters of a chunk, and how far it looks on: more than any match is long.
CHUNK, OVERLAP = 1000, 300


@lru_cache(1)
def rules() -> list[tuple[int, float, str, str]]:
    return license_rules.rules()


@lru_cache(1)
def _gates() -> tuple[list[set[str]], str, list[str]]:
    own, broken = license_rules.gates(rules())
    return own, broken, sorted(set().union(*own) - {license_rules.BROKEN})


def _rule_table():
    """The rules as one constant: one text, not a column for each of their parts."""
    own, _, _ = _gates()
    made = [dict(zip(("order", "strength", "label", "pattern"), r), keywords=license_rules.keywords(r[3]), gates=sorted(g)) for r, g in zip(rules(), own)]
    return F.from_json(F.lit(json.dumps(made)), "array<struct<order:int,strength:double,label:string,pattern:string,keywords:array<string>,gates:array<string>>>")


def _gate_words():
    return F.from_json(F.lit(json.dumps(_gates()[2])), "array<string>")


_MATCH = "struct<start:int,back:int,order:int,label:string,strength:double,matched:string>"
_EMPTY = f"array<{_MATCH}>"


def fold(text):
    """Lower case; each run of white space and comment signs is one space."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("//"), F.lit(" ")), r"[\s\u00A0*#|>]+", " ")


def _chunks(folded):
    """Structs (text, begin, context): pieces of ``CHUNK`` characters with one before and ``OVERLAP`` after."""
    pieces = F.regexp_extract_all(folded, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def made(pieces):
        def one(piece, i):
            before = F.when(i > 0, F.right(F.get(pieces, i - 1), F.lit(1))).otherwise(F.lit(""))
            after = F.coalesce(F.substr(F.get(pieces, i + 1), F.lit(1), F.lit(OVERLAP)), F.lit(""))
            return F.struct(F.concat(before, piece, after).alias("text"), (i * CHUNK).alias("begin"), F.length(before).alias("context"))

        return F.transform(pieces, one)

    return F.flatten(F.transform(F.array(pieces), made))


def _rule_matches(chunk, rule):
    """The matches of one rule that start in a chunk: what lies between them tells where they are."""
    pattern = rule["pattern"]
    zipped = F.arrays_zip(F.split(chunk["text"], pattern, -1).alias("gap"), F.regexp_extract_all(chunk["text"], pattern, F.lit(0)).alias("hit"))

    def one(state, z):
        start = state["at"] + F.length(z["gap"])
        place = start - chunk["context"]
        begin = chunk["begin"] + place
        hit = F.struct(begin.cast("int").alias("start"), (-begin - F.length(z["hit"])).cast("int").alias("back"), rule["order"].alias("order"), rule["label"].alias("label"), rule["strength"].alias("strength"), z["hit"].alias("matched"))
        mine = z["hit"].isNotNull() & (place >= 0) & (place < CHUNK)
        found = F.when(mine, F.concat(state["found"], F.array(hit))).otherwise(state["found"])
        return F.struct((start + F.coalesce(F.length(z["hit"]), F.lit(0))).alias("at"), found.alias("found"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(_EMPTY).alias("found"))
    return F.aggregate(zipped, first, one)["found"]


def _chunk_matches(chunk, table):
    """All matches that start in one chunk, by start, the longest first, then by priority."""
    found = F.filter(_gate_words(), lambda w: F.contains(chunk["text"], w))
    found = F.concat(found, F.when(chunk["text"].rlike(_gates()[1]), F.array(F.lit(license_rules.BROKEN))).otherwise(F.array().cast("array<string>")))

    def of(found):
        fitting = F.filter(table, lambda r: F.arrays_overlap(r["gates"], found) & F.exists(r["keywords"], lambda k: F.contains(chunk["text"], k)))
        matches = F.array_sort(F.flatten(F.transform(fitting, lambda r: _rule_matches(chunk, r))))
        return F.when(F.size(found) > 0, matches).otherwise(F.array().cast(_EMPTY))

    return F.flatten(F.transform(F.array(found), of))


def _outermost(matches, reach):
    """Matches of one chunk that no other holds; ``reach`` is where those of the chunk before end."""

    def one(state, m):
        end = -m["back"]
        inside = state["reach"] >= end
        return F.struct(F.greatest(state["reach"], end).alias("reach"), F.when(inside, state["found"]).otherwise(F.concat(state["found"], F.array(m))).alias("found"))

    return F.aggregate(matches, F.struct(reach.alias("reach"), F.array().cast(_EMPTY).alias("found")), one)["found"]


def _resolved(by_chunk):
    def ends(i):
        return F.coalesce(F.array_max(F.transform(F.get(by_chunk, i - 1), lambda m: -m["back"])), F.lit(0))

    kept = F.flatten(F.transform(by_chunk, lambda found, i: _outermost(found, F.when(i > 0, ends(i)).otherwise(F.lit(0)))))
    return F.transform(kept, lambda m: F.struct(m["label"].alias("label"), m["strength"].alias("strength"), m["start"].alias("start"), (-m["back"]).alias("end"), m["matched"].alias("matched")))


def _stands(parts: list[str]):
    """Whether the words from place i on are these."""

    def at(i):
        same = F.lit(True)
        for k, part in enumerate(parts):
            same &= F.coalesce(F.get("_words", i + k) == part, F.lit(False))
        return same

    return at


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_words, base_starts, base_labels, matches, labels, score`` for each document.

    ``base_starts`` are the word numbers at which base phrases stand, ``matches`` the rule matches
    (label, strength, start and end in the folded text, matched text) in order, ``labels`` the
    labels of both, sorted. Null texts count as empty. Null ids and repeated rows keep their rows;
    an empty table gives none; other columns are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), body.alias("_text"))
    rows = rows.withColumn("_low", F.lower("_text"))
    _, broken, words = _gates()
    gate = F.col("_low").rlike(broken)
    for word in words:
        gate |= F.contains("_low", F.lit(word))
    rows = rows.withColumn("_gate", gate).withColumn("_phrase", F.contains("_low", F.lit("license")) | F.col("_text").rlike("(?i)license")).drop("_low")
    words = F.when(F.col("_phrase"), F.regexp_extract_all(common.fold_ascii(F.col("_text")), F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("n_words", F.regexp_count("_text", F.lit(WORD)).cast("long")).withColumn("_words", words)
    places = F.sequence(F.lit(0), F.size("_words") - 1)
    starts, labels = [], []
    for phrase, label in PHRASES:
        found = F.when(F.col("_phrase") & (F.size("_words") > 0), F.filter(places, _stands(phrase.split())))
        found = F.coalesce(found, F.array().cast("array<int>"))
        starts.append(found)
        labels.append((found, label))
    rows = rows.withColumns({f"_starts{i}": s for i, s in enumerate(starts)})
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"_starts{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]))
    table = _rule_table()
    by_chunk = F.transform(_chunks(fold(F.col("_text"))), lambda c: _chunk_matches(c, table))
    rows = rows.select(
        "_id",
        "n_words",
        F.array_sort(F.concat(*[F.col(f"_starts{i}") for i in range(len(PHRASES))])).alias("base_starts"),
        F.array_sort(base_labels).alias("base_labels"),
        F.when(F.col("_gate"), by_chunk).otherwise(F.array().cast(f"array<{_EMPTY}>")).alias("_by_chunk"),
    )
    rows = rows.withColumn("matches", _resolved(F.col("_by_chunk")))
    method = F.transform("matches", lambda m: m["label"])
    strongest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["strength"])), F.lit(0.0))
    score = F.greatest(strongest, F.when(F.size("base_labels") > 0, F.lit(0.6)).otherwise(F.lit(0.0)))
    return rows.select(
        F.col("_id").alias(id_col), "n_words", "base_starts", "base_labels", "matches", F.array_sort(F.array_distinct(F.concat("base_labels", method))).alias("labels"), score.alias("score")
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and labels as plain columns."""
    return found.select(
        id_col,
        "n_words",
        F.size("base_starts").cast("long").alias("n_base"),
        F.array_min("base_starts").cast("long").alias("first_word"),
        F.array_max("base_starts").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
