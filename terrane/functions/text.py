"""Text functions as Column expressions; Arrow functions only for NFKD and the sequence ratio."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from terrane.config import ARTICLES, SETTINGS, TRANSLITERATIONS


@lru_cache(1)
def _accent_tables() -> tuple[str, str]:
    """Latin letters with marks and the letters below them, from their canonical decompositions."""
    pairs = []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(point):
            pairs.append((chr(point), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text: Column) -> Column:
    """Latin letters without their marks; combining marks go. Stays in the JVM."""
    marked, plain = _accent_tables()
    return F.regexp_replace(F.translate(text, marked, plain), r"\p{M}+", "")


#: Blocks of the scripts that names are written in here: Latin with its signs, Hebrew, Arabic, and their presentation forms.
_SCRIPTS = ((0xA0, 0x370), (0x590, 0x780), (0x8A0, 0x900), (0x1AB0, 0x1B00), (0x1DC0, 0x1F00), (0x2000, 0x2190), (0xFB00, 0xFE30), (0xFE70, 0xFF00), (0xFF00, 0xFFF0))


def _class(points: list[int]) -> str:
    """A character class of code points, runs as ranges."""
    out, at = [], 0
    while at < len(points):
        end = at
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(f"\\x{{{points[at]:x}}}-\\x{{{points[end]:x}}}")
        at = end + 1
    return "[" + "".join(out) + "]"


@lru_cache(1)
def _decompositions() -> tuple[str, str, dict[str, str], str, str]:
    """(characters of one letter, those letters, characters of several, a class of these, a class of what goes)."""
    single, several, gone = {}, {}, []
    for point in (p for begin, end in _SCRIPTS for p in range(begin, end)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if not base:
            gone.append(point)
        elif base != chr(point):
            (single if len(base) == 1 else several)[chr(point)] = base
    return "".join(single), "".join(single.values()), several, _class(sorted(map(ord, several))), _class(gone)


def decomposed(text: Column) -> Column:
    """Compatibility decomposition without combining characters, for the scripts named above; other characters stay.

    All in the JVM: letters of one part by ``translate``, ligatures and other signs of several parts by a map, which only texts that hold one pay for.
    """
    marked, plain, several, many, gone = _decompositions()
    t = F.translate(text, marked, plain)
    parts = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    written_out = F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(parts, c), c)), "")
    return F.regexp_replace(F.when(t.rlike(many), written_out).otherwise(t), gone, "")


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Full compatibility decomposition without combining characters, for scripts beyond Latin."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def _articles(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\b(?:{'|'.join(ARTICLES)})[\s\-']+", " ")


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise(text: Column, exact_unicode: bool = False, fold_first: bool = False) -> Column:
    """Fold spelling variants of a name: marks, case, articles, signs, white space, doubled letters.

    ``exact_unicode`` uses full NFKD (an Arrow function) in place of the tables for Latin, Hebrew and Arabic. With
    ``fold_first`` transliterations are folded before articles are stripped, so "Ayn X" and
    "Ein X" meet. Null gives the empty string.
    """
    text = F.coalesce(text, F.lit(""))
    t = nfkd(text) if exact_unicode else decomposed(text)
    t = F.lower(F.translate(t, "'’ʻʼ", "    "))
    if fold_first:
        t = fold_transliteration(_squeeze(t))
    t = F.regexp_replace(_articles(t), r"(?U)[^\w\s]", " ")
    t = _squeeze(t)
    for pair in ("yy", "ww", "ii"):
        t = F.replace(t, F.lit(pair), F.lit(pair[0]))
    return t


def fold_transliteration(normalised: Column) -> Column:
    """Token by token, one spelling for each known equivalence."""
    table = F.create_map(*[F.lit(x) for pair in TRANSLITERATIONS.items() for x in pair])
    return F.array_join(F.transform(F.split(normalised, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def compare_key(name: Column) -> Column:
    """What two names are compared by: without bracketed qualifiers, normalised and folded."""
    return fold_transliteration(normalise(F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)", " ")))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def surely_same(a: Column, b: Column) -> Column:
    """Keys equal, or one within the other; empty keys never are."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a))


def same_place(a: Column, b: Column, least: float = SETTINGS.name_similarity) -> Column:
    """``surely_same``, or similar enough. The Arrow function sees every row: filter cheaply first."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (surely_same(a, b) | (sequence_ratio(a, b) >= least))


_TASHKEEL = "[ً-ٰٟـ]"
_NIQQUD = "[֑-ׇ]"


def normalise_arabic(text: Column) -> Column:
    """Without vowel signs, letter variants folded, the article set apart at the start of a word."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _TASHKEEL, "")
    t = F.translate(t, "أإآٱةىؤئ", "اااا" + "هيوي")
    t = F.regexp_replace(t, "(?U)(^|\\s)ال", "$1 ال")
    return _squeeze(t)


def normalise_hebrew(text: Column) -> Column:
    return _squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), _NIQQUD, ""))


def search_keys(name: Column) -> Column:
    """The normalised forms by which a name is found, by script; an empty list for null."""
    arabic, hebrew = name.rlike("[؀-ۿ]"), name.rlike("[֐-׿]")
    latin = normalise(name)
    forms = (
        F.when(arabic, F.array(normalise_arabic(name)))
        .when(hebrew, F.array(normalise_hebrew(name)))
        .otherwise(F.array(latin, fold_transliteration(latin), F.trim(F.lower(strip_accents(name)))))
    )
    return F.when(name.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(forms, lambda k: k != "")))


def normalise_query(text: Column) -> Column:
    """A query in the same form as the index: one normaliser for both sides."""
    arabic, hebrew = text.rlike("[؀-ۿ]"), text.rlike("[֐-׿]")
    return F.when(arabic, normalise_arabic(text)).when(hebrew, normalise_hebrew(text)).otherwise(normalise(text))


def slug(text: Column, collapse: bool = True) -> Column:
    """Lower-case letters and digits joined by hyphens; ``unnamed`` if nothing is left."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{Alnum}]" + ("+" if collapse else ""), "-")
    t = F.regexp_replace(t, "^-+|-+$", "")
    return F.when(t == "", F.lit("unnamed")).otherwise(t)


def clean(text: Column) -> Column:
    """Trimmed, or null when blank."""
    return F.nullif(F.trim(text), F.lit(""))


def clean_strict(text: Column) -> Column:
    """``clean``, and null for underscores only or a replacement character."""
    t = clean(text)
    return F.when(t.rlike("^_+$") | F.contains(t, F.lit("�")), None).otherwise(t)


def clean_label(text: Column) -> Column:
    """``clean``, and null without any letter or digit or with a replacement character."""
    t = clean(text)
    return F.when(F.contains(t, F.lit("�")) | ~t.rlike(r"(?U)\p{Alnum}"), None).otherwise(t)


def categorise(text: Column, keywords: dict, whole_words: bool = False) -> Column:
    """Labels whose keywords occur in the text, in the order of ``keywords``; substrings by default."""

    def found(folded):
        labels = []
        for label, words in keywords.items():
            if whole_words:
                hit = folded.rlike(r"(?U)\b(?:" + "|".join(words) + r")\b")
            else:
                hit = F.lit(False)
                for w in words:
                    hit = hit | F.contains(folded, F.lit(w))
            labels.append(F.when(hit, F.lit(label)))
        return F.array_compact(F.array(*labels))

    # inside a transform the text is lower-cased once, not once for each keyword
    return F.flatten(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), found))


def name_variants(primary: Column, arabic: Column) -> Column:
    """Forms of a name that a gazetteer knows: itself, the Arabic, long parts around a dash."""
    parts = F.filter(F.transform(F.split(F.coalesce(primary, F.lit("")), r"\s*[-–—/]\s*"), lambda p: F.trim(p)), lambda p: F.length(p) > 4)
    whole = F.array_compact(F.array(primary, arabic))
    return F.array_distinct(F.concat(whole, F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))))


def id_from_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/(\d+)\.html$", 1), F.lit(""))


def contains_either_way(a: Column, b: Column) -> Column:
    """Case-blind containment in one direction or the other; false for blanks."""
    a, b = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "#39")):
        text = F.replace(text, F.lit(sign), F.lit(f"&{name};"))
    return text


def square_kilometres(area_m2: Column, digits: int = 1) -> Column:
    """Thousands separated, with the unit."""
    return F.concat(F.format_number(area_m2 / 1e6, digits), F.lit(" km²"))
