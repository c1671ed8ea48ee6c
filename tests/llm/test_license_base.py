"""The base layer of the license scan against a plain loop over words."""

import random
import re

from terrane.llm import licenses

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    places = []
    for phrase, label in PHRASES.items():
        asked = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(asked)] == asked]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def test_words_places_and_labels_equal_a_plain_loop(spark):
    rng = random.Random(4)
    words = ["MIT", "mit", "License", "license", "licenses", "apache", "Apache", "general", "GENERAL", "public", "Public", "Été", "ÀPACHE", "x1", "2", "é", "​", "ſ"]
    gaps = [" ", "  ", "-", "\n", "\t", ". ", "_", "\x00", "\x7f", "/", " ", ""]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += ["mit license mit license", "the MIT\nLicense", "mit-license_apache.license", "general public public license", "", None, "mit", "license mit", "GENERAL PUBLIC LICENSE " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.digest(licenses.scan(df)).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert sum(r.n_base > 0 for r in rows.values()) > 50
