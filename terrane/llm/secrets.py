"""Secret scans: base patterns, and two character Markov models compared by log-likelihood ratio.

One model is of random strings, one of ordinary identifiers; both are first-order chains over
character symbols with add-one smoothing, fitted to labelled samples. A candidate is a run of key
characters, or what is left of one beside base spans, that is not a number. It is a secret when the
log-likelihood ratio of its steps, random against ordinary, exceeds ``step`` for each step by
``evidence`` in all: one decision on length and likeness, so a short string must be the more telling.

The random sample is drawn from a seeded generator over common alphabets. The ordinary sample is
made of identifiers joined in the usual styles, and of words of a bounded number of documents
(``sample_docs``, those with the smallest hash of their id), where the base patterns find nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from . import common

# The base patterns; A-Z and a-z only are letters in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 or more: shorter ones fail
KINDS = ("assign", "access", "hex", "random")
ASSIGN_MIN, ACCESS_MIN = 6, 20

# Shorter runs than this could not bring the evidence together.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
STEP, EVIDENCE = 0.25, 4.0
SAMPLE_DOCS = 1000
_WORDS = (
    "account array buffer build cache channel client close config connect content count create data date default delete"
    " device document element email error event fetch field file filter format function global group handler header height"
    " image index input item label layer length line list load local manager message method model module name network node"
    " number object offset option order output page parent path point position prefix process profile query queue reader"
    " record region render request response result return row schema score select server service session setting size source"
    " start state status storage stream string style suffix summary system table target task template text thread time title"
    " total track type update user util value vector version view width window worker writer"
).split()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then by kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], s[2]))
    return [(s, e, KINDS[k]) for s, e, k in found]


def symbols(token: str) -> bytes:
    """Characters as symbols 0..68: digits, both cases of letters, four signs, anything else."""
    return token.encode("ascii", "replace").translate(_SYMBOL)


_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
_SYMBOL = bytes(_ALPHABET.find(chr(b)) if chr(b) in _ALPHABET else len(_ALPHABET) for b in range(256))
N_SYMBOLS = len(_ALPHABET) + 1


def transitions(tokens):
    """Counts of symbol steps over labelled strings."""
    import numpy as np

    counts = np.zeros(N_SYMBOLS * N_SYMBOLS, dtype=np.int64)
    for token in tokens:
        s = np.frombuffer(symbols(token), dtype=np.uint8).astype(np.int64)
        counts += np.bincount(s[:-1] * N_SYMBOLS + s[1:], minlength=len(counts))
    return counts.reshape(N_SYMBOLS, N_SYMBOLS)


def labelled_strings(n: int = 4000, seed: int = 7) -> tuple[list[str], list[str]]:
    """Made samples: random strings over common alphabets, and identifiers in the usual styles."""
    import random

    rng = random.Random(seed)
    digits, lower, upper = _ALPHABET[:10], _ALPHABET[10:36], _ALPHABET[36:62]
    alphabets = [digits + lower[:6], digits[2:8] + upper, digits + lower + upper, _ALPHABET[:64], digits + lower + upper + "_-", digits + lower, lower + upper, upper, lower]
    rand = ["".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(12, 48))) for k in range(n)]
    plain = []
    for k in range(n):
        words = rng.choices(_WORDS, k=rng.randint(2, 5))
        style = k % 5
        joined = ["_".join(words), "-".join(words), "/".join(words), words[0] + "".join(w.title() for w in words[1:]), "_".join(words).upper()][style]
        plain.append(joined + (str(rng.randint(0, 2030)) if k % 3 == 0 else ""))
    return rand, plain


class Ratio:
    """Mean log-likelihood ratio of a string's steps, random against ordinary; and whether it is a secret's."""

    def __init__(self, random_counts, ordinary_counts):
        import numpy as np

        def logs(counts):
            c = np.asarray(counts, dtype=np.float64) + 1.0
            return np.log(c / c.sum(axis=1, keepdims=True))

        self.table = logs(random_counts) - logs(ordinary_counts)

    def __call__(self, token: str) -> float:
        import numpy as np

        s = np.frombuffer(symbols(token), dtype=np.uint8)
        return float(self.table[s[:-1], s[1:]].mean())

    def secret(self, token: str, step: float = STEP, evidence: float = EVIDENCE) -> float | None:
        """The ratio of a secret, or None."""
        value = self(token)
        return value if (value - step) * (len(token) - 1) >= evidence else None


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Ratio:
    """Fit both models; the words of ``sample_docs`` documents at most add to the ordinary sample.

    What comes back is one table of symbol steps, of fixed size. No documents: the made samples alone.
    """
    import numpy as np

    ids = docs.select(F.col(id_col).alias("_id")).where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text")).where("_text is not null")
    sample = texts.join(F.broadcast(ids.distinct()), "_id", "left_semi").select("_text")  # at most sample_docs ids

    def run(batches):
        import pyarrow as pa

        total = np.zeros((N_SYMBOLS, N_SYMBOLS), dtype=np.int64)
        for batch in common.sliced(batches):
            for t in batch.column(0).to_pylist():
                if not base_spans(t):
                    total += transitions(w for w in t.split() if w.isascii() and len(w) > 1 and CANDIDATE.fullmatch(w) is None)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["step", "n"])

    rows = sample.mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()  # <= 68 x 68 rows
    rand, plain = labelled_strings()
    ordinary = transitions(plain)
    words = np.zeros(N_SYMBOLS * N_SYMBOLS, dtype=np.float64)
    for row in rows:
        words[row.step] = row.n
    words *= ordinary.sum() / max(1.0, words.sum())  # both ordinary samples weigh the same
    return Ratio(transitions(rand), ordinary + words.reshape(N_SYMBOLS, N_SYMBOLS))


def scan_text(text: str, ratio: Ratio, step: float = STEP, evidence: float = EVIDENCE) -> tuple[list[tuple[int, int, str]], float]:
    """All spans of one text by start and kind, and the largest ratio of a method span (zero if none)."""
    base = base_spans(text)
    extra, best, k = [], 0.0, 0
    taken = _united(base)
    for m in CANDIDATE.finditer(text):
        begin, end = m.span()
        while k < len(taken) and taken[k][1] <= begin:
            k += 1
        pieces, j = [], k
        while j < len(taken) and taken[j][0] < end:  # what lies between the base spans of a run
            pieces.append((begin, taken[j][0]))
            begin = max(begin, taken[j][1])
            j += 1
        for start, stop in (*pieces, (begin, end)):
            token = text[start:stop]
            if token.isdigit() or not CANDIDATE.fullmatch(token):
                continue
            value = ratio.secret(token, step, evidence)
            if value is not None:
                extra.append((start, stop, "random"))
                best = max(best, value)
    spans = sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))
    return spans, best


def _united(spans) -> list[tuple[int, int]]:
    """Spans by start, those that meet or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end, _ in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, ratio: Ratio, id_col: str = "doc_id", text: str = "text", step: float = STEP, evidence: float = EVIDENCE) -> DataFrame:
    """``id, kinds, starts, ends, values, ratio``: the spans of each text in order, with their strings.

    Null texts count as empty; documents without spans have empty lists. Null ids and repeated
    rows keep their rows; an empty table gives none; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    schema = rows.select(F.col("_id").alias(id_col)).schema
    for name, kind in (("kinds", StringType()), ("starts", LongType()), ("ends", LongType()), ("values", StringType())):
        schema = schema.add(name, ArrayType(kind))
    schema = schema.add("ratio", "double")

    def run(batches):
        import pyarrow as pa

        for batch in common.sliced(batches):
            found = []
            texts = batch.column(1).to_pylist()
            for t in texts:
                found.append(scan_text(t, ratio, step, evidence))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[k for _, _, k in s] for s, _ in found], pa.list_(pa.string())),
                    pa.array([[a for a, _, _ in s] for s, _ in found], pa.list_(pa.int64())),
                    pa.array([[b for _, b, _ in s] for s, _ in found], pa.list_(pa.int64())),
                    pa.array([[t[a:b] for a, b, _ in s] for t, (s, _) in zip(texts, found)], pa.list_(pa.string())),
                    pa.array([r for _, r in found], pa.float64()),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the SHA-256 of the base spans, and all spans as text."""
    zipped = F.arrays_zip("kinds", "starts", "ends")

    def text_of(rows):
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("kinds", lambda k: k == kind))

    counts = [count(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    base = F.filter(zipped, lambda s: s["kinds"] != "random")
    return found.select(
        id_col, *counts, F.sha2(text_of(base).cast("binary"), 256).alias("base_sha256"), text_of(zipped).alias("spans"), F.round("ratio", 6).alias("ratio")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", step: float = STEP, evidence: float = EVIDENCE, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Train on a bounded sample, then scan every document."""
    return find_secrets(docs, train(docs, id_col, text, sample_docs), id_col, text, step, evidence)
