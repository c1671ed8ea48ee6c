"""Ordinal quality classifier: cumulative-link regression on hashed text features.

Grades are ordered; with K grades there are K - 1 rising thresholds and one weight vector for
all of them: P(grade <= k) = logistic(threshold_k - w.x). A document's features are its distinct
words and its shape (shares of upper case, signs and digits, repetition, length), hashed into
``2**bits`` places; places seen in fewer than ``min_docs`` training documents have no weight.
Words of long documents weigh less each (the inverse root of their number, from 100 words on), so
that many small weights don't add up to a verdict; shape features always weigh one.

The fit uses at most ``train_rows`` labelled documents, those with the smallest hash of their id:
a stated bound, so the fit is one task of bounded memory. Scoring covers all documents.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import common

BITS = 18
TRAIN_ROWS = 6000
MIN_DOCS = 6
EPOCHS = 150
L2 = 3.0
GOOD_GRADE = 1
KEEP_AT = 0.5

_BARE = re.compile("(?<![^\\s])[^\\w\\s]+(?![^\\s])")
_UPPER = re.compile("[^\\W\\d_a-zß-öø-ÿ]+")
_SIGNS = re.compile("[^\\w\\s]+")
_DIGITS = re.compile("[0-9]+")


def shape(text: str, words: list[str], distinct: int) -> list[str]:
    """Names of the shape features that hold, in coarse steps."""
    n, n_words = max(1, len(text)), max(1, len(words))
    signs = sum(map(len, _SIGNS.findall(text))) / n
    upper = sum(map(len, _UPPER.findall(text))) / n
    digits = sum(map(len, _DIGITS.findall(text))) / n
    again = sum(map(eq, words, islice(words, 1, None))) / n_words
    bare = len(_BARE.findall(text)) / n_words
    shares = (
        ("signs", signs, (0.01, 0.03, 0.05, 0.08, 0.12, 0.2)),
        ("upper", upper, (0.02, 0.05, 0.1, 0.3, 0.6)),
        ("digits", digits, (0.02, 0.1, 0.3)),
        ("again", again, (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)),
        ("bare", bare, (0.02, 0.05, 0.1, 0.2, 0.4)),
    )
    out = [f"\0{name}>{c}" for name, value, cuts in shares for c in cuts if value > c]
    repeated = 1 - distinct / n_words
    out += [f"\0repeated>{c}" for c in (0.3, 0.5, 0.65, 0.8, 0.9) if repeated > c and (c > 0.6 or len(words) < 400)]
    out += [f"\0words>{c}" for c in (0, 5, 20, 100) if len(words) > c]
    return out


def features(text: str | None, bits: int = BITS):
    """Hashed places of one text (null: empty) and their values."""
    import numpy as np

    words = (text or "").lower().split()
    distinct = set(words)
    mask, crc = (1 << bits) - 1, zlib.crc32
    places = sorted({crc(w.encode("utf-8", "surrogatepass")) & mask for w in distinct})
    shapes = sorted({crc(s.encode()) & mask for s in shape(text or "", words, len(distinct))})
    values = np.ones(len(places) + len(shapes))
    values[: len(places)] = min(1.0, 10 / max(1, len(places)) ** 0.5)
    return np.array(places + shapes, dtype=np.int64), values


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights, thresholds):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score):
        """P(grade > k) for each threshold k, in order: one row for each score."""
        import numpy as np

        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(score)[:, None], -500, 500)))

    def score(self, found) -> float:
        places, values = found
        return float(self.weights[places] @ values)


def _gradients(score, gaps, grades, weight):
    """Of the negative log-likelihood: by each score, and by the thresholds' first value and log gaps."""
    import numpy as np

    n_grades = len(gaps) + 1
    theta = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
    padded = np.concatenate([[-np.inf], theta, [np.inf]])
    hi, lo = (1 / (1 + np.exp(-np.clip(padded[grades + k] - score, -30, 30))) for k in (1, 0))
    hi, lo = np.where(grades == n_grades - 1, 1.0, hi), np.where(grades == 0, 0.0, lo)
    p = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi) / p * weight, lo * (1 - lo) / p * weight
    d_theta = np.zeros(n_grades - 1)
    np.add.at(d_theta, np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, -dhi, 0))
    np.add.at(d_theta, np.maximum(grades - 1, 0), np.where(grades > 0, dlo, 0))
    tail = np.cumsum(d_theta[::-1])[::-1]
    return dhi - dlo, np.concatenate([tail[:1], tail[1:] * np.exp(gaps[1:])])


def _adam(value, gradient, mean, square, epoch: int, epochs: int) -> None:
    """One step in place, the rate falling to zero."""
    import numpy as np

    rate = 0.1 * (0.5 + 0.5 * np.cos(np.pi * epoch / (epochs + 1)))
    mean += 0.1 * (gradient - mean)
    square += 0.001 * (gradient * gradient - square)
    value -= rate * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.999**epoch)) + 1e-8)


def fit(rows: list, grades, n_grades: int, bits: int = BITS, min_docs: int = MIN_DOCS, epochs: int = EPOCHS, l2: float = L2) -> Model:
    """Maximum penalised likelihood by full-batch Adam steps, rare grades weighing as much as common ones.

    Then the thresholds alone are fitted once more without those weights, so that the tail
    probabilities agree with the shares of the grades that were seen.

    ``rows`` are pairs (places, values), ``grades`` numbers from 0. No rows, or one grade only, give a
    model without weights whose thresholds follow the grades seen (smoothed).
    """
    import numpy as np

    grades = np.asarray(grades, dtype=np.int64)
    size = 1 << bits
    counts = np.bincount(grades, minlength=n_grades) + 1.0
    below = np.cumsum(counts)[:-1] / counts.sum()
    thresholds = np.log(below / (1 - below))
    weights = np.zeros(size)
    if len(rows) == 0 or len(np.unique(grades)) < 2:
        return Model(weights, thresholds)
    df = np.zeros(size, dtype=np.int64)
    for places, _ in rows:
        df[places] += 1
    used = np.flatnonzero(df >= min(min_docs, max(1, len(rows) // 20)))
    index = np.full(size, -1)
    index[used] = np.arange(len(used))
    columns = index[np.concatenate([p for p, _ in rows])]
    owner = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    values = np.concatenate([x for _, x in rows])
    columns, owner, values = (x[columns >= 0] for x in (columns, owner, values))
    w = np.zeros(len(used))
    # thresholds as a first value and positive gaps keep their order
    gaps = np.concatenate([thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-3))])
    weight = (len(grades) / (n_grades * counts))[grades]  # rare grades weigh as much as common ones
    steps = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, gaps)]
    for epoch in range(1, epochs + 1):
        score = np.bincount(owner, w[columns] * values, len(rows))
        d_score, d_gaps = _gradients(score, gaps, grades, weight)
        grad = np.bincount(columns, d_score[owner] * values, len(used)) + l2 * w
        for value, g, (a, b) in zip((w, gaps), (grad, d_gaps), steps):
            _adam(value, g, a, b, epoch, epochs)
    # thresholds again with every document weighing one: probabilities follow the shares of the grades
    score, a, b = np.bincount(owner, w[columns] * values, len(rows)), np.zeros_like(gaps), np.zeros_like(gaps)
    for epoch in range(1, epochs + 1):
        _adam(gaps, _gradients(score, gaps, grades, np.ones(len(rows)))[1], a, b, epoch, epochs)
    weights[used] = w
    return Model(weights, np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])])))


def grades_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Grades from two ratings: 0 low quality, 1 good but toxic, 2 good; unrated rows and null ids go.

    A document rated more than once takes its lowest grade.
    """
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).when(F.col("quality") >= 1, 2)
    rated = labels.select(F.col(id_col).alias("_id"), grade.alias("grade")).where("_id is not null and grade is not null")
    return rated.groupBy("_id").agg(F.min("grade").cast("int").alias("grade"))


def train(docs: DataFrame, grades: DataFrame, n_grades: int = 3, id_col: str = "doc_id", text: str = "text", bits: int = BITS, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``train_rows`` graded documents (``grades``: ``_id, grade``).

    Features are made where the documents are; one task gathers the bounded sample and sends
    back weights and thresholds, ``2**bits`` numbers at most.
    """
    import numpy as np

    picked = grades.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)  # bounded: may be broadcast
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(picked), "_id")

    def featurize(batches):
        import pyarrow as pa

        for batch in common.sliced(batches):
            found = [features(t, bits) for t in batch.column(1).to_pylist()]
            packed = [pa.array([x[k].astype(kind).tobytes() for x in found], pa.binary()) for k, kind in ((0, "<i4"), (1, "<f4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *packed], names=["id", "grade", "places", "weights"])

    def learn(batches):
        import pyarrow as pa

        rows = [row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(4)))]
        rows.sort()  # the order that shuffled blocks come in doesn't matter
        pairs = [(np.frombuffer(p, dtype="<i4").astype(np.int64), np.frombuffer(x, dtype="<f4").astype(np.float64)) for _, _, p, x in rows]
        model = fit(pairs, [row[1] for row in rows], n_grades, bits)
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a.astype(t).tobytes()], pa.binary()) for a, t in ((at, "<i8"), (model.weights[at], "<f8"), (model.thresholds, "<f8"))], names=["at", "w", "theta"]
        )

    found = sample.select(F.col("_id").cast("string"), "_text", F.col("grade").cast("int")).mapInArrow(featurize, "id string, grade int, places binary, weights binary")
    # one text for each id before anything is gathered: repeats go where they are
    once = found.groupBy("id").agg(F.min(F.struct("grade", "places", "weights")).alias("r")).select("id", "r.*")
    row = once.repartition(1).mapInArrow(learn, "at binary, w binary, theta binary").first()
    if row is None:
        return fit([], [], n_grades, bits)
    weights = np.zeros(1 << bits)
    weights[np.frombuffer(row.at, dtype="<i8")] = np.frombuffer(row.w, dtype="<f8")
    return Model(weights, np.frombuffer(row.theta, dtype="<f8"))


def grade_documents(docs: DataFrame, model: Model, text: str = "text", good_grade: int = GOOD_GRADE, keep_at: float = KEEP_AT, bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``expected_grade, tail_probability, grade, selected``.

    ``tail_probability`` is P(grade >= good_grade); ``selected`` says it is ``keep_at`` or more.
    Null texts count as empty. Input columns named like a result are replaced; repeated rows and
    nulls in other columns pass; an empty table gives no rows.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("expected_grade", "tail_probability", "grade", "selected")]
    rows = docs.select(*names, F.col(text).cast("string").alias("_quality_text"))
    schema = StructType([*docs.select(*names).schema.fields, StructField("expected_grade", DoubleType()), StructField("tail_probability", DoubleType()), StructField("grade", IntegerType())])
    weights, thresholds = model.weights, model.thresholds
    sent = docs.sparkSession.sparkContext.broadcast((weights.astype("float64"), thresholds))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = Model(*sent.value)
        for batch in common.sliced(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            tails = model.tails(np.array([model.score(features(t, bits)) for t in texts]))
            cumulative = np.concatenate([np.ones((len(texts), 1)), tails, np.zeros((len(texts), 1))], axis=1)
            likely = (cumulative[:, :-1] - cumulative[:, 1:]).argmax(axis=1)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(tails.sum(axis=1)), pa.array(tails[:, good_grade - 1]), pa.array(likely, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("selected", F.col("tail_probability") >= keep_at)
