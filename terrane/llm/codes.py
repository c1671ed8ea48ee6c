"""Product codes of vectors: integer codebooks by Lloyd rounds, nearest entries by partial distances.

Components become whole numbers, vectors are cut into equal parts, and each part position has a
codebook of few entries. The nearest entry is found by partial-distance search: the positions of a
part are taken in descending variance of the codebook, so that the sums grow early, and an entry is
dropped for a vector as soon as its sum so far strictly exceeds the vector's best whole distance.
Masks do that for a batch of vectors at once. All arithmetic is in whole numbers, so codes don't
depend on how Spark deals the rows; a round sends one sum for each entry and position and task, and
only the codebooks (``ENTRIES`` times the vector's length) come to the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
_EXACT = 1 << 28  # sums of squares of a part's differences stay far below 2^63 up to here


def part_edges(dims: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts of equal length; the first ones are longer by one where ``parts`` doesn't divide ``dims``."""
    cuts = [0]
    for i in range(parts):
        cuts.append(cuts[-1] + dims // parts + (i < dims % parts))
    return list(zip(cuts, cuts[1:]))


def by_variance(book) -> list[int]:
    """Positions of a codebook by descending variance of its entries, ties to the smaller position."""
    columns = [[int(v) for v in column] for column in zip(*book)]
    spread = [len(c) * sum(v * v for v in c) - sum(c) ** 2 for c in columns]
    return sorted(range(len(spread)), key=lambda k: (-spread[k], k))


def nearest(x, book):
    """(index, squared distance) of the nearest codebook entry of each row, ties to the lower index.

    ``x`` holds int64 rows, or Python integers where values are too large for exact int64 sums.
    """
    import numpy as np

    order = by_variance(book)
    code = np.zeros(len(x), dtype=np.int64)
    best = np.zeros(len(x), dtype=x.dtype)
    for k in order:
        best += (x[:, k] - int(book[0][k])) ** 2
    for entry in range(1, len(book)):
        rows, total, bound = np.arange(len(x)), np.zeros(len(x), dtype=x.dtype), best
        for k in order:
            total = total + (x[rows, k] - int(book[entry][k])) ** 2
            left = ~(total > bound)
            if not left.all():
                rows, total, bound = rows[left], total[left], bound[left]
            if not len(rows):
                break
        nearer = total < bound
        code[rows[nearer]], best[rows[nearer]] = entry, total[nearer]
    return code, best


def _matrix(column):
    """Rows of an Arrow list column; Python integers where int64 sums could be inexact."""
    import numpy as np

    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    if len(x) and np.abs(x).max(initial=0) > _EXACT:
        return np.array([[int(v) for v in row] for row in x], dtype=object)
    return x.astype(np.int64)


def _sums(whole: DataFrame, books, edges) -> DataFrame:
    """``part, entry, position, n, total`` of one task's rows, an entry's rows and their component sums."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        n = [np.zeros(len(book), dtype=object) for book in books]
        total = [np.zeros((len(book), hi - lo), dtype=object) for book, (lo, hi) in zip(books, edges)]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(at, 4096))
                for p, (lo, hi) in enumerate(edges):
                    code, _ = nearest(x[:, lo:hi], books[p])
                    for entry in np.unique(code):
                        mine = x[code == entry, lo:hi]
                        n[p][entry] += len(mine)
                        total[p][entry] += mine.sum(axis=0)
        rows = [
            (p, entry, k, int(n[p][entry]), str(total[p][entry, k]))
            for p, (lo, hi) in enumerate(edges)
            for entry in range(len(books[p]))
            if n[p][entry]
            for k in range(hi - lo)
        ]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["part", "entry", "position", "n", "total"])

    return whole.select("x").mapInArrow(run, "part long, entry long, position long, n long, total string")


def train(whole: DataFrame, dims: int, parts: int, entries: int, rounds: int) -> list[list[list[int]]]:
    """Codebooks by part: the parts of the smallest ids' vectors, moved by ``rounds`` Lloyd rounds.

    An entry becomes the floor of its rows' mean; one without rows stays.
    """
    edges = part_edges(dims, parts)
    first = whole.where("id is not null").orderBy("id", "x").limit(entries).select("x").collect()
    books = [[[int(v) for v in row.x[lo:hi]] for row in first] for lo, hi in edges]
    for _ in range(rounds if first else 0):
        found = _sums(whole, books, edges).groupBy("part", "entry", "position")
        found = found.agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        for row in found.collect():  # as many rows as the codebooks have components
            books[row.part][row.entry][row.position] = int(row.total) // int(row.n)
    return books


def _encoded(whole: DataFrame, books, edges) -> DataFrame:
    schema = whole.select("id", "label").schema.add("code", "string").add("error", "long")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column("x"))
                code, error = np.zeros(len(x), dtype="U1"), np.zeros(len(x), dtype=x.dtype)
                for book, (lo, hi) in zip(books, edges):
                    entry, far = nearest(x[:, lo:hi], book)
                    code, error = np.char.add(code, digits[entry]), error + far
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(code.tolist(), "string"), pa.array(error.tolist(), "int64")], names=schema.names)

    return whole.select("id", "label", "x").mapInArrow(run, schema)


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """One row for each kept vector: id, ``code``, ``error``, ``label_error``, ``codebooks_sha256``.

    Vectors that are null, empty or hold null or non-finite components go. So do vectors whose length
    is not that of the smallest kept id's vector (there is one codebook). Components are
    ``floor(scale * x)``. Rows with a null id are coded and counted like any other but begin no codebook entry; if
    every id is null there is no codebook and no row. Repeated rows stay repeated; equal ids begin in
    the order of their components. Fewer rows than ``entries`` give as many entries as rows. Null
    labels are one group. Other columns are not read; an empty table gives no rows. Errors over 2^63 fail.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    good = F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    # doubles hold whole numbers below 2^53 exactly, and larger ones are whole already
    floor = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    whole = common.materialize(rows.where(good).select("id", "label", F.transform("v", lambda x: floor(x * scale)).alias("x")))
    head = whole.where("id is not null").orderBy("id", "x").select(F.size("x")).first()
    dims = head[0] if head else 0
    whole = whole.where(F.size("x") == dims)
    edges = part_edges(dims, parts)
    books = train(whole, dims, parts, entries, rounds)
    sha = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    done = common.materialize(_encoded(whole if head else whole.limit(0), books, edges))
    by_label = done.groupBy("label").agg(F.sum("error").alias("label_error"))
    same = done["label"].eqNullSafe(by_label["label"])
    out = done.join(by_label, same).select(done["id"].alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
    return out
