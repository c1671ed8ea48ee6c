"""Best-fit packing of tokenised documents into sequences of bounded length.

Bounded-space online best fit: a task keeps at most ``open_bins`` open sequences. A bit set
keyed by free space finds the open sequence that a piece fills best; when one more would be
opened, the fullest closes first. Pieces come in the order of a hash, which mixes long and short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .pieces import WORD_PATTERN, PackedPieces

CAPACITY = 2048
END_ID = 0
OPEN_BINS = 512
PIECES_PER_TASK = 400_000


class BestFit:
    """Online best fit over at most ``open_bins`` open sequences."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be at least 1")
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0
        self.n_made = 0

    def put(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of 1 to ``capacity`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if length < self.capacity and self.n_open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_ = self.capacity, self.n_made
            self.n_made += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.n_open += 1
        return bin_, self.capacity - free

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.n_open -= 1
        return bin_


def cut_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``id, piece, start, length, ids_crc32``.

    A document's ids end with ``end_id``; only longer documents are cut, into full pieces and
    a last one that may be shorter. Null texts count as empty: one piece, the end id alone.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    schema = docs.select(id_col).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        pieces = PackedPieces(tokenizer_path, WORD_PATTERN, lower=True)
        end = pieces.value([end_id])
        step = 4 * capacity
        for batch in common.sliced(batches):
            at, starts, lengths, crcs = [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                ids = pieces.packed(t) + end
                for start in range(0, len(ids), step):
                    part = ids[start : start + step]
                    at.append(k)
                    starts.append(start // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(np.array(starts, dtype=np.int64) // capacity, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    open_bins: int = OPEN_BINS,
    pieces_per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """Each piece of each document with its ``sequence_id`` and gapless ``offset`` there.

    The number of packing tasks follows the number of pieces; each holds ``open_bins`` open
    sequences and streams its pieces. Null texts are one piece of the end id; null ids and
    repeated rows are packed like any other; an empty table gives no rows.
    """
    pieces = common.materialize(cut_documents(docs, tokenizer_path, id_col, text, capacity, end_id))
    tasks = max(1, -(-pieces.count() // pieces_per_task))
    # the place of a row in the written table is a salt: repeated rows are dealt out like others
    order = F.xxhash64(F.col(id_col), F.col("piece"), F.col("ids_crc32"), F.monotonically_increasing_id())
    dealt = pieces.withColumn("_order", order).repartition(tasks, "_order").sortWithinPartitions("_order", "start", id_col)
    names = [*pieces.columns, "sequence_id", "offset"]
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        packer = BestFit(capacity, open_bins)
        for batch in batches:
            placed = [packer.put(n) for n in batch.column("length").to_pylist()]
            columns = [batch.column(c) for c in names[:-2]]
            columns += [pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return dealt.mapInArrow(run, schema)
