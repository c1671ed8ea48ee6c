"""Token counts; huge documents by overlapping chunks that resynchronise.

The pre-tokenizer reads from left to right and what it does at a piece's start depends only on
the text from there on. So when two overlapping chunks both start a piece at one place, their
pieces agree from there to the end of the shorter, but for the last pieces, which the chunk's end
may have cut. The left chunk counts up to such a place, the right chunk from it on. If an overlap
holds no such place (one endless word), it is widened, at last to the whole document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .pieces import BYTE_PATTERN, Pieces

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
LIMIT = 512
# Longer than the vocabulary's special string, which a chunk's end may cut.
_MARGIN = 32


class Counter(Pieces):
    def __init__(self, path: str):
        super().__init__(path, BYTE_PATTERN)

    def ends(self, text: str) -> tuple[list[int], list[int]]:
        """Where each piece ends (code points), and the tokens in it."""
        if self.sure(text):
            pieces = self.cut(text)
            return _sums(map(len, pieces)), [self[p] for p in pieces]
        got = self.tokenizer.encode(text, add_special_tokens=False)
        ends: list[int] = []
        counts: list[int] = []
        last = None
        for word, (start, end) in zip(got.word_ids, got.offsets):
            if last is not None and (word == last[0] and word is not None and start <= last[1]):
                counts[-1] += 1
                ends[-1] = max(ends[-1], end)
            else:
                counts.append(1)
                ends.append(end)
            last = (word, end)
        return ends, counts

    def count(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
        if len(text) > chunk:
            return self.spliced(text, chunk, overlap)
        return sum(self.values(text)) if self.sure(text) else len(self.ids(text))

    def spliced(self, text: str, chunk: int, overlap: int) -> int:
        """Tokens of a text by chunks of ``chunk`` characters and overlaps of ``overlap`` or more."""
        total, begin = 0, 0
        size = chunk
        while True:
            end = min(len(text), begin + size)
            ends, counts = self.ends(text[begin:end])
            if end == len(text):
                return total + sum(counts)
            found = self._meet(text, begin, end, ends, min(overlap, size // 2))
            if found is None:
                size *= 2
                continue
            place, k = found
            total += sum(counts[: k + 1])
            begin, size = place, chunk

    def _meet(self, text: str, begin: int, end: int, ends: list[int], overlap: int):
        """A place where this chunk and one that starts inside it both begin a piece: (place, its last piece)."""
        while True:
            start = end - overlap
            if start <= begin:
                return None
            right = min(len(text), end + overlap)
            mine = {begin + e: k for k, e in enumerate(ends[:-2]) if start < begin + e <= end - _MARGIN}
            theirs, _ = self.ends(text[start:right])
            for e in reversed(theirs[:-2]):
                if start + e in mine:
                    return start + e, mine[start + e]
            overlap *= 2


def _sums(lengths) -> list[int]:
    total, out = 0, []
    for n in lengths:
        total += n
        out.append(total)
    return out


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    Null texts count as empty (0 bytes, 0 tokens). Null ids and repeated rows keep their rows;
    an empty table gives none; other columns are not read. Counts equal those of the tokenizers
    library over the whole text, special strings in it handled as its default.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.select("_id", F.octet_length("_text").cast("long").alias("_bytes"), "_text")
    schema = rows.select(F.col("_id").alias(id_col), F.col("_bytes").alias("n_bytes")).schema.add("n_tokens", "long")

    def run(batches):
        import pyarrow as pa

        counter = Counter(tokenizer_path)
        for batch in common.sliced(batches):
            texts = batch.column(2).to_pylist()
            counts = pa.array([counter.count(t, chunk_chars, overlap_chars) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=[id_col, "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
