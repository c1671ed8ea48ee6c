"""Frequent phrases by hashed bucket counts (PCY, with direct hashing and pruning), then their cohesion.

Pass ``k`` counts phrases of ``k`` words exactly, and in the same reading the phrases of ``k + 1``
words by hash bucket only. Bucket counts are summed over all tasks; a bitmap says which buckets
reach the least count. The next pass counts a phrase only when its bucket is in that bitmap and
both of its shorter parts are frequent (Apriori; these are looked up in a second bitmap). A bitmap
errs only towards counting too much, and what was counted is exact, so no frequent phrase is lost and none
is added. Both bitmaps have a fixed number of bits, at most ``2 ** MAX_BITS`` (128 MB): with more words than
that they prune less, and the result is the same.

Tasks count a few megabytes of text at a time: words are cut from the bytes by table look-ups, encoded by
an Arrow dictionary, and phrases are grouped by the codes of their words, so a frequent phrase
leaves a task as few rows, however often it occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAX_WORDS = 4
LEAST = 30
TOP = 2000
COVERED_PERCENT = 80
SCORE_SCALE = 2_000_000
MAX_BITS = 30
_RANGE_BITS = 16
_BATCH_BYTES = 4 << 20
_HELD = 1 << 20
_PIECE_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BLANKS = b" \t"
_SPREAD = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
_COUNTED = "lang string, phrase string, count long, part int, ids binary, sums binary"


def mixed(h):
    """64-bit values with all bits spread (uint64 arrays)."""
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(_STEP)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_SPREAD)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts: codes into a dictionary, the piece and the language of each."""

    def __init__(self, texts, groups, group_names: list[str]):
        import numpy as np
        import pyarrow as pa

        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
        at -= at[0]
        kind = np.zeros(256, dtype=np.uint8)
        kind[list(_BLANKS)], kind[list(_PIECE_BREAKS)] = 1, 2
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        kinds = kind[data]
        inside = kinds == 0
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = at[(at > 0) & (at < len(data))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        first = np.flatnonzero(begins)
        offsets = np.zeros(len(first) + 1, dtype=np.int32)
        np.cumsum(np.flatnonzero(ends) + 1 - first, out=offsets[1:])
        plain = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(lower[data[inside]])])
        coded = plain.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.dictionary = coded.dictionary
        row = np.searchsorted(at, first, side="right") - 1
        self.piece = np.cumsum(kinds == 2)[first] + row if len(first) else first
        self.group = np.asarray(groups, dtype=np.int64)[row]
        self.group_names = group_names

    def __len__(self):
        return len(self.codes)

    def starts(self, k: int):
        """Places where ``k`` words stand in one piece."""
        import numpy as np

        n = max(0, len(self.codes) - k + 1)
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 : k - 1 + n])

    def hashes(self, k: int, at):
        """Hashes of the phrases of ``k`` words at these places, with their language."""
        import numpy as np
        import pyarrow as pa

        if not hasattr(self, "_word_hash"):
            self._word_hash = text_hashes(self.dictionary)
            self._group_hash = text_hashes(pa.array(self.group_names, pa.string()))
        h = self._group_hash[self.group[at]]
        for j in range(k):
            h = mixed(h * np.uint64(_SPREAD) + self._word_hash[self.codes[at + j]])
        return h

    def counts(self, k: int, at):
        """(languages, phrases, counts) of the phrases of ``k`` words at these places: grouped by exact words."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        size, top, key = max(1, len(self.dictionary)), len(self.group_names), self.group[at]
        for j in range(k):
            if top * size >= 1 << 62:
                values, key = np.unique(key, return_inverse=True)
                top = len(values)
            key, top = key * size + self.codes[at + j], top * size
        _, one, n = np.unique(key, return_index=True, return_counts=True)
        one = at[one]
        words = [self.dictionary.take(pa.array(self.codes[one + j])) for j in range(k)]
        phrases = pc.binary_join_element_wise(*words, " ") if k > 1 else words[0]
        return pa.array(self.group_names, pa.string()).take(pa.array(self.group[one])), phrases, pa.array(n)


def text_hashes(texts):
    """A 64-bit hash of each string, equal in all tasks. Only buckets depend on it: collisions do no harm."""
    import numpy as np

    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]].astype(np.uint64) + np.uint64(1)
    at -= at[0]
    sizes = np.diff(at)
    power = np.full(int(sizes.max(initial=0)) + 1, _SPREAD, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(data * power[np.arange(len(data)) - np.repeat(at[:-1], sizes)], out=total[1:])
    return mixed(total[at[1:]] - total[at[:-1]] + sizes.astype(np.uint64))


def _slices(batches):
    """(texts, languages) of at most about ``_BATCH_BYTES`` of text, or of one longer text."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + _BATCH_BYTES, side="right")))
            done = ends[to - 1]
            coded = batch.column("lang").slice(at, to - at).dictionary_encode()
            yield batch.column("text").slice(at, to - at), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            at = to


class Held:
    """Counts of one task, merged now and then: phrases by language, and buckets by number."""

    def __init__(self, least: int):
        self.least, self.tables, self.rows, self.buckets, self.size = least, [], 0, [], 0

    def phrases(self, langs, phrases, counts):
        import pyarrow as pa

        self.tables.append(pa.table({"lang": langs, "phrase": phrases, "count": counts}))
        self.rows += len(counts)
        if self.rows > _HELD:
            merged = pa.concat_tables(self.tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("count", "sum")])
            self.tables, self.rows = [merged.rename_columns(["lang", "phrase", "count"])], merged.num_rows
            if self.rows > _HELD // 2:
                yield from self.phrase_rows()

    def phrase_rows(self):
        import pyarrow as pa

        if self.tables:
            merged = pa.concat_tables(self.tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("count", "sum")])
            none = lambda kind: pa.nulls(merged.num_rows, kind)
            whole = pa.table({"lang": merged["lang"], "phrase": merged["phrase"], "count": merged["count_sum"].cast("int64"), "part": none(pa.int32()), "ids": none(pa.binary()), "sums": none(pa.binary())})
            yield from whole.combine_chunks().to_batches(max_chunksize=1 << 17)
        self.tables, self.rows = [], 0

    def hashed(self, buckets, weight=None):
        import numpy as np

        values, counts = np.unique(buckets, return_counts=True)
        self.buckets.append((values, np.minimum(counts if weight is None else np.full(len(values), weight), self.least)))
        self.size += len(values)
        if self.size > 3 * _HELD:
            self._merge()
            if self.size > 2 * _HELD:
                yield from self.bucket_rows()

    def _merge(self):
        import numpy as np

        if len(self.buckets) > 1:
            values, where = np.unique(np.concatenate([v for v, _ in self.buckets]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([c for _, c in self.buckets]), minlength=len(values))
            self.buckets = [(values, np.minimum(counts, self.least))]
        self.size = len(self.buckets[0][0])

    def bucket_rows(self):
        """Sorted buckets cut into ranges: 16 bits for each, and its count up to the least that matters."""
        import numpy as np
        import pyarrow as pa

        if self.buckets:
            self._merge()
            values, counts = self.buckets[0]
            parts = (values >> _RANGE_BITS).astype(np.int32)
            ids, sums = (values & ((1 << _RANGE_BITS) - 1)).astype(np.uint16), counts.astype(_sum_type(self.least))
            cuts = np.flatnonzero(np.diff(parts, prepend=-1, append=-1))
            pairs = list(zip(cuts, cuts[1:]))
            for s in range(0, len(pairs), 512):
                some = pairs[s : s + 512]
                none = lambda kind: pa.nulls(len(some), kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [none(pa.string()), none(pa.string()), none(pa.int64()), pa.array([int(parts[a]) for a, _ in some], pa.int32()), pa.array([ids[a:b].tobytes() for a, b in some]), pa.array([sums[a:b].tobytes() for a, b in some])],
                    names=["lang", "phrase", "count", "part", "ids", "sums"],
                )
        self.buckets, self.size = [], 0


def _sum_type(least: int):
    return "uint8" if least < 256 else "uint64"


def _in(bitmap, buckets):
    import numpy as np

    return (bitmap[buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1 == 1


def _buckets(hashes, bits: int):
    import numpy as np

    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _pass(docs: DataFrame, k: int, last: int, least: int, bits: int, hot, frequent) -> DataFrame:
    """Exact counts of phrases of ``k`` words that may be frequent, and bucket counts of those with one word more."""

    def run(batches):
        import numpy as np

        held = Held(least)
        for texts, groups, names in _slices(batches):
            words = Words(texts, groups, names)
            at = words.starts(k)
            if k > 1:
                part = np.zeros(len(words) + 1, dtype=bool)
                shorter = words.starts(k - 1)
                part[shorter] = _in(frequent.value, _buckets(words.hashes(k - 1, shorter), bits))
                at = at[part[at] & part[at + 1]]
                at = at[_in(hot.value, _buckets(words.hashes(k, at), bits))]
            if len(at):
                yield from held.phrases(*words.counts(k, at))
            if k < last:
                may = np.zeros(len(words) + 1, dtype=bool)
                may[at] = True
                longer = words.starts(k + 1)
                longer = longer[may[longer] & may[longer + 1]]
                if len(longer):
                    yield from held.hashed(_buckets(words.hashes(k + 1, longer), bits))
        yield from held.phrase_rows()
        yield from held.bucket_rows()

    return docs.mapInArrow(run, _COUNTED)


def _bitmap(counted: DataFrame, least: int, bits: int):
    """A broadcast bitmap of the buckets that reach ``least``: 2 ** bits bits, whatever the input."""
    ranges = counted.where("part is not null").select("part", "ids", "sums").repartition("part").sortWithinPartitions("part")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        part, total = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], names=["part", "bits"])

        for batch in batches:
            for p, ids, sums in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if p != part:
                    if part is not None:
                        yield row()
                    part, total = p, np.zeros(1 << _RANGE_BITS, dtype=np.int64)
                total[np.frombuffer(ids.as_buffer(), dtype=np.uint16)] += np.frombuffer(sums.as_buffer(), dtype=_sum_type(least))
        if part is not None:
            yield row()

    import numpy as np

    whole = np.zeros((1 << bits) // 8, dtype=np.uint8)
    width = (1 << _RANGE_BITS) // 8
    for p, found in ranges.mapInArrow(run, "part int, bits binary").collect():  # at most 2 ** MAX_BITS bits
        whole[p * width : (p + 1) * width] = np.frombuffer(found, dtype=np.uint8)
    return counted.sparkSession.sparkContext.broadcast(whole)


def _hashed(found: DataFrame, k: int, least: int, bits: int) -> DataFrame:
    """Bucket rows of phrases that are known to be frequent."""

    def run(batches):
        import numpy as np

        held = Held(least)
        for texts, groups, names in _slices(batches):
            words = Words(texts, groups, names)
            yield from held.hashed(_buckets(words.hashes(k, np.arange(0, len(words), k)), bits), least)
        yield from held.bucket_rows()

    return found.select("lang", F.col("phrase").alias("text")).mapInArrow(run, _COUNTED)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(``lang, phrase, k, a`` of all phrases of up to ``max_words`` words that occur ``least`` times, ``lang, n``).

    ``n`` counts all words. Null texts are empty, null languages are ``und``.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MAX_BITS, max(18, (size // 8).bit_length()))
    levels, total, hot, frequent = [], None, None, None
    for k in range(1, max_words + 1):
        counted = common.materialize(_pass(rows, k, max_words, least, bits, hot, frequent))
        sums = counted.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("count").alias("a"))
        if k == 1:
            total = common.materialize(counted.where("phrase is not null").groupBy("lang").agg(F.sum("count").alias("n")))
        found = common.materialize(sums.where(F.col("a") >= least).select("lang", "phrase", F.lit(k).alias("k"), "a"))
        levels.append(found)
        for bitmap in (hot, frequent):
            if bitmap is not None:
                bitmap.unpersist()
        if k < max_words:
            hot, frequent = _bitmap(counted, least, bits), _bitmap(_hashed(found, k, least, bits), least, bits)
        common.release(counted)
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole, total


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of two or more words.

    A phrase's cut with the lowest score counts, ties to the earliest. Phrases that a longer frequent phrase
    holds with ``covered_percent`` of their count go. Words are lower-cased in A-Z only and never cross
    ``. , ; : ! ?`` or line ends. Null texts are empty, null languages are ``und``; repeated rows count as
    often as they stand there; an empty table gives no rows; other columns are not read.
    """
    found, total = frequent_phrases(docs, text, lang, max_words, least)
    longer = found.where("k > 1")
    words = longer.withColumn("w", F.split("phrase", " "))
    part = lambda begin, n: F.array_join(F.slice("w", begin, n), " ")
    cuts = words.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    counts = found.select("lang", "phrase", "a")
    cuts = cuts.join(counts.toDF("lang", "left", "l"), ["lang", "left"]).join(counts.toDF("lang", "right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumns({"da": wide("a") * SCORE_SCALE, "dl": (wide("l") + wide("r")).cast("decimal(38,0)")})
    cuts = cuts.withColumn("score", F.expr("da div dl"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # contiguous parts of longer phrases, with the largest count of a phrase that holds them
    begins = F.explode(F.expr(f"flatten(transform(sequence(2, least(k - 1, {max_words})), m -> transform(sequence(1, k - m + 1), b -> struct(b, m))))"))
    inner = words.where("k > 2").withColumn("s", begins).select("lang", part(F.col("s.b"), F.col("s.m")).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("held").isNull() | (wide("held") * 100 < wide("a") * covered_percent))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    # a language is first ranked in parts, so that one task sees a bounded number of rows of it
    parted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(parted)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = kept.join(F.broadcast(total) if total.count() <= common.BROADCAST_ROWS else total, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
