"""Repeated passages: suffixes ordered only through the window's length, by most-significant-digit passes.

Two bytes strings of ``window`` bytes that are equal form one group of a sort of all suffixes that
stops at that depth; a group of one suffix needs no further digit. The passes are dealt out so that
little moves:

* Anchors. A window is compared where its anchor stands: the 16 bytes in it with the smallest hash. Equal
  windows have equal anchors at the same place, so every window meets its equals under that digit, and one
  position in about eighteen is sent instead of all.
* First pass. Batches of documents send the hashes of their anchors, each once and in 32 bits beside the bucket's number. An
  anchor that one document alone holds ends here (a false meeting costs work only).
* Second pass. Anchors that are left are sent with the bytes around them, equal surroundings of a batch once. Whatever
  has wholly equal surroundings is decided; the rest goes through digits of eight bytes, first to last,
  for each place of the anchor in the window, and groups of one are dropped after every digit. What is left
  at the last digit is exactly the equal windows, by their bytes.
* An anchor with more than ``HOT`` different surroundings (a common line) would be one large group: its windows are dealt
  by all their bytes instead, once for each batch, and go through the same digits.

Documents are dealt to batches by their id, once; the three passes read that one exchange.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .phrases import mixed

WINDOW = 50
HOT = 50_000
_BATCH_BYTES = 2 << 20
_BUCKET_BYTES = 9 << 20
_CHUNK = 1 << 20
_FULL, _LINK = 2, 3
_MOVED = "bucket int, batch int, kind int, content binary, low binary, high binary, doc binary, ref binary, mask binary"
_MARKS = "batch int, kind int, ref binary, mask binary"


def gram_bytes(window: int) -> int:
    """Length of an anchor: its places in a window fit the 63 bits of a mask."""
    if window < 16:
        raise ValueError("windows need 16 bytes or more")
    return 8 if window < 24 else max(16, -(-(window - 48) // 8) * 8)


class Texts:
    """Some documents' bytes in one buffer, by id, then text: the same in every pass. Null ids come last."""

    def __init__(self, table):
        import numpy as np

        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        self.ids = table.column("id").combine_chunks()
        text = table.column("text").combine_chunks()
        if hasattr(text, "chunks"):
            text = text.chunk(0)
        n = len(text)
        wide = np.int64 if str(text.type).startswith("large") else np.int32
        at = np.frombuffer(text.buffers()[1], dtype=wide)[text.offset : text.offset + n + 1].astype(np.int64)
        self.data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
        self.at = at - at[0]
        self.known = n - self.ids.null_count  # documents that have an id
        self.end = int(self.at[self.known])
        self.doc_ids = self.ids.slice(0, self.known).to_numpy(zero_copy_only=False).astype(np.int64)

    def docs(self, places):
        import numpy as np

        return np.searchsorted(self.at[: self.known + 1], places, side="right") - 1

    def anchors(self, window: int):
        """(places, hashes) of all anchors of windows that lie in one document with an id."""
        import numpy as np

        gram, n = gram_bytes(window), self.end
        span = window - gram + 1
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))]
        starts = np.ones(n, dtype=bool)
        for a, b in zip(self.at[: self.known], self.at[1 : self.known + 1]):
            starts[max(a, b - window + 1) : b] = False
        for c in range(0, n, _CHUNK):
            # places c to c + _CHUNK, with what their windows reach on both sides
            lo, hi = max(0, c - span + 1), min(n, c + _CHUNK + 2 * window)
            if hi - lo < window:
                continue
            h = _gram_hashes(self.data[lo:hi], gram)
            least = _rolling(h, span, np.minimum)
            least[~starts[lo : lo + len(least)]] = 0
            # the largest of the windows' minima over the windows that hold a place
            padded = np.zeros(len(least) + 2 * (span - 1), dtype=np.uint64)
            padded[span - 1 : span - 1 + len(least)] = least
            most = _rolling(padded, span, np.maximum)[: len(h)]
            at = np.flatnonzero((most == h[: len(most)]) & (h[: len(most)] != 0)) + lo
            mine = (at >= c) & (at < c + _CHUNK)
            found.append((at[mine], h[at[mine] - lo]))
        return np.concatenate([p for p, _ in found]), mixed(np.concatenate([h for _, h in found]) + np.uint64(1))

    def around(self, places, window: int):
        """(bytes, low, high): the bytes of all windows that hold each anchor, how many lie before it and from it on."""
        import numpy as np

        gram = gram_bytes(window)
        before = window - gram
        doc = self.docs(places)
        low = np.minimum(before, places - self.at[doc])
        high = np.minimum(window, self.at[doc + 1] - places)
        shift = np.arange(-before, window)
        content = self.data[np.clip(places[:, None] + shift[None, :], 0, max(0, self.end - 1))]
        content[(shift[None, :] < -low[:, None]) | (shift[None, :] >= high[:, None])] = 0
        return content, low.astype(np.uint8), high.astype(np.uint8)


def _gram_hashes(data, gram: int):
    import numpy as np

    n = len(data) - 7
    words = np.empty(n, dtype=np.uint64)
    for r in range(min(8, n)):
        words[r::8] = np.frombuffer(data, dtype="<u8", count=(n - r + 7) // 8, offset=r)
    words = mixed(words + np.uint64(0x632BE59BD9B4E019))
    n = len(data) - gram + 1
    h = words[:n].copy()
    for k in range(8, gram, 8):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return h


def _rolling(values, size: int, best):
    """best() of each ``size`` consecutive values, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def _rows(content, *more):
    """One comparable value for each row of bytes."""
    import numpy as np

    whole = np.ascontiguousarray(np.column_stack([content, *more])) if more else np.ascontiguousarray(content)
    return whole.view(np.dtype((np.void, whole.shape[1]))).ravel()


def _distinct(values):
    """(first rows of the different values, number of each row's value)."""
    import numpy as np

    _, first, which = np.unique(values, return_index=True, return_inverse=True)
    return first, which.ravel()


def equal_windows(content, group):
    """(rows, group) of rows of bytes that equal another one of their group: digits of eight bytes, first to last."""
    import numpy as np

    n, size = content.shape
    padded = np.zeros((n, -(-size // 8) * 8), dtype=np.uint8)
    padded[:, :size] = content
    digits = padded.view(">u8").astype(np.uint64)
    rows = np.arange(n)
    for d in range(digits.shape[1]):
        if not len(rows):
            break
        digit = digits[rows, d]
        order = np.lexsort((digit, group))
        rows, group, digit = rows[order], group[order], digit[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        run = np.cumsum(new) - 1
        more = np.bincount(run)[run] > 1
        rows, group = rows[more], run[more]
    return rows, group


def _later(content, group, doc):
    """Rows that equal a row of a smaller document."""
    import numpy as np

    rows, group = equal_windows(content, group)
    if not len(rows):
        return rows
    begins = np.flatnonzero(np.diff(group, prepend=-1))
    low = np.repeat(np.minimum.reduceat(doc[rows], begins), np.diff(np.append(begins, len(rows))))
    return rows[doc[rows] > low]


def _all_places(low, high, window: int):
    """Masks of the places that an anchor has in windows inside its document."""
    import numpy as np

    one = np.uint64(1)
    first = np.maximum(0, window - high.astype(np.int64)).astype(np.uint64)
    last = low.astype(np.uint64)
    return ((one << (last + one)) - one) & ~((one << first) - one)


def later_places(content, low, high, doc, window: int):
    """For each anchor the places for which its window equals one of a smaller document (a mask)."""
    import numpy as np

    before = window - gram_bytes(window)
    first, which = _distinct(_rows(content, low, high))
    smallest = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(smallest, which, doc)
    content, low, high = content[first], low[first], high[first]
    _, gram = _distinct(_rows(content[:, before:window]))
    live = np.flatnonzero(np.bincount(gram)[gram] > 1)
    masks = np.zeros(len(first), dtype=np.uint64)
    for place in range(before + 1):
        rows = live[(low[live] >= place) & (high[live] >= window - place)]
        if len(rows) > 1:
            begin = before - place
            found = _later(content[rows, begin : begin + window], gram[rows], smallest[rows])
            masks[rows[found]] |= np.uint64(1 << place)
    return np.where(doc > smallest[which], _all_places(low, high, window)[which], masks[which])


def _keys(hashes, buckets: int):
    """A bucket and 32 bits in it, as one number."""
    import numpy as np

    bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
    return (bucket << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _split(parts, *columns):
    """Slices of columns sorted by ``parts``: (part, columns)."""
    import numpy as np

    order = np.argsort(parts, kind="stable")
    parts = parts[order]
    cuts = np.flatnonzero(np.diff(parts, prepend=-1, append=-1)) if len(parts) else []
    for a, b in zip(cuts, cuts[1:]):
        yield int(parts[a]), [c[order[a:b]] for c in columns]


def _blobs(table, name: str, dtype):
    """A binary column as one array, and the row of each value."""
    import numpy as np

    parts = [np.frombuffer(b.as_buffer(), dtype=dtype) for chunk in table.column(name).chunks for b in chunk]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)), row


def _table(schema: str, rows: list[tuple]):
    import pyarrow as pa

    names, kinds = zip(*(c.strip().split(" ") for c in schema.split(",")))
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[k] for k in kinds]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=list(names))


_SENT = "bucket int, batch int, keys binary, notes binary"
_SHARED = "batch int, bucket int, keys binary, hot binary"


def _sent(window: int, buckets: int):
    """First pass: a batch's anchors, each once, with its number of different surroundings and whether documents share it."""

    def run(table):
        import numpy as np

        texts = Texts(table)
        places, hashes = texts.anchors(window)
        keys = _keys(hashes, buckets)
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        run_, sizes = np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(keys)))
        notes = np.ones(len(sizes), dtype=np.uint8)
        again = np.flatnonzero(sizes[run_] > 1) if len(sizes) else np.zeros(0, dtype=np.int64)
        if len(again):
            group, doc = run_[again], texts.docs(places[again])
            pairs = np.unique(np.stack([group, _distinct(_rows(*texts.around(places[again], window)))[1]]), axis=1)[0]
            kinds, several = np.bincount(pairs, minlength=len(sizes)), np.zeros(len(sizes), dtype=bool)
            inside = group[1:] == group[:-1]
            several[group[1:][inside & (texts.doc_ids[doc[1:]] != texts.doc_ids[doc[:-1]])]] = True
            repeated = sizes > 1
            notes[repeated] = (np.minimum(kinds, 127) | np.where(several, 128, 0))[repeated]
        keys = keys[new]
        number = table.column("batch")[0].as_py()
        return _table(_SENT, [(b, number, k.astype(np.uint32).tobytes(), n.tobytes()) for b, (k, n) in _split((keys >> np.uint64(32)).astype(np.int64), keys, notes)])

    return run


def _shared(hot: int):
    """Anchors of a bucket that more than one document may hold, back to their batches."""

    def run(table):
        import numpy as np

        keys, row = _blobs(table, "keys", np.uint32)
        notes, _ = _blobs(table, "notes", np.uint8)
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        run_ = np.cumsum(new) - 1
        kinds = np.bincount(run_, weights=(notes & 127)[order])
        several = (np.bincount(run_) > 1) | (np.bincount(run_, weights=(notes >> 7)[order]) > 0)
        keep, large = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
        keep[order], large[order] = several[run_], (kinds > hot)[run_]
        batches, bucket = table.column("batch").to_pylist(), table.column("bucket")[0].as_py()
        cuts = np.searchsorted(row, np.arange(len(batches) + 1))
        rows = []
        for b, s, e in zip(batches, cuts, cuts[1:]):
            mine = keep[s:e]
            if mine.any():
                rows.append((b, bucket, keys[s:e][mine].tobytes(), large[s:e][mine].astype(np.uint8).tobytes()))
        return _table(_SHARED, rows)

    return run


def _moved(window: int, buckets: int):
    """Second pass: surroundings of shared anchors, or windows of hot ones; what the batch can decide itself goes as marks."""

    def run(table, shared):
        import numpy as np

        if not table.num_rows or not shared.num_rows:
            return _table(_MOVED, [])
        texts, number, rows = Texts(table), table.column("batch")[0].as_py(), []
        places, hashes = texts.anchors(window)
        known, row = _blobs(shared, "keys", np.uint32)
        large, _ = _blobs(shared, "hot", np.uint8)
        known = (np.array(shared.column("bucket").to_pylist(), dtype=np.uint64)[row] << np.uint64(32)) | known.astype(np.uint64)
        order = np.argsort(known)
        known, large = known[order], large[order].astype(bool)
        keys = _keys(hashes, buckets)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        kept = known[at] == keys
        warm, hot = kept & ~large[at], places[kept & large[at]]

        def marks(first, which, refs, doc, masks, hot_bit):
            """Rows that equal an earlier one of the batch: wholly decided in a larger document, else as that one."""
            rest = np.ones(len(refs), dtype=bool)
            rest[first] = False
            rest = np.flatnonzero(rest)
            one = first[which[rest]]
            over = doc[rest] > doc[one]
            for kind, pick, value in ((_FULL, over, masks[rest]), (_LINK, ~over, (refs[one] * 2 + hot_bit).astype(np.uint64))):
                if pick.any():
                    rows.append((number % buckets, number, kind, None, None, None, None, (refs[rest][pick] * 2 + hot_bit).tobytes(), value[pick].tobytes()))

        refs, bucket = places[warm], (keys[warm] >> np.uint64(32)).astype(np.int64)
        if len(refs):
            content, low, high = texts.around(refs, window)
            doc = texts.doc_ids[texts.docs(refs)]
            first, which = _distinct(_rows(content, low, high))
            for b, (c, lo, hi, d, r) in _split(bucket[first], content[first], low[first], high[first], doc[first], refs[first]):
                rows.append((b, number, 0, c.tobytes(), lo.tobytes(), hi.tobytes(), d.tobytes(), (r * 2).tobytes(), None))
            marks(first, which, refs, doc, _all_places(low, high, window), 0)
        if len(hot):
            _, low, high = texts.around(hot, window)
            masks = _all_places(low, high, window)
            refs = np.unique(np.concatenate([hot[masks >> np.uint64(p) & np.uint64(1) == 1] - p for p in range(window - gram_bytes(window) + 1)]))
            for s in range(0, len(refs), 1 << 17):  # windows equal across slices only cost a second row
                some = refs[s : s + (1 << 17)]
                content = texts.data[some[:, None] + np.arange(window)[None, :]]
                doc = texts.doc_ids[texts.docs(some)]
                first, which = _distinct(_rows(content))
                bucket = (_content_hashes(content[first]) % np.uint64(buckets)).astype(np.int64)
                for b, (c, d, r) in _split(bucket, content[first], doc[first], some[first]):
                    rows.append((b, number, 1, c.tobytes(), None, None, d.tobytes(), (r * 2 + 1).tobytes(), None))
                marks(first, which, some, doc, np.ones(len(some), dtype=np.uint64), 1)
        return _table(_MOVED, rows)

    return run


def _content_hashes(content):
    import numpy as np

    padded = np.zeros((len(content), -(-content.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : content.shape[1]] = content
    h = np.zeros(len(content), dtype=np.uint64)
    for column in padded.view("<u8").T:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h


def _marked(window: int):
    """A bucket's anchors and windows that equal ones of smaller documents, back to their batches."""

    def run(table):
        import numpy as np
        import pyarrow.compute as pc

        done = table.filter(pc.greater_equal(table.column("kind"), _FULL))
        rows = list(zip(*(done.column(c).to_pylist() for c in ("batch", "kind", "ref", "mask"))))
        for kind, width in ((0, 2 * window - gram_bytes(window)), (1, window)):
            part = table.filter(pc.equal(table.column("kind"), kind))
            if not part.num_rows:
                continue
            content = _blobs(part, "content", np.uint8)[0].reshape(-1, width)
            doc, row = _blobs(part, "doc", np.int64)
            ref, _ = _blobs(part, "ref", np.int64)
            if kind == 0:
                masks = later_places(content, _blobs(part, "low", np.uint8)[0], _blobs(part, "high", np.uint8)[0], doc, window)
            else:
                masks = np.zeros(len(doc), dtype=np.uint64)
                masks[_later(content, np.zeros(len(doc), dtype=np.int64), doc)] = 1
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            for b, s, e in zip(part.column("batch").to_pylist(), cuts, cuts[1:]):
                some = masks[s:e] != 0
                if some.any():
                    rows.append((b, _FULL, ref[s:e][some].tobytes(), masks[s:e][some].tobytes()))
        return _table(_MARKS, rows)

    return run


def covered(texts: Texts, marks, window: int):
    """Whether each byte of a batch lies in a marked window."""
    import numpy as np
    import pyarrow.compute as pc

    refs, masks = [], []
    full = marks.filter(pc.equal(marks.column("kind"), _FULL))
    links = marks.filter(pc.equal(marks.column("kind"), _LINK))
    ref, mask = _blobs(full, "ref", np.int64)[0], _blobs(full, "mask", np.uint64)[0]
    order = np.argsort(ref, kind="stable")
    ref, mask = ref[order], mask[order]
    refs.append(ref)
    masks.append(mask)
    mine, like = _blobs(links, "ref", np.int64)[0], _blobs(links, "mask", np.uint64)[0].astype(np.int64)
    if len(ref) and len(mine):
        at = np.minimum(np.searchsorted(ref, like), len(ref) - 1)
        same = ref[at] == like
        refs.append(mine[same])
        masks.append(mask[at[same]])
    ref, mask = np.concatenate(refs) >> 1, np.concatenate(masks)
    steps = np.zeros(len(texts.data) + window + 1, dtype=np.int32)
    for place in range(64):
        start = ref[mask >> np.uint64(place) & np.uint64(1) == 1] - place
        np.add.at(steps, start, 1)
        np.add.at(steps, start + window, -1)
    return np.cumsum(steps)[: len(texts.data)] > 0


def _cleaned(window: int, id_col: str, with_text: bool):
    """Last pass: what is left of each document of a batch."""

    def run(table, marks):
        import numpy as np
        import pyarrow as pa

        if not table.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string() if not with_text else pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])
        texts = Texts(table)
        gone = covered(texts, marks, window)
        removed, spans, kept = [], [], []
        for a, b in zip(texts.at, texts.at[1:]):
            mine = gone[a:b]
            removed.append(int(mine.sum()))
            spans.append(int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()))
            left = texts.data[a:b][~mine].tobytes()
            kept.append(left if with_text else hashlib.sha256(left).hexdigest())
        return pa.table([texts.ids, pa.array(np.diff(texts.at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept)], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans`` of each document, and ``kept_sha256`` or the bytes that are left (``kept``).

    A byte goes when a string of ``window`` bytes over it also starts in a document with a smaller id;
    strings are judged on the input. Null texts are empty. Documents with a null id keep all their bytes and take none
    from others. Documents of one id (repeated rows) take nothing from each other, but all lose what
    smaller ids hold. An empty table gives no rows; ids are whole numbers; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = lambda each: max(1, -(-size // each), min(64, size >> 15))
    batches, buckets = count(_BATCH_BYTES), count(_BUCKET_BYTES)
    # equal ids and null ids stay together only by chance: salted by the text, both are dealt out
    dealt = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(batches)).cast("int").alias("batch"), "id", "text")
    by_batch = dealt.groupBy("batch")
    sent = by_batch.applyInArrow(_sent(window, buckets), _SENT)
    shared = sent.groupBy("bucket").applyInArrow(_shared(hot), _SHARED)
    moved = dealt.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(_moved(window, buckets), _MOVED)
    marks = moved.groupBy("bucket").applyInArrow(_marked(window), _MARKS)
    kept = "binary" if with_text else "string"
    out = dealt.groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(_cleaned(window, id_col, with_text), f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept {kept}")
    return out if with_text else out.withColumnRenamed("kept", "kept_sha256")
