"""SimHash near-duplicates: pigeonhole blocks of a 64-bit fingerprint, then exact Hamming distance.

Two fingerprints at ``radius`` or fewer differing bits, cut into ``blocks`` blocks, agree on at
least ``blocks - radius`` of them. So every choice of that many blocks is a join key, each close
pair shares a key, and the Hamming distance of what shares a key is verified. Equal fingerprints
are one class from the start: thousands of copies are one row here. Within a key only a spanning
forest of the links leaves the task, and keys of many fingerprints are dealt into tiles.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType

from . import common

SHINGLE_WORDS = 3
RADIUS = 3
BLOCKS = 6
TILE_ROWS = 4096
# The verified form: fingerprints, their radius and blocks, and what similarity means.
PRINTS, WIDE_RADIUS, WIDE_BLOCKS = 5, 7, 9
SIMILAR_WORDS, SIMILARITY = 5, 0.8
# Links in tiles of so many members or fewer are looked for all at once, in larger ones one member after another. In the
# verified form that changes how links are found, never which: see similar_groups.
SMALL_TILE = 24
_LONG = 1 << 16
# Bits of the table of counts that orders shingles by rarity: 8 MB in each task at any size. Other
# bits change how many pairs are compared, never which links are found.
RANK_BITS = 20
# Links that a member keeps of those which the tiles find, nearest first in each of so many parts; what they leave out the prefix join finds.
KEPT_LINKS = 16
# Bits of a shingle set's bitmap in the prefix join: rows of 64 bytes. Other bits change how many pairs are compared, never which links are found.
MAP_BITS = 512


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of one text (null: no words).

    A-Z are lower-cased, words are runs of other than ASCII white space, shingles are
    ``shingle_words`` words joined by a space, repeats included; fewer words are one shingle;
    no words give zero. A bit is set when over half of the XXH64 (seed 42) values have it.
    """
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    whole = b" ".join(words)
    if len(words) <= shingle_words:
        return hash_(whole, 42)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    n = len(words) - shingle_words + 1
    starts = (ends - lengths + 1)[:n].tolist()
    ends = ends[shingle_words - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _LONG):
        hashes = np.array([hash_(whole[i:j], 42) for i, j in zip(starts[at : at + _LONG], ends[at : at + _LONG])], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle_words: int = SHINGLE_WORDS, out: str = "fp") -> DataFrame:
    """All columns of ``docs`` but the text, and the fingerprint as a signed long."""
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep).schema.add(out, "long")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in common.sliced(batches):
            texts = batch.column(batch.num_columns - 1)
            values = [fingerprint(t, shingle_words) for t in texts.to_pylist()]
            signed = np.array(values, dtype=np.uint64).view(np.int64)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(signed)], names=[*keep, out])

    return docs.select(*keep, F.col(text).cast("string")).mapInArrow(run, schema)


def masks(blocks: int, radius: int) -> list[int]:
    """One signed 64-bit mask for each choice of ``blocks - radius`` blocks."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be less than blocks, and blocks at most 64")
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    whole = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in whole]


def _forest(fp, chunk, cross: bool, radius: int, seed: int = 0):
    """Spanning forest of the links in one tile: each member meets only those not yet reached.

    Members come in an order drawn from ``seed``, so that tiles of the same members differ.
    """
    import numpy as np

    left = np.random.default_rng(seed & 0xFFFFFFFF).permutation(len(fp))
    found = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= radius
            if cross:
                near &= chunk[left] != chunk[at]
            if near.any():
                reached = left[near]
                found.append(np.stack([np.full(len(reached), at), reached]))
                queue.extend(reached.tolist())
                left = left[~near]
    return np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=int)


def _tile_links(frame, radius: int, small: int = SMALL_TILE, sparse: bool = False):
    """Index pairs of links in whole tiles: small tiles all at once by shifts, large ones one by one.

    With ``sparse`` a member of a small tile keeps one link, to the first that it is linked with before it, else to the last after it:
    whoever has a link is in a pair, but pairs don't grow with the square of a tile.
    """
    import numpy as np

    starts = common.group_starts(frame, ["key", "tile"])
    sizes = np.diff(starts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    fp, chunk, cross = frame["fp"].to_numpy().view(np.uint64), frame["chunk"].to_numpy(), frame["cross"].to_numpy()
    keys = frame["key"].to_numpy()
    is_small = (sizes <= small)[group]
    pairs = []
    before, after = np.full(len(fp), len(fp)), np.full(len(fp), -1)
    for shift in range(1, min(small, int(sizes.max()))):
        ok = (group[shift:] == group[:-shift]) & is_small[shift:]
        i = np.flatnonzero(ok)
        if not len(i):
            break
        j = i + shift
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= radius) & (~cross[i] | (chunk[i] != chunk[j]))
        if sparse:
            before[j[near]], after[i[near]] = i[near], j[near]  # further shifts are farther away
        else:
            pairs.append(np.stack([i[near], j[near]]))
    if sparse:
        low, high = np.flatnonzero(before < len(fp)), np.flatnonzero((before == len(fp)) & (after >= 0))
        pairs.append(np.concatenate([np.stack([before[low], low]), np.stack([high, after[high]])], axis=1))
    for g in np.flatnonzero(sizes > small):
        a, b = starts[g], starts[g + 1]
        pairs.append(_forest(fp[a:b], chunk[a:b], bool(cross[a]), radius, int(keys[a])) + a)
    return np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), dtype=int)


def _tiles(classes: DataFrame, radius: int, blocks: int, tile_rows: int, node: str) -> DataFrame:
    """Tiles of what shares a key; a column ``print`` says which fingerprint ``fp`` is, for these never meet."""
    which = [F.col("print")] if "print" in classes.columns else []
    keys = F.array(*[F.xxhash64(F.lit(i), *which, F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(blocks, radius))])
    keyed = classes.select("fp", F.col(node).alias("node"), F.explode(keys).alias("key"))
    return common.tiled(keyed, "node", tile_rows).select("key", "tile", "chunk", "cross", "fp", "node")


def links(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile_rows: int = TILE_ROWS, node: str = "fp") -> DataFrame:
    """Edges ``a, b`` between rows of distinct ``node`` with the components of all links of column ``fp``.

    Every link joins two members of one component of these edges, and every edge is a link.
    """

    def run(batches):
        import pyarrow as pa

        for frame in common.group_batches(batches, ["key", "tile"]):
            i, j = _tile_links(frame, radius)
            nodes = frame["node"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], names=["a", "b"])

    return _tiles(classes, radius, blocks, tile_rows, node).mapInArrow(run, "a long, b long")


def _some_links(classes: DataFrame, radius: int, blocks: int, tile_rows: int, kept: int | None = None) -> DataFrame:
    """Edges ``a, b`` between column ``cid``, once each: every row that has a link is in one, and rows choose ``kept`` links or fewer.

    Links of a row fall into ``kept`` parts by a hash of both ends, and of each part it chooses the nearest. So there are at most ``kept`` edges for
    each row with a link, whatever the number of keys and the size of groups.
    """
    kept = KEPT_LINKS if kept is None else kept

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for frame in common.group_batches(batches, ["key", "tile"]):
            i, j = _tile_links(frame, radius, sparse=True)
            nodes, fp = frame["node"].to_numpy(), frame["fp"].to_numpy().view(np.uint64)
            columns = [np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j]), np.bitwise_count(fp[i] ^ fp[j]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["a", "b", "d"])

    found = _tiles(classes, radius, blocks, tile_rows, "cid").mapInArrow(run, "a long, b long, d int")
    found = common.materialize(found.where("a <> b").groupBy("a", "b").agg(F.min("d").alias("d")))
    part = F.pmod(F.xxhash64("a", "b"), F.lit(kept)).alias("part")
    ends = [found.select(F.col(x).alias("x"), F.col(y).alias("y"), "d", part) for x, y in (("a", "b"), ("b", "a"))]
    chosen = ends[0].union(ends[1]).groupBy("x", "part").agg(F.min(F.struct("d", "y"))["y"].alias("y"))
    chosen = common.materialize(chosen.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    common.release(found)
    return chosen


def _bucket(shingles, bits: int):
    """Place of 32-bit hashes in a table of ``2 ** bits`` counts."""
    import numpy as np

    return np.asarray(shingles, dtype=np.int32).view(np.uint32) >> np.uint32(32 - bits)


def _rarity(sets: DataFrame, bits: int):
    """How many shingles of ``s`` fall into each bucket: an array of fixed size, whatever the corpus."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, n = np.unique(_bucket(batch.column(0).flatten().to_numpy(zero_copy_only=False), bits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64))], names=["at", "n"])

    found = sets.select("s").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    counts = np.ones(1 << bits, dtype=np.int64)
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return counts


def _prefixes(sets: DataFrame, similarity: float, bits: int) -> DataFrame:
    """``key, place, node, root, n, map``: the rarest shingles of each set, one of which every similar set shares, and a bitmap of the set."""
    counts = _rarity(sets, bits)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for node, root, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = held.values.to_numpy(zero_copy_only=False)
                often = counts[_bucket(s, bits)]
                first = np.lexsort((s, often))[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]
                place = np.flatnonzero(often[first] > 1)
                own = [np.full(len(place), v, dtype=np.int64) for v in (node, root, len(s))]
                columns = [s[first[place]].astype(np.int64), place, *own]
                maps = pa.array([_bitmap(s)] * len(place), pa.binary())
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), maps], names=["key", "place", "node", "root", "n", "map"])

    sets = sets.select("cid", "root", "s").where(F.size("s") > 0)
    return sets.mapInArrow(run, "key long, place long, node long, root long, n long, map binary")


def _bitmap(shingles) -> bytes:
    """Which of ``MAP_BITS`` low values the shingles have."""
    import numpy as np

    held = np.zeros(MAP_BITS, dtype=np.uint8)
    held[np.asarray(shingles, dtype=np.int32).view(np.uint32) & np.uint32(MAP_BITS - 1)] = 1
    return np.packbits(held).tobytes()


def _shared_at_most(n, maps, m, map_):
    """Bound on what sets of ``n`` shingles share with one of ``m``: each bit that one bitmap has alone is a shingle that the other set lacks."""
    import numpy as np

    own = np.bitwise_count(maps & ~map_).sum(axis=1, dtype=np.int64)
    others = np.bitwise_count(map_ & ~maps).sum(axis=1, dtype=np.int64)
    return np.minimum(n - own, m - others)


def _links_across(
    members: DataFrame, roots: DataFrame, rows: DataFrame, classes: DataFrame, similarity: float, tile_rows: int, bits: int = RANK_BITS
) -> DataFrame:
    """Pairs ``a, b`` of ``members`` in different components, all similar ones among them.

    Shingles are ordered by how often the members hold them, rarest first. Sets of ``n`` and ``m``
    shingles with similarity ``t`` share ``t / (1 + t) * (n + m)`` or more, so the first one they share
    stands early in both, and enough follow it. A set whose rare shingles are all its own meets nothing. Bitmaps of the sets
    rule out most pairs that share one and aren't similar before they leave the task.
    """
    wanted = members.join(roots.withColumnRenamed("node", "_n"), F.col("cid") == F.col("_n"), "left").select("cid", F.coalesce("root", "cid").alias("root"))
    wanted = classes.select("cid", "whole").join(wanted, "cid")
    sets = rows.select("whole", "shingles").join(wanted, "whole").groupBy("cid", "root").agg(F.min("shingles").alias("s"))
    keyed = common.materialize(_prefixes(common.materialize(sets), similarity, bits))
    split = keyed.groupBy("key").agg((F.min("root") < F.max("root")).alias("_open")).where("_open").select("key")
    share = similarity / (1 + similarity)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for frame in common.group_batches(batches, ["key", "tile"]):
            starts = common.group_starts(frame, ["key", "tile"])
            columns, held, count = [frame[c].to_numpy() for c in ("place", "node", "root", "n", "chunk", "cross")], [], 0
            columns.append(np.frombuffer(b"".join(frame["map"]), dtype=np.uint64).reshape(-1, MAP_BITS // 64))
            for lo, hi in zip(starts[:-1], starts[1:]):
                place, node, root, n, chunk, cross, maps = (c[lo:hi] for c in columns)
                values, sizes = np.unique(root, return_counts=True)
                most, order = values[sizes.argmax()], np.arange(hi - lo)
                for at in np.flatnonzero(root != most):  # the largest component meets the others, never itself
                    near = (root != root[at]) & ((root == most) | (order > at))
                    near &= np.minimum(n - place, n[at] - place[at]) >= share * (n + n[at]) - 1e-9
                    if cross[0]:
                        near &= chunk != chunk[at]
                    near = np.flatnonzero(near)
                    near = near[_shared_at_most(n[near], maps[near], n[at], maps[at]) >= share * (n[near] + n[at]) - 1e-9]
                    other = node[near]
                    if not len(other):
                        continue
                    held.append(np.stack([np.full(len(other), node[at]), other]))
                    count += len(other)
                    if count > _LONG:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(held, axis=1))), names=["a", "b"])
                        held, count = [], 0
            if held:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(held, axis=1))), names=["a", "b"])

    return common.tiled(keyed.join(split, "key", "left_semi"), "node", tile_rows).mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """One row for each row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Component ids are the smallest id that links reach. Null texts count as empty, and empty
    texts have fingerprint zero and link like any other. Rows with a null id keep a row and
    take the component's smallest id (null if it has none). Repeated rows give repeated rows.
    An empty table gives no rows. Other columns are not read.
    """
    prints = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    prints = common.materialize(fingerprints(prints, "_text", shingle_words))
    classes = prints.groupBy("fp").agg(F.min("_id").alias("low"))
    roots = common.connected_components(links(prints.select("fp").distinct(), radius, blocks, tile_rows))
    member = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    member = common.materialize(member)
    grouped = member.join(roots.select("root").distinct(), "root", "left_semi")
    lows = grouped.groupBy("root").agg(F.min("low").alias("root_low"))
    member = member.join(lows, "root", "left").select("fp", F.coalesce("root_low", "low").alias("component_id"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(member, "fp").select(F.col("_id").alias(id_col), digits.alias("fingerprint"), "component_id")


def sketches(docs: DataFrame, text: str = "text", shingle_words: int = SHINGLE_WORDS, prints: int = PRINTS, similar_words: int = SIMILAR_WORDS) -> DataFrame:
    """All columns but the text, ``fps`` (``prints`` fingerprints), ``shingles`` and ``whole``.

    ``shingles`` are the distinct 32-bit hashes of ``similar_words`` words each, sorted; ``whole``
    is a 128-bit hash of the set of their 64-bit hashes, equal for equal sets. Further
    fingerprints mix the same hashes anew, so they differ independently for different texts.
    """
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep).schema.add("fps", ArrayType(LongType())).add("shingles", ArrayType(IntegerType())).add("whole", BinaryType())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in common.sliced(batches):
            found = [_sketch(t, shingle_words, prints, similar_words) for t in batch.column(batch.num_columns - 1).to_pylist()]
            fps = pa.array([np.array(f, dtype=np.uint64).view(np.int64) for f, _, _ in found], pa.list_(pa.int64()))
            sets = pa.array([s for _, s, _ in found], pa.list_(pa.int32()))
            whole = pa.array([w for _, _, w in found], pa.binary())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, fps, sets, whole], names=[*keep, "fps", "shingles", "whole"])

    return docs.select(*keep, F.col(text).cast("string")).mapInArrow(run, schema)


def _sketch(text: str | None, shingle_words: int, prints: int, similar_words: int):
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1

    def hashed(k: int, hash_, kind: str):
        if not words:
            return np.empty(0, dtype=kind)
        n = max(1, len(words) - k + 1)
        starts, stops = (ends - lengths + 1)[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist()
        return np.fromiter((hash_(whole[i:j], 42) for i, j in zip(starts, stops)), dtype=kind, count=n)

    hashes = hashed(shingle_words, xxhash.xxh64_intdigest, "<u8")
    fps = []
    for r in range(prints):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), _LONG):
            h = hashes[at : at + _LONG]
            if r:  # a round of mixing for each further fingerprint
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * r)
                h = h ^ (h >> np.uint64(32))
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        fps.append(int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0)
    wide = np.unique(hashed(similar_words, xxhash.xxh64_intdigest, "<u8").view(np.int64))
    return fps, np.unique((wide >> 32).astype(np.int32)), xxhash.xxh3_128_digest(wide.tobytes())


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    similar_words: int = SIMILAR_WORDS,
    prints: int = PRINTS,
    radius: int = WIDE_RADIUS,
    blocks: int = WIDE_BLOCKS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``id, component_id`` by links that are verified: Jaccard similarity of word shingles.

    One rule holds whatever stands beside a pair: two texts are linked when they are within ``radius`` bits in one of
    several fingerprints and the sets of their ``similar_words``-word shingles have the similarity. Texts of equal sets
    are one class. Large tiles send a spanning
    forest, and each text keeps ``KEPT_LINKS`` candidates of all tiles; what these left out is found among their members by an exact prefix join on rare
    shingles, of which only pairs within the radius count. Edge cases are those of ``near_duplicates``.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    rows = common.materialize(sketches(rows, "_text", prints=prints, similar_words=similar_words))
    classes = rows.groupBy("whole").agg(F.min("_id").alias("low"), F.min(F.size("shingles")).alias("n"))
    classes = common.materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "whole", "low", "n"))
    named = common.materialize(rows.select("whole", "fps").distinct().join(classes.select("whole", "cid"), "whole").select("cid", "fps"))
    each = named.select("cid", F.posexplode("fps").alias("print", "fp")).distinct()
    first = _some_links(each, radius, blocks, tile_rows)
    verified = common.materialize(_verified(first, rows, classes, similarity))
    roots = common.connected_components(verified)
    common.release(verified)
    members = common.materialize(first.select(F.col("a").alias("cid")).union(first.select("b")).distinct())
    more = _links_across(members, roots, rows, classes, similarity, tile_rows)
    more = _within(_ordered(more).join(first.select("a", "b"), ["a", "b"], "left_anti"), named, radius)
    near = common.materialize(more)
    more = common.materialize(_verified(near, rows, classes, similarity))
    for table in (first, members, named, near):  # nothing below reads these
        common.release(table)
    member = classes.join(roots, classes.cid == roots.node, "left").select("whole", "low", F.coalesce("root", "cid").alias("root"))
    if not more.isEmpty():  # only the components of the first links are joined further
        for end in ("a", "b"):
            more = more.join(roots, F.col(end) == F.col("node"), "left").withColumn(end, F.coalesce("root", end)).select("a", "b")
        above = common.connected_components(more).select("node", F.col("root").alias("_above"))
        member = member.join(above, member.root == above.node, "left").select("whole", "low", F.coalesce("_above", "root").alias("root"))
    lows = member.groupBy("root").agg(F.min("low").alias("component_id"))
    member = common.materialize(member.join(lows, "root").select("whole", "component_id"))
    return rows.select("_id", "whole").join(member, "whole").select(F.col("_id").alias(id_col), "component_id")


def _within(pairs: DataFrame, named: DataFrame, radius: int) -> DataFrame:
    """The pairs ``a, b`` that are within the radius in one of their fingerprints."""
    both = pairs.join(named.select(F.col("cid").alias("a"), F.col("fps").alias("_fa")), "a").join(named.select(F.col("cid").alias("b"), F.col("fps").alias("_fb")), "b")
    near = F.exists(F.zip_with("_fa", "_fb", lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius), lambda v: v)
    return both.where(near).select("a", "b").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs of classes whose shingle sets are similar."""
    used = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "cid")
    wanted = classes.join(used, "cid", "left_semi").select("cid", "whole")
    sets = rows.select("whole", "shingles").join(wanted, "whole").groupBy("cid").agg(F.min("shingles").alias("s"))
    sets = common.materialize(sets)
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", find=similar_groups, **options) -> DataFrame:
    """The columns of ``docs``, one document of each group: the one with the smallest id.

    ``find`` makes the groups: ``similar_groups``, or ``near_duplicates`` for Hamming distance alone;
    options are its own. Rows that repeat an id and its text are one row;
    rows with a null id stay, but for repeats of the same text among them. The ids to drop are
    broadcast only while they are few; else the join is a shuffle.
    """
    found = common.materialize(find(docs, id_col, text, **options).select(F.col(id_col).alias("_id"), "component_id"))
    kept = found.where(F.col("_id") == F.col("component_id")).select("_id").distinct()
    gone = common.materialize(found.where(F.col("_id").isNotNull()).select("_id").distinct().join(kept, "_id", "left_anti"))
    n_gone = gone.count()
    gone = F.broadcast(gone) if n_gone <= common.BROADCAST_ROWS else gone
    rows = docs.join(gone, docs[id_col] == gone["_id"], "left_anti")
    again = common.materialize(found.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id"))
    n_again = again.count()
    if not n_again:
        return rows
    again = F.broadcast(again) if n_again <= common.BROADCAST_ROWS else again
    same = rows[id_col].eqNullSafe(again["_id"])
    once = rows.join(again, same, "left_anti")
    return once.unionByName(rows.join(again, same, "left_semi").dropDuplicates([id_col, text]))
