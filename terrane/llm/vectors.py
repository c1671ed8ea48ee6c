"""Near-duplicate vectors: a subspace pigeonhole join, then the exact cosine.

Unit vectors at cosine ``t`` or more are at squared distance ``2 - 2t`` or less. A fixed random
rotation spreads that distance over all axes; cut into blocks of few axes, a close pair is within
a block's share of the squared distance (in proportion to its axes) in at least one block. Each
block is a range join by recursive halving: members split at an axis, and those near enough to the
cut, by what is left of their budget, visit the other side too, so no pair in reach is lost and
each further axis leaves fewer. A label that fits one task is halved there, at medians. A larger
one is first dealt out by the signs of so many axes that cells stay small; vectors visit the cells
with a lower code in reach. What meets within the block's budget is verified by the cosine in
double precision. A pair counts in its first block within budget, so in one place only. Equal
vectors are one class from the start, and only link counts and a spanning forest leave a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from . import common

THRESHOLD = 0.98
BLOCK_DIMS = 16
TILE_ROWS = 8192
SEED = 20240607
_SLACK = 1e-9
_PAIRS = 1 << 15
_LEAF = 4096
_ALL_BLOCKS = -1


def rotation(dims: int, seed: int = SEED):
    """A fixed random rotation of ``dims`` axes."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_edges(dims: int, block_dims: int) -> list[tuple[int, int]]:
    n = max(1, -(-dims // block_dims))
    cuts = [round(i * dims / n) for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def unit(rows):
    """Rows scaled to length one in double precision, safe for very large and very small numbers."""
    import numpy as np

    x = np.asarray(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(vector):
    values = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return vector.isNotNull() & values & F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False)))


def budgets(dims: int, block_dims: int, threshold: float) -> list[float]:
    """Each block's share of the squared distance."""
    return [(2 - 2 * threshold) * (hi - lo) / dims + _SLACK for lo, hi in block_edges(dims, block_dims)]


def visits(z, budget: float, bits: int):
    """(row, code, home) of the sign cells that each row of a block lies in or reaches with a lower code."""
    import numpy as np

    at, code, left = np.arange(len(z)), np.zeros(len(z), dtype=np.int64), np.full(len(z), budget)
    own = np.zeros(len(z), dtype=np.int64)
    for axis in range(min(bits, z.shape[1])):
        bit = (z[:, axis] >= 0).astype(np.int64) << axis
        own |= bit
        gap = z[at, axis] ** 2
        over = gap <= left
        code = np.concatenate([code | bit[at], code[over] | (bit[at[over]] ^ (1 << axis))])
        left = np.concatenate([left, left[over] - gap[over]])
        at = np.concatenate([at, at[over]])
    keep = code <= own[at]
    return at[keep], code[keep], code[keep] == own[at[keep]]


def _cells(classes: DataFrame, threshold: float, block_dims: int) -> DataFrame:
    """A row for each class and cell: one alone where the label fits a task (``bits`` 0), else for each block and cell."""
    schema = classes.select("cid", "label", "n", "vec").schema.add("block", "integer").add("code", "long").add("home", "boolean")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            vec, bits = batch.column("vec"), batch.column("bits").to_numpy(zero_copy_only=False)
            sizes = pa.compute.list_value_length(vec).to_numpy(zero_copy_only=False)
            found = [(np.flatnonzero(bits == 0), _ALL_BLOCKS, 0, True)]
            for dims, many in {*zip(sizes[bits > 0].tolist(), bits[bits > 0].tolist())}:
                rows = np.flatnonzero((sizes == dims) & (bits == many))
                y = unit(np.stack(vec.take(pa.array(rows)).to_pylist())) @ rotation(dims)
                for block, ((lo, hi), budget) in enumerate(zip(block_edges(dims, block_dims), budgets(dims, block_dims, threshold))):
                    at, code, home = visits(y[:, lo:hi], budget, many)
                    found.append((rows[at], block, code, home))
            for rows, block, code, home in found:
                for s in range(0, len(rows), 4096):
                    pick = rows[s : s + 4096]
                    full = lambda v, kind: np.full(len(pick), v, dtype=kind) if np.isscalar(v) else v[s : s + 4096].astype(kind)  # noqa: B023, E731
                    columns = [batch.column(c).take(pa.array(pick)) for c in ("cid", "label", "n", "vec")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(full(block, "int32")), pa.array(full(code, "int64")), pa.array(full(home, "bool"))], names=schema.names)

    return classes.select("cid", "label", "n", "vec", "bits").mapInArrow(run, schema)


def near(z, home, budget: float, leaf: int = _LEAF):
    """Index pairs (i, j) within the squared distance, i at home; each pair of two at home once.

    Targets and probes are halved at the target's median, axis by axis; probes go to both sides
    while their squared way to the cut stays within what is left of the budget.
    """
    import numpy as np

    targets = np.flatnonzero(home)
    todo = [(targets, np.arange(len(z)), np.full(len(z), budget), 0)]
    while todo:
        t, p, left, axis = todo.pop()
        if not len(t) or not len(p):
            continue
        if len(t) * len(p) > leaf and axis < z.shape[1]:
            cut = np.median(z[t, axis])
            below, mine = z[t, axis] < cut, z[p, axis] < cut
            gap = (z[p, axis] - cut) ** 2
            for side, own in ((below, mine), (~below, ~mine)):
                reach = own | (gap <= left)
                todo.append((t[side], p[reach], (left - np.where(own, 0.0, gap))[reach], axis + 1))
            continue
        step = max(1, (1 << 16) // len(p))
        for s in range(0, len(t), step):
            rows = t[s : s + step]
            far = np.zeros((len(rows), len(p)))
            for k in range(z.shape[1]):
                far += (z[rows, k][:, None] - z[p, k][None, :]) ** 2
            ok = (far <= budget) & ((p[None, :] < rows[:, None]) | ~home[p][None, :])
            i, j = np.nonzero(ok)
            if len(i):
                yield rows[i], p[j]


def _tile(x, home, chunk, cross: bool, block: int, threshold: float, block_dims: int):
    """Linked index pairs of one tile, slice by slice: of one block, or of all of them."""
    import numpy as np

    dims = x.shape[1]
    y = unit(x) @ rotation(dims)
    edges, share = block_edges(dims, block_dims), budgets(dims, block_dims, threshold)
    for b in range(len(edges)) if block == _ALL_BLOCKS else (block,):
        lo, hi = edges[b]
        held, count = [], 0
        for pair in _ended(near(y[:, lo:hi], home, share[b])):
            if pair is not None:
                held.append(np.stack(pair))
                count += len(pair[0])
            if not held or (pair is not None and count < _PAIRS):
                continue
            whole, held, count = np.concatenate(held, axis=1), [], 0
            for s in range(0, whole.shape[1], _PAIRS):
                i, j = whole[:, s : s + _PAIRS]
                ok = chunk[i] != chunk[j] if cross else np.ones(len(i), dtype=bool)
                i, j = i[ok], j[ok]
                for k in range(b):  # an earlier block within budget answers for the pair
                    gap = ((y[i, edges[k][0] : edges[k][1]] - y[j, edges[k][0] : edges[k][1]]) ** 2).sum(axis=1)
                    i, j = i[gap > share[k]], j[gap > share[k]]
                same = cosine(x[i], x[j]) >= threshold
                if same.any():
                    yield i[same], j[same]


def _ended(items):
    yield from items
    yield None


def cosine(a, b):
    """Cosines of paired rows in double precision."""
    import numpy as np

    a, b = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    big = np.abs(a).max(axis=1, initial=0), np.abs(b).max(axis=1, initial=0)
    if any(((m < 1e-100) | (m > 1e100)).any() for m in big):
        a, b = a / big[0][:, None], b / big[1][:, None]
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _forest(pairs, n: int):
    """For each of ``n`` members the smallest that the pairs join it with."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[pairs[0]], label[pairs[1]])
        new = label.copy()
        np.minimum.at(new, pairs[0], low)
        np.minimum.at(new, pairs[1], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tile_links(part, block: int, threshold: float, block_dims: int):
    """Of one tile: members with links and their counts, and forest edges (member, smallest member)."""
    import numpy as np

    x, n = np.stack(part["vec"].to_numpy()).astype(np.float64), part["n"].to_numpy()
    counts, label = np.zeros(len(part), dtype=np.int64), np.arange(len(part))
    home = part["home"].to_numpy()
    for i, j in _tile(x, home, part["chunk"].to_numpy(), bool(part["cross"].iloc[0]), block, threshold, block_dims):
        np.add.at(counts, i, n[j])
        np.add.at(counts, j, n[i])
        a, b = label[i], label[j]
        if (a != b).any():
            label = _forest((a, b), len(part))[label]
    at = np.flatnonzero(label != np.arange(len(part)))
    return np.flatnonzero(counts), counts, at, label[at]


def _linked(cells: DataFrame, threshold: float, block_dims: int, tile_rows: int) -> DataFrame:
    """``a, b, n``: link counts of a class (b null) and forest edges (n zero)."""
    key = F.xxhash64("label", F.size("vec"), "block", "code")
    tiles = common.tiled(cells.withColumn("key", key), "cid", tile_rows)
    tiles = tiles.select("key", "tile", "chunk", "cross", "cid", "label", "n", "vec", "block", "code", "home")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for frame in common.group_batches(batches, ["key", "tile"], rows=4096):
            starts = common.group_starts(frame, ["key", "tile"])
            out_a, out_b, out_n = [], [], []
            for s, e in zip(starts, starts[1:]):
                if e - s < 2:
                    continue
                tile = frame.iloc[s:e]
                # rows of another label, block, code or length share a key only when hashes meet
                for (_, block, _, _), part in tile.groupby([tile["label"], tile["block"], tile["code"], tile["vec"].str.len()]):
                    if len(part) < 2 or not part["home"].any():
                        continue
                    at, counts, i, j = _tile_links(part, int(block), threshold, block_dims)
                    cid = part["cid"].to_numpy()
                    out_a += [cid[at], cid[i]]
                    out_b += [np.full(len(at), -1), cid[j]]
                    out_n += [counts[at], np.zeros(len(i), dtype=np.int64)]
            if out_a:
                b = np.concatenate(out_b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_a)), pa.array(b, mask=b < 0), pa.array(np.concatenate(out_n))], names=["a", "b", "n"]
                )

    return tiles.mapInArrow(run, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    block_dims: int = BLOCK_DIMS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """One row for each vector: id, ``n_links``, ``component_id`` and ``kept``.

    Vectors link when their labels are equal and not null, their lengths are equal and their
    cosine is ``threshold`` or more. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing: no links, their own id, kept. Repeated vectors are
    linked with each other. A null id keeps its row, takes the smallest id of its component
    (null if none) and isn't kept. Other columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label).cast("string").alias("_label"), F.col(vector).alias("_vec"))
    kind = rows.schema["_vec"].dataType
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)):
        rows = rows.withColumn("_vec", F.col("_vec").cast(ArrayType(DoubleType())))
    usable = _usable(F.col("_vec")) & F.col("_label").isNotNull()
    # two hashes stand for a label and a vector: whole vectors move once, to their class
    good = rows.where(usable).withColumns({"_k1": F.xxhash64("_label", "_vec"), "_k2": F.xxhash64(F.lit(1), "_vec", "_label")})
    classes = good.groupBy("_k1", "_k2").agg(F.min("_id").alias("low"), F.count("*").alias("n"), F.first("_label").alias("label"), F.first("_vec").alias("vec"))
    classes = common.materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "_k1", "_k2", "label", "vec", "low", "n"))
    sizes = classes.groupBy("label").agg(F.count("*").alias("_m"))
    bits = F.when(F.col("_m") <= tile_rows, 0).otherwise(F.ceil(F.log2(F.col("_m") / tile_rows)).cast("int") + 2)
    found = _linked(_cells(classes.join(sizes, "label").withColumn("bits", bits), threshold, block_dims), threshold, block_dims, tile_rows)
    found = common.materialize(found)
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    roots = common.connected_components(found.where("b is not null").select("a", "b"))
    slim = classes.select("cid", "_k1", "_k2", "low", "n")
    member = slim.join(roots, slim.cid == roots.node, "left").select("cid", "_k1", "_k2", "low", "n", F.coalesce("root", "cid").alias("root"))
    lows = member.groupBy("root").agg(F.min("low").alias("component_id"))
    member = member.join(lows, "root").join(counts, F.col("cid") == counts.a, "left")
    member = member.select("_k1", "_k2", "component_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    member = common.materialize(member)
    for table in (found, roots, classes):
        common.release(table)
    whole = good.select("_id", "_k1", "_k2").join(member, ["_k1", "_k2"]).select("_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(usable, F.lit(False))).select("_id", F.lit(0).cast("long"), F.col("_id").cast("long"))
    out = whole.union(rest)
    return out.select(
        F.col("_id").alias(id_col),
        F.col("n_links").cast("long").alias("n_links"),
        F.col("component_id").cast("long").alias("component_id"),
        F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
