"""Rules that look at rows one after another, over rows dealt by range: no key is ever one task's group.

Rows are sorted by key and order over all partitions, and kept that way by a checkpoint. A partition
can be walked by itself but for its first key, which may go on from the partition before; what that one hands over
is one row for each partition.
"""

from __future__ import annotations

import bisect
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder that the session names; a folder of our own only on a local master."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="terrane-checkpoint-"))
    return df.checkpoint()


def dealt(rows: DataFrame, key: str, order: list[str], parts: int | None = None) -> DataFrame:
    """All rows in (key, order), their partition as ``_part``; the parts never change again. Rows with nested columns get a ``_row``."""
    by = [F.col(c) for c in (key, *order)]
    spread = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    spread = spread.sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    if any(isinstance(f.dataType, (ArrayType, MapType, StructType)) for f in rows.schema):
        spread = spread.withColumn("_row", F.monotonically_increasing_id())
    return checkpointed(spread)


def borders(pinned: DataFrame, key: str) -> list[tuple[int, object, object]]:
    """(part, first key, last key) of the parts that have rows, in order: a row for each partition."""
    found = pinned.groupBy("_part").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    return sorted(((r["_part"], r["a"], r["b"]) for r in found.collect()), key=lambda r: r[0])


def walked(pinned: DataFrame, key: str, columns: list[str], begin: Callable, step: Callable, out: str, kind: str) -> DataFrame:
    """Rows with ``out``: ``step(state, row values)`` gives it and the next state; ``begin(part)`` the state of a part's first key.

    ``begin(None)`` is the state of any other key. A task holds one state and one Arrow batch. Nested columns, which can be
    large and are many times as large in Python, never go there: a walk over ``_row`` is joined with them.
    """
    names = list(dict.fromkeys(["_part", "_row", key, *columns])) if "_row" in pinned.columns else pinned.columns
    schema = pinned.select(*[c for c in names if c != "_part"]).schema.add(out, kind)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for frame in frames:
            values = []
            for part, k, *row in zip(frame["_part"], frame[key], *(frame[c] for c in columns)):
                if k != last:
                    state = begin(int(part) if state is None else None)
                    last = k
                value, state = step(state, *row)
                values.append(value)
            yield frame.assign(**{out: pd.Series(values, index=frame.index, dtype=object)}).drop(columns="_part")

    found = pinned.select(*names).mapInPandas(run, schema)
    if "_row" not in names:
        return found
    found = found.select("_row", out).hint("shuffle_hash")
    return pinned.drop("_part").join(found, "_row").drop("_row")


def last_kept(rows: DataFrame, key: str, order: list[str], x: str, y: str, far: Callable[[float, float, float, float], bool], parts: int | None = None) -> DataFrame:
    """Rows of each key that are ``far`` from the last row kept before them; the first is kept.

    Partitions are walked from what their predecessor is known to hand over, at first nothing. Walks
    from different beginnings soon keep the same row and agree from there on, so few are walked again; the result
    is the one of a single walk over all rows, since it is final only when no hand-over changes.
    """
    pinned = dealt(rows, key, order, parts)
    edges = borders(pinned, key)
    follows = {p: q for (q, _, b), (p, a, _) in zip(edges, edges[1:]) if a == b}  # parts whose first key goes on

    def kept(incoming: dict) -> Callable:
        def begin(part):
            return (incoming.get(part),)

        def step(state, px, py):
            (held,) = state
            if held is not None and not far(held[0], held[1], px, py):
                return False, state
            return True, ((px, py),)

        return walked(pinned, key, [x, y], begin, step, "_kept", "boolean"), begin, step

    incoming: dict[int, tuple[float, float]] = {}
    todo, ends = set(follows.values()), {}
    while todo:
        _, begin, step = kept(incoming)

        def tail(frames, begin=begin, step=step):
            last, state, part = object(), None, None
            for frame in frames:
                for part, k, px, py in zip(frame["_part"], frame[key], frame[x], frame[y]):
                    if k != last:
                        state = begin(int(part) if state is None else None)
                        last = k
                    _, state = step(state, px, py)
            if state is not None and state[0] is not None:
                yield pd.DataFrame({"part": [int(part)], "x": [state[0][0]], "y": [state[0][1]]})

        some = pinned.where(F.col("_part").isin(sorted(todo))).select("_part", key, x, y)
        ends |= {r.part: (r.x, r.y) for r in some.mapInPandas(tail, "part int, x double, y double").collect()}  # a row for each part
        after = {p: ends[q] for p, q in follows.items() if q in ends}
        changed = {p for p in follows if after.get(p) != incoming.get(p)}
        incoming, todo = after, changed & set(follows.values())
    return kept(incoming)[0].where("_kept").drop("_kept")


class FreeSlots:
    """The first slot from a wanted one on that is free: taken intervals to begin with, then slot by slot."""

    def __init__(self, counts: dict[int, int]):
        self.begins: list[int] = []
        self.ends: list[int] = []
        for level in sorted(counts):  # rows that want a level take the next free ones from it on, in whatever order
            begin = max(level, self.ends[-1]) if self.ends else level
            if self.ends and begin == self.ends[-1]:
                self.ends[-1] += counts[level]
            else:
                self.begins.append(begin)
                self.ends.append(begin + counts[level])
        self.after: dict[int, int] = {}

    def take(self, level: int) -> int:
        path = []
        while True:
            if level in self.after:
                path.append(level)
                level = self.after[level]
                continue
            at = bisect.bisect_right(self.begins, level) - 1
            if at < 0 or level >= self.ends[at]:
                break
            path.append(level)
            level = self.ends[at]
        for taken in (*path, level):
            self.after[taken] = level + 1
        return level


def free_slots(rows: DataFrame, key: str, order: list[str], level: str, out: str, parts: int | None = None) -> DataFrame:
    """Rows with the first slot of their key from ``level`` on that no earlier row has.

    Which slots are taken depends only on how many rows want each level, so a partition begins with counts
    of the partitions before it, for the one key that goes on: at most one row for each partition and level.
    """
    pinned = dealt(rows, key, order, parts)
    edges = borders(pinned, key)
    open_keys = {a: None for (_, _, b), (_, a, _) in zip(edges, edges[1:]) if a == b}
    counts: dict[int, dict[int, int]] = {}
    if open_keys:
        some = pinned.where(F.col(key).isin(list(open_keys)))
        found = some.groupBy(key, "_part", level).agg(F.count("*").alias("n")).collect()
        by_key: dict = {}
        for r in found:
            by_key.setdefault(r[key], []).append((r["_part"], r[level], r["n"]))
        for p, a, _ in edges:
            for q, wanted, n in by_key.get(a, ()):
                if q < p:
                    counts.setdefault(p, {}).setdefault(wanted, 0)
                    counts[p][wanted] += n

    def begin(part):
        return FreeSlots(counts.get(part, {}))

    def step(state, wanted):
        return state.take(int(wanted)), state

    return walked(pinned, key, [level], begin, step, out, "integer")
