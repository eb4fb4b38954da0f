"""Streaming over sorted groups, and connected components of large graphs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, frugal, shuffle_width


def stream_groups(df: DataFrame, key: str, of_group: Callable[[pa.Table], pa.RecordBatch | None], schema: str, order: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """of_group(rows of one value of the long column `key`), for every value.

    Rows are dealt by the key and sorted; a task holds one group at a time, so
    callers bound a group's size before they call this."""
    dealt = df.repartition(parts or shuffle_width(df.sparkSession), key).sortWithinPartitions(key, *order)

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(batch.schema.get_field_index(key)))
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if held and keys[a] != last:
                    if (out := of_group(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
                last = keys[a]
        if held and (out := of_group(pa.Table.from_batches(held))) is not None:
            yield out

    return dealt.mapInArrow(frugal(run), schema)


#: Edges that one task may settle, in about 100 bytes each.
FEW = 1 << 19
EDGE_BYTES = 48


def components(edges: DataFrame, few: int = FEW, size: float | None = None) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b) of 16 bytes
    each; root is the smallest node of its component. size: about how many bytes
    the edges are, if that is known.

    Edges are counted first. A few are settled in one task. More are settled by
    large-star and small-star steps in turn: every node is linked to the
    smallest node it can see, until the edges are stars, which takes a number of
    rounds that is logarithmic in the longest path. Each round is written to the
    shared folder; nothing comes to the driver but two numbers. The smallest
    neighbours are written before they are joined, so that both sides of a join
    are plain shuffles, and Spark can split the one that holds a hot centre."""
    now = cut(_oriented(edges), "edges", size)
    size = now.count()
    if size <= few:
        return cut(now.coalesce(1).mapInArrow(frugal(_settled), "node binary, root binary"), "roots", 0)
    size *= EDGE_BYTES
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "low", size)
        large = cut(_oriented(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))), "large", size)
        least = cut(large.groupBy("a").agg(F.min("b").alias("low")), "low", size)
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.a", "e.b")
        before, now = now, cut(_oriented(small), "edges", size)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop_cut(before, low, large, least)
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges with a > b."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _settled(batches):
    """All edges of a small graph -> node, root: the smallest label spreads
    over edges, and pointers to labels are doubled."""
    ends = [np.stack([np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=">u8").reshape(-1, 2) for c in ("a", "b")]) for batch in batches if batch.num_rows]
    if not ends:
        return
    ends = np.concatenate(ends, axis=1).astype(np.uint64)
    every = ends.reshape(-1, 2)
    order = np.lexsort((every[:, 1], every[:, 0]))
    new = np.concatenate([[True], (every[order[1:]] != every[order[:-1]]).any(axis=1)])
    nodes = every[order[new]]
    number = np.empty(len(every), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    a, b = number.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(label, end, least)
        label = label[label]
        if (label == before).all():
            break
    packed = nodes.astype(">u8").tobytes()
    name = [packed[16 * i : 16 * i + 16] for i in range(len(nodes))]
    for at in range(0, len(name), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(name[at : at + 10_000], type=pa.binary()), pa.array([name[i] for i in label[at : at + 10_000].tolist()], type=pa.binary())], names=["node", "root"])
