"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample of the vectors (FIT_ROWS, FIT_BYTES), with a number
of leaves in proportion to the rows as far as the sample bears it (a leaf for
SAMPLED of its rows); every row is then dealt to a leaf. A query walks the tree
best bin first: a priority queue gives the node whose centre is nearest, until
enough leaves are found. How many is calibrated on the sample, widening until the
recall aimed at is reached; a query goes on past these until its leaves hold k
rows other than its own. The tree sees vectors centred, scaled and clipped, so
that neither offsets nor outliers blind it; distances are of the vectors.

Leaves are cut into blocks of bounded size, so a leaf that holds a third of all
rows is many tasks' work. A task holds one block and streams the queries that
visit it; a block that very many visit is copied, once for every LANE of them. A
block answers each query with its own nearest rows, with exact distances in
double precision; a task keeps the nearest of its blocks, and the nearest of all
tasks are the result. Rows are passed over
by a fast formula only where they are farther by more than its error.

Nearness is Euclidean distance, ties go to the smaller id. Sums of squares are
scaled by a power of two where they would leave the range of doubles. Vectors that are
null, zero, of another width than most, or that hold null or non-finite
components take no part, nor do rows without an id. Of rows that repeat an id
all are candidates; one is the query, and none of them is its own neighbour.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batch, bounded_batches, cut, frugal, shuffle_width

#: Rows on which the tree is fitted and calibrated, their bytes where vectors
#: are wide, and queries of these.
FIT_ROWS, FIT_BYTES, FIT_QUERIES = 65_536, 64 << 20, 300
#: Children of a node; rows of a leaf, and sampled rows that a leaf needs.
BRANCHES, LEAF_ROWS, SAMPLED = 8, 32, 16
RECALL = 0.97
#: Rows of a block, and queries of a lane.
BLOCK, LANE = 8192, 65_536


class Tree:
    """centres and children by node; node 0 is the root; leaves have none."""

    def __init__(self, sample: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.middle = np.median(sample, axis=0)
        spread = np.abs(sample - self.middle)
        self.spread = float(np.median(spread)) or float(spread.max()) or 1.0
        sample = self.seen(sample)
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self._grow(sample, leaves, branches)
        self.centre = np.array(self.centres)
        self.leaf_nodes = [i for i, c in enumerate(self.children) if not c]
        self.leaf_of = {n: k for k, n in enumerate(self.leaf_nodes)}

    def seen(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as the tree sees them."""
        with np.errstate(over="ignore"):
            return np.clip((vectors - self.middle) / self.spread, -1e3, 1e3)

    def _grow(self, rows: np.ndarray, leaves: int, branches: int) -> int:
        node = len(self.centres)
        self.centres.append(rows.mean(axis=0))
        self.children.append([])
        k = min(branches, leaves)
        if k > 1 and len(rows) >= 4 * k:
            near = self._cluster(rows, k)
            groups = [rows[near == j] for j in range(k)]
            groups = [g for g in groups if len(g)]
            if len(groups) > 1:
                self.children[node] = [self._grow(g, n, branches) for g, n in zip(groups, shared_out(leaves, [len(g) for g in groups]))]
        return node

    def _cluster(self, rows: np.ndarray, k: int) -> np.ndarray:
        centres = rows[self.rng.choice(len(rows), k, replace=False)]
        for _ in range(10):
            near = squared(rows, centres).argmin(axis=1)
            centres = np.array([rows[near == j].mean(axis=0) if (near == j).any() else rows[self.rng.integers(len(rows))] for j in range(k)])
        return squared(rows, centres).argmin(axis=1)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at each node."""
        vectors = self.seen(vectors)
        out = np.zeros(len(vectors), dtype=np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, own = todo.pop()
            kids = self.children[node]
            if not kids:
                out[own] = self.leaf_of[node]
            elif len(own):
                near = squared(vectors[own], self.centre[kids]).argmin(axis=1)
                todo += [(kid, own[near == j]) for j, kid in enumerate(kids)]
        return out

    def visits(self, queries: np.ndarray, most: int | None = None, sizes: list[int] | None = None, needed: list[int] | None = None) -> list[list[int]]:
        """For each query its leaves, best bin first; beyond `most`, as long as
        they hold fewer rows by `sizes` than the query's `needed`."""
        most = most or len(self.leaf_nodes)
        out = []
        for i, far in enumerate(squared(self.seen(queries), self.centre).tolist()):
            queue, found, held = [(far[0], 0)], [], 0
            least = needed[i] if needed is not None else 0
            while queue and (len(found) < most or held < least):
                _, node = heapq.heappop(queue)
                if not self.children[node]:
                    found.append(self.leaf_of[node])
                    held += sizes[found[-1]] if sizes is not None else 0
                for kid in self.children[node]:
                    heapq.heappush(queue, (far[kid], kid))
            out.append(found)
        return out

    def calibrate(self, sample: np.ndarray, k: int, recall: float, n_queries: int = FIT_QUERIES) -> int:
        """The fewest leaves that give this recall of k neighbours within the
        sample; all leaves, if none does."""
        own = self.rng.choice(len(sample), min(n_queries, len(sample)), replace=False)
        seen = self.seen(sample)
        far = squared(seen[own], seen)
        far[np.arange(len(own)), own] = np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return len(self.leaf_nodes)
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        leaf = self.leaves(sample)[near]
        place = np.empty(len(self.leaf_nodes), dtype=np.int64)
        needed = []
        for order, leaves in zip(self.visits(sample[own]), leaf):
            place[order] = np.arange(1, len(order) + 1)
            needed.extend(place[leaves])
        return int(np.sort(needed)[math.ceil(recall * len(needed)) - 1])


def shared_out(leaves: int, sizes: list[int]) -> list[int]:
    """Leaves for groups of these sizes: one at least, the rest in proportion."""
    upto = np.cumsum([0, *sizes]) * max(0, leaves - len(sizes)) // sum(sizes)
    return (1 + np.diff(upto)).tolist()


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1), 0)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec (array of double) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"))
    return out.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0))


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, width)


FOUND = "query_id long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_ASKED = pa.schema([("leaf", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("vecs", pa.binary())])
EPS = float(np.finfo(float).eps)


def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances. Where squares would overflow or vanish, everything
    is scaled by a power of two, which changes no digit."""
    with np.errstate(over="ignore", invalid="ignore"):
        far = np.abs(rows - q).max(axis=1, initial=0.0)
        out = np.sqrt(((rows - q) ** 2).sum(axis=1))
    odd = np.flatnonzero((far > 1e150) | (far < 1e-140) & (far > 0))
    for i in odd.tolist():
        top = far[i] if np.isfinite(far[i]) else max(np.abs(rows[i]).max(), np.abs(q).max())
        e = int(np.frexp(top)[1])
        out[i] = np.ldexp(np.sqrt(((np.ldexp(rows[i], -e) - np.ldexp(q, -e)) ** 2).sum()), e)
    return out


class Block:
    """Rows of a block in the order of their ids, ready for the fast formula:
    centred and scaled by a power of two."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.e = int(np.frexp(np.abs(rows).max())[1])
        scaled = np.ldexp(self.rows, -self.e)
        self.middle = scaled.mean(axis=0)
        self.centred = scaled - self.middle
        self.norm = (self.centred**2).sum(axis=1)

    def nearest(self, own: np.ndarray, q: np.ndarray, k: int):
        """(query ids, row ids, distances) of the k nearest rows, by query."""
        with np.errstate(over="ignore", invalid="ignore"):
            at = np.ldexp(q, -self.e) - self.middle
            size = (at**2).sum(axis=1)
            far = size[:, None] - 2 * (at @ self.centred.T) + self.norm
        far[own[:, None] == self.ids] = np.inf
        n = min(k, far.shape[1])
        limit = np.partition(far, n - 1, axis=1)[:, n - 1]
        # Errors of the formula, and of centring components of up to 1.
        width = q.shape[1]
        top = 1 + np.abs(at).max(axis=1, initial=0.0) + np.abs(self.middle).max(initial=0.0)
        slack = 16 * EPS * width * (size + self.norm.max()) + 16 * EPS * top * math.sqrt(width) * (np.sqrt(np.maximum(limit, 0)) + EPS * top * math.sqrt(width)) + 1e-300
        close = far <= (limit + slack)[:, None]
        close[~np.isfinite(limit) | ~np.isfinite(slack)] = True  # beyond the formula: all, exactly
        close &= own[:, None] != self.ids
        for i, row in enumerate(close):
            which = np.flatnonzero(row)
            exact = distances(self.rows[which], q[i])
            best = np.argsort(exact, kind="stable")[:n]
            yield np.full(len(best), own[i]), self.ids[which[best]], exact[best]


def _answer(width: int, k: int):
    """Rows by block and lane, first those of the block, then its queries -> the
    block's k nearest rows of each query."""

    def run(batches):
        key, held, block, found = None, [], None, Nearest(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("block", "lane", "kind")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if tuple(keys[:2, a]) != key:
                    key, held, block = tuple(keys[:2, a]), [], None
                part = batch.slice(a, b - a)
                if keys[2, a] == 0:
                    held.append((np.asarray(part.column("vec_id")), _matrix(part.column("vec"), width)))
                    continue
                if block is None and held:
                    block, held = Block(*(np.concatenate(x) for x in zip(*held))), []
                for own, packed in zip(part.column("ids").to_pylist(), part.column("vecs").to_pylist()) if block is not None else ():
                    own, q = np.frombuffer(own, np.int64), np.frombuffer(packed, np.float64).reshape(-1, width)
                    for at in range(0, len(own), 256):
                        found.add(block.nearest(own[at : at + 256], q[at : at + 256], k))
                        if found.size > MOST:
                            yield from found.full()
        yield found.rows()

    return run


#: Found rows that a task holds.
MOST = 1 << 18


class Nearest:
    """What a task has found, the k nearest of each query."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, found) -> None:
        new = list(found)
        self.parts += new
        self.size += sum(len(x[0]) for x in new)

    def _compact(self) -> None:
        own, ids, far = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((ids, far, own))
        own, ids, far = own[order], ids[order], far[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
        count = np.diff(np.append(first, len(own)))
        keep = np.arange(len(own)) - np.repeat(first, count) < self.k
        self.parts, self.size = [(own[keep], ids[keep], far[keep])], int(keep.sum())

    def full(self):
        """Rows to let go, if there are too many queries to hold."""
        self._compact()
        if self.size > MOST // 2:
            yield self.rows()
            self.parts, self.size = [], 0

    def rows(self) -> pa.RecordBatch:
        self._compact()
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(self.parts[0], _FOUND)], schema=_FOUND)


def _of_leaf(values: list[int]):
    return F.element_at(F.array(*map(F.lit, values)), (F.col("leaf") + 1).cast("int")).cast("long")


def search(vectors: DataFrame, is_query, k: int = 10, recall: float = RECALL, leaves: int | None = None, fit_rows: int = FIT_ROWS, block_rows: int = BLOCK, lane: int = LANE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each
    query. is_query: a condition on the column vec_id."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors, id_col, vector_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    widths = rows.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not widths:
        return empty
    width, total = widths[0]["width"], widths[0]["n"]
    rows = rows.filter(F.size("vec") == width)
    fit_rows = max(1, min(fit_rows, FIT_BYTES // (8 * width)))
    share = min(1.0, 1.1 * fit_rows / total)
    sample = (rows.sample(share, seed=11) if share < 1 else rows).select("vec").limit(fit_rows).toArrow()
    if not sample.num_rows:
        sample = rows.select("vec").limit(fit_rows).toArrow()
    fit = _matrix(sample.column("vec"), width)
    tree = Tree(fit, leaves or max(1, min(total // LEAF_ROWS, len(fit) // SAMPLED)))
    visits = tree.calibrate(fit, k, recall)

    def deal(batches):
        for batch in batches:
            leaf = tree.leaves(_matrix(batch.column("vec"), width)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(leaf)], names=["vec_id", "vec", "leaf"])

    dealt = cut(rows.mapInArrow(frugal(deal), "vec_id long, vec array<double>, leaf long"), "leaves")
    n_leaves = len(tree.leaf_nodes)

    def by_leaf(df: DataFrame, n) -> list[int]:
        got = {r["leaf"]: r["n"] for r in df.groupBy("leaf").agg(n.alias("n")).collect()}  # a row a leaf
        return [got.get(leaf, 0) for leaf in range(n_leaves)]

    sizes = by_leaf(dealt, F.count("*"))
    queries = dealt.filter(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"), F.min("leaf").alias("leaf"), F.count("*").alias("copies"))

    def ask(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, q = np.asarray(part.column("vec_id")), _matrix(part.column("vec"), width)
                needed = [k + n for n in part.column("copies").to_pylist()]  # a query's own rows are no neighbours
                visited = np.zeros((len(ids), n_leaves), dtype=bool)
                for i, own in enumerate(tree.visits(q, visits, sizes, needed)):
                    visited[i, own] = True
                out = [(int(leaf), int(own.sum()), ids[own].tobytes(), q[own].tobytes()) for leaf, own in ((x, visited[:, x]) for x in np.flatnonzero(visited.any(axis=0)))]
                yield arrow_batch(_ASKED, out)

    # Queries of a leaf ask together; a leaf of very many is several ranges.
    asked = queries.repartitionByRange(shuffle_width(spark), "leaf", "vec_id").sortWithinPartitions("leaf", "vec_id").select("vec_id", "vec", "copies")
    asked = cut(asked.mapInArrow(frugal(ask), "leaf long, n long, ids binary, vecs binary"), "asked")
    blocks = [max(1, -(-n // block_rows)) for n in sizes]
    lanes = [max(1, -(-n // lane)) for n in by_leaf(asked, F.sum("n"))]

    at = lambda block: F.col("leaf") * (1 << 32) + block
    each = lambda values: F.explode(F.sequence(F.lit(0).cast("long"), _of_leaf(values) - 1))
    base = dealt.withColumn("block", at(F.pmod(F.xxhash64("vec_id"), _of_leaf(blocks)))).withColumn("lane", each(lanes))
    base = base.select("block", "lane", F.lit(0).alias("kind"), "vec_id", "vec", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("vecs"))
    lane_of = F.pmod(F.xxhash64("ids"), _of_leaf(lanes))
    asks = asked.withColumn("lane", lane_of).withColumn("block", each(blocks)).withColumn("block", at(F.col("block")))
    asks = asks.select("block", "lane", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("vec"), "ids", "vecs")
    met = base.unionByName(asks).repartition(shuffle_width(spark), "block", "lane").sortWithinPartitions("block", "lane", "kind")
    found = met.mapInArrow(frugal(_answer(width, k)), FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
