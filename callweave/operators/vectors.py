"""Exact nearest neighbours and hybrid search over unit vectors."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import similarity
from ..lineage import cut
from . import graph
from .areas import contains, relative

#: Pivots of an exact search for many queries, and vectors of a block of a cell.
PIVOTS, BLOCK = 32, 8192


def l2(a, b) -> Column:
    """Euclidean distance of two arrays of double."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def knn(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "l2") -> DataFrame:
    """id, distance, similarity of the k nearest; the one query is a literal,
    so the scan keeps k rows a task and nothing is shuffled but these."""
    q = F.array(*(F.lit(float(x)) for x in query))
    found = vectors.select("id", l2(F.col("embedding").cast("array<double>"), q).alias("distance"))
    return found.orderBy("distance", "id").limit(k).withColumn("similarity", similarity("distance", metric))


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query, id, distance, rank of the k nearest for any number of queries (id,
    embedding); a query is not its own neighbour. Exact: see Cells. A row of a
    null vector takes no part."""
    kept = lambda df, name: df.select(F.col("id").alias(name), F.col("embedding").cast("array<double>").alias(name[0] + "vec")).filter(F.col(name[0] + "vec").isNotNull())
    near = Cells(kept(vectors, "id"), k, pivots, block).nearest(kept(queries, "query"))
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


class Cells:
    """Vectors by their nearest pivot, for exact searches that pass over what the
    triangle inequality rules out.

    Bound: a vector's distance to its pivot is known, so a query's to the pivot
    plus that is not below the query's to the vector; the k-th smallest of these
    sums over the k nearest of every cell is at least the k-th distance looked for.
    Verify: a query goes to the cells, and there meets the vectors, whose distance
    to the pivot differs from its own by no more than this bound.

    Cells are cut into blocks of bounded size, so one that holds a third of all
    vectors is many tasks' work. What comes to the driver, and goes to all tasks, is
    a bounded number of pivots, and a row of k + 1 distances for each."""

    def __init__(self, vectors: DataFrame, k: int, pivots: int, block: int):
        # The pivots are the same whatever the partitions.
        some = vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).select("ivec").collect()
        self.pivots = sorted({tuple(r["ivec"]) for r in some})
        self.k, self.block = k, block
        to = self._distances("ivec")
        nearest = F.array_min(F.transform(to, lambda d, i: F.struct(d.alias("far"), i.alias("cell"))))
        placed = vectors.withColumn("near", nearest).select("id", "ivec", "near.cell", "near.far")
        self.placed = cut(placed)
        first = F.slice(F.array_sort(F.collect_list("far")), 1, k + 1)
        rank = F.row_number().over(W.partitionBy("cell").orderBy("far"))
        close = self.placed.withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy("cell").agg(first.alias("first"))
        size = self.placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("wide"))
        # A row a cell.
        self.cells = size.join(close, "cell").select("cell", "wide", "first", F.ceil(F.col("n") / block).alias("blocks")).orderBy("cell").collect()

    def _distances(self, column: str) -> Column:
        """An array: the distance of a vector to each pivot."""
        table = F.array(*(F.array(*map(F.lit, p)) for p in self.pivots))
        return F.transform(table, lambda p: l2(F.col(column), p))

    def visits(self, queries: DataFrame) -> DataFrame:
        """query, qvec, bound, cell, to (the pivot), block: where a query looks.
        Bounds are a little wider than what is computed, which rounds."""
        known = [(r["cell"], r["wide"], list(r["first"]), r["blocks"]) for r in self.cells]
        rows = F.from_json(F.lit(json.dumps([dict(zip(("cell", "wide", "first", "blocks"), r)) for r in known])), "array<struct<cell:int,wide:double,first:array<double>,blocks:long>>")
        q = queries.withColumn("to", self._distances("qvec")).withColumn("cells", rows)
        sums = F.flatten(F.transform("cells", lambda c: F.transform(c["first"], lambda f: f + F.get("to", c["cell"]))))
        # One more than k, as a query may be among the vectors; all, if there are fewer.
        bound = F.coalesce(F.get(F.array_sort(sums), F.lit(self.k)), F.lit(float("inf")))
        q = q.withColumn("bound", bound * (1 + 1e-9) + 1e-12).select("query", "qvec", "bound", "to", F.explode("cells").alias("c"))
        q = q.withColumn("to", F.get("to", F.col("c.cell"))).filter(F.col("to") - F.col("c.wide") <= F.col("bound"))
        return q.select("query", "qvec", "bound", F.col("c.cell").alias("cell"), "to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c.blocks") - 1)).alias("block"))

    def _meeting(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Visits, and placed vectors, each dealt by cell and block."""
        blocks = F.element_at(F.create_map(*(F.lit(x) for r in self.cells for x in (r["cell"], r["blocks"]))), F.col("cell")) if self.cells else F.lit(1)
        dealt = self.placed.withColumn("block", F.pmod(F.xxhash64("id"), blocks))
        return self.visits(queries), dealt

    def candidates(self, queries: DataFrame) -> DataFrame:
        """query, qvec, id, ivec of what isn't ruled out."""
        visits, dealt = self._meeting(queries)
        # Few bytes, but much to compute: Spark must not put these into few tasks.
        width = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = visits.repartition(width, "cell", "block").join(dealt.repartition(width, "cell", "block"), ["cell", "block"])
        return met.filter((F.abs(F.col("to") - F.col("far")) <= F.col("bound")) & (F.col("query") != F.col("id")))

    def nearest(self, queries: DataFrame) -> DataFrame:
        """query, id, distance: the k nearest candidates of each query in each
        block. A task holds one block and as many visits at a time."""
        visits, dealt = self._meeting(queries)
        # Visits of a block are cut too; a block goes to each of their shares.
        visits = cut(visits)
        n = visits.groupBy("cell", "block").agg(F.ceil(F.count("*") / self.block).alias("shares"))
        width = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left = visits.join(n, ["cell", "block"]).withColumn("share", F.pmod(F.xxhash64("query"), F.col("shares")))
        right = dealt.join(n, ["cell", "block"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        key = ["cell", "block", "share"]
        left = left.select(*key, "query", "qvec", "bound", "to").repartition(width, *key).groupBy(key)
        right = right.select(*key, "id", "ivec", "far").filter("far is not null").repartition(width, *key).groupBy(key)
        kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *self.placed.schema)}
        return left.cogroup(right).applyInArrow(_nearest_of(self.k), f"query {kinds['query']}, id {kinds['id']}, distance double")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _nearest_of(k: int):
    """A function of the visits and the vectors of a block: of each visit the k
    nearest by distance and id. Squares are summed in the order of the places,
    as l2 does."""

    def run(visits: pa.Table, block: pa.Table) -> pa.Table:
        visits = visits.filter(pc.is_valid(visits["to"]))
        out: tuple[list, list, list] = ([], [], [])
        if len(visits) and len(block):
            block = block.sort_by("far")
            ids, far, places = block["id"].to_pylist(), block["far"].to_numpy(), np.ascontiguousarray(_matrix(block["ivec"]).T)
            for query, q, bound, to in zip(visits["query"].to_pylist(), _matrix(visits["qvec"]), visits["bound"].to_pylist(), visits["to"].to_pylist()):
                # Rounded as the filter of all others: the ends may be a little too wide, but lose none.
                low, high = (0, len(ids)) if np.isnan(bound) or np.isinf(bound) else (np.searchsorted(far, to - bound - 1e-9 * (abs(to) + bound)), np.searchsorted(far, to + bound + 1e-9 * (abs(to) + bound), "right"))
                if low >= high:
                    continue
                apart = places[:, low:high] - q[:, None]
                distance = np.sqrt(np.add.reduce(apart * apart, axis=0))
                some = np.arange(high - low)
                if len(some) > k + 1:
                    # One more than k, as the query itself may be among them, and all that are as near.
                    limit = np.partition(distance, k)[k]
                    some = some if np.isnan(limit) else np.flatnonzero(distance <= limit)
                best = sorted(((distance[i], ids[low + i]) for i in some if ids[low + i] is not None and ids[low + i] != query), key=lambda x: (np.isnan(x[0]), x))[:k]
                out[0].extend([query] * len(best))
                out[1].extend(i for _, i in best)
                out[2].extend(float(d) for d, _ in best)
        kinds = (visits.schema.field("query").type, block.schema.field("id").type, pa.float64())
        return pa.table([pa.array(x, kind) for x, kind in zip(out, kinds)], names=["query", "id", "distance"])

    return run


def hybrid(vectors: DataFrame, units: DataFrame, edges: DataFrame, query: list[float], k: int = 10, areas=None, metric: str = "l2", area: str | None = None) -> DataFrame:
    """id, source (matched or neighbour), distance, similarity, area: the k
    nearest units and what is two steps from them. area: a part of an area's
    name, of which only the units stay; the k nearest are chosen before."""
    found = knn(vectors, query, k, metric)
    # The k rows are what the steps below start from: found once, then literals.
    hits = vectors.sparkSession.createDataFrame(found.toArrow())
    near = graph.two_hops(edges, hits, few=True).select("id", F.lit("neighbour").alias("source"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("double").alias("similarity"))
    every = hits.select("id", F.lit("matched").alias("source"), "distance", "similarity").unionByName(near)
    place = relative("file", areas) if areas else F.lit(None).cast("string")
    found = every.join(units.select("id", "name", "file"), "id").withColumn("area", place)
    return found if area is None else found.filter(contains("area", area))


def affected_areas(found: DataFrame) -> DataFrame:
    return found.agg(F.array_sort(F.collect_set("area")).alias("areas"))  # a set of configured areas


def embedder(name: str):
    """The embedding of a name: `local`, the words hashed; `none`, which is
    None, and searches by text fail; other names are errors."""
    if name == "local":
        return hashed_embedding
    if name == "none":
        return None
    raise ValueError(f"no embedding model {name!r}; there are local and none")


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """A deterministic stand-in for a model: words hashed into width places,
    scaled to length 1."""
    words = F.split(F.lower(text), r"\W+")
    zero = F.array_repeat(F.lit(0.0), width)
    spot = lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int")
    counts = F.aggregate(words, zero, lambda acc, w: F.transform(acc, lambda x, i: x + F.when((i == spot(w)) & (w != ""), 1.0).otherwise(0.0)))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).cast("array<float>")
