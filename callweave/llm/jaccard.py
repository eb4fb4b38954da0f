"""N-gram Jaccard join by MinHash banding.

1. Each text's set of word n-grams is hashed; equal sets are one node with a
   number of copies, so copies are never expanded into pairs.
2. Band hashes of MinHash signatures are shuffled; a bucket links its members
   to its smallest one, which costs a row per member, not per pair. Connected
   components of these links hold every candidate pair.
3. The full n-gram sets of a component meet in tasks of bounded size - a large
   one is split into blocks, every pair of blocks in a task - where pairs that
   share a bucket are verified by counting common n-grams; pairs leave a task only
   as numbers of links and as a spanning tree. Where a large component's buckets
   hold fewer pairs than the component, as chance links tie it together, buckets
   meet in tasks instead, and a pair is verified in the first of its buckets.

A link is the same in a component of any size: two sets that share a bucket and
are similar enough.

The number of bands and rows follows from the similarity and the recall aimed
at. Words are `[^\\x20\\x09-\\x0D]+`, unchanged; a text of fewer words than n
has one gram of them all. Null and empty texts have no gram and no link; they
are classes of their own. Repeated rows are copies of each other. Rows without
an id take part; a class's id is its smallest id. An empty table gives an empty
result; only the id and text columns are read.
"""

from __future__ import annotations

import math
import uuid
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYS, NO_ID, cut, drop_since, frugal, keyed, mix, parts_for, prefix_hashes, rolling, row_keys, word_hashes, written
from .groups import FEW, components, stream_groups

N, SIMILARITY, RECALL = 5, 0.8, 0.99999
ROWS = 4
#: Nodes, and n-grams, that a block of a large component holds about.
BLOCK_NODES, BLOCK_GRAMS = 1024, 1 << 19


def bands_for(similarity: float, recall: float, rows: int = ROWS) -> int:
    """Bands so that a pair of this similarity shares one with this chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def gram_set(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    words, _, _ = word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8))
    if not len(words):
        return words
    return np.unique(rolling(prefix_hashes(words), min(n, len(words))) ^ np.uint64(min(n, len(words))))


def _functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:k] | np.uint64(1), seeds[k:]


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    a, b = _functions(bands * rows)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 2048):
        np.minimum(low, (grams[at : at + 2048, None] * a + b).min(axis=0), out=low)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ low[r::rows])
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, KEYS, node (of the gram set; null without grams), grams (their
    number), bands (array of long)."""
    schema = pa.schema([("doc_id", pa.int64()), (KEYS[0], pa.int64()), (KEYS[1], pa.int64()), ("node", pa.binary()), ("grams", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            nodes, sizes, values = [], [], []
            for text in batch.column("text"):
                grams = gram_set(text.as_py(), n)
                sizes.append(len(grams))
                if not len(grams):
                    nodes.append(None)
                    values.append(None)
                    continue
                key = np.array([np.bitwise_xor.reduce(mix(grams)), np.add.reduce(mix(grams * np.uint64(0x2545F4914F6CDD1D)))])
                nodes.append(key.tobytes())
                values.append(band_hashes(grams, bands, rows).view(np.int64))
            cols = [*(batch.column(c) for c in ("doc_id", *KEYS)), nodes, sizes, values]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)

    return docs.select("doc_id", *KEYS, "text").mapInArrow(frugal(run), f"doc_id long, {KEYS[0]} long, {KEYS[1]} long, node binary, grams long, bands array<long>")


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of common grams between sets of left and of right."""
    sizes = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(column)
    row, column = row[order], column[order]
    for at in range(0, int(number[-1]) + 1, 2048):
        a, b = np.searchsorted(column, (at, at + 2048))
        m = np.zeros((len(sets), 2048), dtype=np.float32)
        m[row[a:b], column[a:b] - at] = 1
        out += m[left] @ m[right].T
    return out


def _trees(links: np.ndarray) -> np.ndarray:
    """A root for each row of a symmetric boolean matrix."""
    root = np.full(len(links), -1)
    for start in range(len(links)):
        if root[start] >= 0:
            continue
        root[start] = start
        new = np.array([start])
        while len(new):
            new = np.flatnonzero(links[new].any(axis=0) & (root < 0))
            root[new] = start
    return root


VERIFIED = "node binary, other binary, links long, whole boolean"
_VERIFIED = pa.schema([("node", pa.binary()), ("other", pa.binary()), ("links", pa.int64()), ("whole", pa.bool_())])


def _verifier(similarity: float):
    s = Fraction(similarity).limit_denominator(1000)

    def of_group(table: pa.Table) -> pa.RecordBatch | None:
        own = [tuple(x) for x in zip(*(table.column(c).to_pylist() for c in ("cell", "low", "high")))]
        if len(set(own)) > 1:  # two tasks share a hash
            out = [of_group(table.filter(pa.array([x == one for x in own]))) for one in sorted(set(own))]
            out = [x for x in out if x is not None]
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None
        nodes = table.column("node").to_pylist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("set").to_pylist()]
        copies = np.asarray(table.column("copies"))
        block = np.asarray(table.column("block"))
        sizes = np.array([len(x) for x in sets])
        # The task's own pair: where one of two blocks is empty, the other
        # one's links belong to its task with itself.
        left = np.flatnonzero(block == table.column("low")[0].as_py())
        right = np.flatnonzero(block == table.column("high")[0].as_py())
        if not len(left) or not len(right):
            return None
        common = _common(sets, left, right)
        # common / (a + b - common) >= s, in integers
        found = common.astype(np.int64) * (s.denominator + s.numerator) >= s.numerator * (sizes[left][:, None] + sizes[right])
        band = table.column("band")[0].as_py()
        bands = np.array(table.column("bands").to_pylist(), dtype=np.int64)
        if band >= 0:
            # A pair belongs to the first band that its two sides share.
            for k in range(band):
                found &= bands[left, k][:, None] != bands[right, k]
        else:
            apart = found.copy()  # without a band in common so far
            for k in range(bands.shape[1]):
                if not apart.any():
                    break
                apart &= bands[left, k][:, None] != bands[right, k]
            found &= ~apart
        links = np.zeros((len(sets), len(sets)), dtype=bool)
        links[np.ix_(left, right)] = found
        links |= links.T
        np.fill_diagonal(links, False)
        root = _trees(links)
        whole = band < 0 and bool(table.column("blocks")[0].as_py() == 1)
        every = range(len(sets))
        cols = ([*nodes, *nodes], [None] * len(nodes) + [nodes[root[i]] for i in every], [*(links @ copies).tolist(), *[0] * len(nodes)], [whole] * (2 * len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _VERIFIED)], schema=_VERIFIED)

    return of_group


_MEMBER = "node binary, copies long, cell binary, band int, blocks long, bands array<long>, set binary"
_MEMBER_ARROW = pa.schema([("node", pa.binary()), ("copies", pa.int64()), ("cell", pa.binary()), ("band", pa.int32()), ("blocks", pa.int64()), ("bands", pa.list_(pa.int64())), ("set", pa.binary())])


def _sets(n: int):
    def run(batches):
        for batch in batches:
            sets = pa.array([gram_set(t.as_py(), n).tobytes() for t in batch.column("text")], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in list(_MEMBER_ARROW)[:-1]), sets], schema=_MEMBER_ARROW)

    return run


def _blocks(nodes, grams) -> F.Column:
    return F.greatest(F.ceil(nodes / BLOCK_NODES), F.ceil(grams / BLOCK_GRAMS))


def cells(nodes: DataFrame, banded: DataFrame, roots: DataFrame, size: float) -> DataFrame:
    """node, cell, band, blocks: where a node's pairs are verified. The pairs of
    a component are verified in one cell (band -1), each once. A component of
    several blocks whose buckets hold fewer pairs than it has itself - it hangs
    together by chance links - is verified by bucket; a pair of several buckets
    counts in the first."""
    members = roots.join(nodes.select("node", "grams"), "node")
    total = cut(members.groupBy("root").agg(F.count("*").alias("n"), _blocks(F.count("*"), F.sum("grams")).alias("blocks")), "components", size)
    small = members.join(total.filter("blocks = 1"), "root", "left_semi").select("node", F.col("root").alias("cell"), F.lit(-1).alias("band"), F.lit(1).cast("long").alias("blocks"))
    large = total.filter("blocks > 1")
    if large.isEmpty():
        return small
    wide = cut(members.join(large, "root"), "large", size)
    bucket = F.concat(F.col("root"), F.encode(F.hex("hash"), "UTF-8"))
    held = cut(wide.join(banded, "node").withColumn("cell", bucket), "held", size)
    buckets = cut(held.groupBy("root", "cell", "band").agg(F.count("*").alias("m"), _blocks(F.count("*"), F.sum("grams")).alias("parts")).filter("m > 1"), "buckets", size)
    pairs = buckets.groupBy("root").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs"))
    loose = cut(large.join(pairs, "root").filter(F.col("pairs") < F.col("n").cast("double") * F.col("n")).select("root"), "loose", size)
    whole = wide.join(loose, "root", "left_anti").select("node", F.col("root").alias("cell"), F.lit(-1).alias("band"), "blocks")
    split = held.select("node", "cell").join(buckets.join(loose, "root", "left_semi"), "cell").select("node", "cell", "band", F.col("parts").alias("blocks"))
    return small.union(whole).union(split)


def join(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """Per row: doc_id, KEYS, class_key (null without grams), class_id (the
    smallest id of all that links connect), n_links (rows, copies included, of
    at least this similarity)."""
    docs, before = keyed(docs, id_col, text_col), written()
    signed = cut(signatures(docs, n, bands_for(similarity, recall, rows), rows), "signed")
    size = signed.count() * 64
    nodes = cut(
        signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(*KEYS)).alias("keys"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands")),
        "nodes",
        4 * size,
    )
    banded = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    low = banded.groupBy("band", "hash").agg(F.min("node").alias("low"), F.count("*").alias("n")).filter("n > 1")
    edges = banded.join(low.select("band", "hash", "low"), ["band", "hash"]).select(F.col("node").alias("a"), F.col("low").alias("b"))
    candidates = components(edges, few, 4 * size)

    place = cells(nodes, banded, candidates, size).join(nodes.select("node", "keys", "copies", "bands", "grams"), "node")
    place = cut(place.select(*(F.col(f"keys.{k}").alias(k) for k in KEYS), "node", "copies", "cell", "band", "blocks", "grams", "bands"), "place", 4 * size)
    # Each set goes to a task for each of its cell's blocks.
    parts = parts_for(docs.sparkSession, place.agg(F.sum(8 * (F.col("grams") + F.size("bands")) * F.col("blocks"))).first()[0] or 0)
    texts = docs.select(*KEYS, "text").join(place.drop("grams"), KEYS).dropDuplicates([*KEYS, "cell"])  # of repeated rows, one
    sets = texts.select("node", "copies", "cell", "band", "blocks", "bands", "text").mapInArrow(frugal(_sets(n)), _MEMBER)
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pair = {"low": F.least("block", "other"), "high": F.greatest("block", "other")}
    paired = sets.withColumn("block", block).withColumn("other", other).withColumns(pair).withColumn("task", F.xxhash64("cell", "low", "high"))
    verified = cut(stream_groups(paired.drop("other"), "task", _verifier(similarity), VERIFIED, ("node",), parts), "verified")

    stars = verified.filter("other is not null")
    roots = stars.filter("whole").select("node", F.col("other").alias("root"))
    split = stars.filter("not whole and node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    if not split.isEmpty():
        roots = roots.union(components(split, few, size))
    links = verified.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    # A node outside every tree is its own root.
    placed = nodes.select("node", "first_id", "copies").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = cut(placed, "placed", size)
    # Both sides of this join are read, so that Spark can split a hot root.
    ids = cut(placed.groupBy("root").agg(F.min("first_id").alias("class_id")), "ids", size)
    drop_since(before, "signed", "placed", "ids")
    classes = placed.join(ids, "root").select("node", "root", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = signed.select("doc_id", *KEYS, "node").join(classes, "node", "left")
    return out.select("doc_id", *KEYS, F.col("root").alias("class_key"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs, all columns as they are, of which each class keeps
    the one with the smallest id; of rows that repeat id and text, one stays."""
    names = [f"__{uuid.uuid4().hex}" for _ in KEYS]
    classes = join(docs, id_col=id_col, text_col=text_col, **settings)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), *KEYS)).alias("first")
    own = F.coalesce("class_key", F.encode(F.concat_ws(",", *(F.col(k).cast("string") for k in KEYS)), "UTF-8"))
    kept = classes.groupBy(own.alias("class")).agg(first).select(*(F.col(f"first.{k}").alias(c) for k, c in zip(KEYS, names)))
    marked = docs.select("*", *(k.alias(c) for k, c in zip(row_keys(id_col, text_col), names)))
    return marked.join(kept, names, "left_semi").dropDuplicates(names).select(docs.columns)
