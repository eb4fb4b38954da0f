"""Mixing sources to target weights by the cube method.

A source's target over its size says how many times each of its documents is
taken on average: the whole copies are certain, the fraction is an inclusion
probability. The cube method turns these into zeros and ones, and keeps every
source's words and documents in balance on the way:

* Documents that are more than a sixty-fourth of what is open of their source come
  first, the largest first: one goes to 0 or 1, and all others of the source move
  against it. These are few for any source; the others move as one, by a new
  probability. Where the words of a source can be kept one way only (a document is
  larger than all that is open, say), it goes that way; else it goes by chance, and
  keeps its probability. The smallest ones, which come last, mostly go the way that
  is left.
* Flight: three undecided documents of a source have one direction that changes
  neither their words nor their number. Probabilities move along it, forth or
  back at random, so that each stays the same on average, until one is 0 or 1.
* Documents are dealt to buckets by a hash, a bounded number to each, so a hot
  source is in all of them. A bucket leaves two undecided documents of a source
  and a reserve: its smallest ones, and a ladder over all sizes.
* What buckets leave meets, 64 buckets at a time, in groups of a source, round
  by round, until one group of a source is left. Groups are bounded; each round
  is written to the shared folder.
* Landing: of the few documents that are left the largest is decided first, and
  all others move against it, by words and documents where they can, else by
  words alone. So what can't be balanced at last is about a small document.

Targets come from the sources' table alone: all words are shared by weight, what
is above a source's limit is shared anew until nothing is. This is a level that
rises, one aggregate a round.

Chance is drawn from hashes of the documents, and buckets follow from the number
of rows, so reruns agree however the input is partitioned. Words are
`[^\\x20\\x09-\\x0D]+`; a null text has none. A null source is a source, the last
one. Documents without words are balanced by number and take nothing. Repeated
rows (id, text and source) are one unit of several copies, which are dealt to them
evenly. Null ids are kept; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import KEYS, cut, drop_cut, mix, row_keys, shuffle_width
from .groups import stream_groups

#: Weights of the sources in order, repeating, and how often a document is taken
#: at most.
WEIGHTS, LIMIT = (5, 2, 1), 3
#: A document is large if so many of them would be more than their source.
LARGE = 64
#: Documents in a bucket, buckets that meet, and documents kept for the landing.
BUCKET, FAN, RESERVE = 8192, 64, 32
#: Probabilities this near to 0 or 1 are that.
NEAR = 1e-9
#: Rows that are made of one unit at a time.
CHUNK = 1 << 16

_UNIT = "rank long, key1 long, key2 long, size long, p double, z int"
_UNIT_ARROW = pa.schema([("rank", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("size", pa.int64()), ("p", pa.float64()), ("z", pa.int32())])
_SPACE = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """How many `[^\\x20\\x09-\\x0D]+` a text has; each is made one letter."""
    one = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(one, _SPACE, "")).cast("long")


# ------------------------------------------------------------------- targets


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0, by code point and null last: numbered within
    ranges, of which there are as many as a shuffle has partitions."""
    order = F.col("source").isNull(), F.col("source")
    dealt = cut(sources.repartitionByRange(shuffle_width(sources.sparkSession), *order).withColumn("part", F.spark_partition_id()), "sources")
    before = F.sum("n").over(W.orderBy("part")) - F.col("n")  # a row a range
    parts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    return dealt.withColumn("own", F.row_number().over(W.partitionBy("part").orderBy(*order))).join(parts, "part").withColumn("rank", F.col("before") + F.col("own") - 1).drop("part", "own", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, rank, target of sources (source, source_size)."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    out = cut(_ranked(sources).select("source", "source_size", "rank", weight.cast("long").alias("weight"), (F.col("source_size") * limit).alias("most")), "ranked")
    level, full = 0.0, None
    while True:
        over = F.col("most") < F.col("weight") * F.lit(level)
        row = out.agg(F.sum("source_size"), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        every, held, free, n = (x or 0 for x in row)
        if n == full or not free:
            break
        level, full = (every - held) / free, n
    return out.select("source", "source_size", "rank", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


# ---------------------------------------------------------------- the method


def _move(p: list[float], at: list[int], v: list[float], chance: float) -> None:
    """Move p[at] along v or back, to where the first of them is 0 or 1; on
    average nothing moves."""
    forth = back = float("inf")
    for i, x in zip(at, v):
        if x > 0:
            forth, back = min(forth, (1 - p[i]) / x), min(back, p[i] / x)
        elif x < 0:
            forth, back = min(forth, p[i] / -x), min(back, (1 - p[i]) / -x)
    t = forth if chance * (forth + back) < back else -back
    for i, x in zip(at, v):
        now = p[i] + t * x
        p[i] = 0.0 if now < NEAR else 1.0 if now > 1 - NEAR else now


def _undecided(p: list[float], at) -> list[int]:
    return [i for i in at if 0 < p[i] < 1]


def fly(p: list[float], size: list[int], order: list[int], draw) -> list[int]:
    """Decide p in this order, words and number kept; what is left, two at most."""
    block: list[int] = []
    for i in order:
        block.append(i)
        if len(block) == 3:
            a, b, c = (size[j] for j in block)
            _move(p, block, [b - c, c - a, a - b] if not a == b == c else [1, -1, 0], draw())
            block = _undecided(p, block)
    return block


def _against(p: list[float], size: list[int], first: int, rest: list[int], both: bool) -> list[float] | None:
    """How the rest moves when the first one goes up by 1, each by what it can
    give: by words and, with both, by number; None if it can't."""
    w = [min(p[i], 1 - p[i]) for i in rest]
    s, a = [size[i] for i in rest], size[first]
    n, one, two = sum(w), sum(x * y for x, y in zip(w, s)), sum(x * y * y for x, y in zip(w, s))
    if not both:
        return [-a * x / one for x in w] if one else [0.0] * len(rest)
    det = n * two - one * one
    if det <= 1e-9 * n * two:
        return None
    alpha, beta = (one * a - two) / det, (one - n * a) / det
    return [x * (alpha + beta * y) for x, y in zip(w, s)]


def _leads(p: list[float], first: int, rest: list[int], v: list[float]) -> bool:
    """Whether the first gets to 0 and to 1 before another one does."""
    up, down = 1 - p[first], p[first]
    return all(0 <= p[i] + up * x <= 1 and 0 <= p[i] - down * x <= 1 for i, x in zip(rest, v))


def land(p: list[float], size: list[int], left: list[int], draw, rest: int | None = None) -> None:
    """Decide what is left, the largest first. rest: stands for many documents;
    it moves as the others do, but never comes first."""
    left = sorted(left, key=lambda i: -size[i])
    while left:
        first, others = left[0], left[1:]
        if rest is not None:
            others = others + _undecided(p, [rest])
        v = _against(p, size, first, others, True) if rest is None and len(others) > 1 else None
        if v is None or not _leads(p, first, others, v):
            v = _against(p, size, first, others, False)
        _move(p, [first, *others], [1.0, *v], _chance(p, size, first, others, draw))
        left = _undecided(p, left)


def _chance(p: list[float], size: list[int], first: int, others: list[int], draw) -> float:
    """A random number, or 0 or 1 where the first can go one way only: the
    others can't make up for the other way, or less well."""
    expected = sum(p[i] * size[i] for i in (first, *others))
    over, short = max(0.0, size[first] - expected), max(0.0, expected - sum(size[i] for i in others))
    return draw() if max(over, short) < NEAR or over == short else float(over > short)


def _draw(key1: np.ndarray, key2: np.ndarray, seed: int):
    """Chance by the keys of the units, whatever their order."""
    mark = mix(key1.view(np.uint64) + mix(key2.view(np.uint64)) + np.uint64(seed))
    return random.Random(int(mark.sum(dtype=np.uint64))).random


def _reserve(order: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order cut in two: for the flight, and kept: the smallest that have words,
    and a ladder over all that have."""
    words = np.flatnonzero(size[order] > 0)
    if len(words) > RESERVE:
        half = RESERVE // 2
        words = np.unique(np.concatenate([words[-half:], words[np.linspace(0, len(words) - 1, half).astype(np.int64)]]))
    kept = np.zeros(len(order), dtype=bool)
    kept[words] = True
    return order[~kept], order[kept]


def _decide(seed: int, last: bool):
    """Units of a group -> the same with p, and with z where they are decided."""

    def of_group(table: pa.Table) -> pa.RecordBatch:
        rank, key1, key2, size, p = (table.column(c).to_numpy() for c in ("rank", "key1", "key2", "size", "p"))
        order = np.lexsort((key2, key1, -size, size > 0, rank))  # no words first, then the largest
        now, sizes = p.tolist(), size.tolist()
        edges = np.flatnonzero(np.diff(rank[order])) + 1
        for own in np.split(order, edges):
            draw = _draw(key1[own], key2[own], seed)
            flight, kept = _reserve(own, size)
            left = fly(now, sizes, flight.tolist(), draw) + kept.tolist()
            if last:
                land(now, sizes, left, draw)
        now = np.array(now)
        open_ = (now > 0) & (now < 1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rank, key1, key2, size, now)] + [pa.array(now.astype(np.int32), mask=open_)], schema=_UNIT_ARROW)

    return of_group


#: In z of a row that has the new probability of a source's other documents.
OTHERS = -1


def _decide_large(seed: int):
    """The large units of a source, with words and share of its others -> the
    same with z, and a row OTHERS."""

    def of_group(table: pa.Table) -> pa.RecordBatch:
        rank, key1, key2, size, p, others, share = (table.column(c).to_numpy() for c in ("rank", "key1", "key2", "size", "p", "others", "share"))
        order = np.lexsort((key2, key1, -size))
        now, sizes = [*p[order].tolist(), float(share[0])], [*size[order].tolist(), int(others[0])]
        land(now, sizes, list(range(len(order))), _draw(key1, key2, seed), len(order))
        z = [*map(int, now[:-1]), OTHERS]
        keys = np.append(rank, rank[0]), np.append(key1[order], 0), np.append(key2[order], 0)
        return pa.RecordBatch.from_arrays([*map(pa.array, (*keys, sizes, now)), pa.array(z, type=pa.int32())], schema=_UNIT_ARROW)

    return of_group


def _without_large(units: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """rank, key1, key2, z of large units; the other ones with probabilities
    that make up for these."""
    # What is a row a source is written before it is joined: Spark then knows its
    # size, and needn't shuffle a hot source.
    open_ = cut(units.groupBy("rank").agg(F.sum("size").alias("open")), "open", 0)
    marked = cut(units.join(open_, "rank").withColumn("large", F.col("size") * LARGE > F.col("open")), "marked")
    small = ~F.col("large")
    words, expected = F.sum(F.when(small, F.col("size")).otherwise(0)), F.sum(F.when(small, F.col("size") * F.col("p")).otherwise(0.0))
    others = cut(marked.groupBy("rank").agg(words.alias("others"), F.coalesce(F.try_divide(expected, words), F.lit(0.0)).alias("share")), "others", 0)
    large = cut(stream_groups(marked.filter("large").join(others, "rank").drop("open", "large"), "rank", _decide_large(seed), _UNIT), "large")
    now = cut(large.filter(F.col("z") == OTHERS).join(others, "rank").select("rank", "share", F.col("p").alias("now")), "now", 0)
    up = 1 - (1 - F.col("p")) * (1 - F.col("now")) / (1 - F.col("share"))
    moved = F.when(F.col("now").isNull() | (F.col("now") == F.col("share")), F.col("p")).when(F.col("now") > F.col("share"), up).otherwise(F.col("p") * F.col("now") / F.col("share"))
    moved = F.when(moved < NEAR, 0.0).when(moved > 1 - NEAR, 1.0).otherwise(moved)
    rest = marked.filter(small).join(now, "rank", "left").select("rank", *KEYS, "size", moved.alias("p"))
    return large.filter(F.col("z") != OTHERS).select("rank", *KEYS, "z"), rest


def decide(units: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """rank, key1, key2, z (0 or 1) of units (rank, key1, key2, size, p), of
    which there are n, each with keys of its own."""
    buckets, level = -(-n // BUCKET), 0
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(max(1, buckets)))
    done, rest = _without_large(units, seed)
    now = rest.withColumn("bucket", bucket)
    while True:
        # Later on a group is a source's part of what the buckets have left.
        group = F.col("bucket") if not level else F.xxhash64("rank", "bucket")
        one = _decide(int(mix(np.array([seed + level], dtype=np.uint64))[0]), buckets <= 1)
        out = cut(stream_groups(now.withColumn("grp", group), "grp", one, _UNIT), f"flight-{level}")
        decided = out.filter("z is not null").select("rank", *KEYS, "z")
        done = done.union(decided)
        if buckets <= 1:
            return done
        buckets, level = -(-buckets // FAN), level + 1
        now = out.filter("z is null").withColumn("bucket", F.floor(F.pmod(F.xxhash64(*KEYS), F.lit(-(-n // BUCKET))) / FAN**level).cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row."""
    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), *row_keys(id_col, text_col))
    rows = cut(row.groupBy("doc_id", "source", "size", *KEYS).agg(F.count("*").alias("m")), "rows")
    sources = cut(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, limit), "targets", 0)
    # The keys of a unit tell its source too.
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("m")
    placed = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = placed.withColumn("key1", F.xxhash64("key1", "rank")).withColumn("sure", F.floor(share)).withColumn("p", share - F.col("sure"))
    placed = cut(placed, "units")
    open_ = placed.filter("p > 0").select("rank", *KEYS, "size", "p")
    z = decide(open_, open_.count(), seed)
    out = placed.join(z, ["rank", *KEYS], "left").withColumn("all", F.col("sure") + F.coalesce("z", F.lit(0)))
    out = cut(out.select("doc_id", "source", "size", "source_size", "target", "m", "all", *KEYS), "mixed")
    drop_cut(rows, sources, placed)
    named = "doc_id", "source", "size", "source_size", "target"
    one = out.filter("m = 1").select(*named, F.col("all").alias("copies"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / CHUNK)))
    many = out.filter("m > 1").withColumn("chunk", chunk).repartition(shuffle_width(docs.sparkSession), *KEYS, "chunk")
    many = many.withColumn("at", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("m")) - 1)))
    copies = F.floor(F.col("all") / F.col("m")) + (F.col("at") < F.col("all") % F.col("m")).cast("long")
    every = one.union(many.select(*named, copies.alias("copies")))
    return every.withColumn("taken", F.col("copies") * F.col("size"))


def take(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them. Ids must be unique."""
    n = mixed.filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("copies").alias("_n"))
    own = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & F.col(source_col).cast("string").eqNullSafe(F.col("_source"))
    return docs.join(n, own).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_id", "_source", "_n", "_copy")
