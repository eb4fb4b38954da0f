"""Ranked lexical search with a bit-sliced impact index.

1. Documents are read once, in blocks of a bounded number: for each the number of
   its terms, and how often each term that any item asks for occurs. A block is one
   row; all blocks are written. Sums over them are the corpus statistics: documents,
   terms, and each asked term's document frequency.
2. A block's postings become impacts, the integers that a document gets for a term,
   and these bitmaps: one for each bit of the impact, over the block's documents.
   A bitmap has only the machine words in which the term occurs at all. This is done
   where a block is searched, as postings are a tenth of the bitmaps' size.
3. An item's terms are added for all documents of the block at once: carry-save
   adders of bitwise operations take one term's bitmaps after the other, a term that
   the item repeats shifted by the bits of its number, and the last carries ripple.
4. The best are found from the most significant slice of the sums down: documents
   with the bit are taken, or, if these are more than are asked for, the others are
   left out. Of equal sums the smaller ids are taken. A task keeps the best of its
   blocks, and the best of all tasks are the result.

The terms that items ask for are broadcast. Items whose terms are more than
QUERY_BYTES are dealt to several rounds of this, each of a bounded size and over all
documents.

Terms are the maximal runs of digits, letters and all that is not ASCII, only A-Z
lower-cased. Null and empty texts have none, and don't count as documents; an item
without terms has no result. Repeated rows, of documents or items, are rows of their
own and get ranks of their own; equal scores go by id, null ids last. Very long texts
are counted in pieces. Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, arrow_batch, bounded_batches, cut, frugal

#: Ranks of an item.
TOP = 20
#: Documents of a block, and postings after which one is closed.
BLOCK, POSTINGS = 8192, 1 << 20
#: Bytes of the items that are answered in one round.
QUERY_BYTES = 4 << 20
#: Bytes of a text that are counted at once.
PIECE = 1 << 20
#: Slices of a sum; scores are below 2 ** 62.
SLICES = 63

# Separators of terms, and A-Z to a-z.
_CLEAN = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))

_BLOCK = "docs long, terms_all long, ids binary, sizes binary, terms binary, df binary, doc binary, tf binary"
_BLOCK_ARROW = pa.schema([("docs", pa.int64()), ("terms_all", pa.int64()), *((c, pa.binary()) for c in ("ids", "sizes", "terms", "df", "doc", "tf"))])
_FOUND = "item long, doc_id long, score long"
_FOUND_ARROW = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms(text: str | None):
    """Lists of the terms of the pieces of a text, as UTF-8."""
    data = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and _CLEAN[data[end]] != 0x20:  # to the end of a term
            end += 1
        yield data[at:end].translate(_CLEAN).split()
        at = end


def counted(text: str | None) -> tuple[int, Counter]:
    n, out = 0, Counter()
    for piece in terms(text):
        n += len(piece)
        out.update(piece)
    return n, out


# ------------------------------------------------------------------ postings


class _Block:
    def __init__(self, size: int):
        self.ids, self.sizes, self.doc, self.term, self.tf = [], [], [], [], []
        self.most = size

    def add(self, doc_id: int | None, n: int, found: list[tuple[int, int]]) -> None:
        self.doc += [len(self.ids)] * len(found)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.sizes.append(n)
        for term, tf in found:
            self.term.append(term)
            self.tf.append(tf)

    def full(self) -> bool:
        return len(self.ids) >= self.most or len(self.doc) >= POSTINGS

    def row(self) -> tuple:
        """Documents by id; postings by term, then document."""
        ids, sizes = np.array(self.ids, dtype=np.int64), np.array(self.sizes, dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        doc, term, tf = place[np.array(self.doc, dtype=np.int64)], np.array(self.term, dtype=np.int64), np.array(self.tf, dtype=np.int64)
        by = np.lexsort((doc, term))
        own, df = np.unique(term, return_counts=True)
        kind = np.uint16 if len(ids) <= 1 << 16 else np.uint32
        return len(ids), int(sizes.sum()), ids[order].tobytes(), sizes[order].tobytes(), own.astype(np.uint32).tobytes(), df.astype(np.uint32).tobytes(), doc[by].astype(kind).tobytes(), tf[by].astype(np.uint32).tobytes()


def postings(docs: DataFrame, asked: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """Rows of packed blocks of documents that have a term, with the postings of
    the asked terms (their numbers)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = spark.sparkContext.broadcast(asked)

    def run(batches):
        known, block = own.value, _Block(size)
        names = known.keys()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                n, count = counted(text.as_py())
                if not n:
                    continue
                block.add(doc_id, n, [(known[t], count[t]) for t in count.keys() & names])
                if block.full():
                    yield arrow_batch(_BLOCK_ARROW, [block.row()])
                    block = _Block(size)
        if block.ids:
            yield arrow_batch(_BLOCK_ARROW, [block.row()])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), _BLOCK)


def _frequencies(batches):
    """Blocks -> term, df; one row a block and term."""
    for batch in batches:
        for a, b in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.uint32).astype(np.int64)), pa.array(np.frombuffer(b, np.uint32).astype(np.int64))], names=["term", "df"])


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """What documents of these sizes get for terms of these weights; n documents
    have `total` terms."""
    m = 100 - 25 + (25 * size * n) // total
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


# -------------------------------------------------------------- bit slices


def slices(doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the 64-document words in which a term occurs, and a bitmap
    over these for each bit of the impacts. doc rises."""
    words, at = np.unique(doc >> 6, return_inverse=True)
    bits = int(impact.max(initial=0)).bit_length()
    dense = np.zeros((bits, len(words) * 64), dtype=np.uint8)
    dense[:, at * 64 + (doc & 63)] = (impact >> np.arange(bits)[:, None]) & 1
    return words, np.packbits(dense, axis=1, bitorder="little").view(np.uint64)


class Adder:
    """Sums over documents, as slices of sums and of carries that are to be
    added yet."""

    def __init__(self, words: int):
        self.sums, self.carries = np.zeros((2, SLICES, words), dtype=np.uint64)

    def add(self, words: np.ndarray, own: np.ndarray, shift: int = 0) -> None:
        """Add a term's slices, times 2 ** shift."""
        x = np.zeros((SLICES, len(words)), dtype=np.uint64)
        x[shift : shift + len(own)] = own
        s, c = self.sums[:, words], self.carries[:, words]
        odd = s ^ c
        self.sums[:, words] = odd ^ x
        carry = (s & c) | (x & odd)
        self.carries[1:, words] = carry[:-1]
        self.carries[0, words] = 0

    def total(self) -> np.ndarray:
        out, carry = np.empty_like(self.sums), np.zeros(self.sums.shape[1], dtype=np.uint64)
        for i, (s, c) in enumerate(zip(self.sums, self.carries)):
            odd = s ^ c
            out[i] = odd ^ carry
            carry = (s & c) | (carry & odd)
        return out


def places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents of the k largest sums above 0, the smaller of equal ones,
    and their sums, largest first."""
    sure, open_ = np.zeros(total.shape[1], dtype=np.uint64), np.bitwise_or.reduce(total, axis=0)
    for own in total[::-1]:
        if not own.any():
            continue
        more = sure | (open_ & own)
        n = int(np.bitwise_count(more).sum())
        if n > k:
            open_ &= own
        else:
            sure, open_ = more, open_ & ~own
            if n == k:
                open_[:] = 0
                break
    got = places(sure)
    got = np.concatenate([got, places(open_)[: k - len(got)]])
    score = np.zeros(len(got), dtype=np.int64)
    for i, own in enumerate(total):
        score |= ((own[got >> 6] >> (got & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << i
    order = np.lexsort((got, -score))
    return got[order], score[order]


class BlockIndex:
    """The bit-sliced index of a block: by term, its words and slices."""

    def __init__(self, row: dict, weights: dict[int, int], n: int, total: int):
        self.ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        doc = np.frombuffer(row["doc"], np.uint16 if len(self.ids) <= 1 << 16 else np.uint32).astype(np.int64)
        tf, df = np.frombuffer(row["tf"], np.uint32).astype(np.int64), np.frombuffer(row["df"], np.uint32)
        own = np.frombuffer(row["terms"], np.uint32).tolist()
        value = impacts(np.repeat(np.array([weights[t] for t in own], dtype=np.int64), df), tf, sizes[doc], n, total)
        end = np.cumsum(df)
        self.words = -(-len(self.ids) // 64)
        self.terms = {t: slices(doc[b - c : b], value[b - c : b]) for t, b, c in zip(own, end.tolist(), df.tolist()) if weights[t]}

    def search(self, query: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the best for (term, how often the query has it)."""
        adder = Adder(self.words)
        for term, times in query:
            if term in self.terms:
                for shift in range(times.bit_length()):
                    if times >> shift & 1:
                        adder.add(*self.terms[term], shift)
        at, score = best(adder.total(), k)
        return self.ids[at], score


# -------------------------------------------------------------------- search


def _searched(queries: dict[int, list[tuple[int, int]]], weights: dict[int, int], n: int, total: int, k: int):
    def run(batches):
        top: dict[int, list] = {item: [] for item in queries}
        for batch in batches:
            for row in batch.to_pylist():
                index = BlockIndex(row, weights, n, total)
                for item, query in queries.items():
                    for doc_id, score in zip(*(x.tolist() for x in index.search(query, k))):
                        if len(top[item]) < k:
                            heapq.heappush(top[item], (score, -doc_id))
                        elif (score, -doc_id) > top[item][0]:
                            heapq.heapreplace(top[item], (score, -doc_id))
        rows = [(item, -doc_id, score) for item, own in top.items() for score, doc_id in own]
        if rows:
            yield arrow_batch(_FOUND_ARROW, rows)

    return run


def _round(docs: DataFrame, items: list[tuple[int, Counter]], k: int, id_col: str, text_col: str) -> DataFrame:
    """item (number), doc_id, score: the best of each task."""
    asked = {t: i for i, t in enumerate(sorted({t for _, count in items for t in count}))}
    blocks = cut(postings(docs, asked, id_col, text_col), "postings")
    n, total = (x or 0 for x in blocks.agg(F.sum("docs"), F.sum("terms_all")).first())
    df = blocks.select("terms", "df").mapInArrow(frugal(_frequencies), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = {r["term"]: weight(n, r["df"]) for r in df.collect()}  # asked terms only
    queries = {i: [(asked[t], c) for t, c in sorted(count.items())] for i, count in items if count}
    return cut(blocks.mapInArrow(frugal(_searched(queries, weights, n, total, k)), _FOUND), "found")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k best documents."""
    own = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(query_col).cast("string"), F.lit("")).alias("query"))
    own = cut(own.withColumn("item", F.monotonically_increasing_id()), "items")
    size = own.agg(F.sum(F.octet_length("query"))).first()[0] or 0
    rounds = max(1, -(-size // query_bytes))
    found = None
    for r in range(rounds):
        mine = own.filter(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r)
        part = _round(docs, [(x["item"], counted(x["query"])[1]) for x in mine.select("item", "query").toLocalIterator()], k, id_col, text_col)
        found = part if found is None else found.union(part)
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    out = found.withColumn("rank", rank).filter(F.col("rank") <= k).join(own.select("item", "item_id"), "item")
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
