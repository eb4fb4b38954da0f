"""Substring dedup with fixed-block anchors.

A window of `width` words holds a whole block of about half as many words at
every phase. Each document's non-overlapping blocks are the index; every
rolling window of block length of every document probes it. Hits are extended
to all windows of full width around them; a window's words are compared by two
independent hashes, and the smallest document that holds it is found. Covered
windows of a document are joined into maximal repeats.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word is removed if a window over it
also starts in a document with a smaller id; windows are judged on the input.
Null and empty texts have no words and lose none. Rows without an id sort
behind all others, and rows of one id never remove each other's words, so
repeated rows give equal results. Texts are read whole. An empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import OFTEN, pack_rising, runs, shared_places, unpack_rising
from .common import KEYS, NO_ID, arrow_batch, cut, drop_cut, from_planes, frugal, keyed, mix, part_slices, parts_for, planes, prefix_hashes, rolling, span_hashes, text_bytes, word_hashes
from .groups import stream_groups

WIDTH = 13
#: Windows that a task sends at once.
FLUSH = 500_000


def block_anchors(width: int):
    block = (width + 1) // 2

    def of_text(data: np.ndarray):
        words, _, _ = word_hashes(data)
        if len(words) < width:
            words = words[:0]
        hashes = rolling(prefix_hashes(words), block)
        places = np.arange(len(hashes), dtype=np.uint32)
        return hashes, places, places % block == 0

    return of_text


def around(hits: np.ndarray, reach: int, n: int) -> np.ndarray:
    """Starts in [0, n) at most `reach` before a hit."""
    mark = np.zeros(n + reach + 2, dtype=np.int32)
    hits = hits.astype(np.int64)
    np.add.at(mark, np.maximum(hits - reach, 0), 1)
    np.add.at(mark, np.minimum(hits + 1, n + reach + 1), -1)
    return np.flatnonzero(np.cumsum(mark)[:n] > 0)


_SENT = pa.schema([("part", pa.int32()), ("flush", pa.int64()), ("kind", pa.int32()), ("first", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_SENT_DDL = "part int, flush long, kind int, first long, a binary, b binary, c binary"
_FOUND = pa.schema(list(_SENT)[1:3] + list(_SENT)[4:])
_FOUND_DDL = "flush long, kind int, a binary, b binary, c binary"
_STARTS = pa.schema([(KEYS[0], pa.int64()), (KEYS[1], pa.int64()), ("starts", pa.binary())])
PLACES, WINDOWS, LATE = range(3)


def _equal_windows(hashes, seconds, ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal windows are neighbours, the first places of the
    runs of these, and the smallest id of each."""
    order = np.argsort(hashes)
    h, s = hashes[order], seconds[order]
    if ((h[1:] == h[:-1]) & (s[1:] != s[:-1])).any():  # different windows share the first hash
        order = np.lexsort((seconds, hashes))
        h, s = hashes[order], seconds[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])]))
    return order, first, np.minimum.reduceat(ids[order], first)


def _send_windows(width: int, parts: int, flush_size: int):
    """A flush's different windows around the hits go to their parts, each with
    the smallest document that holds it here; where each stands goes to the
    flush itself."""
    block = (width + 1) // 2

    def run(batches):
        flush = TaskContext.get().partitionId() << 32
        held, docs, size = [], [], 0

        def rows():
            hashes, seconds, doc, places = (np.concatenate(x) for x in zip(*held))
            ids = np.array([d[2] for d in docs], dtype=np.int64)[doc]
            order, first, least = _equal_windows(hashes, seconds, ids)
            count = np.diff(np.append(first, len(order)))
            of = np.empty(len(order), dtype=np.uint32)
            of[order] = np.repeat(np.arange(len(first), dtype=np.uint32), count)
            # The flush's own: keys and number of places of its documents; places
            # as steps; each place's window, and whether its document is the
            # smallest that holds it here.
            table = np.array([(*d[:2], n) for d, n in zip(docs, np.bincount(doc, minlength=len(docs)).tolist())], dtype=np.int64)
            mine = planes(of) + np.packbits(ids == least[of]).tobytes()
            yield flush % parts, flush, PLACES, 0, table.tobytes(), planes(np.diff(places, prepend=0).astype(np.int32)), mine
            hashes, seconds = hashes[order[first]], seconds[order[first]]
            for part, s in part_slices(hashes, parts):
                yield part, flush, WINDOWS, s.start, planes(np.diff(hashes[s], prepend=np.uint64(0))), seconds[s].tobytes(), planes(least[s])

        for batch in batches:
            for doc_id, key1, key2, text, hits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", *KEYS, "text", "hits"))):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                words, begin, end = word_hashes(data)
                starts = around(unpack_rising(hits), width - block, len(words) - width + 1)
                if not len(starts):
                    continue
                first = rolling(prefix_hashes(words), width)[starts]
                # Of other hashes of the bytes, so that both would have to lie.
                others = span_hashes(prefix_hashes(mix(data + np.uint64(0x5851F42D4C957F2D))), begin, end)
                second = rolling(prefix_hashes(others), width)[starts]
                held.append((first, second, np.full(len(starts), len(docs)), starts))
                docs.append((key1, key2, NO_ID if doc_id is None else doc_id))
                size += len(starts)
                if size >= flush_size:
                    yield arrow_batch(_SENT, rows())
                    held, docs, size, flush = [], [], 0, flush + 1
        if held:
            yield arrow_batch(_SENT, rows())

    return run


def _later(batches):
    """Of a part's windows, those that a smaller document of another flush
    holds too, by flush."""
    rows: list[tuple] = []
    for batch in batches:
        kinds = np.asarray(batch.column("kind"))
        passing, own = (pa.array(np.flatnonzero(kinds == kind)) for kind in (PLACES, WINDOWS))
        if len(passing):
            yield pa.RecordBatch.from_arrays([batch.column(f.name).take(passing) for f in _FOUND], schema=_FOUND)
        rows += zip(*(batch.column(c).take(own).to_pylist() for c in ("flush", "first", "a", "b", "c")))
    if not rows:
        return
    flush, start, *packed = zip(*rows)
    rows.clear()
    size = [len(x) // 8 for x in packed[1]]
    hashes = np.concatenate([np.cumsum(from_planes(x, np.uint64), dtype=np.uint64) for x in packed[0]])
    seconds = np.frombuffer(b"".join(packed[1]), dtype=np.uint64)
    ids = np.concatenate([from_planes(x, np.int64) for x in packed[2]])
    del packed
    order, first, least = _equal_windows(hashes, seconds, ids)
    late = np.zeros(len(order), dtype=bool)
    late[order] = ids[order] > np.repeat(least, np.diff(np.append(first, len(order))))
    out, at = [], 0
    for f, number, n in zip(flush, start, size):
        found = np.flatnonzero(late[at : at + n])
        at += n
        if len(found):
            out.append((f, LATE, planes((found + number).astype(np.uint32)), b"", b""))
    if out:
        yield arrow_batch(_FOUND, out)


def _by_row(table: pa.Table) -> pa.RecordBatch | None:
    """A flush's places and late windows -> late starts by row."""
    late = []
    for kind, a, b, c in zip(*(table.column(x).to_pylist() for x in ("kind", "a", "b", "c"))):
        if kind == LATE:
            late.append(from_planes(a, np.uint32))
            continue
        docs = np.frombuffer(a, dtype=np.int64).reshape(-1, 3)
        doc = np.repeat(np.arange(len(docs)), docs[:, 2])
        places = np.cumsum(from_planes(b, np.int32), dtype=np.int64).astype(np.uint32)
        of = from_planes(c[: 4 * len(doc)], np.uint32)
        own = np.unpackbits(np.frombuffer(c, dtype=np.uint8, offset=4 * len(doc)), count=len(doc)).astype(bool)
    gone = np.zeros(int(of.max()) + 1, dtype=bool)
    for x in late:
        gone[x] = True
    # Rows stand in the order of documents and places.
    hit = ~own | gone[of]
    doc, places = doc[hit], places[hit]
    cuts = np.append(runs(doc), len(doc))
    rows = [(*docs[doc[a], :2].tolist(), pack_rising(places[a:b])) for a, b in zip(cuts, cuts[1:])]
    return arrow_batch(_STARTS, rows) if rows else None


def repeats(docs: DataFrame, width: int = WIDTH, flush_size: int = FLUSH, often: int = OFTEN) -> DataFrame:
    """KEYS, starts (pack_rising): of keyed docs, the windows that also start
    in a document with a smaller id."""
    spark = docs.sparkSession
    # About a word every 6 bytes, in 6 bytes; around a hit up to 13 windows.
    size = text_bytes(docs)
    hits = cut(shared_places(docs, block_anchors(width), parts_for(spark, size), often=often).drop("hot"), "hits", size / 8)
    found = hits.agg(F.sum("n")).first()[0] or 0
    parts = parts_for(spark, found * 40)
    windows = docs.join(hits, KEYS).select("doc_id", *KEYS, "text", "hits").mapInArrow(frugal(_send_windows(width, parts, flush_size)), _SENT_DDL)
    late = windows.repartitionById(parts, F.col("part")).mapInArrow(frugal(_later), _FOUND_DDL)
    starts = stream_groups(late, "flush", _by_row, f"{KEYS[0]} long, {KEYS[1]} long, starts binary", parts=parts)
    # Repeated rows share their keys, and so their windows.
    out = cut(starts.groupBy(*KEYS).agg(F.first("starts").alias("starts")), "late", size / 8)
    drop_cut(hits)
    return out


def spans(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal runs [first, end) that windows at rising starts cover."""
    if not len(starts):
        return []
    starts = starts.astype(np.int64)
    new = np.concatenate([[True], starts[1:] > starts[:-1] + width])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
    return list(zip(starts[first].tolist(), (starts[last] + width).tolist()))


SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<first:long,end:long>>, kept string"


def dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, spans (maximal repeats, in words),
    kept (the words that stay, joined by one space). settings: of repeats."""
    docs = keyed(docs, id_col, text_col)
    found = docs.join(repeats(docs, width, **settings), KEYS, "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                runs = spans(unpack_rising(starts), width) if starts else []
                kept, at = [], 0
                for a, b in runs:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                for c, v in zip(out, (len(words), len(words) - len(kept), [{"first": a, "end": b} for a, b in runs], b" ".join(kept).decode("utf-8", "replace"))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, type=f.type) for c, f in zip(out, list(schema)[1:]))], schema=schema)

    return found.select("doc_id", "text", "starts").mapInArrow(frugal(run), SCHEMA)
