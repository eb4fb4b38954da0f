"""Anchors of texts that meet anchors of other texts, found with one compact
exchange.

A task reads its documents in flushes of bounded size. An anchor (a hash and a
place) is packed into about six bytes and goes to the part its hash belongs
to: a flush sends one binary row to each part, and there are so many parts that
one holds a bounded number of bytes. A part finds the hashes that occur twice
and at least once in the index, and answers each flush with the places.

A hash that a flush holds twice, once in the index, is a hit without asking, and
so is one that it holds very often; of these the flush sends only one entry with
their number, so that a hash that a third of all documents hold costs a part one
entry a flush. Hash bits are few; a false hit costs later work, but no wrong
result, as later steps look at what stands around the place.

Hashes that occur more than `hot` times in all are marked, each of their places,
so that later steps can deal these by more than the hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYS, arrow_batch, frugal, part_slices
from .groups import stream_groups

#: Anchors in a flush, and how many of one hash are too many to send.
FLUSH, OFTEN = 1_000_000, 64
DOCS, SURE, HOT, COUNTED, ENTRIES = range(5)

#: of_text(text as bytes) -> hashes, places (rising), whether in the index.
Anchors = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]

_ROW = "part int, flush long, kind int, a binary, b binary"
_ROW_ARROW = pa.schema([("part", pa.int32()), ("flush", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_ANSWER = "flush long, kind int, a binary, b binary"
_ANSWER_ARROW = pa.schema(list(_ROW_ARROW)[1:])
_HITS_ARROW = pa.schema([(KEYS[0], pa.int64()), (KEYS[1], pa.int64()), ("n", pa.int64()), ("hits", pa.binary()), ("hot", pa.binary())])


def pack_rising(x: np.ndarray) -> bytes:
    """Rising uint32 as first value and steps, in 16 bits where they fit."""
    steps = np.diff(x, prepend=np.uint32(0)).astype(np.uint32)
    small = not len(x) or int(steps[1:].max(initial=0)) < 65536
    return bytes([small]) + (steps[:1].tobytes() + steps[1:].astype(np.uint16).tobytes() if small else steps.tobytes())


def unpack_rising(b: bytes) -> np.ndarray:
    if len(b) == 1:
        return np.zeros(0, dtype=np.uint32)
    if b[0]:
        steps = np.concatenate([np.frombuffer(b, dtype=np.uint32, count=1, offset=1), np.frombuffer(b, dtype=np.uint16, offset=5).astype(np.uint32)])
    else:
        steps = np.frombuffer(b, dtype=np.uint32, offset=1)
    return np.cumsum(steps, dtype=np.uint32)


def runs(keys: np.ndarray) -> np.ndarray:
    """First places of the runs of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


class _Flush:
    def __init__(self, number: int, parts: int, often: int):
        self.number, self.parts, self.often = number, parts, often
        self.base = self.size = 0
        self.docs: list[tuple[int, int, int]] = []  # keys, first place
        self.got: list[tuple] = []

    def add(self, key1: int, key2: int, extent: int, hashes, places, index) -> None:
        self.docs.append((key1, key2, self.base))
        self.got.append((hashes, places.astype(np.uint32) + np.uint32(self.base), index))
        self.base += extent
        self.size += len(hashes)

    def rows(self):
        home = self.number % self.parts
        yield home, self.number, DOCS, np.array(self.docs, dtype=np.int64).tobytes(), b""
        hashes, places, index = (np.concatenate(x) for x in zip(*self.got))
        self.got = []
        order = np.argsort(hashes)
        hashes, places, index = hashes[order], places[order], index[order]
        first = runs(hashes)
        count = np.diff(np.append(first, len(hashes)))
        indexed = np.logical_or.reduceat(index, first)
        sure = (count > 1) & indexed | (count > self.often)
        own = np.flatnonzero(sure)
        if len(own):
            # Places in the order of their hashes, so that a hash is a number.
            yield home, self.number, SURE, count[own].astype(np.uint32).tobytes(), places[np.repeat(sure, count)].tobytes()
            at = first[own]
            short = _short(hashes[at], indexed[own])
            for part, s in part_slices(hashes[at], self.parts):
                number = np.arange(s.start, s.stop, dtype=np.uint32)
                yield part, self.number, COUNTED, short[s].tobytes(), np.stack([number, count[own[s]].astype(np.uint32)]).tobytes()
        keep = ~np.repeat(sure, count)
        hashes, places, index = hashes[keep], places[keep], index[keep]
        short = _short(hashes, index)
        for part, s in part_slices(hashes, self.parts):
            by_place = np.argsort(places[s])
            yield part, self.number, ENTRIES, short[s][by_place].tobytes(), pack_rising(places[s][by_place])


def _short(hashes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The low bits of a hash, the lowest telling whether it is in the index."""
    return (hashes.astype(np.uint32) & ~np.uint32(1)) | index.astype(np.uint32)


def _match(hot: int | None):
    """A part's entries of all flushes -> which of each flush's places hit."""

    def run(batches):
        rows: list[tuple] = []  # flush, kind, hashes, places or numbers
        for batch in batches:
            kinds = np.asarray(batch.column("kind"))
            passing = np.flatnonzero(kinds < COUNTED)
            if len(passing):
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(passing)) for c in ("flush", "kind", "a", "b")], schema=_ANSWER_ARROW)
            for i in np.flatnonzero(kinds >= COUNTED).tolist():
                rows.append((batch.column("flush")[i].as_py(), int(kinds[i]), batch.column("a")[i].as_py(), batch.column("b")[i].as_py()))
        if not rows:
            return
        hashes = np.concatenate([np.frombuffer(r[2], dtype=np.uint32) for r in rows])
        times = np.concatenate([np.frombuffer(r[3], dtype=np.uint32)[len(r[2]) // 4 :] if r[1] == COUNTED else np.ones(len(r[2]) // 4, dtype=np.uint32) for r in rows])
        order = np.argsort(hashes)
        ranked = hashes[order]
        first = runs(ranked >> np.uint32(1))
        size = np.diff(np.append(first, len(ranked)))
        count = np.add.reduceat(times[order].astype(np.int64), first)
        # Within a hash the entries of the index sort last.
        good = (count > 1) & ((ranked[first + size - 1] & np.uint32(1)) == 1)
        mark = np.zeros(len(ranked), dtype=np.uint8)
        mark[order] = np.repeat(np.where(good, 1 if hot is None else np.where(count > hot, 2, 1), 0).astype(np.uint8), size)
        out, at = [], 0
        for flush, kind, own, b in rows:
            n = len(own) // 4
            found = mark[at : at + n]
            at += n
            if kind == COUNTED:
                if (found == 2).any():
                    out.append((flush, HOT, np.frombuffer(b, dtype=np.uint32)[:n][found == 2].tobytes(), b""))
            elif found.any():
                places = unpack_rising(b)
                for value in (1, 2):
                    if (found == value).any():
                        out.append((flush, SURE if value == 1 else HOT, b"", pack_rising(places[found == value])))
            if len(out) >= 1024:
                yield arrow_batch(_ANSWER_ARROW, out)
                out = []
        if out:
            yield arrow_batch(_ANSWER_ARROW, out)

    return run


def _by_row(table: pa.Table) -> pa.RecordBatch | None:
    """A flush's documents and hits -> places by document."""
    docs, sure, hot, hot_numbers, grouped = None, [], [], [], None
    for kind, a, b in zip(*(table.column(c).to_pylist() for c in ("kind", "a", "b"))):
        if kind == DOCS:
            docs = np.frombuffer(a, dtype=np.int64).reshape(-1, 3)
        elif kind == SURE and a:
            grouped = np.frombuffer(a, dtype=np.uint32).astype(np.int64), np.frombuffer(b, dtype=np.uint32)
        elif kind == SURE:
            sure.append(unpack_rising(b))
        elif a:
            hot_numbers.append(np.frombuffer(a, dtype=np.uint32))
        else:
            hot.append(unpack_rising(b))
    if grouped is not None:
        count, places = grouped
        warm = np.zeros(len(count), dtype=bool)
        for n in hot_numbers:
            warm[n] = True
        warm = np.repeat(warm, count)
        sure.append(places[~warm])
        hot.append(places[warm])
    found = [np.sort(np.concatenate(x)) if x else np.zeros(0, dtype=np.uint32) for x in (sure, hot)]
    if not any(map(len, found)):
        return None
    cuts = [np.append(np.searchsorted(x, docs[:, 2]), len(x)) for x in found]
    rows = []
    for i in np.flatnonzero((cuts[0][1:] > cuts[0][:-1]) | (cuts[1][1:] > cuts[1][:-1])).tolist():
        own = [x[c[i] : c[i + 1]] - np.uint32(docs[i, 2]) for x, c in zip(found, cuts)]
        rows.append((int(docs[i, 0]), int(docs[i, 1]), sum(map(len, own)), *map(pack_rising, own)))
    return arrow_batch(_HITS_ARROW, rows)


def shared_places(docs: DataFrame, anchors: Anchors, parts: int, hot: int | None = None, flush_size: int = FLUSH, often: int = OFTEN) -> DataFrame:
    """KEYS, n, hits, hot (pack_rising of places; n of both): anchors of keyed
    docs whose hash stands at another place too, at one of them in the index."""

    def send(batches):
        number = TaskContext.get().partitionId() << 32
        flush = _Flush(number, parts, often)
        for batch in batches:
            for key1, key2, text in zip(batch.column(KEYS[0]).to_pylist(), batch.column(KEYS[1]).to_pylist(), batch.column("text")):
                data = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), dtype=np.uint8)
                hashes, places, index = anchors(data)
                if not len(hashes):
                    continue
                flush.add(key1, key2, int(places[-1]) + 1, hashes, places, index)
                if flush.size >= flush_size or flush.base >= 1 << 31:
                    yield arrow_batch(_ROW_ARROW, flush.rows())
                    number += 1
                    flush = _Flush(number, parts, often)
        if flush.size:
            yield arrow_batch(_ROW_ARROW, flush.rows())

    sent = docs.select(*KEYS, "text").mapInArrow(frugal(send), _ROW).repartitionById(parts, F.col("part"))
    answers = sent.mapInArrow(frugal(_match(hot)), _ANSWER)
    rows = stream_groups(answers, "flush", _by_row, f"{KEYS[0]} long, {KEYS[1]} long, n long, hits binary, hot binary", parts=parts)
    # Repeated rows share their keys, and so their places.
    return rows.groupBy(*KEYS).agg(F.first("n").alias("n"), F.first("hits").alias("hits"), F.first("hot").alias("hot"))
