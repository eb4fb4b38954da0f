"""Substring dedup with a hash-compared suffix sort.

Every string of `width` bytes has a smallest hash of `width - k + 1` shorter
strings in it; equal strings have equal smallest hashes. So texts are cut into
segments of strings that share this hash, only segments whose hash occurs
twice are looked at, and all equal strings meet in one part. Of equal segments
a flush of documents sends one, and a hash that occurs in very many places would
make one part large, so each of its strings is dealt by all of its bytes.

There the segments' suffixes are sorted. Two suffixes compare in a logarithm
of their common length: prefix polynomial hashes tell whether two stretches
are equal, and a binary search over their length finds the first byte that
differs. A bottom-up mergesort that works on all groups at once uses this
comparison wherever the first eight bytes are equal. Strings whose hash is alone
equal no other and are left out; of strings with equal hashes one is merged, and
the others stand behind it. Neighbours that agree in `width` bytes are checked
byte for byte; if a hash has lied, their group is sorted by its bytes. Strings of
a run of equal neighbours start in the run's documents; those of all but the
smallest document are removed.

Texts are UTF-8 bytes; matches never cross documents; strings are judged on
the input. Null, empty and shorter texts lose nothing. Rows without an id sort
behind all others; rows of one id never remove each other's bytes, so repeated
rows give equal results. Texts are read whole. An empty table gives an empty
result. Only the id and text columns are read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import OFTEN, runs, shared_places, unpack_rising
from .common import KEYS, NO_ID, _power, arrow_batch, cut, drop_cut, from_planes, frugal, keyed, mix, part_slices, parts_for, planes, prefix_hashes, rolling, row_keys, span_hashes, text_bytes
from .groups import stream_groups

WIDTH = 50
#: Bytes of the shorter strings whose hashes choose a segment.
CHOSEN = 26
#: Bytes of segments that a task sends at once.
FLUSH = 8 << 20


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, dtype=np.uint8)])


def eights(data: np.ndarray) -> np.ndarray:
    """A view of padded data: the eight bytes from each place on."""
    return np.ndarray((len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))


class Suffixes:
    """Suffixes of data, each up to its own end, and at most `limit` bytes."""

    def __init__(self, data: np.ndarray, limit: int):
        self.data = padded(data)
        self.limit = limit
        self.prefix = prefix_hashes(data)
        self.inverse = _power(len(data) + 1, True)
        self.word = eights(self.data)

    def _equal(self, a, b, n):
        left = (self.prefix[a + n] - self.prefix[a]) * self.inverse[a]
        return left == (self.prefix[b + n] - self.prefix[b]) * self.inverse[b]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension, at most `most`, by binary search."""
        low, high = np.zeros(len(a), dtype=np.int64), most.astype(np.int64).copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = self._equal(a, b, mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, a, b, end_a, end_b) -> np.ndarray:
        """Whether suffix a comes before suffix b; both share 8 bytes or end."""
        room_a, room_b = np.minimum(end_a - a, self.limit), np.minimum(end_b - b, self.limit)
        most = np.minimum(room_a, room_b)
        n = self.common(a, b, most)
        inside = n < most
        out = room_a < room_b
        out[inside] = self.data[a[inside] + n[inside]] < self.data[b[inside] + n[inside]]
        return out

    def sort(self, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the suffixes within rising groups, and for each in that
        order whether it equals the one before in `limit` bytes or to its end."""
        first = self.word[start].astype(np.uint64)
        room = end - start
        if (room < 8).any():  # bytes past the end count as nothing
            short = np.minimum(room, 8).astype(np.uint64)
            first = np.where(short == 0, 0, first >> (np.uint64(64) - np.maximum(short, 1) * np.uint64(8)) << (np.uint64(64) - np.maximum(short, 1) * np.uint64(8)))
        order = np.lexsort((first, group))
        g, f = group[order], first[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (f[1:] != f[:-1])])
        base = np.flatnonzero(new)
        size = np.diff(np.append(base, len(order)))
        tied = np.repeat(size > 1, size)
        if tied.any():
            order[tied] = self._merge_distinct(order[tied], size[size > 1], start, end)
        equal = np.zeros(len(order), dtype=bool)
        at = np.flatnonzero(~new)
        a, b = order[at - 1], order[at]
        equal[at] = self._same(start[a], start[b], end[a], end[b])
        lied = self._lies(order, at, equal, start, end)
        for lo in np.unique(np.searchsorted(base, lied, side="right") - 1) if len(lied) else ():
            own = slice(base[lo], base[lo] + size[lo])
            key = lambda i: self.data[start[i] : min(end[i], start[i] + self.limit)].tobytes()
            order[own] = sorted(order[own].tolist(), key=key)
            texts = [key(i) for i in order[own]]
            equal[own] = [False, *(x == y for x, y in zip(texts, texts[1:]))]
        return order, equal

    def _merge_distinct(self, items: np.ndarray, sizes: np.ndarray, start, end) -> np.ndarray:
        """Classes of items in order. Of suffixes with equal hashes one is sorted,
        and the others stand behind it; sort() checks their bytes."""
        room = np.minimum(end[items] - start[items], self.limit)
        content = mix(span_hashes(self.prefix, start[items], start[items] + room) + room.astype(np.uint64))
        group = np.repeat(np.arange(len(sizes)), sizes)
        by = np.lexsort((content, group))
        g, c = group[by], content[by]
        lead = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]))
        count = np.diff(np.append(lead, len(by)))
        # Places in `lead`, class by class, are what is merged.
        rep = items[by[lead]]
        number = np.empty(len(start), dtype=np.int64)
        number[rep] = np.arange(len(rep))
        place = number[self._merge(rep, np.bincount(g[lead], minlength=len(sizes)), start, end)]
        n = count[place]
        return items[by[np.arange(n.sum()) + np.repeat(lead[place] - np.cumsum(n) + n, n)]]

    def _same(self, a, b, end_a, end_b):
        room_a, room_b = np.minimum(end_a - a, self.limit), np.minimum(end_b - b, self.limit)
        return (room_a == room_b) & self._equal(a, b, np.minimum(room_a, room_b))

    def _lies(self, order, at, equal, start, end) -> np.ndarray:
        """Places in the order whose equality the bytes don't bear out."""
        at = at[equal[at]]
        a, b = start[order[at - 1]], start[order[at]]
        room = np.minimum(end[order[at]] - b, self.limit)
        wrong = np.zeros(len(at), dtype=bool)
        for k in range(0, self.limit, 8):
            n = np.clip(room - k, 0, 8)
            full = n == 8
            part = np.flatnonzero(~full & (n > 0))
            wrong[full] |= self.word[a[full] + k] != self.word[b[full] + k]
            for i in part:
                wrong[i] |= (self.data[a[i] + k : a[i] + k + n[i]] != self.data[b[i] + k : b[i] + k + n[i]]).any() if room[i] < 8 else False
            if len(part):
                tail = part[room[part] >= 8]
                wrong[tail] |= self.word[a[tail] + room[tail] - 8] != self.word[b[tail] + room[tail] - 8]
        return at[wrong]

    def _merge(self, items: np.ndarray, sizes: np.ndarray, start, end) -> np.ndarray:
        """Mergesort of consecutive classes of items, all classes at once."""
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        size = np.repeat(sizes, sizes)
        place = np.arange(len(items)) - base
        items = items.copy()
        width = 1
        while width < sizes.max():
            act = np.flatnonzero(size > width)
            p, b, z, own = place[act], base[act], size[act], items[act]
            run = p // width
            left = run % 2 == 0
            low = np.minimum((run ^ 1) * width, z)
            top = np.minimum(low + width, z)
            first = low.copy()
            while (going := np.flatnonzero(low < top)).size:
                mid = (low[going] + top[going]) >> 1
                other = items[b[going] + mid]
                mine = own[going]
                # An item of the left run comes before its equals of the right one.
                is_left = left[going]
                x, y = np.where(is_left, other, mine), np.where(is_left, mine, other)
                before = self.less(start[x], start[y], end[x], end[y])
                further = before == is_left  # the other one stands before mine
                low[going[further]] = mid[further] + 1
                top[going[~further]] = mid[~further]
            to = run // 2 * 2 * width + p % width + low - first
            items[b + to] = own
            width *= 2
        return items


def suffix_array(data: bytes) -> np.ndarray:
    """Starts of all suffixes of data in their order."""
    text = np.frombuffer(data, dtype=np.uint8)
    start = np.arange(len(text))
    if not len(text):
        return start
    return Suffixes(text, len(text)).sort(start, np.full(len(text), len(text)), np.zeros(len(text), dtype=np.int64))[0]


def chosen_hashes(prefix: np.ndarray, width: int, k: int) -> np.ndarray:
    """For each string of width bytes the smallest hash of k bytes in it."""
    hashes = rolling(prefix, k)
    w = width - k + 1
    n = len(hashes) - w + 1
    if n <= 0:
        return hashes[:0]
    padded = np.full(-(-len(hashes) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(hashes)] = hashes
    cells = padded.reshape(-1, w)
    fore = np.minimum.accumulate(cells, axis=1).ravel()
    back = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[w - 1 : w - 1 + n])


def segments(prefix: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first start and number of starts of each run of strings that
    share their smallest hash."""
    chosen = chosen_hashes(prefix, width, k)
    if not len(chosen):
        return chosen, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1])
    # Smallest hashes are small; mixed anew they are spread over all parts.
    return mix(chosen[first]), first, np.diff(np.append(first, len(chosen)))


def segment_anchors(width: int, k: int):
    def of_text(data: np.ndarray):
        hashes, first, _ = segments(prefix_hashes(data), width, k)
        return hashes, first.astype(np.uint32), np.ones(len(hashes), dtype=bool)

    return of_text


_SENT = pa.schema([("part", pa.int32()), ("flush", pa.int64()), ("kind", pa.int32()), ("first", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_SENT_DDL = "part int, flush long, kind int, first long, a binary, b binary, c binary, d binary"
_FOUND = pa.schema(list(_SENT)[1:3] + list(_SENT)[4:])
_FOUND_DDL = "flush long, kind int, a binary, b binary, c binary, d binary"
_SPANS = pa.schema([(KEYS[0], pa.int64()), (KEYS[1], pa.int64()), ("spans", pa.binary())])
PLACES, SEGMENTS, LATE = range(3)


def _send_segments(width: int, k: int, parts: int, flush_bytes: int):
    """A flush's different segments go to their parts, each with the smallest
    document that holds it here; where each stands goes to the flush itself. Of
    hot hashes every string goes for itself, dealt by all of its bytes."""

    def run(batches):
        flush = TaskContext.get().partitionId() << 32
        held, docs, size = [], [], 0

        def rows():
            hashes, content, counts, doc, first, at = (np.concatenate(x) for x in zip(*(h[:-1] for h in held)))
            data = padded(np.concatenate([h[-1] for h in held]))
            ids = np.array([d[2] for d in docs], dtype=np.int64)[doc]
            length = counts + width - 1
            order, lead = equal_segments(eights(data), content, hashes, at, length)
            least = np.minimum.reduceat(ids[order], lead)
            rep = order[lead]
            # Different segments are numbered in the order of their hashes.
            rank = np.argsort(hashes[rep])
            number = np.empty(len(rep), dtype=np.uint32)
            number[rank] = np.arange(len(rep), dtype=np.uint32)
            of = np.empty(len(order), dtype=np.uint32)
            of[order] = np.repeat(number, np.diff(np.append(lead, len(order))))
            rep, least = rep[rank], least[rank]
            own = ids == least[of]
            # The flush's own: keys and number of places of its documents; places
            # as steps; counts by segment; each place's segment, and whether its
            # document is the smallest that holds it here.
            table = np.array([(*d[:2], n) for d, n in zip(docs, np.bincount(doc, minlength=len(docs)).tolist())], dtype=np.int64)
            mine = planes(of) + np.packbits(own).tobytes()
            yield flush % parts, flush, PLACES, 0, table.tobytes(), planes(np.diff(first, prepend=0).astype(np.int32)), planes(counts[rep].astype(np.uint32)), mine
            short = hashes[rep].astype(np.uint32)
            for part, s in part_slices(hashes[rep], parts):
                one = rep[s]
                ends = np.cumsum(length[one])
                took = data[np.arange(ends[-1]) + np.repeat(at[one] - (ends - length[one]), length[one])]
                yield part, flush, SEGMENTS, s.start, short[s].tobytes(), planes(counts[one].astype(np.uint32)), planes(least[s]), took.tobytes()

        for batch in batches:
            for doc_id, key1, key2, text, hits, hot in zip(*(batch.column(c).to_pylist() for c in ("doc_id", *KEYS, "text", "hits", "hot"))):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                prefix = prefix_hashes(data)
                hashes, first, count = segments(prefix, width, k)
                own, warm = (np.searchsorted(first, unpack_rising(x)) for x in (hits, hot))
                start, hashes, every = first[own], hashes[own], count
                count = every[own]
                if len(warm):
                    n = every[warm]
                    strings = np.repeat(first[warm] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    start = np.concatenate([start, strings])
                    hashes = np.concatenate([hashes, rolling(prefix, width)[strings]])
                    count = np.concatenate([count, np.ones(len(strings), dtype=np.int64)])
                content = span_hashes(prefix, start, start + count + width - 1)
                held.append((hashes, content, count, np.full(len(start), len(docs)), start, start + size, data))
                docs.append((key1, key2, NO_ID if doc_id is None else doc_id))
                size += len(data)
                if size >= flush_bytes:
                    yield arrow_batch(_SENT, rows())
                    held, docs, size, flush = [], [], 0, flush + 1
        if held:
            yield arrow_batch(_SENT, rows())

    return run


def equal_segments(word, content, hashes, at, length) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal segments are neighbours, and the first places of
    the runs of these. Hashes of the content find them, bytes decide."""
    key = mix(hashes ^ mix(content + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    k, n = key[order], length[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    which = np.cumsum(new) - 1
    lead = np.flatnonzero(new)
    bad = n != n[lead][which]
    same = np.flatnonzero(~bad)
    bad[same] = _differ(word, at[order[same]], at[order[lead]][which[same]], n[same])
    if bad.any():
        # A hash has lied: those segments stand for themselves.
        new |= bad
        new[1:] |= bad[:-1]
        lead = np.flatnonzero(new)
    return order, lead


#: Strings that are sorted at once, and equal hashes kept together.
CHUNK = 250_000


def _later(width: int, chunk: int):
    """Of a part's segments, the stretches of strings that start in a smaller
    document too, by flush. Only hashes of two documents matter; these are
    taken in chunks of bounded size, whole hashes at a time."""

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            kinds = np.asarray(batch.column("kind"))
            passing, own = (pa.array(np.flatnonzero(kinds == kind)) for kind in (PLACES, SEGMENTS))
            if len(passing):
                yield pa.RecordBatch.from_arrays([batch.column(f.name).take(passing) for f in _FOUND], schema=_FOUND)
            rows += zip(*(batch.column(c).take(own).to_pylist() for c in ("flush", "first", "a", "b", "c", "d")))
        if not rows:
            return
        flush, start, *packed = zip(*rows)
        rows.clear()
        size = np.array([len(x) // 4 for x in packed[0]])
        hashes, data = (np.frombuffer(b"".join(x), dtype=t) for x, t in ((packed[0], np.uint32), (packed[3], np.uint8)))
        counts = np.concatenate([from_planes(x, np.uint32) for x in packed[1]])
        ids = np.concatenate([from_planes(x, np.int64) for x in packed[2]])
        flushes = np.repeat(np.array(flush), size)
        numbers = np.arange(len(hashes)) + np.repeat(np.array(start) - np.cumsum(size) + size, size)
        del packed
        counts = counts.astype(np.int64)
        length = counts + width - 1
        at = np.cumsum(length) - length
        order = np.argsort(hashes)
        edge = runs(hashes[order])
        low, high = np.minimum.reduceat(ids[order], edge), np.maximum.reduceat(ids[order], edge)
        order = order[np.repeat(low < high, np.diff(np.append(edge, len(order))))]
        if not len(order):
            return
        edge = np.append(runs(hashes[order]), len(order))
        upto = np.concatenate([[0], np.cumsum(counts[order])])[edge]
        first = 0
        while first < len(edge) - 1:
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + chunk, side="right")) - 1)
            own = order[edge[first] : edge[last]]
            first = last
            seg, begin, stop = _late_stretches(hashes[own], counts[own], ids[own], at[own], data, width)
            if not len(seg):
                continue
            seg = own[seg]
            by = np.argsort(flushes[seg])
            got = np.stack([numbers[seg], begin, stop])[:, by].astype(np.uint32)
            f = flushes[seg][by]
            cuts = np.append(runs(f), len(f))
            yield arrow_batch(_FOUND, [(int(f[a]), LATE, *(planes(x[a:b]) for x in got), b"") for a, b in zip(cuts, cuts[1:])])

    return run


def _late_stretches(hashes, counts, ids, at, data, width: int):
    """(segment, first and end byte in it) of what starts in a smaller document
    too. Equal segments are found by their content first, and sorted once."""
    length = counts + width - 1
    local = np.cumsum(length) - length
    sorts = Suffixes(data[np.arange(length.sum()) + np.repeat(at - local, length)], width)
    order, lead = equal_segments(sorts.word, span_hashes(sorts.prefix, local, local + length), hashes, local, length)
    which = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(order))))
    rep, smallest = order[lead], np.minimum.reduceat(ids[order], lead)
    # Where a hash has one segment only, its strings are in the same documents.
    by_hash = np.argsort(hashes[rep])
    group = runs(hashes[rep][by_hash])
    several = np.empty(len(rep), dtype=bool)
    several[by_hash] = np.repeat(np.diff(np.append(group, len(rep))) > 1, np.diff(np.append(group, len(rep))))
    alone = np.flatnonzero(~several[which] & (ids[order] > smallest[which]))
    whole = order[alone], np.zeros(len(alone), dtype=np.int64), length[order[alone]]
    # The others' strings are sorted.
    rep = by_hash[several[by_hash]]
    if not len(rep):
        return whole
    back = np.zeros(len(lead), dtype=np.int64)
    back[rep] = np.arange(len(rep))
    own = several[which]
    order, which, smallest, rep = order[own], back[which[own]], smallest[rep], order[lead[rep]]
    n_starts = counts[rep]
    base = np.cumsum(n_starts) - n_starts
    start = np.arange(n_starts.sum()) + np.repeat(local[rep] - base, n_starts)
    group = np.repeat(np.cumsum(np.concatenate([[True], hashes[rep][1:] != hashes[rep][:-1]])), n_starts)
    # A string whose hash is alone equals no other, and isn't sorted.
    of_start = np.repeat(smallest, n_starts)
    own_hash = span_hashes(sorts.prefix, start, start + width)
    by = np.argsort(own_hash)
    again = own_hash[by][1:] == own_hash[by][:-1]
    shared = np.sort(by[np.concatenate([[False], again]) | np.concatenate([again, [False]])])
    if len(shared):
        ranked, equal = sorts.sort(start[shared], start[shared] + width, group[shared])
        least = np.minimum.reduceat(of_start[shared][ranked], np.flatnonzero(~equal))
        of_start[shared[ranked]] = least[np.cumsum(~equal) - 1]
    # Back to every segment: stretches of its starts with a smaller id.
    n = counts[order]
    seg = np.repeat(np.arange(len(order)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    late = of_start[base[which[seg]] + offset] < ids[order][seg]
    edge = np.diff(np.concatenate([[False], late, [False]]).astype(np.int8))
    same = np.concatenate([[True], seg[1:] != seg[:-1], [True]])
    begin = np.flatnonzero(late & ((edge[:-1] == 1) | same[:-1]))
    stop = np.flatnonzero(late & ((edge[1:] == -1) | same[1:]))
    return tuple(np.concatenate(x) for x in zip(whole, (order[seg[begin]], offset[begin], offset[stop] + width)))


def _differ(word: np.ndarray, a, b, length) -> np.ndarray:
    """Whether stretches of at least 8 bytes differ, byte for byte."""
    wrong = np.zeros(len(a), dtype=bool)
    at = np.zeros(len(a), dtype=np.int64)
    going = np.flatnonzero(a != b)
    while len(going):
        k = np.minimum(at[going], length[going] - 8)
        wrong[going] |= word[a[going] + k] != word[b[going] + k]
        at[going] += 8
        going = going[(at[going] < length[going]) & ~wrong[going]]
    return wrong


def _by_row(table: pa.Table, width: int) -> pa.RecordBatch | None:
    """A flush's places and late stretches -> maximal stretches, by row."""
    late = []
    for kind, a, b, c, d in zip(*(table.column(x).to_pylist() for x in ("kind", "a", "b", "c", "d"))):
        if kind == LATE:
            late.append(np.stack([from_planes(x, np.uint32) for x in (a, b, c)]))
            continue
        docs = np.frombuffer(a, dtype=np.int64).reshape(-1, 3)
        keys, doc = docs[:, :2], np.repeat(np.arange(len(docs)), docs[:, 2])
        first = np.cumsum(from_planes(b, np.int32), dtype=np.int64)
        of = from_planes(d[: 4 * len(doc)], np.uint32)
        own = np.unpackbits(np.frombuffer(d, dtype=np.uint8, offset=4 * len(doc)), count=len(doc)).astype(bool)
        length = (from_planes(c, np.uint32).astype(np.int64) + width - 1)[of]
    number, begin, stop = (np.concatenate(late, axis=1) if late else np.zeros((3, 0))).astype(np.int64)
    order = np.argsort(number)
    number, begin, stop = number[order], begin[order], stop[order]
    # Where the flush has a smaller document with the same segment, all of it
    # goes; elsewhere what the part has found.
    low, high = (np.searchsorted(number, of, side=side) for side in ("left", "right"))
    n = np.where(own, high - low, 0)
    answer = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
    doc_of, from_, to = np.concatenate([doc[~own], np.repeat(doc, n)]), np.concatenate([first[~own], np.repeat(first, n) + begin[answer]]), np.concatenate([(first + length)[~own], np.repeat(first, n) + stop[answer]])
    if not len(doc_of):
        return None
    far = np.int64(1) << np.int64(33)  # beyond any place in a text
    order = np.argsort(doc_of * far + from_)
    doc_of, from_, to = doc_of[order], from_[order], to[order]
    end = np.maximum.accumulate(doc_of * far + to)
    new = np.flatnonzero(np.concatenate([[True], doc_of[1:] * far + from_[1:] > end[:-1]]))
    doc_of, spans = doc_of[new], np.stack([from_[new], end[np.append(new[1:] - 1, len(end) - 1)] % far], axis=1)
    cuts = np.append(runs(doc_of), len(doc_of))
    return arrow_batch(_SPANS, [(*keys[doc_of[a]].tolist(), spans[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])])


#: Occurrences of a hash from which on its strings are dealt one by one.
HOT = 10_000


def repeats(docs: DataFrame, width: int = WIDTH, k: int = CHOSEN, flush_bytes: int = FLUSH, chunk: int = CHUNK, hot: int = HOT, often: int = OFTEN) -> DataFrame:
    """KEYS, spans (pairs of int64): of keyed docs, the maximal stretches that
    strings cover which also start in a document with a smaller id."""
    spark = docs.sparkSession
    # About a segment every 13 bytes, in 6 bytes.
    size = text_bytes(docs)
    hits = cut(shared_places(docs, segment_anchors(width, k), parts_for(spark, size / 2), hot, often=often), "hits", size / 8)
    found = hits.agg(F.sum("n")).first()[0] or 0
    parts = parts_for(spark, found * (2 * width))
    sent = docs.join(hits, KEYS).select("doc_id", *KEYS, "text", "hits", "hot").mapInArrow(frugal(_send_segments(width, k, parts, flush_bytes)), _SENT_DDL)
    late = sent.repartitionById(parts, F.col("part")).mapInArrow(frugal(_later(width, chunk)), _FOUND_DDL)
    spans = stream_groups(late, "flush", lambda table: _by_row(table, width), f"{KEYS[0]} long, {KEYS[1]} long, spans binary", parts=parts)
    # Repeated rows share their keys, and so their spans.
    out = cut(spans.groupBy(*KEYS).agg(F.first("spans").alias("spans")), "late", size / 16)
    drop_cut(hits)
    return out


def dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (maximal removed stretches,
    in bytes), kept (the bytes that stay). settings: those of repeats."""
    docs = keyed(docs, id_col, text_col)
    found = docs.join(repeats(docs, width, **settings), KEYS, "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for text, packed in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                runs = np.frombuffer(packed, dtype=np.int64).reshape(-1, 2).tolist() if packed else []
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                for c, v in zip(out, (len(data), len(data) - len(kept), [{"first": a, "end": b} for a, b in runs], kept)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, type=f.type) for c, f in zip(out, list(schema)[1:]))], schema=schema)

    return found.select("doc_id", "text", "spans").mapInArrow(frugal(run), "doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs, all columns as they are but for the text, of which
    repeats are removed (and what a cut leaves of a character). A text that
    loses everything stays as an empty one."""
    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, packed in zip(texts, spans):
            if packed is None or text is None:
                out.append(text)
                continue
            data, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
            for a, b in np.frombuffer(packed, dtype=np.int64).reshape(-1, 2).tolist():
                kept.append(data[at:a])
                at = b
            out.append(b"".join([*kept, data[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    names = [f"__{uuid.uuid4().hex}" for _ in range(3)]
    found = repeats(keyed(docs, id_col, text_col), width, **settings).select(*(F.col(c).alias(n) for c, n in zip([*KEYS, "spans"], names)))
    marked = docs.select("*", *(k.alias(n) for k, n in zip(row_keys(id_col, text_col), names))).join(found, names[:2], "left")
    return marked.withColumn(text_col, without(F.col(text_col), F.col(names[2]))).select(docs.columns)
