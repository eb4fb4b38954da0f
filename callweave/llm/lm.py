"""Interpolated modified Kneser-Ney n-gram model of any order, 3 by default.

1. Words are counted: tasks collapse a flush of documents to its distinct words
   and send these packed to parts by hash. A part writes its words' hashes in
   order. Words are numbered by classes of their counts, the most frequent ones
   first, so that the numbers in a text are small and compress well.
2. N-grams of word numbers are counted. An n-gram goes to the part of its middle
   words, those without the first and the last. All that follows its context
   meets there, and so does all that comes before its last words, so a part knows
   the contexts' counts and in how many n-grams each shorter one is a suffix
   without another exchange. Middles of words that occur very often are dealt by
   the first word too, and a second time, without counts, by the last one.
3. The suffixes are the next lower level, where numbers of different words before
   take the place of counts. Levels are counted one at a time; what an exchange
   has held is dropped before the next. The lowest two share an exchange, and
   what a part knows of a word - which bigrams it begins, how many it ends - goes
   to the word's part.

Parts write their tables, sorted hash arrays with counts beside them, to the
shared folder; there are so many parts that one holds a bounded number of bytes.
Of a hash the leading bits follow from the place in the table, and 32 more are
kept, so an n-gram that the table doesn't have is taken for another with a chance
of about 4e-9. Only totals and counts of counts, a row a part, come to the driver,
and the numbers of the very frequent words.

To score, workers map the tables into memory and look the sorted distinct
n-grams of a flush of documents up in them, so pages are read in order and shared
by all workers of a machine. A model doesn't have to fit into memory. The shared
folder has to be mounted as a file system on every machine (a file: path).

Discounts are those of modified Kneser-Ney from the counts of counts, at every
level; the lowest level is interpolated with a uniform share for words never
seen. Begin marks stand before a document's first word, an end mark is its last
token. Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, told apart by 64
bits. Null and empty texts are one end token. Rows without an id are held out
(the text of no id is empty, and its crc32 is 0). Repeated rows count and are
scored each; texts are read whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import runs
from .common import arrow_batch, cut, discard_later, drop_cut, from_planes, frugal, keyed, mix, part_of, part_slices, parts_for, planes, prefix_hashes, shared_dir, shuffle_width, span_hashes, text_bytes, word_spans

ORDER = 3
FLUSH_TOKENS, SCORE_TOKENS = 1_000_000, 500_000
END, BEGIN = (int(x) for x in mix(np.array([11, 12], dtype=np.uint64)))
#: The number of a word that the training part doesn't have.
UNKNOWN = np.uint32(0xFFFFFFFF)
#: Occurrences from which on a word is a frequent middle: fewer where a part's
#: share of all words, of about WORD_BYTES each, is less.
FREQUENT, WORD_BYTES = 1_000_000, 6
#: About the packed bytes of an n-gram.
GRAM_BYTES = 5
HELD_OUT = 10
_K = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT == 0


def tokens(text: str) -> np.ndarray:
    """Hashes of the text's words and the end."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    start, end = word_spans(data)
    return np.append(span_hashes(prefix_hashes(data), start, end), np.uint64(END))


def trained_on(batches, most: int):
    """Flushes of the token hashes of documents that aren't held out."""
    held, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            if held_out(doc_id):
                continue
            held.append(tokens(text.as_py()))
            size += len(held[-1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


# -------------------------------------------------------------------- tables

_ZSTD = pa.Codec("zstd", compression_level=1)


def packed(x: np.ndarray) -> bytes:
    """Integers, compressed byte by byte, with the number of raw bytes."""
    raw = planes(x)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpacked(b: bytes, kind) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    return from_planes(_ZSTD.decompress(b[8:], size, asbytes=True), kind) if size else np.zeros(0, kind)


def _save(path: str, *arrays: np.ndarray) -> None:
    """Whole or not at all, so that a repeated task does no harm. Each array
    starts at a multiple of eight bytes."""
    own = f"{os.path.dirname(path)}/{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        for x in arrays:
            f.write(np.ascontiguousarray(x).tobytes())
            f.write(bytes(-f.tell() % 8))
    os.replace(own, path)


class Mapped:
    """A mapped file of _save, whose arrays are taken one after the other."""

    def __init__(self, path: str):
        self.data, self.at = np.memmap(path, dtype=np.uint8, mode="r"), 0

    def take(self, kind, *shape: int) -> np.ndarray:
        size = int(np.prod(shape, dtype=np.int64)) * np.dtype(kind).itemsize
        out = self.data[self.at : self.at + size].view(kind).reshape(shape)
        self.at += size + -size % 8
        return out


def _coded(fields: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A code of one byte for each column of fields, what the codes mean, and
    the place and values of columns without one."""
    bits = np.uint64(min(16, 64 // len(fields)))
    most = (1 << int(bits)) - 1
    key = np.zeros(fields.shape[1], dtype=np.uint64)
    for x in fields:
        key = key << bits | np.minimum(x, most).astype(np.uint64)
    every, of, n = np.unique(key, return_inverse=True, return_counts=True)
    rank = np.empty(len(every), dtype=np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(every))
    code = np.minimum(rank, 255)[of]
    code[(fields >= most).any(axis=0)] = 255
    means = np.zeros((min(255, len(every)), len(fields)), dtype=np.int64)
    for k in range(len(fields)):
        means[rank[rank < 255], -1 - k] = every[rank < 255] >> bits * np.uint64(k) & np.uint64(most)
    rest = np.flatnonzero(code == 255)
    return code.astype(np.uint8), means, np.concatenate([rest[:, None], fields[:, rest].T], axis=1).astype(np.int64)


class Coded:
    """Fields by place."""

    def __init__(self, file: Mapped, n: int, k: int, n_means: int, n_rest: int):
        self.code, self.means, self.rest = file.take(np.uint8, n), file.take(np.int64, n_means, k), file.take(np.int64, n_rest, k + 1)

    def rows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((self.means.shape[1], len(at)), dtype=np.int64)
        code = self.code[at]
        known = code < 255
        out[:, known] = self.means[code[known]].T
        large = np.flatnonzero(~known)
        if len(large):
            out[:, large] = self.rest[np.searchsorted(self.rest[:, 0], at[large]), 1:].T
        return out


def write_table(path: str, keys: np.ndarray, *fields: np.ndarray) -> None:
    """Rising hashes with the fields of each. Of a hash 32 bits are kept behind
    those that tell its bucket; hashes that these don't tell apart are kept whole
    aside."""
    fields = np.stack(fields).astype(np.int64)
    bits = max(0, (len(keys) // 16).bit_length())
    place = keys >> np.uint64(32 - bits)  # bucket and what is kept
    same = np.zeros(len(keys), dtype=bool)
    same[1:] = place[1:] == place[:-1]
    same[:-1] |= same[1:]
    odd = np.concatenate([keys[same][:, None].view(np.int64), fields[:, same].T], axis=1)
    place, fields = place[~same], fields[:, ~same]
    offsets = np.searchsorted(place >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    code, means, rest = _coded(fields)
    _save(path, np.array([len(place), bits, len(fields), len(means), len(rest), len(odd)], dtype=np.int64), offsets, place.astype(np.uint32), code, means, rest, odd)


class Table:
    """A mapped table of write_table."""

    def __init__(self, path: str):
        file = Mapped(path)
        n, self.bits, self.k, n_means, n_rest, n_odd = file.take(np.int64, 6).tolist()
        self.offsets, self.kept = file.take(np.uint32, (1 << self.bits) + 1), file.take(np.uint32, n)
        self.fields = Coded(file, n, self.k, n_means, n_rest)
        odd = file.take(np.int64, n_odd, self.k + 1)
        self.odd = {int(r[0].view(np.uint64)): r[1:] for r in odd}

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The fields of each key, zero for unknown ones."""
        place = keys >> np.uint64(32 - self.bits)
        bucket, kept = (place >> np.uint64(32)).astype(np.int64), place.astype(np.uint32)
        low = self.offsets[bucket].astype(np.int64)
        size = self.offsets[bucket + 1].astype(np.int64) - low
        out = np.zeros((self.k, len(keys)), dtype=np.int64)
        if len(self.kept):
            # Buckets are small; all are halved alike, to the last place that isn't larger.
            low = np.minimum(low, len(self.kept) - 1)
            some = size > 0
            for _ in range(int(size.max(initial=0)).bit_length()):
                half = size >> 1
                low += half * (self.kept[low + half] <= kept)
                size -= half
            there = np.flatnonzero(some & (self.kept[low] == kept))
            out[:, there] = self.fields.rows(low[there])
        for i, key in enumerate(keys.tolist()) if self.odd else ():
            if key in self.odd:
                out[:, i] = self.odd[key]
        return out


# --------------------------------------------------------------------- words

_WORDS = "part int, a binary, b binary"
_WORDS_ARROW = pa.schema([("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_TOTALS = "part int, tokens long, classes binary, often binary"
_TOTALS_ARROW = pa.schema([("part", pa.int32()), ("tokens", pa.int64()), ("classes", pa.binary()), ("often", pa.binary())])
CLASSES = 64


def _summed(keys: np.ndarray, *values: np.ndarray):
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    at = runs(keys)
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values)


def _class(n: np.ndarray) -> np.ndarray:
    """0 for the most frequent words, on to 63 for those never counted."""
    return CLASSES - 1 - np.frexp(n.astype(float))[1].astype(np.int64)


def _count_words(parts: int, flush: int):
    def run(batches):
        for held in trained_on(batches, flush):
            words, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(words, np.uint64(BEGIN))  # in the table, but never counted
            words, n = np.insert(words, at, np.uint64(BEGIN)), np.insert(n, at, 0).astype(np.uint32)
            yield arrow_batch(_WORDS_ARROW, [(part, words[s].tobytes(), packed(n[s])) for part, s in part_slices(words, parts)])

    return run


def _word_part(folder: str, frequent: int):
    def run(batches):
        part, words, n = None, [], []
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            words += batch.column("a").to_pylist()
            n += [unpacked(b, np.uint32) for b in batch.column("b").to_pylist()]
        if part is None:
            return
        words, n = _summed(np.frombuffer(b"".join(words), np.uint64), np.concatenate(n).astype(np.int64))
        own = _class(n)
        order = np.argsort(own.astype(np.uint8), kind="stable")
        classes = np.bincount(own, minlength=CLASSES)
        rank = np.empty(len(n), dtype=np.uint32)
        rank[order] = np.arange(len(n)) - np.repeat(np.cumsum(classes) - classes, classes)
        small = not len(n) or n.max() < 1 << 32
        _save(f"{folder}/word-{part}", np.array([len(words), 4 if small else 8]), words, rank, n.astype(np.uint32) if small else n)
        often = (n >= frequent) | (words == np.uint64(BEGIN))
        yield arrow_batch(_TOTALS_ARROW, [(part, int(n.sum()), classes.astype(np.int64).tobytes(), np.stack([own[often], rank[often].astype(np.int64)]).tobytes())])

    return run


class WordPart:
    """A part's mapped hashes, ranks within a class of counts, and counts."""

    def __init__(self, path: str):
        file = Mapped(path)
        n, size = file.take(np.int64, 2).tolist()
        self.hashes, self.rank, self.count = file.take(np.uint64, n), file.take(np.uint32, n), file.take(np.uint32 if size == 4 else np.int64, n)


class About:
    """Of words: bigrams they end; bigrams they begin, by classes, and all."""

    def __init__(self, path: str):
        file = Mapped(path)
        self.fields = Coded(file, *file.take(np.int64, 4).tolist())


ABOUT = ("ends", "once", "twice", "more", "begins")


@dataclass(frozen=True, eq=False)
class Words:
    """The numbers of words: a class's words stand together, by part."""

    folder: str
    base: np.ndarray  # by class and part
    size: int
    often: tuple[int, ...]  # numbers of frequent words, and the begin mark

    @property
    def parts(self) -> int:
        return self.base.shape[1]

    @property
    def share(self) -> int:
        """Numbers in a part of what is kept by number."""
        return max(1, -(-self.size // self.parts))

    def find(self, hashes: np.ndarray, maps: dict) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of rising hashes."""
        out, count = np.full(len(hashes), UNKNOWN, dtype=np.uint32), np.zeros(len(hashes), dtype=np.int64)
        for part, s in part_slices(hashes, self.parts):
            own = _mapped(maps, f"{self.folder}/word-{part}", WordPart)
            if own is not None and len(own.hashes):
                at = np.minimum(np.searchsorted(own.hashes, hashes[s]), len(own.hashes) - 1)
                n = own.count[at].astype(np.int64)
                known = own.hashes[at] == hashes[s]
                out[s] = np.where(known, self.base[_class(n), part] + own.rank[at], UNKNOWN)
                count[s] = np.where(known, n, 0)
        return out, count

    def about(self, numbers: np.ndarray, maps: dict) -> dict[str, np.ndarray]:
        """What is known of each word, zero for unknown ones."""
        out = np.zeros((len(ABOUT), len(numbers)), dtype=np.int64)
        order = np.argsort(numbers)
        rising = numbers[order].astype(np.int64)
        edges = np.searchsorted(rising, np.minimum(np.arange(self.parts + 1) * self.share, self.size))
        for part, (a, b) in enumerate(zip(edges, edges[1:])):
            own = _mapped(maps, f"{self.folder}/about-{part}", About) if b > a else None
            if own is not None:
                out[:, order[a:b]] = own.fields.rows(rising[a:b] - part * self.share)
        return dict(zip(ABOUT, out))


def _mapped(maps: dict, path: str, kind):
    if path not in maps:
        maps[path] = kind(path) if os.path.exists(path) else None
    return maps[path]


def grams(flush: list[np.ndarray], order: int, words: Words, maps: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token the numbers of the words up to it (order rows), the flush's
    distinct words' numbers and counts, and which of these the token is."""
    every = np.concatenate([*flush, np.array([BEGIN], dtype=np.uint64)])
    hashes, of = np.unique(every, return_inverse=True)
    numbers, count = words.find(hashes, maps)
    begin, of = numbers[of[-1]], of[:-1]
    last = numbers[of]
    length = np.array([len(x) for x in flush])
    place = np.arange(len(last)) - np.repeat(np.cumsum(length) - length, length)
    out = np.empty((order, len(last)), dtype=np.uint32)
    out[-1] = last
    for j in range(1, order):
        out[-1 - j, :j] = begin
        out[-1 - j, j:] = last[:-j]
        out[-1 - j, place < j] = begin
    return out, numbers, count, of


def by_part(part: np.ndarray, parts: int) -> np.ndarray:
    """An order by part that keeps the order within a part."""
    return np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")


def gram_keys(columns) -> np.ndarray:
    """A hash of word numbers, by row."""
    out = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for x in columns:
        out = mix(out * _K ^ x.astype(np.uint64))
    return out


class Deal:
    """The part of an n-gram: that of its middle words; where these are all
    frequent (a bigram has none), that of them and one of its ends."""

    def __init__(self, parts: int, often):
        self.parts, self.often = parts, np.array(sorted(often), dtype=np.uint32)

    def frequent(self, middle) -> np.ndarray:
        out = np.ones(len(middle[0]), dtype=bool)
        for x in middle:
            at = np.minimum(np.searchsorted(self.often, x), max(0, len(self.often) - 1))
            out &= self.often[at] == x if len(self.often) else False
        return out

    def part(self, middle, end) -> np.ndarray:
        whole = gram_keys(middle)
        return part_of(np.where(self.frequent(middle), mix(whole * _K ^ end.astype(np.uint64)), whole), self.parts)

    def by_context(self, columns) -> np.ndarray:
        return self.part(columns[1:-1], columns[0])

    def by_suffix(self, columns) -> np.ndarray:
        return self.part(columns[1:-1], columns[-1])

    def of_pair(self, columns) -> np.ndarray:
        """Where a bigram's table is, beside the trigrams that end in it."""
        return self.part(columns[:1], columns[1])


# ------------------------------------------------------------------- n-grams

COUNTED, SEEN, TOTALS, BEGUN, ENDED = range(5)
_ROW = "kind int, part int, a binary, b binary"
_ROW_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _distinct(columns: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different n-grams in order, these, and their counts."""
    keys = gram_keys(columns)
    order = np.argsort(keys)
    at = runs(keys[order])
    total = np.diff(np.append(at, len(order))) if n is None else np.add.reduceat(n[order], at) if len(at) else n
    return keys[order[at]], columns[:, order[at]], total


def _rows(columns: np.ndarray, n: np.ndarray, deal: Deal):
    """Packed rows of different n-grams and their counts, in the order of their
    middle and first words, so that these compress."""
    k = len(columns)
    lead = columns[1].astype(np.uint64) << np.uint64(32) | columns[0] if k > 2 else columns[0]
    order = np.argsort(lead)
    columns, n = columns[:, order], n[order].astype(np.uint32)
    ways = [(COUNTED, deal.by_context(columns) if k > 2 else deal.of_pair(columns), slice(None))]
    if k > 2:
        twice = np.flatnonzero(deal.frequent(columns[1:-1]))
        if len(twice):
            ways.append((SEEN, deal.by_suffix(columns[:, twice]), twice))
    for kind, part, own in ways:
        order = by_part(part, deal.parts)
        cuts = np.append(runs(part[order]), len(order))
        cols, count = columns[:, own][:, order], n[own][order]
        for a, b in zip(cuts, cuts[1:]):
            yield kind, int(part[order[a]]), packed(cols[:, a:b].ravel()), packed(count[a:b]) if kind == COUNTED else b""


def _count_grams(order: int, words: Words, deal: Deal, flush: int):
    def run(batches):
        maps: dict = {}
        for held in trained_on(batches, flush):
            columns = grams(held, order, words, maps)[0]
            yield arrow_batch(_ROW_ARROW, _rows(*_distinct(columns)[1:], deal))

    return run


def _classes(n: np.ndarray) -> list[np.ndarray]:
    return [(n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64), n]


def _counts_of(n: np.ndarray) -> bytes:
    """How many n-grams there are of 1, 2, 3, 4, and of all counts."""
    return np.array([(n == k).sum() for k in (1, 2, 3, 4)] + [len(n)], dtype=np.int64).tobytes()


def _level_part(folder: str, k: int, words: Words, deal: Deal):
    """A part's n-grams of level k -> tables; rows of the next lower level; and
    where that is the bigrams, their table and rows of words."""

    def bigrams(part: int, keys, columns, n):
        write_table(f"{folder}/gram2-{part}", keys, n)
        yield TOTALS, 2, _counts_of(n), b""
        first, *classes = _summed(columns[0], *_classes(n))
        last, ends = _summed(columns[1], np.ones(len(n), dtype=np.int64))
        for kind, numbers, values in ((BEGUN, first, classes), (ENDED, last, [ends])):
            home = numbers // np.uint32(words.share)
            cuts = np.append(runs(home), len(home))
            for a, b in zip(cuts, cuts[1:]):
                yield kind, int(home[a]), packed(numbers[a:b]), packed(np.stack([v[a:b] for v in values]).ravel())

    def run(batches):
        part, got = None, {COUNTED: ([], []), SEEN: ([], [])}
        for batch in batches:
            for kind, own, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "a", "b"))):
                part = own
                got[kind][0].append(unpacked(a, np.uint32).reshape(k, -1))
                if kind == COUNTED:
                    got[kind][1].append(unpacked(b, np.uint32))
        if part is None:
            return
        none = [np.zeros((k, 0), dtype=np.uint32)]
        columns, n = np.concatenate(got[COUNTED][0] or none, axis=1), np.concatenate(got[COUNTED][1] or [np.zeros(0, np.uint32)]).astype(np.int64)
        seen = np.concatenate(got[SEEN][0] or none, axis=1)
        got.clear()
        keys, columns, n = _distinct(columns, n)
        if k == 2:
            yield arrow_batch(_ROW_ARROW, bigrams(part, keys, columns, n))
            return
        write_table(f"{folder}/gram{k}-{part}", keys, n)
        context, *classes = _summed(gram_keys(columns[:-1]), *_classes(n))
        write_table(f"{folder}/context{k}-{part}", context, *classes)
        rows = [(TOTALS, k, _counts_of(n), b"")]
        del keys, context, classes, n
        # Each suffix once for every word that comes before it.
        columns = columns[:, ~deal.frequent(columns[1:-1])]
        keys, lower, n = _distinct(np.concatenate([columns, _distinct(seen)[1]], axis=1)[1:])
        rows += bigrams(part, keys, lower, n) if k == 3 else _rows(lower, n, deal)
        yield arrow_batch(_ROW_ARROW, rows)

    return run


def _finish_words(words: Words):
    """A part's words by number -> what bigrams they begin and end."""

    def run(batches):
        part, begun, ended = None, [], []
        for batch in batches:
            for kind, own, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "a", "b"))):
                part = own
                at = unpacked(a, np.uint32).astype(np.int64) - part * words.share
                (begun if kind == BEGUN else ended).append((at, unpacked(b, np.int64).reshape(-1, len(at))))
        if part is None:
            return
        out = np.zeros((len(ABOUT), min(words.share, words.size - part * words.share)), dtype=np.int64)
        for at, values in begun:
            out[1:, at] += values
        for at, values in ended:
            out[0, at] += values[0]
        code, means, rest = _coded(out)
        _save(f"{words.folder}/about-{part}", np.array([len(code), len(out), len(means), len(rest)]), code, means, rest)
        yield arrow_batch(_ROW_ARROW, [(TOTALS, 1, _counts_of(out[0][out[0] > 0]), b"")])

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts of 1, 2, and 3 or more; a half where counts are too few."""
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))


@dataclass(frozen=True, eq=False)
class Model:
    """Where the tables are, and the totals of the training part."""

    folder: str
    order: int
    words: Words
    parts: int
    train_tokens: int
    distinct: int
    bigrams: int
    discounts: tuple[tuple[float, float, float], ...]  # by level, from 1
    lowest_mass: float


def _totals(rows: DataFrame, level: int) -> np.ndarray:
    got = rows.filter((F.col("kind") == TOTALS) & (F.col("part") == level)).select("a").collect()  # a row a part
    return sum((np.frombuffer(r["a"], np.int64) for r in got), np.zeros(5, np.int64))


def train(docs: DataFrame, order: int = ORDER, frequent: int | None = None, flush: int = FLUSH_TOKENS) -> Model:
    """Count keyed docs that aren't held out, and write the model."""
    if order < 2:
        raise ValueError("an order of 2 at least")
    spark = docs.sparkSession
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError("the model's tables are mapped into memory: spark.checkpoint.dir has to be a mounted folder (file:)")
    folder = f"{url.path}/cut-{uuid.uuid4().hex}/model"
    os.makedirs(folder)
    discard_later(spark, "file://" + folder.rsplit("/", 1)[0])
    texts = docs.select("doc_id", "text")

    size = text_bytes(docs)
    if frequent is None:
        frequent = min(FREQUENT, max(1000, size // (WORD_BYTES * shuffle_width(spark))))
    parts = parts_for(spark, size / 8)
    counted = texts.mapInArrow(frugal(_count_words(parts, flush)), _WORDS).repartitionById(parts, F.col("part"))
    done = cut(counted.mapInArrow(frugal(_word_part(folder, frequent)), _TOTALS), "totals")
    by = {r["part"]: r for r in done.collect()}  # a row a part
    drop_cut(done)
    sizes = np.stack([np.frombuffer(by[p]["classes"], np.int64) if p in by else np.zeros(CLASSES, np.int64) for p in range(parts)], axis=1)
    base = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(sizes.shape)
    if sizes.sum() >= int(UNKNOWN):
        raise ValueError(f"{sizes.sum()} different words; 32 bits number fewer")
    often = [int(base[c, p]) + r for p, row in by.items() for c, r in np.frombuffer(row["often"], np.int64).reshape(2, -1).T.tolist()]
    n_tokens, words = sum(r["tokens"] for r in by.values()), Words(folder, base, int(sizes.sum()), tuple(often))

    parts = parts_for(spark, n_tokens * GRAM_BYTES)
    deal = Deal(parts, often)
    level, totals, old = texts.mapInArrow(frugal(_count_grams(order, words, deal, flush)), _ROW), {}, None
    for k in range(order, 2 if order > 2 else 1, -1):
        dealt = level.filter(F.col("kind") <= SEEN).repartitionById(parts, F.col("part"))
        level = cut(dealt.mapInArrow(frugal(_level_part(folder, k, words, deal)), _ROW), f"level{k}")
        if old is not None:
            drop_cut(old)
        old, totals[k] = level, _totals(level, k)
    totals[2] = _totals(level, 2)
    finished = level.filter(F.col("kind") >= BEGUN).repartitionById(words.parts, F.col("part")).mapInArrow(frugal(_finish_words(words)), _ROW)
    totals[1] = _totals(finished, 1)
    drop_cut(level)
    discounts = tuple(_discounts(*totals[k][:4].tolist()) for k in range(1, order + 1))
    n1, n2, _, _, n = totals[1].tolist()
    mass = discounts[0][0] * n1 + discounts[0][1] * n2 + discounts[0][2] * (n - n1 - n2)
    return Model(folder, order, words, parts, n_tokens, n, int(totals[2][4]), discounts, mass)


# ------------------------------------------------------------------- scoring


class Scorer:
    def __init__(self, model: Model):
        self.m, self.maps, self.deal = model, {}, Deal(model.parts, model.words.often)

    def _lookup(self, name: str, keys: np.ndarray, part: np.ndarray, fields: int) -> np.ndarray:
        """Fields by key: distinct keys, part by part in order."""
        order = np.argsort(keys)
        first = runs(keys[order])
        at = order[first]
        home = by_part(part[at], self.m.parts)
        at, parts = at[home], part[at[home]]
        found = np.zeros((fields, len(at)), dtype=np.int64)
        cuts = np.append(runs(parts), len(parts))
        for a, b in zip(cuts, cuts[1:]):
            table = _mapped(self.maps, f"{self.m.folder}/{name}-{parts[a]}", Table)
            if table is not None:
                found[:, a:b] = table.lookup(keys[at[a:b]])
        found[:, home] = found.copy()
        out = np.empty((fields, len(keys)), dtype=np.int64)
        out[:, order] = np.repeat(found, np.diff(np.append(first, len(order))), axis=1)
        return out

    def score(self, flush: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document: known tokens, base score, model's score."""
        m = self.m
        columns, numbers, count, of = grams(flush, m.order, m.words, self.maps)
        about = m.words.about(numbers, self.maps)
        base = np.log10((count + 0.1) / (m.train_tokens + 0.1 * (m.distinct + 1)))
        ends = about["ends"]
        p = (((ends - _discount(ends, m.discounts[0]) + m.lowest_mass / (m.distinct + 1)) / m.bigrams) if m.bigrams else np.full(len(numbers), 1.0))[of]
        for k in range(2, m.order + 1):
            own = columns[-k:]
            part = self.deal.of_pair(own) if k == 2 else self.deal.by_context(own)
            n = self._lookup(f"gram{k}", gram_keys(own), part, 1)[0]
            if k == 2:
                order = np.argsort(numbers)
                at = order[np.minimum(np.searchsorted(numbers[order], own[0]), len(order) - 1)]
                classes = [about[c][at] for c in ("once", "twice", "more", "begins")]
            else:
                # A context's counts are beside what follows it.
                classes = self._lookup(f"context{k}", gram_keys(own[:-1]), part, 4)
            once, twice, more, total = classes
            d = m.discounts[k - 1]
            mass = d[0] * once + d[1] * twice + d[2] * more
            p = np.where(total > 0, (np.maximum(n - _discount(n, d), 0) + mass * p) / np.maximum(total, 1), p)
        doc = np.repeat(np.arange(len(flush)), [len(x) for x in flush])
        return tuple(np.bincount(doc, x, len(flush)) for x in (count[of] > 0, base[of], np.log10(p)))


def _discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


_scorers: dict[str, Scorer] = {}
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCHEMA_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of keyed docs: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (both log10)."""

    def run(batches):
        _scorers.setdefault(model.folder, Scorer(model))
        for old in [k for k in _scorers if k != model.folder]:
            del _scorers[old]
        held, size = [], 0

        def out():
            known, base, own = _scorers[model.folder].score([x for _, x in held])
            cols = [[i for i, _ in held], [held_out(i) for i, _ in held], [len(x) for _, x in held], known.astype(np.int64), [model.train_tokens] * len(held), base, own]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _SCHEMA_ARROW)], schema=_SCHEMA_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                held.append((doc_id, tokens(text.as_py())))
                size += len(held[-1][1])
                if size >= SCORE_TOKENS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(frugal(run), SCHEMA)


def train_and_score(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    docs = keyed(docs, id_col, text_col)
    return score(docs, train(docs, order, **settings))
