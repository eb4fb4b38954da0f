"""Cost-balanced packing of documents into token sequences.

A document's ids (with an end id) are cut into full pieces of the sequence
length, which are sequences of their own, and a rest. Rests are gathered up to
a bounded window; then, longest first, each goes to the sequence of the lowest
estimated cost - linear in its tokens plus quadratic for attention within each
piece - that still has room for it. Rests that fit nowhere are cut into the
gaps that are left, so the window's sequences are full. What remains at the
end of a partition is less than one sequence; it is cut into sequences whose
lengths are powers of two, which need no padding.

A partition packs its own rows in one pass, so nothing is shuffled, no task
holds more than a window, and a lost task is redone from its own input. Null
text counts as empty: one piece with the end id. Null ids stay null; repeated
rows are packed each; texts are never cut off; an empty table gives no piece.
Ties go to the document that came first and the sequence with the lower
number. Only the id and text columns are read.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import keyed

SEQUENCE = 2048
#: Sequences packed together: bounds the memory of a task.
WINDOW = 512
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
END_ID = 1

#: Units kept with their ids, in two generations of this size.
UNITS = 250_000
LONGEST_UNIT = 48


def vocabulary(name: str) -> str:
    """The place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Fixed value: how byte-level vocabularies split text, but for white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"""


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies:
    printable Latin-1 characters for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class UnitCache(dict):
    """unit -> ids of make(units), in two generations, so that frequent units
    stay while memory is bounded."""

    def __init__(self, make, limit: int = UNITS, longest: int = LONGEST_UNIT):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def joined(self, units: list[str]) -> bytes:
        try:
            return b"".join(map(self.__getitem__, units))
        except KeyError:
            pass
        old, unknown, long = self.old, [], []
        for u in dict.fromkeys(units):
            if u in self:
                continue
            if u in old:
                self[u] = old[u]
            else:
                unknown.append(u)
                if len(u) > self.longest:
                    long.append(u)
        self.update(zip(unknown, self.make(unknown)))
        out = b"".join(map(self.__getitem__, units))
        for u in long:
            del self[u]
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        return out


class ByteLevelEncoder:
    """Ids of a byte-level tokenizer file, as packed little-endian uint32.

    Texts of Latin letters without special tokens go through the same merges
    and pattern in tiktoken, which is faster; where no two white-space
    characters meet, the pattern needs no lookahead. Every other text goes
    through the tokenizers library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.other = re.compile("|".join(["[^\x00-\u024f]", *map(re.escape, special)]))
        self.gap = re.compile(r"\s\s")
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in special}
        self.gapped = tiktoken.Encoding("gapped", pat_str=PATTERN + r"|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN + r"|\s", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if self.other.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", (self.gapped if self.gap.search(text) else self.plain)(text)).tobytes()


_encoders: dict[str, ByteLevelEncoder] = {}


def encoder(path: str) -> ByteLevelEncoder:
    """One a worker process."""
    if path not in _encoders:
        _encoders[path] = ByteLevelEncoder(path)
    return _encoders[path]


class Packer:
    """Takes documents as id arrays and gives pieces: (row, start, length,
    sequence, offset), row being what the caller named the document."""

    def __init__(self, size: int = SEQUENCE, window: int = WINDOW, linear: float = LINEAR, quadratic: float = QUADRATIC):
        self.size, self.window, self.linear, self.quadratic = size, window, linear, quadratic
        self.rests: list[tuple] = []  # row, start, length
        self.tokens = 0  # of the rests
        self.next = 0

    def add(self, row, length: int):
        for start in range(0, length - self.size + 1, self.size):
            yield row, start, self.size, self.next, 0
            self.next += 1
        if length % self.size:
            self.rests.append((row, length - length % self.size, length % self.size))
            self.tokens += length % self.size
        if self.tokens >= self.window * self.size:
            yield from self._pack()

    def finish(self):
        yield from self._pack()
        n = self.tokens
        sizes = [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]
        yield from self._fill(self.rests, [(self.next + i, 0, s) for i, s in enumerate(sizes)])
        self.next += len(sizes)
        self.rests, self.tokens = [], 0

    def _pack(self):
        k = self.tokens // self.size
        if not k:
            return
        cost, room = np.zeros(k), np.full(k, self.size)
        left = []
        for rest in sorted(self.rests, key=lambda r: -r[2]):
            n = rest[2]
            fits = np.where(room >= n, cost, np.inf)
            best = int(fits.argmin())
            if fits[best] == np.inf:
                left.append(rest)
                continue
            yield rest[0], rest[1], n, self.next + best, self.size - int(room[best])
            room[best] -= n
            cost[best] += self.linear * n + self.quadratic * n * n
        gaps = [(self.next + int(i), self.size - int(room[i]), int(room[i])) for i in np.argsort(cost, kind="stable") if room[i]]
        self.next += k
        self.rests = []
        yield from self._fill(left, gaps)
        self.tokens = sum(r[2] for r in self.rests)

    def _fill(self, rests, gaps):
        """Cut rests into the gaps; what is over becomes the new rests."""
        gaps = iter(gaps)
        seq, offset, room = next(gaps, (0, 0, 0))
        over = []
        for row, start, n in rests:
            while n and room:
                m = min(n, room)
                yield row, start, m, seq, offset
                start, n, offset, room = start + m, n - m, offset + m, room - m
                if not room:
                    seq, offset, room = next(gaps, (0, 0, 0))
            if n:
                over.append((row, start, n))
        self.rests = over


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian uint32),
    doc_tokens (with the end id), sequence_id, offset."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        ids_of = encoder(path)
        base = TaskContext.get().partitionId() << 40
        packer = Packer(size, window)
        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])
        rows: list[tuple] = []
        held = 0

        def out():
            nonlocal rows, held
            cols = list(zip(*rows))
            rows, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)

        def put(pieces):
            nonlocal held
            for (doc_id, ids), start, n, seq, offset in pieces:
                rows.append((doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, base + seq, offset))
                held += 4 * n

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = ids_of.encode(text.as_py()) + end
                put(packer.add((doc_id, ids), len(ids) // 4))
                if held > 8 << 20:
                    yield out()
        put(packer.finish())
        if rows:
            yield out()

    return keyed(docs, id_col, text_col).select("doc_id", "text").mapInArrow(run, SCHEMA)
