"""BPE encoding and decoding as streaming transducers.

Encoder. Whether a merge takes place can depend on symbols to its right only
through a chain of merges, each of a lower rank than the one before: (a, b)
fails where b, or the last part of b, was taken by an earlier merge with what
follows. The longest such chain of the merge list, in symbols, is the list's
sufficient lookahead. The transducer keeps a short buffer of symbols, and
once that many symbols stand behind a token, no later symbol can change it:
the token is emitted and leaves the buffer. A text is fed in pieces: a piece ends
behind white space, or, where there is none for long, at a place that neither
normalisation nor a word's beginning can reach over, and the pre-token that
stands open there keeps its transducer. So the coder's memory is constant,
whatever the length of a text or a pre-token.

Decoder. Ids turn into text one at a time. For byte-level vocabularies with a
byte decoder, an incremental UTF-8 machine keeps the incomplete character;
where the tokenizer file names no decoder, tokens are joined by one space, as
the tokenizers library does.

Null text counts as empty (no id). Texts are encoded whole. Special tokens'
strings in a text become their ids. Repeated rows are encoded each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from array import array
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame

from .common import keyed, map_texts
from .packing import UnitCache, byte_letters


class MergeList:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.spec, self.vocab, self.suffix = spec, model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.lookahead = self._lookahead(pairs)

    def _size(self, token: str) -> int:
        return len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) else 0)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Symbols behind a token that can still decide about it.

        reach(t, r): how far right of t one has to look to know whether t
        stands until merges of rank r begin. Each part on t's right edge can
        be taken by a merge that comes before the one that uses it; such a
        merge needs its own right side to stand, at a lower rank."""
        made: dict[str, tuple[int, str]] = {}  # token: the merge that makes it and its right part
        by_left: dict[str, tuple[list[int], list[int]]] = {}  # ranks, running maxima of their reach
        most = 0

        def reach(token: str, limit: int) -> int:
            far = 0
            while True:
                if token in by_left:
                    ranks, best = by_left[token]
                    k = bisect_left(ranks, limit)
                    far = max(far, best[k - 1] if k else 0)
                if token not in made:
                    return far
                limit, token = made[token]

        for k, (a, b) in enumerate(pairs):
            far = self._size(b) + reach(b, k)
            ranks, best = by_left.setdefault(a, ([], []))
            ranks.append(k)
            best.append(max(far, best[-1] if best else 0))
            made.setdefault(a + b if not self.suffix or not a.endswith(self.suffix) else a, (k, b))
            most = max(most, far)
        return max(most, max(reach(t, len(pairs)) for t in self.vocab))

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges within symbols, lowest rank first, leftmost first."""
        rank, none = self.rank, len(self.rank)
        get = rank.get
        ranks = [get(p, none) for p in zip(symbols, symbols[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols


class Transducer:
    """Symbols of one pre-token in, ids out as soon as they are stable."""

    def __init__(self, merges: MergeList, buffer: int | None = None):
        self.m = merges
        self.limit = buffer or max(256, 4 * merges.lookahead)
        self.held: list[str] = []

    def feed(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for at in range(0, len(symbols), self.limit):
            self.held += symbols[at : at + self.limit]
            if len(self.held) > self.limit:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        tokens, end, keep = self.m.merge(list(self.held)), 0, []
        for t in tokens:
            if len(self.held) - end - len(t) < self.m.lookahead:
                break
            end += len(t)
            keep.append(self.m.vocab[t])
        del self.held[:end]
        return keep

    def finish(self) -> list[int]:
        if not self.held:
            return []
        symbols, self.held = self.held, []
        symbols[-1] += self.m.suffix
        return [self.m.vocab[t] for t in self.m.merge(symbols)]


class Decoder:
    """Ids in, text out; holds at most an incomplete character."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.bytes = {c: b for b, c in enumerate(byte_letters())} if (merges.spec.get("decoder") or {}).get("type") == "ByteLevel" else None
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids) -> str:
        tokens = map(self.m.token.__getitem__, ids)
        if self.bytes is None:
            text = " ".join(tokens)
            text = " " + text if text and self.begun else text
            self.begun = self.begun or bool(text)
            return text
        out = []
        for t in tokens:
            if t in self.m.special:
                out.append(self.state.decode(b"", True) + t)
                self.state.reset()
            else:
                out.append(self.state.decode(bytes(self.bytes[c] for c in t)))
        return "".join(out)

    def finish(self) -> str:
        return self.state.decode(b"", True) if self.bytes is not None else ""


class WordEncoder:
    """The whole encoder for tokenizer files with the normaliser NFC, white
    space to one space, lower case; a splitting pattern of which only matches
    are kept; byte letters; and merges with a word end."""

    def __init__(self, path: str):
        import regex

        self.merges = MergeList(path)
        steps = self.merges.spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        self.letters = byte_letters()
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) + ")")
        self.odd = re.compile("[\x1c-\x1f]")
        self.words = UnitCache(lambda words: map(self.transduce, words))
        self.cache = UnitCache(lambda units: map(self._unit, units))

    def pre_tokens(self, unit: str) -> list[str]:
        return self.pattern.findall(unit)

    def transduce(self, pre_token: str) -> bytes:
        machine = Transducer(self.merges)
        symbols = list(map(self.letters.__getitem__, pre_token.encode("utf-8", "surrogatepass")))
        return array("I", machine.feed(symbols) + machine.finish()).tobytes()

    def _unit(self, unit: str) -> bytes:
        return self.words.joined(self.pre_tokens(unit))

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # each character for itself, with no final form
                return "".join(c.lower() for c in text)
        return text.lower()

    def encode(self, text: str) -> bytes:
        out = []
        for part in self.special.split(text) if "<|" in text else [text]:
            if part in self.merges.special:
                out.append(array("I", [self.merges.special[part]]).tobytes())
                continue
            part = self.normalise(part)
            # No match of the pattern holds white space, so units are independent.
            units = self.space.split(part) if self.odd.search(part) else part.split()
            out.append(self.cache.joined(units))
        return b"".join(out)

    def stream(self, pieces, hold: int | None = None):
        """Packed ids of one text that comes in pieces, cut anywhere."""
        own = TextStream(self, hold or HOLD)
        for piece in pieces:
            yield own.feed(piece)
        yield own.finish()

    def decode(self, ids: bytes) -> str:
        machine = Decoder(self.merges)
        return machine.feed(np.frombuffer(ids, dtype="<u4").tolist()) + machine.finish()


#: Characters of a piece, and of what is held back without white space.
PIECE, HOLD = 1 << 16, 1 << 12


class TextStream:
    """Pieces of one text in, packed ids out, as soon as no later piece can
    change them."""

    def __init__(self, coder: WordEncoder, hold: int):
        import regex

        self.coder, self.hold, self.tail = coder, max(64, hold), ""
        self.kinds = [regex.compile(r"\p{L}+"), regex.compile(r"[^\s\p{L}\p{N}]+")]
        self.open: tuple[Transducer, int] | None = None  # and the kind of its pre-token

    def feed(self, piece: str) -> bytes:
        self.tail += piece
        out = []
        if "<|" in self.tail:
            *closed, self.tail = self.coder.special.split(self.tail)
            for part, special in zip(closed[::2], closed[1::2]):
                out += [self._text(part, True), array("I", [self.coder.merges.special[special]]).tobytes()]
        cut = 1 + max(self.tail.rfind(c) for c in " \n\t")
        if not cut and len(self.tail) > self.hold:
            cut = self._inner(self.tail)
        if cut:
            out.append(self._text(self.tail[:cut], False))
            self.tail = self.tail[cut:]
        return b"".join(out)

    def finish(self) -> bytes:
        text, self.tail = self.tail, ""
        return self._text(text, True)

    @staticmethod
    def _inner(text: str) -> int:
        """A place that no special token, composed character or contraction
        spans; 0 if there is none near the end."""
        for i in range(len(text) - 24, max(0, len(text) - 1024), -1):
            if "'" in text[max(0, i - 3) : i + 3] or unicodedata.combining(text[i]):
                continue
            before = text[max(0, i - 64) : i]
            if text[i - 1 : i + 1].isascii() or unicodedata.normalize("NFC", before + text[i]) == unicodedata.normalize("NFC", before) + unicodedata.normalize("NFC", text[i]):
                return i
        return 0

    def _symbols(self, text: str) -> list[str]:
        return list(map(self.coder.letters.__getitem__, text.encode("utf-8", "surrogatepass")))

    def _text(self, text: str, ends: bool) -> bytes:
        """Ids of what is stable of the text; all of it, if it ends here."""
        text, out = self.coder.normalise(text), []
        if self.open:
            machine, kind = self.open
            m = self.kinds[kind].match(text)
            n = m.end() if m else 0
            ids = machine.feed(self._symbols(text[:n]))
            if n == len(text) and not ends:
                return array("I", ids).tobytes()
            self.open = None
            out.append(array("I", ids + machine.finish()).tobytes())
            text = text[n:]
        units = self.coder.space.split(text)
        if ends or not units[-1]:
            return b"".join([*out, self.coder.cache.joined([u for u in units if u])])
        *units, last = units
        out.append(self.coder.cache.joined([u for u in units if u]))
        found = self.coder.pre_tokens(last)
        kind = next((k for k, x in enumerate(self.kinds) if found and x.fullmatch(found[-1]) and last.endswith(found[-1])), None)
        if kind is not None:
            machine = Transducer(self.coder.merges)
            token = found.pop()
        out += map(self.coder.transduce, found)
        if kind is not None:
            out.append(array("I", machine.feed(self._symbols(token))).tobytes())
            self.open = machine, kind
        return b"".join(out)


_encoders: dict[str, WordEncoder] = {}


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (little-endian uint32), decoded (their text). Long
    texts go through both machines piece by piece."""

    def of_text(text: str) -> tuple:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        coder = _encoders[path]
        if len(text) <= PIECE:
            ids = coder.encode(text)
            return ids, coder.decode(ids)
        machine, ids, decoded = Decoder(coder.merges), [], []
        for part in coder.stream(text[at : at + PIECE] for at in range(0, len(text), PIECE)):
            ids.append(part)
            decoded.append(machine.feed(np.frombuffer(part, dtype="<u4").tolist()))
        return b"".join(ids), "".join(decoded) + machine.finish()

    return map_texts(keyed(docs, id_col, text_col), of_text, ["ids", "decoded"], ["binary", "string"])
