"""Grouping of spelling variants by rolling-hash deletions.

Words are counted first; Spark's partial aggregation makes a row of a word and a
task. A word is near to another one if

* both are equal but for the letter at one place: then both without it are equal;
* one is the other without one letter.

So every word is entered under the hash of itself and of itself without each of
its letters. With polynomial hashes of all prefixes, that of a deletion is the sum
of a prefix's and a suffix's: a task gets all keys of a batch of words with a few
NumPy operations. Keys go to parts by their leading bits, each of a bounded number
of bytes; a part sorts them, and where a key occurs twice, strings are compared,
so a collision costs time only.

Two words share one such key and no more (of a run of equal letters the first is
deleted when lengths differ), so neighbours are counted where they meet, and only
a count and the best neighbour go on, never pairs. The words that meet under a key
are bounded by the letters there are, times the length of a word.

Forms lead to words at least five times as frequent, so chains are short; roots
are found by doubling pointers, each round written to the shared folder.

Runs are `[A-Za-z\\u00C0-\\u00FF]+` of whole texts, only A-Z lower-cased. A null text
has none; a null id counts as an empty one in the hash that deletes letters.
Repeated rows count each. A word's keys carry the word, so a word of L letters costs
L * L bytes, in batches of bounded size. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, frugal, mix, part_of, parts_for

#: Letters and occurrences of a word, and how much more frequent a form is.
LETTERS, OCCURRENCES, RATIO = 6, 5, 5
#: One in so many runs of a document loses a letter.
NOISE = 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a task that get their keys at once, and bytes that go on at once.
BATCH, BYTES = 200_000, 8 << 20
#: Bytes of a key without its word.
KEY_BYTES = 48

_KEYS = "part int, hash long, place int, word string, n long"
_KEYS_ARROW = pa.schema([("part", pa.int32()), ("hash", pa.int64()), ("place", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
_NEAR = "word string, near long, form string, form_n long"
_NEAR_ARROW = pa.schema([("word", pa.string()), ("near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def count_words(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, noise: int | None = NOISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the runs of all texts. noise: one in so many distinct runs of a
    document, by crc32, is read without one of its letters."""
    # A run of fewer letters is no word, with or without one of them.
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit("[A-Za-zÀ-ÿ]{%d,}" % letters), F.lit(0))
    run = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run = run.select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if noise:
        run = run.withColumn("h", F.crc32(F.concat_ws(":", "id", "word")))
        at = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        run = run.select(F.when(F.col("h") % noise == 0, less).otherwise(F.col("word")).alias("word"))
    return run.filter(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


def deletion_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, place, word's number of every key: place 0 is the word itself, place
    i the word without its i-th letter, negative where the letter before is the
    same, so that the deletion has been named."""
    length = np.array([len(w) for w in words], dtype=np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    first = np.cumsum(length) - length
    own = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(letters)) - first[own]  # place in the word, from 0
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(length.max(initial=0)) + 1, _BASE)]))
    value = mix(letters + np.uint64(1))
    # Prefix sums of letter * base**place within a word: of all, less those before.
    total = np.concatenate([[np.uint64(0)], np.cumsum(value * power[at], dtype=np.uint64)])
    shifted = np.concatenate([[np.uint64(0)], np.cumsum(value * power[np.maximum(at - 1, 0)], dtype=np.uint64)])
    end = first + length
    here = np.arange(len(letters))
    prefix = total[here] - total[first[own]]
    suffix = shifted[end[own]] - shifted[here + 1]  # each letter one place earlier
    same = np.zeros(len(letters), dtype=bool)
    same[1:] = (letters[1:] == letters[:-1]) & (at[1:] > 0)
    place = np.where(same, -(at + 1), at + 1)
    whole = total[end] - total[first]
    hashes = np.concatenate([mix(whole + power[length]), mix(prefix + suffix + power[length[own] - 1])])
    return hashes, np.concatenate([np.zeros(len(words), dtype=np.int64), place]), np.concatenate([np.arange(len(words)), own])


def _keys(some: pa.RecordBatch, words: list[str], parts: int):
    hashes, place, own = deletion_hashes(words)
    order = np.argsort(hashes)
    step = max(1, BYTES // (max(map(len, words)) + KEY_BYTES))
    for at in range(0, len(order), step):
        now = order[at : at + step]
        of = pa.array(own[now])
        arrays = [pa.array(part_of(hashes[now], parts).astype(np.int32)), pa.array(hashes[now].view(np.int64)), pa.array(place[now].astype(np.int32)), some.column("word").take(of), some.column("n").take(of)]
        yield pa.RecordBatch.from_arrays(arrays, schema=_KEYS_ARROW)


def _enter(parts: int):
    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            upto = np.cumsum([len(w) for w in words])
            edges = [0, *(np.flatnonzero(np.diff(upto // BATCH)) + 1).tolist(), len(words)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield from _keys(batch.slice(a, b - a), words[a:b], parts)

    return run


def _without(word: str, place: int) -> str:
    return word[: abs(place) - 1] + word[abs(place) :] if place else word


class _Best:
    """The most frequent words of a group, ties by code point, two at most."""

    def __init__(self):
        self.size, self.top = 0, []

    def add(self, n: int, word: str) -> None:
        self.size += 1
        self.top = sorted([*self.top, (-n, word)])[:2]

    def but(self, word: str) -> tuple[int, str] | None:
        return next(((-n, w) for n, w in self.top if w != word), None)


def neighbours(keys: list[tuple[int, str, int]]):
    """(word, near, form, n of form) for the words (place, word, n) that share a
    hash. Strings decide; words of one string and place are replacements of each
    other, those of place 0 are without a letter what the others are with it."""
    by: dict[str, list] = {}
    for place, word, n in keys:
        by.setdefault(_without(word, place), []).append((place, word, n))
    for own in by.values():
        if len(own) < 2:
            continue
        groups: dict[int, _Best] = {}
        longer = _Best()
        for place, word, n in own:
            if place:
                groups.setdefault(abs(place), _Best()).add(n, word)
            if place > 0:
                longer.add(n, word)
        whole = next(((n, word) for place, word, n in own if not place), None)
        if whole and longer.size:
            n, word = longer.but("")
            yield whole[1], longer.size, word, n
        for place, word, n in own:
            if place and (best := groups[abs(place)].but(word)):
                yield word, groups[abs(place)].size - 1, best[1], best[0]
            if place > 0 and whole:
                yield word, 1, whole[1], whole[0]


def _meet(batches):
    """All keys of a part -> what neighbours find, key by key."""
    tables = [batch for batch in batches if batch.num_rows]
    if not tables:
        return
    table = pa.Table.from_batches(tables)
    hashes = table.column("hash").to_numpy()
    order = np.argsort(hashes)
    ranked = hashes[order]
    again = ranked[1:] == ranked[:-1]
    twice = np.append(again, False) | np.append(False, again)
    table, ranked = table.take(pa.array(order[twice])), ranked[twice]
    place, word, n = (table.column(c).to_pylist() for c in ("place", "word", "n"))
    edges = [0, *(np.flatnonzero(np.diff(ranked)) + 1).tolist(), len(ranked)]
    out = []
    for a, b in zip(edges, edges[1:]):
        out += neighbours(list(zip(place[a:b], word[a:b], n[a:b])))
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _NEAR_ARROW)], schema=_NEAR_ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _NEAR_ARROW)], schema=_NEAR_ARROW)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: of every word (word, n) that has a near one,
    their number and the most frequent one."""
    size = words.agg(F.sum((F.length("word").cast("double") + 1) * (F.length("word") + KEY_BYTES))).first()[0] or 0
    parts = parts_for(words.sparkSession, size)
    keys = words.select("word", "n").mapInArrow(frugal(_enter(parts)), _KEYS).repartitionById(parts, F.col("part"))
    found = keys.mapInArrow(frugal(_meet), _NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word with a form (word, form): the last of its chain."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_cut(now)
        now = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            return now


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    words = cut(words.select("word", "n"), "words")
    strong = F.col("best_n") >= F.col("n") * ratio
    found = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n"))
    found = cut(found, "forms")
    out = found.join(roots(found.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, **how) -> DataFrame:
    """group_variants of the words of docs; how: as count_words takes it."""
    return group_variants(count_words(docs, **how))
