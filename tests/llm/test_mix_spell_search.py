"""Mixing, spelling variants and lexical search against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import lexical, mixing, spelling

LOWER = {i: i + 32 for i in range(65, 91)}


# ------------------------------------------------------------------- mixing


def wanted(size, weights=(5, 2, 1), limit=3):
    """Targets by resharing what is above a limit, as long as there is any."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, rest = {}, set(names), sum(size.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if limit * size[s] < level * weight[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: float(limit * size[s]) for s in over}
        rest -= sum(limit * size[s] for s in over)
        open_ -= over
    return out


@pytest.fixture(scope="module")
def mixed_docs(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * max(1, int(r.lognormvariate(4, 1)))), r.choice(["a", "b", "B", "é", "中", None]), "x") for i in range(1500)]
    rows += [(5000, "one two", "tiny", "x"), (5001, None, "a", None), (5002, "", "b", None), (5003, " \t\n", None, "x"), (5004, "w " * 30_000, "a", "x"), (None, "no id", "b", "x")]
    rows += [(6000 + i, "", "silent", "x") for i in range(3)] + [rows[3]] * 40 + [(7, "seven " * 9, "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rank string")


def test_targets_and_balance(mixed_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 100)  # many buckets, two rounds of them
    monkeypatch.setattr(mixing, "FAN", 4)
    rows = mixing.mix_sources(mixed_docs).collect()
    given = collections.Counter((r.doc_id, len(re.findall("[^\x20\x09-\x0d]+", r.text or "")), r.source) for r in mixed_docs.collect())
    assert collections.Counter((r.doc_id, r.size, r.source) for r in rows) == given
    size = collections.Counter()
    for (_, n, s), m in given.items():
        size[s] += n * m
    want, taken, copies = wanted(size), collections.Counter(), collections.defaultdict(list)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        copies[r.source].append(r.copies)
    assert taken["tiny"] == 6 and taken["silent"] == 0
    for s in size:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 2), s
        # Documents are in balance too but for a few of the landing; not in a, of
        # whose words one document has half, so that words and number can't both be kept.
        if size[s] and s != "a":
            assert abs(sum(copies[s]) - len(copies[s]) * want[s] / size[s]) <= 12, s
    again = mixing.mix_sources(mixed_docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert sorted(map(str, mixing.mix_sources(mixed_docs, seed=1).collect())) != sorted(map(str, rows))


def test_mix_of_little(spark, mixed_docs):
    none = mixed_docs.limit(0)
    assert mixing.mix_sources(none).count() == 0
    silent = mixing.mix_sources(mixed_docs.filter("source = 'silent'")).collect()
    assert [(r.size, r.target, r.taken) for r in silent] == [(0, 0.0, 0)] * 3
    one = mixing.mix_sources(mixed_docs.filter("source = 'tiny'"))
    assert [(r.target, r.taken) for r in one.collect()] == [(2.0, 2)]
    docs = mixed_docs.filter("doc_id < 50 and doc_id not in (3, 7)")
    mixed = mixing.mix_sources(docs)
    drawn = mixing.take(docs, mixed)
    assert drawn.columns == docs.columns
    assert drawn.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == mixed.agg(F.sum("taken")).first()[0]


def test_flight_keeps_words_and_number():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(0, 40)
        size = [r.choice([0, 1, 5, r.randint(1, 1000)]) for _ in range(n)]
        p = [r.random() for _ in range(n)]
        before = sum(p), sum(x * s for x, s in zip(p, size))
        left = mixing.fly(p, size, list(range(n)), r.random)
        assert len(left) <= 2 and all(x in (0.0, 1.0) for i, x in enumerate(p) if i not in left)
        assert sum(p) == pytest.approx(before[0], abs=1e-6) and sum(x * s for x, s in zip(p, size)) == pytest.approx(before[1], abs=1e-4)
        mixing.land(p, size, left, r.random)
        assert all(x in (0.0, 1.0) for x in p)


def test_probabilities_are_kept():
    r, hits = random.Random(5), np.zeros(40)
    size, off = [r.randint(1, 30) for _ in hits], []
    for _ in range(2000):
        p = [0.3] * 40
        mixing.land(p, size, mixing.fly(p, size, list(range(20)), r.random) + list(range(20, 40)), r.random)
        hits += p
        off.append(abs(sum(x * s for x, s in zip(p, size)) - 0.3 * sum(size)))
    # What is left is about a small document, never a large one.
    assert np.mean(off) < 2 and max(off) < 15
    # All but the smallest keep their probabilities: these go the way that is left.
    large = np.array(size) > 5
    assert np.abs(hits / 2000 - 0.3)[large].max() < 0.05 and np.abs(hits / 2000 - 0.3).max() < 0.2


def test_what_can_go_one_way_only():
    r = random.Random(6)
    for size, p, want in (([100, 30, 20, 10, 5, 5], 0.3, 51), ([50, 1], 0.9, 50), ([10, 9, 1], 0.5, 10), ([7], 0.4, 0)):
        p = [p] * len(size)
        mixing.land(p, size, list(range(len(size))), r.random)
        assert abs(sum(x * s for x, s in zip(p, size)) - want) <= 1


# ----------------------------------------------------------------- spelling


def variants(rows, letters=6, occurrences=5, ratio=5):
    count = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= letters and c >= occurrences}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in by.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}
    root = lambda w: root(form[w]) if w in form else w
    return {(w, form.get(w), root(w), n[w], len(by[w]), n[form[w]] if w in form else None) for w in n}


def test_spelling_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BATCH", 200)
    monkeypatch.setattr(spelling, "BYTES", 2000)
    r = random.Random(12)
    seeds = ["aaabbb", "aaaabb", "aaaaaa", "aaaaaaa", "gettings", "ÀÉÿabcd", "Straßen", "balloon", "baloon", "ballloon"] + ["".join(r.choice("abé") for _ in range(r.randint(6, 8))) for _ in range(60)]

    def word():
        w = list(r.choice(seeds))
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            i = r.randrange(len(w))
            w[i : i + 1] = r.choice([[], [r.choice("abéZ")], [w[i], w[i]], [r.choice("abé"), w[i]]]) if len(w) > 2 else [w[i]]
        return "".join(w)

    rows = [(i, r.choice([" ", "1", "\n", "中", "'"]).join(word() for _ in range(r.randint(0, 120)))) for i in range(150)]
    rows += [(None, "gettings Gettings gettingss " * 4), (900, None), (901, ""), (902, "short a 1 中"), (903, "z" * 400 + " "), *[(904 + k, "y" * 300) for k in range(6)], rows[0], rows[0]]
    rows += [(2000, "chainage " * 200), (2001, "chainagge " * 30), (2002, "chainaggge " * 5)]  # a chain of forms
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = [tuple(x) for x in spelling.spelling_variants(docs).collect()]
    want = variants(rows)
    assert len(got) == len(want) > 200 and set(got) == want
    assert any(f for _, f, *_ in want) and any(root not in (f, w) for w, f, root, *_ in want)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_keys_of_deletions():
    words = ["abcdef", "aabbcc", "zzzzzz", "éàbcdef", "q"]
    hashes, place, own = spelling.deletion_hashes(words)
    by = {}
    for h, p, w in zip(hashes.tolist(), place.tolist(), own.tolist()):
        by.setdefault(h, set()).add(spelling._without(words[w], p))
        assert (p < 0) == (p != 0 and abs(p) > 1 and words[w][abs(p) - 1] == words[w][abs(p) - 2])
    assert all(len(x) == 1 for x in by.values())
    assert len(by) == len({spelling._without(words[w], p) for p, w in zip(place.tolist(), own.tolist())})


def test_colliding_keys_are_told_apart():
    assert not list(spelling.neighbours([(1, "xabcdef", 9), (1, "yqqqqqq", 7)]))
    assert sorted(spelling.neighbours([(1, "xabc", 9), (1, "yabc", 7), (2, "kqqq", 5), (0, "abc", 3)])) == [("abc", 2, "xabc", 9), ("xabc", 1, "abc", 3), ("xabc", 1, "yabc", 7), ("yabc", 1, "abc", 3), ("yabc", 1, "xabc", 9)]


# ------------------------------------------------------------------- search


def ranked(rows, items, k=20):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    docs = [(i, collections.Counter(words(t)), len(words(t))) for i, t in rows if words(t)]
    n, total = len(docs), sum(x for *_, x in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, size in docs:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if score:
                found.append((-score, i is None, i if i is not None else 0))
        out += [(item, rank, None if no else i, -s) for rank, (s, no, i) in enumerate(sorted(found)[:k], 1)]
    return out


def test_search_against_all_scores(spark, rows, docs, none, monkeypatch):
    r = random.Random(2)
    text = [t for _, t, *_ in rows if t]
    items = [(i, " ".join(r.choice(text).split()[: r.randint(1, 40)])) for i in range(12)]
    items += [(20, None), (21, ""), (22, "nothing-of-this unheard"), (23, "THE the The of of of of of"), (24, "weiß ÉTÉ été"), (25, text[0]), (25, "x1"), (None, "end. re")]
    asked = spark.createDataFrame([(i, t, 1, "s") for i, t in items], "item_id long, text string, rank int, score string")
    want = sorted(ranked([(i, t) for i, t, *_ in rows], items), key=str)
    for size, piece, bytes_ in ((lexical.BLOCK, lexical.PIECE, lexical.QUERY_BYTES), (16, 50, 500)):
        monkeypatch.setattr(lexical, "PIECE", piece)
        monkeypatch.setattr(lexical.postings, "__defaults__", ("doc_id", "text", size))
        got = lexical.search(docs, asked, query_bytes=bytes_)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert lexical.search(none, asked).count() == 0 and lexical.search(docs, asked.limit(0)).count() == 0


def test_slices_add_and_select():
    r = np.random.default_rng(6)
    for n, k in ((1, 3), (64, 5), (300, 20), (1000, 20)):
        total, adder = np.zeros(n, dtype=np.int64), lexical.Adder(-(-n // 64))
        for shift in r.integers(0, 5, 30).tolist():
            doc = np.flatnonzero(r.random(n) < r.choice([0.02, 0.5, 1.0]))
            value = r.integers(0, r.choice([3, 1 << 34]), len(doc))
            total[doc] += value << shift
            adder.add(*lexical.slices(doc, value), shift)
        got, score = lexical.best(adder.total(), k)
        want = [i for i in np.lexsort((np.arange(n), -total)).tolist() if total[i] > 0][:k]
        assert got.tolist() == want and score.tolist() == total[want].tolist()
