"""The document operators against brute force on a small fixture."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from callweave.llm import blocks, bpe, jaccard, license, lm, packing, quality, queries, suffix

BIG = (1 << 63) - 1


def same(df, expected):
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == sorted(expected, key=str)


def test_quality_base_columns(docs, rows, none):
    expected = []
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(win)
        rep = {j for k, x in enumerate(win) if n[x] > 1 for j in range(k, k + 3)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        dup = sum(x in lines[:k] for k, x in enumerate(lines))
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), failed))
    got = quality.judge(docs)
    same(got.drop("kept"), expected)
    assert not [r for r in got.collect() if r.base_failed and r.kept]
    assert quality.judge(none).count() == 0


def test_quality_verdicts_against_plain_rules(docs, rows):
    def keeps(t):
        w = re.findall("[^\x20\x09-\x0d]+", t)
        win = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {j for k in range(len(w) - 2) if win[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        upper, lower = sum(c.isupper() for c in t), sum(c.islower() for c in t)
        long = sum(map(len, w))
        return not (len(w) < 50 or 2 * len(rep) > len(w) or 10 * len(re.findall(r"[#*$%&|<>]", t)) > len(w) or 2 * (len(lines) - len(set(lines))) > len(lines) or upper > lower or not 2 * len(w) <= long <= 15 * len(w))

    want = {(i, t or ""): keeps(t or "") for i, t, *_ in rows}
    ids = collections.Counter(i for i, _ in want)
    got = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert all(got[i] == k for (i, _), k in want.items() if ids[i] == 1)
    assert {r.doc_id for r in quality.filter_documents(docs).collect()} == {i for (i, _), k in want.items() if k}
    r = random.Random(1)
    for _ in range(200):
        t = " ".join(r.choice(["aa", "BBB", "c", "#", "x" * 40, "w\n", "The", str(r.random())]) for _ in range(r.randint(40, 90)))
        assert (quality.rejected_by(quality.Features(t), quality.RULES) is None) == keeps(t)


def test_quality_cascade_is_by_rejection_per_cost(docs):
    now, log = [0.0], []

    def rule(name, cost, rejects):
        def run(f):
            log.append(name)
            if f._once(name, lambda: now.__setitem__(0, now[0] + cost) or True):
                return rejects(f)

        return quality.Rule(name, run)

    rules = (rule("dear", 5.0, lambda f: f.text != "d"), rule("same", 1.1, lambda f: f.text in "ab"), rule("cheap", 1.0, lambda f: f.text in "ab"), rule("rare", 1.0, lambda f: f.text == "c"))
    got = quality.greedy(list("abcd"), rules, lambda: now[0])
    # After "cheap" the rule "same" rejects nothing that is left.
    assert [m.name for m in got] == ["cheap", "rare", "dear", "same"] and [m.rejected for m in got] == [0.5, 0.5, 0.0, 0.0]
    order = quality.ordered(rules, got)
    log.clear()
    assert quality.rejected_by(quality.Features("a"), order) == "cheap" and log == ["cheap"]
    for o in (quality.RULES, quality.RULES[::-1]):
        assert quality.rejected_by(quality.Features("word | " * 80), o)
    assert [m.name for m in quality.measure(docs)] != [] and quality.filter_documents(docs).columns == docs.columns


def test_license_phrases_and_statistics(spark, none):
    texts = ["Released under the MIT License.", "x CC-BY-NC y cc by\nnc 4.0 cc by", "Apache License, Version 2.0", "under the the mit license", None, "", "This work is licensed under the GNU General Public License, version 3.", "PERMISSION IS HEREBY GRANTED, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license.scan_licenses(df).collect()}
    assert [p.first for p in got[0].places] == [1] and [p.label for p in got[1].places] == ["cc-by-nc"] * 2
    assert [p.first for p in got[1].places] == [1, 5] and [p.label for p in got[2].places] == ["apache-2"]
    assert not got[3].places and not got[4].places and got[5].n_words == 0
    assert {s.label for s in got[6].spans} == {"gpl-3"} and {s.label for s in got[7].spans} == {"mit"}
    assert license.scan_licenses(none).count() == 0
    r, seqs = random.Random(2), [list("abcab"), list("bcaab"), list("cc")]
    sam = license.SuffixAutomaton(seqs)
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(200):
        w = [r.choice("abcd") for _ in range(r.randint(0, 12))]
        for end, state, size in sam.statistics(w):
            assert tuple(w[end - size : end]) in subs
            assert end == len(w) or tuple(w[end - size : end + 1]) not in subs
            assert size == end or tuple(w[end - size - 1 : end]) not in subs
            for k, e in sam.at[state]:
                assert seqs[k][e - size : e] == w[end - size : end]


def test_license_chains_as_by_halving():
    """All chains: the best one, then those left of it and right of it."""

    def halved(runs, size, least):
        todo, out = [runs], []
        while todo:
            own = todo.pop()
            chain, words = license.best_chain(own, size)
            if words < least:
                continue
            first, end = chain[0][0], max(f + n for f, _, n in chain)
            out.append((chain, words))
            todo += [x for x in ([r for r in own if r[0] + r[2] <= first], [r for r in own if r[0] >= end]) if x]
        return sorted(out)

    r = random.Random(9)
    for _ in range(600):
        size = r.randint(3, 12)
        runs = set()
        for _ in range(r.randint(1, 40)):
            n, t = r.randint(1, size), 0
            t = r.randint(0, size - n)
            runs.add((r.randint(0, 90), t, n))
        runs, least = sorted(runs), r.uniform(0.3, 1) * size
        assert sorted(license.best_chains(runs, size, least)) == halved(runs, size, least)


def test_license_overlaps_are_those_of_all_pairs():
    r = random.Random(10)
    for _ in range(200):
        spans = [(a, a + r.randint(1, 200), "x", 1.0, r.randint(1, 40)) for a in (r.randint(0, 400) for _ in range(25))]
        kept = []
        for s in sorted(spans, key=lambda s: (-s[4], -s[3])):
            if all(2 * (min(s[1], x[1]) - max(s[0], x[0])) < s[1] - s[0] for x in kept):
                kept.append(s)
        assert license.longest_of_overlaps(spans) == [s[:4] for s in kept]


def test_license_scan_is_linear():
    import time

    scanner, took = license.Scanner(), []
    for times in (2000, 8000):
        began = time.perf_counter()
        found = scanner.scan("licensed under the mit license " * times)
        took.append(time.perf_counter() - began)
        assert len(found.spans) == len(found.places) == times
    assert took[1] < 10 * took[0]


def test_license_chains_are_the_best():
    r = random.Random(7)
    for _ in range(300):
        size, runs = 12, sorted({(r.randint(0, 20), r.randint(0, 9), r.randint(1, 3)) for _ in range(r.randint(1, 7))})

        def words(chain):
            total = 0
            for k, (f, t, n) in enumerate(chain):
                if k:
                    g, u, m = chain[k - 1]
                    n -= max(0, g + m - f, u + m - t)
                    if n <= 0 or t <= u or f - g - m > size:
                        return 0
                total += n
            return total

        chain, best = license.best_chain(runs, size)
        every = ([runs[i] for i in range(len(runs)) if mask >> i & 1] for mask in range(1, 1 << len(runs)))
        assert best == words(chain) == max(map(words, every))


def test_license_versions_and_names():
    scan = license.Scanner().scan
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, {}version {} of the License, or (at your option) any later version."
    for name, version, label in (("", "3", "gpl-3"), ("", "2", "gpl-2"), ("Lesser ", "3", "lgpl-3"), ("Lesser ", "2.1", "lgpl-2.1"), ("Affero ", "3", "agpl-3")):
        for either in ("either ", ""):
            assert {s[2] for s in scan(notice.format(name, either, version)).spans} == {label}, (name, either, version)
    for text, label in (
        ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\nCopyright", "gpl-3"),
        ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "gpl-2"),
        ("This work is under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
        ("a Creative Commons Attribution 4.0 International License", "cc-by"),
        ("Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:", "bsd"),
    ):
        assert {s[2] for s in scan(text).spans} == {label}, text
    assert not scan("the general public license of the version we published, and the terms of the software").spans
    twice = scan("x " * 9 + notice.format("", "either ", "3") + " y" * 40 + notice.format("", "either ", "3"))
    assert [s[2] for s in twice.spans] == ["gpl-3"] * 2 and twice.spans[0][1] <= twice.spans[1][0]


def test_license_query_against_a_plain_search(spark, tmp_path):
    r = random.Random(11)
    words = ["under", "the", "mit", "license", "MIT", "apache", "version", "2", "cc", "by", "nc", "x", "-", "é", "Cc-By-Nc"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, "", "UNDER THE MIT\u00a0LICENSE", "under the mit license " * 2000]
    spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, places string").write.parquet(f"{tmp_path}/documents.parquet")
    phrases = [(p.split(), label) for p, label in license.PHRASES]
    want = []
    for i, t in enumerate(texts):
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        starts = [k for k, _ in at]
        want.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    got = queries.op6_license(spark, str(tmp_path))
    same(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), want)
    for row in got.collect():
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1


@pytest.fixture(scope="module")
def word_bpe():
    return packing.vocabulary("word_bpe_49k.json")


ODD = [" ", "  ", "\n", "\t", "a", "the", "ing", "É", "é", "Σ", "ς", "İ", "ß", "1", "½", "!", "'s", "'", "’", "<|endoftext|>", "<|startoftext|>", "<|", "\x1c", "\x85", "\xa0", "　", "中文", "한", "😀", "́", "\x00", "\r\n", "_", "x" * 60]


def odd_texts(n=1500):
    r = random.Random(9)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_bpe_is_the_librarys(word_bpe, rows):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(word_bpe), bpe.WordEncoder(word_bpe)
    for t in odd_texts() + [x[1] or "" for x in rows]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids, t
        assert own.decode(own.encode(t)) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_streams_with_bounded_memory(word_bpe):
    m = bpe.MergeList(word_bpe)
    letters = bpe.byte_letters()
    r = random.Random(3)
    for k in range(20):
        word = "".join(r.choice("abeginrstth") for _ in range(3000)) if k % 2 else "thing" * 500
        symbols = [letters[b] for b in word.encode()]
        small, out = bpe.Transducer(m, m.lookahead + 40), []
        for s in symbols:
            out += small.feed([s])
            assert len(small.held) <= m.lookahead + 40
        whole = m.merge([*symbols[:-1], symbols[-1] + m.suffix])
        assert out + small.finish() == [m.vocab[t] for t in whole]


def test_bpe_streams_texts_in_any_pieces(word_bpe):
    own, r = bpe.WordEncoder(word_bpe), random.Random(12)
    long = ["", "a", "Ab", "中", "é", "e\u0301", "한", "\u1112\u1161\u11ab", "!", "'", "'s", "1", "😀", "<|endoftext|>", "Σ", "\u3000", "x" * 40, "=-", "\x85"]
    texts = odd_texts(200) + ["".join(r.choice(long) for _ in range(r.randint(100, 900))) for _ in range(60)] + ["a" * 3000, "中" * 3000, "e\u0301" * 900, "ab'" * 1000, "-" * 3000 + "'s" * 700, "<" * 500 + "|" * 300]
    for t in texts:
        pieces, at = [], 0
        while at < len(t):
            n = r.choice([1, 3, 50, 400])
            pieces.append(t[at : at + n])
            at += n
        assert b"".join(own.stream(pieces, hold=64)) == own.encode(t), t
    stream, most = bpe.TextStream(own, 256), 0
    for _ in range(400):
        stream.feed("abcdefghij" * 100)
        most = max(most, len(stream.tail) + len(stream.open[0].held))
    assert most < 256 + 2000 + 1000


def test_byte_decoder_waits_for_whole_characters():
    path = packing.vocabulary("byte_bpe_50k.json")
    m = bpe.MergeList(path)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    for t in ["héllo 中文 😀", "", "plain"]:
        d = bpe.Decoder(m)
        assert "".join(d.feed([i]) for i in lib.encode(t).ids) + d.finish() == t


def test_bpe_documents(spark, docs, rows, none, word_bpe, monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(word_bpe)
    long = [(900, "word, " * 30_000), (901, "中" * 70_000), (902, None)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(long, "doc_id long, text string"))
    want = []
    for i, t, *_ in [*rows, *long]:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, bytearray(np.array(ids, dtype="<u4").tobytes()), lib.decode(ids, skip_special_tokens=False)))
    same(bpe.encode_documents(table, word_bpe), want)
    assert bpe.encode_documents(none, word_bpe).count() == 0


def test_byte_encoder_is_the_librarys():
    from tokenizers import Tokenizer

    path = packing.vocabulary("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), packing.ByteLevelEncoder(path)
    for t in odd_texts():
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_packing_holds_every_id_once(docs, rows, none):
    path = packing.vocabulary("byte_bpe_50k.json")
    pieces = packing.pack(docs, path, size=64, window=8).collect()
    own = packing.encoder(path)
    seqs, by = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append((p.offset, p.length))
        by[p.doc_id, p.doc_tokens].append((p.start, p.length, bytes(p.ids)))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0 and at < 64
    want = collections.Counter()
    for i, t, *_ in rows:
        want[i] += len(own.encode(t or "")) // 4 + 1
    got = collections.Counter()
    for (i, _), ps in by.items():
        got[i] += sum(n for _, n, _ in ps)
        assert all(len(x) == 4 * n for _, n, x in ps)
    assert got == want
    assert packing.pack(none, path).count() == 0


def test_packing_prefers_cheap_sequences():
    p = packing.Packer(size=10, window=2)
    out = [x for k, n in enumerate([6, 5, 4, 5]) for x in p.add(k, n)] + list(p.finish())
    assert sorted((x[0], x[3], x[4]) for x in out) == [(0, 0, 0), (1, 1, 0), (2, 0, 6), (3, 1, 5)]


def gram_sets(rows):
    out = []
    for _, t, *_ in rows:
        w = (t or "").encode().split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    return out


def brute_classes(rows):
    """doc_id, class_id, n_links of every row, and the rows' roots."""
    sets = gram_sets(rows)
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(n):
        for b in range(a + 1, n):
            if sets[a] and sets[b] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, x in enumerate(rows):
        if x[0] is not None:
            least[find(k)] = min(least.get(find(k), BIG), x[0])
    return [(x[0], least.get(find(k)), links[k]) for k, x in enumerate(rows)], {find(k) for k, s in enumerate(sets) if s}, sets


@pytest.mark.parametrize("block,few", [(512, 1000), (4, 0), (4, 1000)])
def test_jaccard_links_and_classes(docs, rows, none, block, few, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    expected, roots, sets = brute_classes(rows)
    same(jaccard.join(docs, few=few).select("doc_id", "class_id", "n_links"), expected)
    if block == 512:
        kept = jaccard.keep_first(docs)
        assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.collect()]
        assert len(ids) == len(roots) + len({(x[0], x[1] or "") for k, x in enumerate(rows) if not sets[k]})
        assert jaccard.join(none).count() == 0 and jaccard.keep_first(none).count() == 0


@pytest.mark.parametrize("block", [8, 3])
def test_jaccard_verifies_loose_components_by_bucket(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    chain = [(i, " ".join(f"w{k}" for k in range(8 * i, 8 * i + 100))) for i in range(70)]
    rows = chain + [(100 + i, t) for i, t in chain[::9]]
    seen, cells = [], jaccard.cells

    def seen_cells(*a):
        out = cells(*a)
        seen.extend(r.band for r in out.collect())
        return out

    monkeypatch.setattr(jaccard, "cells", seen_cells)
    same(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links"), brute_classes(rows)[0])
    assert seen and min(seen) >= 0


def test_components_of_many_edges(spark):
    from callweave.llm import groups

    name = lambda k: k.to_bytes(16, "big")
    pairs = [(k, k + 1) for k in range(120) if k % 30] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "a binary, b binary")
    by_way = [{(int.from_bytes(r.node, "big"), int.from_bytes(r.root, "big")) for r in groups.components(edges, few).collect()} for few in (0, 10_000)]
    assert by_way[0] == by_way[1] == {(k, max(1, (k - 1) // 30 * 30 + 1)) for k in range(1, 121)} | {(k, 500) for k in range(500, 560)}


@pytest.mark.parametrize("size", [10, 60])
def test_jaccard_counts_a_link_once_where_a_block_is_empty(spark, size, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", size)
    pairs = [[" ".join(f"{p}w{i}" for i in range(100)) + end for end in ("", " more")] for p in "abcdef"]
    df = spark.createDataFrame([(10 * k + j, t) for k, pair in enumerate(pairs) for j, t in enumerate(pair)], "doc_id long, text string")
    same(jaccard.join(df).select("doc_id", "class_id", "n_links"), [(10 * k + j, 10 * k, 1) for k in range(len(pairs)) for j in range(2)])


def test_bands_follow_from_recall():
    b = jaccard.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**4) ** b >= 0.999 > 1 - (1 - 0.8**4) ** (b - 1)


def brute(rows, symbols, width):
    """Which symbols a smaller document's window covers."""
    first = {}
    for i, t, *_ in rows:
        s = symbols(t or "")
        for k in range(len(s) - width + 1):
            key = s[k : k + width] if isinstance(s, bytes) else tuple(s[k : k + width])
            first[key] = min(first.get(key, BIG), BIG if i is None else i)
    for i, t, *_ in rows:
        s = symbols(t or "")
        gone = [False] * len(s)
        for k in range(len(s) - width + 1):
            key = s[k : k + width] if isinstance(s, bytes) else tuple(s[k : k + width])
            if first[key] < (BIG if i is None else i):
                gone[k : k + width] = [True] * width
        yield i, s, gone


def test_substrings(docs, rows, none):
    expected = []
    for i, s, gone in brute(rows, str.encode, 50):
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        expected.append((i, len(s), sum(gone), runs, bytearray(x for x, g in zip(s, gone) if not g)))
    got = suffix.dedup(docs)
    same(got.selectExpr("doc_id", "n_bytes", "n_removed", "size(spans)", "kept"), expected)
    assert suffix.dedup(none).count() == 0
    left = suffix.remove_repeats(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert suffix.remove_repeats(none).count() == 0


def test_suffix_sort():
    r = random.Random(5)
    for k in range(150):
        d = bytes(r.choice(b"ab" if k % 2 else b"abc ") for _ in range(r.randint(0, 80)))
        assert suffix.suffix_array(d).tolist() == sorted(range(len(d)), key=lambda i: d[i:])


def test_suffix_sort_survives_lying_hashes(monkeypatch):
    d = b"abcdefghijklmnop" * 3 + b"abcdefghijklmnoq" * 2
    monkeypatch.setattr(suffix.Suffixes, "_equal", lambda self, a, b, n: np.ones(len(a), dtype=bool))
    s = suffix.Suffixes(np.frombuffer(d, np.uint8), 16)
    start = np.array([0, 16, 32, 48, 64])
    order, equal = s.sort(start, start + 16, np.zeros(5, dtype=np.int64))
    assert sorted(order[:3].tolist()) == [0, 1, 2] and equal.tolist() == [False, True, True, False, True]


@pytest.mark.parametrize("settings", [{"chunk": 40}, {"flush_bytes": 2000, "often": 1}, {"flush_bytes": 5000, "hot": 3}, {"hot": 0}])
def test_sizes_do_not_matter_to_substrings(docs, settings):
    assert sorted(map(str, suffix.dedup(docs, **settings).collect())) == sorted(map(str, suffix.dedup(docs).collect()))


def test_removed_text_is_what_dedup_keeps(spark, docs):
    left = {(r.doc_id, r.text) for r in suffix.remove_repeats(docs).collect() if r.text}
    kept = {(r.doc_id, bytes(r.kept).decode("utf-8", "ignore")) for r in suffix.dedup(docs).collect()}
    assert left == {x for x in kept if x[1]}
    own = docs.withColumnRenamed("lang", "__row").withColumnRenamed("spans", "__spans")
    assert suffix.remove_repeats(own).columns == own.columns
    assert {r["__row"] for r in suffix.remove_repeats(own).collect()} == {r["__row"] for r in own.collect()}
    assert {r["__row"] for r in jaccard.keep_first(own).collect()} <= {r["__row"] for r in own.collect()}


def test_blocks(docs, rows, none):
    expected = [(i, len(s), sum(gone), b" ".join(x for x, g in zip(s, gone) if not g).decode()) for i, s, gone in brute(rows, lambda t: t.encode().split(), 13)]
    same(blocks.dedup(docs).select("doc_id", "n_words", "n_removed", "kept"), expected)
    assert blocks.dedup(none).count() == 0


@pytest.mark.parametrize("settings", [{"often": 1}, {"flush_size": 50}])
def test_sizes_do_not_matter_to_blocks(docs, settings):
    assert sorted(map(str, blocks.dedup(docs, **settings).collect())) == sorted(map(str, blocks.dedup(docs).collect()))


@pytest.mark.parametrize("order,frequent", [(2, 1000), (3, 1000), (3, 1), (4, 3)])
def test_language_model(docs, rows, none, order, frequent):
    begin, end = 1, 0
    count, levels, texts = collections.Counter(), {order: collections.Counter()}, []
    for i, t, *_ in rows:
        w = [*(t or "").encode().lower().split(), end]
        held = zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
        padded = [begin] * (order - 1) + w
        texts.append((i, w, held, [tuple(padded[k : k + order]) for k in range(len(w))]))
        if not held:
            count.update(w)
            levels[order].update(texts[-1][3])
    n, v = sum(count.values()), len(count)
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])

    def discounts(values):
        return (0, *lm._discounts(*(sum(x == k for x in values) for k in (1, 2, 3, 4))))

    d = {k: discounts(levels[k].values()) for k in levels}
    total, rest = collections.Counter(), collections.Counter()
    for k in range(2, order + 1):
        for g, c in levels[k].items():
            total[g[:-1]] += c
            rest[g[:-1]] += d[k][min(c, 3)]
    mass = sum(d[1][min(c, 3)] for c in levels[1].values())
    got = sorted((tuple(r) for r in lm.train_and_score(docs, order, frequent=frequent, flush=300).collect()), key=lambda r: str((r[0], r[2], round(r[5], 6))))
    want = []
    for i, w, held, own in texts:
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = 0.0
        for g in own:
            e = levels[1][g[-1:]]
            p = (e - d[1][min(e, 3)] + mass / (v + 1)) / len(levels[2])
            for k in range(2, order + 1):
                h = g[-k:]
                if total[h[:-1]]:
                    c = levels[k][h]
                    p = (max(c - d[k][min(c, 3)], 0) + rest[h[:-1]] * p) / total[h[:-1]]
            score += math.log10(p)
        want.append((i, held, len(w), sum(count[x] > 0 for x in w), n, base, score))
    want.sort(key=lambda r: str((r[0], r[2], round(r[5], 6))))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_language_model_of_nothing(spark, none):
    assert lm.train_and_score(none).count() == 0
    row = lm.train_and_score(spark.createDataFrame([(None, "x y", "x")], "doc_id long, text string, part string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)


def test_language_model_sums_to_one(docs):
    from callweave.llm.common import keyed

    own = keyed(docs)
    s = lm.Scorer(lm.train(own))
    words = np.unique(np.concatenate([lm.tokens(r.text) for r in own.collect() if not lm.held_out(r.doc_id)]))
    unknown = np.array([12345], dtype=np.uint64)
    for before in ([], [words[5]], [words[5], words[9]], [unknown[0], words[3]], list(lm.tokens(own.collect()[0].text)[:2])):
        known = s.score([np.array(before, dtype=np.uint64)])[2][0] if before else 0.0
        total = sum(10 ** (s.score([np.array([*before, w], dtype=np.uint64)])[2][0] - known) for w in [*words, *unknown])
        assert abs(total - 1) < 1e-9


def test_large_counts_are_kept(spark):
    df = spark.createDataFrame([(1, "x y " * 400)], "doc_id long, text string")
    row = lm.train_and_score(df).first()
    assert row.n_known == 801 and row.score > -30


def test_a_link_is_the_same_in_small_and_large_components():
    """Similar sets without a bucket in common are no link, whatever the cell."""
    import pyarrow as pa

    sets = [np.arange(20, dtype=np.uint64), np.arange(1, 21, dtype=np.uint64), np.arange(20, dtype=np.uint64) + np.uint64(900)]
    for shared in (False, True):
        bands = [[1, 2, 3], [7, 2, 9] if shared else [7, 8, 9], [1, 2, 3]]
        for band, blocks in ((-1, 1), (-1, 2), (1, 2)):
            t = pa.table({"cell": [b"c"] * 3, "low": [0] * 3, "high": [0] * 3, "node": [b"a", b"b", b"c"], "copies": [1, 5, 1], "band": [band] * 3, "blocks": [blocks] * 3, "bands": bands, "set": [s.tobytes() for s in sets], "block": [0] * 3})
            got = jaccard._verifier(0.8)(t).to_pydict()
            assert got["links"][:3] == ([5, 1, 0] if shared or band > 0 else [0, 0, 0]), (shared, band)


def test_costs_are_those_after_the_base_rules(docs, monkeypatch):
    f, failed = quality.judged("one two three " * 30)
    assert failed and {"words", "chars", "symbols", "dups", "repeats"} <= set(f._got)
    got = quality.measure(docs, quality.METHOD_RULES, after_base=True)
    assert {m.name for m in got} == {r.name for r in quality.METHOD_RULES}
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 1)
    assert len(quality.measure(docs)) == len(quality.RULES)
