"""The registered queries' own columns against brute force, on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from callweave.llm import lm, packing, queries

SCHEMA = "doc_id long, text string, ids string, kept string, spans string"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(21)
    words = ["a", "The", "of", "weiß", "été", "end.", "#", "x1", "中文"] + [f"w{i}" for i in range(120)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(40)
    out = {i: text(r.randint(0, 150)) for i in range(25)}
    out |= {30 + i: f"{text(10)}\n{passage}\n{text(5)}" for i in range(6)}
    out |= {40: None, 41: "", 42: " \t\n", 43: out[3], 44: "ab " * 400, 45: out[7] + " more", 46: "line\nline\n" * 30}
    return out


@pytest.fixture(scope="module")
def sf(spark, texts, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "i", "k", "s") for i, t in texts.items()], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def covered(texts, symbols, width):
    """Per document: symbols, and which of them a smaller document's window covers."""
    first, out = {}, {}
    for i in sorted(texts):
        s = symbols(texts[i] or "")
        keys = [tuple(s[k : k + width]) for k in range(len(s) - width + 1)]
        gone = [False] * len(s)
        for k, key in enumerate(keys):
            if first.setdefault(key, i) < i:
                gone[k : k + width] = [True] * width
        out[i] = s, gone
    return out


def test_op1_pieces(spark, sf, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json"))
    ids = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in texts.items()}
    sequences, at = {}, dict.fromkeys(texts, 0)
    rows = queries.op1_packing(spark, sf).collect()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.start, r.doc_tokens, r.ids_crc32) == (at[r.doc_id], len(ids[r.doc_id]), zlib.crc32(own.tobytes()))
        at[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for s in sequences.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end == 2048 or end & (end - 1) == 0 and end < 2048


def test_op3_digests(spark, sf, texts):
    want = []
    for i, (s, gone) in covered(texts, lambda t: t.encode(), 50).items():
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(s), sum(gone), runs, digest(bytes(x for x, g in zip(s, gone) if not g))))
    assert sorted(map(tuple, queries.op3_suffix(spark, sf).collect())) == sorted(want)


def test_op10_digests(spark, sf, texts):
    want = [(i, len(s), sum(gone), digest(" ".join(x for x, g in zip(s, gone) if not g).encode())) for i, (s, gone) in covered(texts, lambda t: re.findall("[^\x20\x09-\x0d]+", t), 13).items()]
    assert sorted(map(tuple, queries.op10_blocks(spark, sf).collect())) == sorted(want)


def test_op4_digests(spark, sf, texts):
    from tokenizers import Tokenizer

    lib, want = Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json")), []
    for i, t in texts.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), digest(np.array(ids, dtype="<u4").tobytes()), digest(lib.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, queries.op4_bpe(spark, sf).collect())) == sorted(want)


def test_op8_and_op9_columns(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op8_quality(spark, sf).collect()}
    scored = {r.doc_id: r for r in queries.op9_lm(spark, sf).collect()}
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or "")), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    count = {}
    for i, own in tokens.items():
        for w in own if not held[i] else ():
            count[w] = count.get(w, 0) + 1
    n = sum(count.values())
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        base = sum(np.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (len(count) + 1))) for x in tokens[i])
        assert (scored[i].held_out, scored[i].n_tokens, scored[i].n_known, scored[i].train_tokens) == (held[i], len(tokens[i]), sum(x in count for x in tokens[i]), n)
        assert scored[i].base_score == pytest.approx(base, rel=1e-12)
    assert lm.ORDER == 3 and sum(r.score for r in scored.values()) > sum(r.base_score for r in scored.values())


def test_op2_and_op7_columns(spark, sf, texts, tmp_path):
    rows = {r.doc_id: r for r in queries.op2_jaccard(spark, sf).collect()}
    assert rows[43].class_id == 3 and rows[43].n_links >= 1 and rows[40].class_id == 40 and rows[40].n_links == 0
    x = np.random.default_rng(4).normal(size=(250, 6))
    spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op7_ann(spark, str(tmp_path))
    assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    assert {(r.query_id, r["count"]) for r in got.groupBy("query_id").count().collect()} == {(0, 10), (100, 10), (200, 10)}
