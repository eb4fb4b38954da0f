import re

import numpy as np
import pytest

from callweave.llm import ann, chat
from pyspark.sql import functions as F


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string, block long")


def test_search_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1000:1400] = x[100]  # a hot group of one vector
    df = vectors(spark, [(i, v.tolist(), "l", 1) for i, v in enumerate(x)]).repartition(3)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, leaves=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    x = x.astype(float)
    for q in range(0, 3000, 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        best = np.lexsort((np.arange(3000), far))[:10]
        assert [r for r, _, _ in got[q]] == list(range(1, 11))
        assert all(s == far[v] for _, v, s in got[q])
        assert [(s, v) for _, v, s in got[q]] == sorted((s, v) for _, v, s in got[q])
        hit += len({v for _, v, _ in got[q]} & set(best.tolist()))
    assert hit / 300 >= 0.9
    assert [v for _, v, _ in got[100]] == list(range(1000, 1010))


def test_search_leaves_out_what_has_no_direction(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (200, [0.0, 0.0]), (7, [3.0, 0.0]), (7, [3.0, 0.0])]
    df = vectors(spark, [(i, v, None, None) for i, v in rows])
    got = [(r.query_id, r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 100, 2**0.5), (0, 7, 2.0), (0, 7, 2.0), (100, 0, 2**0.5), (100, 7, 10**0.5), (100, 7, 10**0.5)]
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def exact(x, ids, q, k=10):
    """The k nearest of row q by distances in long doubles, ties by id."""
    far = np.array([np.sqrt(((np.ldexp(v.astype(np.longdouble), -900) - np.ldexp(x[q].astype(np.longdouble), -900)) ** 2).sum()) for v in x])
    far[q] = np.inf
    return [ids[i] for i in sorted(range(len(x)), key=lambda i: (far[i], ids[i]))[:k]]


def test_search_bears_offsets_and_extremes(spark):
    rng = np.random.default_rng(8)
    cases = [rng.normal(size=(400, 16)) + 1e7, rng.normal(size=(400, 16)) * 1e160, rng.normal(size=(400, 16)) * 1e-170, rng.normal(size=(400, 16)) * 10.0 ** rng.integers(-100, 200, size=(400, 1)), rng.normal(size=(400, 16)) * 3e307]
    for x in cases:
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {}
        for r in ann.search(df, F.col("vec_id") % 100 == 0, recall=1.0, leaves=8).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r)
        assert {k: len(v) for k, v in got.items()} == dict.fromkeys(range(0, 400, 100), 10)
        hit = sum(len({r.vec_id for r in own} & set(exact(x, range(400), q))) for q, own in got.items())
        assert hit >= 36
        for own in got.values():
            assert all(np.isfinite(r.score) and r.score > 0 for r in own) and [r.score for r in own] == sorted(r.score for r in own)


def test_lanes_and_blocks_do_not_matter(spark):
    x = np.random.default_rng(6).normal(size=(700, 8)).round(1)
    df = vectors(spark, [(i, v.tolist(), "l", 1) for i, v in enumerate(x)])
    one = sorted(map(str, ann.search(df, F.col("vec_id") % 7 == 0, leaves=16).collect()))
    assert sorted(map(str, ann.search(df, F.col("vec_id") % 7 == 0, leaves=16, block_rows=10, lane=3).collect())) == one


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(1).normal(size=(600, 8))
    t = ann.Tree(x, leaves=32)
    for order in t.visits(x[:20]):
        assert sorted(order) == list(range(len(t.leaf_nodes)))
    assert t.calibrate(x, 10, 1.0) >= t.calibrate(x, 10, 0.8)


def test_search_finds_k_where_leaves_are_small(spark):
    x = np.random.default_rng(2).normal(size=(301, 8))
    df = vectors(spark, [(i, v.tolist(), "l", 1) for i, v in enumerate(x)])
    found = ann.search(df, F.col("vec_id") % 100 == 0, recall=0.01, leaves=64)  # one leaf, by calibration
    assert {r.query_id: r["count"] for r in found.groupBy("query_id").count().collect()} == dict.fromkeys((0, 100, 200, 300), 10)


CHAT = "conv_id long, turn long, role string, text string, parent string, message long"


def test_quotes_link_and_go(spark):
    rows = [
        (1, 0, "user", "What is  Spark?\nAnd Flink?"),
        (1, 1, "bot", "Spark is an engine."),
        (1, 2, "user", "On Monday bot wrote:\n> Spark is AN engine.\n>> What is Spark?\nThanks."),
        (1, 3, "user", "> and flink?\nI mean this"),
        (1, 4, "bot", "> nothing like this\nok"),
        (1, 5, "bot", ">> Thanks.\n> I mean this\nright"),
        (2, 0, "user", "> Spark is an engine.\nelsewhere"),
        (None, 3, "user", "> x\nlost"),
        (3, None, None, None),
        (4, 0, "user", None),
        (4, 0, "user", None),
    ]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], CHAT)
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(df).collect()}
    assert len(rows) == chat.format_chats(df).count()
    r = got[1, 2]
    assert (r.parent, r.root, r.depth, r.text) == (1, 1, 1, "Thanks.")
    assert [(q.level, q.turn) for q in r.quotes] == [(1, 1), (2, 0)]
    assert (got[1, 3].parent, got[1, 3].text) == (0, "I mean this")
    assert got[1, 4].parent is None and got[1, 4].text == "ok"
    assert (got[1, 5].parent, got[1, 5].root, got[1, 5].depth) == (3, 0, 2)
    order = sorted((r.position, t) for (c, t), r in got.items() if c == 1)
    assert order == [(0, 0), (1, 3), (2, 5), (3, 1), (4, 2), (5, 4)]
    assert got[2, 0].parent is None
    assert got[None, 3].position is None and got[None, 3].text == "lost" and got[3, None].text == ""
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_chains_and_hot_conversations(spark):
    rows = [(1, 0, "u", "line 0", "p", 1)] + [(1, k, "u", f"> line {k - 1}\nline {k}", "p", 1) for k in range(1, 60)]
    rows += [(2, k, "u", "the same first turn", "p", 1) for k in range(200)]
    got = chat.format_chats(spark.createDataFrame(rows, CHAT)).collect()
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert all(one[k].depth == k and one[k].root == 0 and one[k].position == k for k in range(60))
    assert sorted(r.position for r in got if r.conv_id == 2) == list(range(200))


def test_every_turn_that_holds_a_quote_is_weighed(spark, monkeypatch):
    sign = "Hi\nKind regards,\nA. N. Author of Somewhere"
    quote = "\n".join("> " + x for x in f"{sign}\nyes".split("\n"))
    rows = [(1, 0, sign), (1, 1, "no"), (1, 2, f"{sign}\nyes"), (1, 3, quote), (2, 0, "same"), (2, 1, "same"), (2, 2, "> same\nx")]
    rows += [(3, 0, "a text that\nis long enough"), (3, 1, "> a text\n> that is long\n> enough\nok")]
    words = ["Hi", "Bye", "Thanks", "aa", "bbb", "cccc"]
    rng = np.random.default_rng(5)
    for k in range(60):
        rows.append((4, k, "\n".join([*("> " + w for w in rng.choice(words, 2, replace=False)), *rng.choice(words, rng.integers(1, 4), replace=False)])))
    df = spark.createDataFrame([(c, t, "u", x, "p", 1) for c, t, x in rows], CHAT)
    expected = {(1, 3): 2, (2, 2): 1, (3, 1): 0}
    said = []
    for c, t, x in rows[-60:]:
        lines = x.lower().split("\n")
        want, own = [y[2:] for y in lines if y[0] == ">"], [y for y in lines if y[0] != ">"]
        whole = " ".join(want)
        weigh = [(sum(len(w) for w in want if w in o) + len(whole) * (" ".join(o) == whole), k) for k, o in enumerate(said)]
        expected[c, t] = max(weigh)[1] if weigh and max(weigh)[0] else None
        said.append(own)
    for common, piece in ((16, 4096), (0, 4), (1000, 4)):
        monkeypatch.setattr(chat, "COMMON", common)
        monkeypatch.setattr(chat, "SLICE", piece)
        got = {(r.conv_id, r.turn): r.parent for r in chat.format_chats(df).collect()}
        assert {k: got[k] for k in expected} == expected


def plain_chats(rows):
    """(conv_id, turn) -> parent, root, depth, quotes, text, position of rows
    with one message a turn, and the order of each conversation."""
    flat = lambda x: " ".join(x.split()).lower()
    parsed, out = {}, {}
    for c, t, text in rows:
        lines = [(len(re.match(r"((?: ?>)*)", x)[1].replace(" ", "")), re.sub(r"^((?: ?>)+) ?", "", x)) for x in text.split("\n")]
        own = [x for k, ((level, _), x) in enumerate(zip(lines, text.split("\n"))) if not level and not (re.search(r"\bwrote:\s*$", x) and k + 1 < len(lines) and lines[k + 1][0])]
        body = "\n".join(own).strip(" ")
        held = {flat(x) for level, x in lines if not level} | {flat(x) for x in re.split(r"\n\s*\n", body)} | {flat(body)}
        parsed[c, t] = lines, body, held - {""}
    for c, t, _ in rows:
        lines, body, _ = parsed[c, t]
        quotes = []
        for level in sorted({x for x, _ in lines} - {0}):
            said = [flat(x) for n, x in lines if n == level and flat(x)]
            pieces = {*said, " ".join(said)} - {""}
            weigh = [(sum(len(p) for p in pieces & held), u) for (d, u), (_, _, held) in parsed.items() if d == c and u < t]
            if weigh and max(weigh)[0]:
                quotes.append((level, max(weigh)[1]))
        out[c, t] = [quotes[0][1] if quotes else None, quotes, body]
    for (c, t), (parent, quotes, body) in list(out.items()):
        root, depth = t, 0
        while out[c, root][0] is not None:
            root, depth = out[c, root][0], depth + 1
        out[c, t] = parent, root, depth, quotes, body
    for c in {c for c, _ in out}:
        for place, (_, t) in enumerate(sorted((v[1], t) for (d, t), v in out.items() if d == c)):
            out[c, t] += (place,)
    return out


@pytest.mark.parametrize("common,piece,width", [(16, 4096, 4), (0, 3, 9), (2, 5, 2)])
def test_nested_quotes_against_plain_code(spark, monkeypatch, common, piece, width):
    rng, rows = np.random.default_rng(width), []
    for c in range(6):
        said = []
        for t in range(25 if c else 60):
            lines = []
            if said and rng.random() < 0.8:
                old = said[rng.integers(len(said))].split("\n")
                at = int(rng.integers(len(old)))
                if rng.random() < 0.3:
                    lines.append("Someone wrote:")
                mark = [">", "> ", " > "][rng.integers(3)]
                lines += [mark + x for x in old[at : at + int(rng.integers(1, 5))]]
            lines += [["Hi", "thanks,  A", f"point {rng.integers(40)}", "", "yes wrote: no", f"see {t} {c}"][rng.integers(6)] for _ in range(int(rng.integers(1, 4)))]
            said.append("\n".join(lines))
            rows.append((c, t, said[-1]))
    monkeypatch.setattr(chat, "COMMON", common)
    monkeypatch.setattr(chat, "SLICE", piece)
    monkeypatch.setattr(chat, "shuffle_width", lambda s: width)
    df = spark.createDataFrame([(c, t, "u", x, "p", 1) for c, t, x in rows], CHAT).repartition(5)
    got = {(r.conv_id, r.turn): (r.parent, r.root, r.depth, [(q.level, q.turn) for q in r.quotes], r.text, r.position) for r in chat.format_chats(df).collect()}
    want = plain_chats(rows)
    assert max(v[2] for v in want.values()) > 3 and max(len(v[3]) for v in want.values()) > 1
    assert got == want


def test_more_leaves_are_left_out_as_rows_grow(spark):
    """On clustered rows a small share of the leaves is visited, with recall."""
    r = np.random.default_rng(17)
    share = []
    for n in (2000, 16_000):
        x = r.normal(size=(40, 24))[r.integers(0, 40, n)] * 3 + r.normal(size=(n, 24))
        tree = ann.Tree(x, n // ann.LEAF_ROWS)
        assert len(tree.leaf_nodes) > 0.8 * (n // ann.LEAF_ROWS)
        share.append(tree.calibrate(x, 10, ann.RECALL) / len(tree.leaf_nodes))
    assert share[1] < share[0] < 0.6 and share[1] < 0.2
    x = x[:6000]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for t in ann.search(rows, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(t.query_id, set()).add(t.vec_id)
    hits = 0
    for i, own in got.items():
        far = ((x - x[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        hits += len(own & set(np.argsort(far)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(got) and len(got) == 60


def test_leaves_are_shared_out_in_proportion():
    assert ann.shared_out(15, [10, 10, 10, 10, 10, 10, 10, 10]) and sum(ann.shared_out(15, [10] * 8)) == 15
    assert ann.shared_out(3, [5, 5, 5, 5]) == [1, 1, 1, 1] and sum(ann.shared_out(100, [97, 1, 2])) == 100


def test_a_message_is_one_of_its_conversation(spark, monkeypatch):
    """Equal hashes in two conversations: no quotes of the other one."""
    rows = [(1, 0, "u", "The first long line of this."), (1, 1, "v", "> The first long line of this.\nyes"), (2, 0, "u", "Something else is said here."), (2, 1, "v", "> Something else is said here.\nno")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parse = chat.parse
    monkeypatch.setattr(chat, "parse", lambda *a, **k: parse(*a, **k).withColumn("message", F.col("turn") * 0 + 7))
    got = {(r.conv_id, r.turn): r for r in chat.links(chat.parse(messages)).select("conv_id", F.lit(1).alias("turn"), "quotes").collect()}
    assert {k: [q.turn for q in r.quotes] for k, r in got.items()} == {(1, 1): [0], (2, 1): [0]}


def test_op5_query(spark, tmp_path):
    from callweave.llm import queries

    rows = [(1, 0, "u", "Where is the library now?\n\nThanks"), (1, 1, "v", "> Where is the library now?\nIn the old town."), (1, 2, "u", "> > Where is the library now?\n> In the old town.\nGood."), (1, 3, "w", "> Where is the library now?\nI know it too."), (None, 0, "u", "alone"), (2, None, "u", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r for r in queries.op5_chat(spark, str(tmp_path)).collect()}
    assert len(got) == 6
    assert [got[1, t].parent for t in range(4)] == [None, 0, 1, 0] and [got[1, t].depth for t in range(4)] == [0, 1, 2, 1]
    assert {got[1, t].root for t in range(4)} == {0} and sorted(got[1, t].position for t in range(4)) == [0, 1, 2, 3]
    assert got[1, 2].text == "Good." and got[1, 2].n_quotes == 2 and got[1, 0].n_quotes == 0
    assert got[None, 0].position is None and got[2, None].text in ("", None)
