import random

import pytest

SCHEMA = "doc_id long, text string, lang string, n_words long, node string, row_key long, spans string"


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, copies, near copies, shared
    passages, repeated rows and ids; further columns with clashing names."""
    r = random.Random(4)
    words = ["a", "the", "of", "tion", "weiß", "été", "Ing", "x1", "end.", "re", "zu", "and", "with", "from"] + [f"w{i}" for i in range(300)]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    texts = [text(r.randint(1, 160)) for _ in range(30)]
    passage = text(60)
    out = [(i, t, "en", 1, "n", 2, "s") for i, t in enumerate(texts)]
    out += [(100 + i, texts[i], None, None, None, None, None) for i in range(0, 20, 3)]  # copies
    out += [(200 + i, texts[i] + " more", "en", 1, "n", 2, "s") for i in range(0, 30, 2)]  # near copies
    out += [(300 + i, f"{text(20)}\n{passage} {text(15)}", "de", 1, "n", 2, "s") for i in range(8)]
    out += [(400, "", "en", 1, "n", 2, "s"), (401, None, "en", 1, "n", 2, "s"), (402, " \n\t ", "en", 1, "n", 2, "s"), (403, "one two", "en", 1, "n", 2, "s"), (404, "one two", "en", 1, "n", 2, "s")]
    out += [(405, text(9000), "en", 1, "n", 2, "s"), (None, texts[1], "en", 1, "n", 2, "s"), (None, passage, "en", 1, "n", 2, "s")]
    out += [out[3], out[3], (5, text(90), "en", 1, "n", 2, "s"), (406, "a" * 300, "en", 1, "n", 2, "s"), (407, "b" + "a" * 299, "en", 1, "n", 2, "s")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sort_key(row):
    return tuple((v is None, str(v)) for v in row)
