"""Scalar text functions of the code-graph model, as Spark columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Literals that point to dynamic dispatch.
DYNAMIC = ("getattr", "__dict__", "vars(", "locals(", "globals(", "importlib")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unit_id(file, name) -> Column:
    return F.concat_ws("::", col(file), col(name))


def signature(text) -> Column:
    """First line of a unit's text, or null."""
    return F.nullif(F.trim(F.substring_index(col(text), "\n", 1)), F.lit(""))


def unit_type(capture_name) -> Column:
    """Of a capture: null for imports, calls and bare names."""
    c = col(capture_name)
    none = c.contains("import") | c.contains("call") | (c == "name")
    is_class = c.contains("class") | c.contains("struct") | c.contains("interface") | c.contains("type")
    return F.when(none, None).when(c.contains("function") | c.contains("method"), "function").when(is_class, "class")


def callee_name(text) -> Column:
    return F.trim(F.substring_index(col(text), "(", 1))


def import_name(text) -> Column:
    """First token after the last `import`; null where there is none."""
    after = F.trim(F.substring_index(col(text), "import", -1))
    return F.when(col(text).contains("import") & (after != ""), F.split(after, r"\s+")[0])


def unit_hash(name, start, end) -> Column:
    return F.sha2(F.concat_ws(":", col(name), col(start).cast("string"), col(end).cast("string")), 256)


def embedding_text(name, sig, doc) -> Column:
    blank = F.lit("")
    return F.substring(F.trim(F.concat(col(name), F.lit(": "), F.coalesce(col(sig), blank), F.lit(" "), F.coalesce(col(doc), blank))), 1, 512)


def normal_signature(sig) -> Column:
    return F.trim(F.regexp_replace(col(sig), r"\s+", " "))


def tokens(text) -> Column:
    """Estimated tokens: none for empty text, else a fourth of the length, 1 at least."""
    n = F.length(col(text))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def model_tokens(path: str):
    """A column function: tokens of a text by a tokenizer file (Hugging Face
    JSON), null as none; the tokenizer is read once a worker, texts come in
    Arrow batches."""
    held: dict = {}

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if path not in held:
            from tokenizers import Tokenizer

            held[path] = Tokenizer.from_file(path)
        return pd.Series([len(held[path].encode(t, add_special_tokens=False).ids) if t else 0 for t in texts], dtype="int64")

    return lambda text: count(col(text))


def loc(start, end) -> Column:
    return F.greatest(F.lit(0), col(end) - col(start) + 1)


def tags_array(csv) -> Column:
    return F.filter(F.transform(F.split(col(csv), ","), lambda x: F.trim(x)), lambda x: x != "")


def has_dynamic(sig, doc) -> Column:
    text = F.concat(F.coalesce(col(sig), F.lit("")), F.lit(" "), F.coalesce(col(doc), F.lit("")))
    found = F.lit(False)
    for p in DYNAMIC:
        found = found | text.contains(p)
    return found


def summary(doc, sig, n: int = 200) -> Column:
    return F.substring(F.coalesce(F.nullif(col(doc), F.lit("")), col(sig), F.lit("")), 1, n)


def source_span(content, start, end) -> Column:
    """Lines start..end (from 1, both included) of a file's text."""
    lines = F.split(col(content), "\n")
    first = F.greatest(col(start).cast("int"), F.lit(1))
    n = F.greatest(F.least(col(end).cast("int"), F.size(lines)) - first + 1, F.lit(0))
    return F.array_join(F.slice(lines, first, n), "\n")


def is_test_name(file) -> Column:
    base = F.substring_index(col(file), "/", -1)
    return base.startswith("test_") | base.endswith("_test.py")


def in_tests(file) -> Column:
    return col(file).ilike("tests/%")


def xml_escape(text) -> Column:
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
