"""Quality rules as a short-circuit cascade.

Each rule is a cheap test on a text's features. On a bounded sample, spread over
the whole table, the cascade measures what a rule costs and how often it rejects,
and takes the rules by rejection per cost: the best one first, then the best one
on what the first leaves, with the features that it has computed at no cost, and
so on. A text is given up at the first rule that rejects it, and no later feature
is computed. The verdict doesn't depend on the order, only the work does.

Null text counts as empty, and empty texts fail the length rule. Texts are
judged whole, however long; repeated rows get the same verdict each; an empty
table gives an empty result. Only the id and text columns are read, so other
columns can have any names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keyed, map_texts

SYMBOLS = "#*$%&|<>"
#: Rows on which costs and selectivities are measured (a documented bound;
#: verdicts cover every row and don't depend on it).
SAMPLE_ROWS = 256
#: Characters of these, where texts are long.
SAMPLE_BYTES = 32 << 20


class Features:
    """A text's features, each computed when a rule first asks for it."""

    def __init__(self, text: str):
        self.text = text
        self._got: dict[str, object] = {}

    def _once(self, name: str, make: Callable[[], object]):
        if name not in self._got:
            self._got[name] = make()
        return self._got[name]

    def copy(self) -> Features:
        out = Features(self.text)
        out._got = dict(self._got)
        return out

    @property
    def words(self) -> list[bytes]:
        return self._once("words", lambda: self.text.encode("utf-8", "surrogatepass").split())

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_chars(self) -> int:
        return self._once("chars", lambda: len(self.text) - sum(map(self.text.count, " \t\n\v\f\r")))

    @property
    def n_symbols(self) -> int:
        return self._once("symbols", lambda: sum(map(self.text.count, SYMBOLS)))

    @property
    def lines(self) -> list[str]:
        return self._once("lines", lambda: [x for x in self.text.split("\n") if x.strip(" \t\n\v\f\r")])

    @property
    def n_dup_lines(self) -> int:
        return self._once("dups", lambda: len(self.lines) - len(set(self.lines)))

    @property
    def n_repeat_words(self) -> int:
        return self._once("repeats", self._repeats)

    def _repeats(self) -> int:
        words = self.words
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        first: dict[tuple, int] = {}
        again = set()
        for i, w in enumerate(windows):
            if first.setdefault(w, i) != i:
                again.add(w)
        covered = 0
        upto = 0  # words before this one are counted already
        for i, w in enumerate(windows):
            if w in again:
                covered += i + 3 - max(upto, i)
                upto = i + 3
        return covered

    @property
    def upper_share(self) -> float:
        t = self.text
        upper = sum(map(str.isupper, t))
        return upper / max(1, upper + sum(map(str.islower, t)))


@dataclass(frozen=True)
class Rule:
    """rejects(features) -> True if the text has to go."""

    name: str
    rejects: Callable[[Features], bool]


#: The two rules that always hold, then the method's own.
BASE_RULES = (
    Rule("too_short", lambda f: f.n_words < 50),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
#: Features that a verdict states whatever the rules.
BASE_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
METHOD_RULES = (
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("repeated_lines", lambda f: 2 * f.n_dup_lines > len(f.lines)),
    Rule("capitals", lambda f: f.upper_share > 0.5),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 15 * f.n_words),
)
RULES = BASE_RULES + METHOD_RULES


@dataclass(frozen=True)
class Measured:
    """A rule's place in the cascade: seconds a text, and the share of texts
    that it rejects of those that the rules before it leave."""

    name: str
    seconds: float
    rejected: float


def greedy(texts: list, rules: tuple[Rule, ...], clock: Callable[[], float] = time.perf_counter) -> list[Measured]:
    """The rules by rejection per cost, each measured on the texts that those
    before it leave, with the features that these have computed. Ties, and rules
    that reject nothing, keep the given order and come last."""
    left, todo, out = [t if isinstance(t, Features) else Features(t) for t in texts], list(rules), []
    while todo:
        tried = []
        for rule in todo:
            own, gone = [f.copy() for f in left], []
            began = clock()
            for f in own:
                gone.append(rule.rejects(f))
            cost = max(clock() - began, 1e-9)
            tried.append((sum(gone) / cost, rule, cost, own, gone))
        _, rule, cost, own, gone = max(tried, key=lambda x: x[0])
        out.append(Measured(rule.name, cost / max(1, len(left)), sum(gone) / max(1, len(left))))
        left = [f for f, g in zip(own, gone) if not g]
        todo.remove(rule)
    return out


def judged(text: str) -> tuple[Features, bool]:
    """A text with the base features, which a verdict states anyway, and whether
    a base rule fails. What comes after finds these features there."""
    f = Features(text)
    for name in BASE_FEATURES:
        getattr(f, name)
    return f, any(r.rejects(f) for r in BASE_RULES)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, after_base: bool = False) -> list[Measured]:
    """greedy() on at most sample_rows texts, and SAMPLE_BYTES (one text at
    least), from all of docs, by one task; only a row a rule comes to the driver.
    after_base: on texts that pass the base rules, whose base features are known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, size = [], 0
        for text in (t for pdf in batches for t in pdf["text"]):
            f, failed = judged(text) if after_base else (Features(text), False)
            size += len(text)
            if texts and size > SAMPLE_BYTES:
                break
            if not failed:
                texts.append(f)
        yield pd.DataFrame([(k, m.name, m.seconds, m.rejected) for k, m in enumerate(greedy(texts, rules))], columns=["ord", "name", "seconds", "rejected"])

    bounded_batches(docs.sparkSession)
    share = min(1.0, 4 * sample_rows / max(1, docs.count()))
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).sample(share, seed=5).orderBy(F.rand(5)).limit(sample_rows)
    got = texts.coalesce(1).mapInPandas(run, "ord long, name string, seconds double, rejected double").collect()
    return [Measured(r["name"], r["seconds"], r["rejected"]) for r in sorted(got, key=lambda r: r["ord"])]


def ordered(rules: tuple[Rule, ...], measured: list[Measured]) -> tuple[Rule, ...]:
    """The rules in the measured order; those not measured come last."""
    place = {m.name: k for k, m in enumerate(measured)}
    return tuple(sorted(rules, key=lambda r: place.get(r.name, len(place))))


def rejected_by(f: Features, cascade: tuple[Rule, ...]) -> str | None:
    """The first rule that rejects; later ones are not evaluated."""
    return next((r.name for r in cascade if r.rejects(f)), None)


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, all columns as they are, that no rule rejects."""
    cascade = ordered(rules, measure(docs, rules, text_col, sample_rows))

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        return pd.Series([rejected_by(Features(t or ""), cascade) is None for t in texts], dtype=bool)

    return docs.filter(passes(F.col(text_col)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = METHOD_RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, the base features, base_failed, and kept (false if a
    base rule fails, else the cascade's verdict)."""
    cascade = ordered(rules, measure(docs, rules, text_col, sample_rows, after_base=True))

    def of_text(text: str) -> tuple:
        f, failed = judged(text)
        kept = not failed and rejected_by(f, cascade) is None
        return f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, kept

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return map_texts(keyed(docs, id_col, text_col), of_text, names, ["long"] * 5 + ["boolean"] * 2)
