"""Definitions, imports and calls in languages of braces, in Ruby, and in Python
files that don't parse: comments and strings are blanked, brackets are matched,
and headers are found in what is left, so that units nest and end where their
body does. No grammar is at hand; headers that need one are missed (see README).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_DOUBLE, _CHAR = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.[^'\n]*|[^'\\\n])'"
_SINGLE = r"'(?:\\.|[^'\\\n])*'"

# What is no code, by language.
BLANK = {
    "javascript": (_LINE, _BLOCK, _DOUBLE, _SINGLE, r"`(?:\\.|[^`\\])*`"),
    "go": (_LINE, _BLOCK, _DOUBLE, _CHAR, r"`[^`]*`"),
    "rust": (_LINE, _BLOCK, r'r(#*)".*?"\1', _DOUBLE, _CHAR),
    "java": (_LINE, _BLOCK, r'""".*?"""', _DOUBLE, _CHAR),
    "c": (r"^[ \t]*#[ \t]*(?!include)\w+(?:\\\n|[^\n])*", _LINE, _BLOCK, _DOUBLE, _CHAR),
    "ruby": (r"^=begin\b.*?^=end\b", r"#(?!\{)[^\n]*", _DOUBLE, _SINGLE),
    "python": (r"\"\"\".*?\"\"\"", r"'''.*?'''", r"#[^\n]*", _DOUBLE, _SINGLE),
}
# Languages that share another's rules.
LIKE = {"typescript": "javascript", "tsx": "javascript", "jsx": "javascript", "cpp": "c", "c_header": "c"}
# Words before a bracket that are no names.
KEYWORDS = frozenset("if for while switch catch return sizeof function def func fn new else do throw await yield typeof delete void case in of match loop unless until elsif when super synchronized assert with and or not lambda print del elif except defined alignof decltype static_assert operator import type var const".split())
C_TYPES = frozenset("int char float double long short unsigned signed void bool".split())
MODIFIERS = frozenset("public private protected static final abstract synchronized native default strictfp".split())

_NAME = r"([A-Za-z_$][\w$]*)"
IMPORTS = {
    "javascript": r"^\s*import\b(?!\s*\()(?:[^;\n{]|\{[^}]*\})*",
    "go": r"^import\b\s*(?:\([^)]*\)|[^\n]*)",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+[^;]+;",
    "java": r"^\s*import\s+[^;\n]+;",
    "c": r"^\s*#\s*include\b[^\n]*",
    "python": r"^\s*(?:import|from)\s+\S[^\n]*",
}
CLASSES = {
    "javascript": r"\bclass\s+" + _NAME,
    "typescript": r"\b(?:class|interface)\s+" + _NAME + r"|^\s*(?:export\s+)?(?:declare\s+)?type\s+" + _NAME + r"\s*(?:<[^=]*>)?\s*=",
    "go": r"^type\s+" + _NAME + r"\s",
    "rust": r"\b(?:struct|enum)\s+" + _NAME + r"|\bimpl\b(?:\s*<[^{;]*?>)?\s+(?:[^{;]+?\s+for\s+)?([A-Za-z_][\w:]*)",
    "java": r"\b(?:class|interface)\s+" + _NAME,
    "c": r"\bstruct\s+" + _NAME + r"(?=[^;(){}=]*\{)",
    "cpp": r"\b(?:class|struct|namespace)\s+" + _NAME + r"(?=[^;(){}=]*\{)",
}
CLASSES |= {"jsx": CLASSES["javascript"], "tsx": CLASSES["typescript"], "c_header": CLASSES["c"]}
CALL = re.compile(r"(?<![\w$.:])([A-Za-z_$][\w$]*(?:(?:\?\.|\.|::|->)[A-Za-z_$][\w$]*)*[!?]?)\s*\(")


@dataclass(frozen=True)
class Unit:
    kind: str  # function or class
    name: str
    start: int  # place of the header, and the end of the body
    end: int
    body: int  # where the body's text begins, or -1


class Source:
    """A file's text, its code with all else blanked, and its brackets."""

    def __init__(self, content: str, lang: str):
        self.content, self.lang, self.family = content, lang, LIKE.get(lang, lang)
        rx = re.compile("|".join(f"(?:{p})" if r"\1" not in p else p for p in BLANK[self.family]), re.S | re.M)
        self.code = rx.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), content)
        self.starts = [0, *(m.end() for m in re.finditer("\n", content))]
        self.match, self.inside = self._brackets()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def text_of_line(self, at: int) -> str:
        n = self.line(at)
        return self.content[self.starts[n - 1] : self.starts[n] if n < len(self.starts) else None].strip()

    def _brackets(self) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """Closing places by opening ones, and the braces' opening places with
        the one around each. What closes nothing is passed over."""
        match: dict[int, int] = {}
        braces, stack = [], []
        for m in re.finditer(r"[(){}]", self.code):
            c, at = m[0], m.start()
            if c in "({":
                if c == "{":
                    braces.append((at, next((b for b in reversed(stack) if self.code[b] == "{"), -1)))
                stack.append(at)
            else:
                want = "(" if c == ")" else "{"
                if c == "}" and any(self.code[b] == "{" for b in stack):
                    while self.code[stack[-1]] != "{":  # a bracket that was left open
                        stack.pop()
                if stack and self.code[stack[-1]] == want:
                    match[stack.pop()] = at
        return match, braces

    def around(self, at: int) -> int:
        """The opening place of the innermost closed brace around a place."""
        best = -1
        for b, _ in self.inside:
            if b >= at:
                break
            if self.match.get(b, -1) > at:
                best = b
        return best


def _bodies(src: Source) -> Iterator[Unit]:
    code, family = src.code, src.family
    classes = {}
    for m in re.finditer(CLASSES[src.lang], code, re.M):
        name = next(x for x in m.groups() if x)
        stop = re.compile(r"[{;]" if family != "go" else r"[{\n]").search(code, m.end())
        if stop and stop[0] == "{" and stop.start() in src.match:
            classes[stop.start()] = name
            yield Unit("class", name, m.start(), src.match[stop.start()], stop.start() + 1)
        else:
            yield Unit("class", name, m.start(), stop.start() if stop else len(code) - 1, -1)
    for m in re.finditer(r"(?<![\w$#@])(#?" + _NAME[1:] + r"\s*(?:<[^<>(){};]*>\s*|\[[^\]\n]*\]\s*)?\(", code):
        name, close = m[1], src.match.get(m.end() - 1)
        if close is None or name in KEYWORDS:
            continue
        before = code[max(0, m.start() - 200) : m.start()]
        word = re.search(r"([\w$>\]&*.:]*)\s*$", before)[1]
        found = _function(src, family, name, m, close, before, word, classes)
        if found is not None:
            yield found


def _function(src: Source, family: str, name: str, m, close: int, before: str, word: str, classes: dict[int, str]) -> Unit | None:
    """The function whose parameters are the brackets behind a name, if it is
    one's definition."""
    code, start = src.code, m.start()
    if family == "javascript":
        own = re.search(r"(?:\basync\s+)?\bfunction\s*\*?\s*$", before)
        tail = re.compile(r"\s*(?::\s*[^;={}()]*(?:\{[^{}]*\}[^;={}()]*)?)?\{").match(code, close + 1)
        if not tail or not own and (word.endswith(".") or word in KEYWORDS):
            return None
        start = start - len(before) + own.start() if own else start
    elif family == "go":
        own = re.search(r"^func\s+(?:\([^()]*\)\s*)?$", before, re.M)
        tail = re.compile(r"[^\n{]*(?:\b(?:interface|struct)\s*\{\s*\}[^\n{]*)?\{").match(code, close + 1)
        if not own or not tail:
            return None
        start = start - len(before) + own.start()
    elif family == "rust":
        own = re.search(r"\bfn\s+$", before)
        tail = re.compile(r"[^;{]*([;{])").match(code, close + 1)
        if not own or not tail or tail[1] == ";":
            return None
        start = start - len(before) + own.start()
    else:
        typed = bool(re.search(r"[\w>\]]$", word) or word.endswith(("*", "&"))) and (word == "void" or word not in KEYWORDS) and word not in MODIFIERS
        if not typed or name in MODIFIERS:
            return None
        if family == "java":
            tail = re.compile(r"\s*(?:throws\s+[\w.,\s]+?)?\s*([{;])").match(code, close + 1)
            if not tail or src.around(start) not in classes:
                return None
        elif src.lang == "c_header":
            tail = re.compile(r"[^;{}()]*(;)").match(code, close + 1)
            if not tail or src.around(start) != -1:
                return None
        else:
            tail = re.compile(r"\s*(?:const|noexcept|override|final|\s)*(?:->[^;{]*)?\{").match(code, close + 1)
            around = src.around(start)
            if not tail or around != -1 and not re.search(r"\bnamespace\b[^;{}]*$|\bextern\s+$", code[max(0, around - 200) : around].rstrip('" ') + " "):
                return None
        # From the type on, within the line.
        start = max(src.starts[src.line(start) - 1], *(code.rfind(c, 0, start) + 1 for c in ";{}"))
        start = re.compile(r"\s*").match(code, start).end()
    last = tail.end() - 1
    if code[last] != "{":
        return Unit("function", name, start, last, -1)
    return Unit("function", name, start, src.match.get(last, len(code) - 1), last + 1)


_OPENS = re.compile(r"^\s*(class|module|def|if|unless|while|until|case|begin|for)\b|=\s*(?:if|unless|case|begin)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$")


def _ruby(src: Source) -> Iterator[Unit]:
    stack: list[tuple | None] = []
    at = 0
    for line in src.code.split("\n"):
        m = re.match(r"\s*(def)\s+(?:self\.|\w+\.)?([\w]+[?!=]?)|\s*(class|module)\s+([A-Z]\w*(?:::\w+)*)", line)
        one_line = re.search(r"\bend\b\s*$", line) and _OPENS.search(line) or m and m[1] and re.match(r"\s*def\s+[\w.?!]+\s*(?:\([^)]*\))?\s*=(?!=)", line)
        if _OPENS.search(line):
            here = ("function" if m[1] else "class", m[2] or m[4], at + len(line) - len(line.lstrip())) if m else None
            if one_line:
                if here:
                    yield Unit(here[0], here[1], here[2], at + len(line), -1)
            else:
                stack.append(here and (*here, at + len(line)))
        elif re.match(r"\s*end\b", line) and stack:
            here = stack.pop()
            if here:
                yield Unit(here[0], here[1], here[2], at + len(line), here[3])
        at += len(line) + 1


def _python(src: Source) -> Iterator[Unit]:
    """By indentation, for files that don't parse."""
    lines, places = src.code.split("\n"), src.starts
    for n, line in enumerate(lines):
        m = re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)", line)
        if m:
            end = n
            for k in range(n + 1, len(lines)):
                if lines[k].strip():
                    if len(lines[k]) - len(lines[k].lstrip()) <= len(m[1]):
                        break
                    end = k
            yield Unit("function" if m[2] == "def" else "class", m[3], places[n] + len(m[1]), places[end] + len(lines[end]), -1)


def _docstring(src: Source, unit: Unit) -> str | None:
    """The comment or string that a body begins with, without its marks."""
    if unit.body < 0:
        return None
    m = re.compile(r"\s*(?:((?:(?://|#)[^\n]*\n?\s*)+)|/\*(.*?)\*/|\"([^\"\n]*)\"|'([^'\n]*)')", re.S).match(src.content, unit.body, unit.end)
    if not m:
        return None
    text = next(x for x in m.groups() if x is not None)
    return "\n".join(re.sub(r"^\s*(?://+|#+|\*+)?\s?", "", x).rstrip() for x in text.strip().split("\n")).strip() or None


def units(src: Source) -> list[Unit]:
    """Units by place. A class that holds a function is present through it."""
    found = list({"ruby": _ruby, "python": _python}.get(src.family, _bodies)(src))
    functions = sorted(u.start for u in found if u.kind == "function")
    holds = lambda u: bisect_right(functions, u.end) > bisect_right(functions, u.start)
    return sorted((u for u in found if u.kind == "function" or not holds(u)), key=lambda u: (u.start, u.name))


def _classes_of(src: Source) -> list[Unit]:
    return [u for u in _bodies(src) if u.kind == "class"] if src.lang in CLASSES else []


def _defines(src: Source, m, classes: set[str]) -> bool:
    """Whether what looks like a call is a declaration that makes no unit: of a
    method without a body, a constructor, a member of C++, a pointer."""
    before = src.code[max(0, m.start() - 40) : m.start()]
    if re.search(r"\b(?:fn|def|func|function)\s+$", before):
        return True
    if src.family == "java":
        return m[1] in classes and not re.search(r"\bnew\s+$", before)
    close = src.match.get(m.end() - 1)
    if src.family == "c" and m[1] in C_TYPES:
        return True
    return src.family == "c" and close is not None and bool(re.compile(r"\s*(?:const|noexcept|override|final|\s)*\{").match(src.code, close + 1))


def scan(file: str, content: str, lang: str):
    """Rows of parse.PARSED."""
    src = Source(content, lang)
    found = units(src)
    for u in found:
        yield "unit", f"{u.kind}.def", u.name, file, u.kind, src.line(u.start), src.line(u.end), src.text_of_line(u.start) or None if u.kind == "function" else None, _docstring(src, u), None
    if src.family in IMPORTS:
        for m in re.finditer(IMPORTS[src.family], src.code, re.M):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            yield "capture", "import", None, file, None, src.line(at), src.line(at), None, None, content[at : m.end()].strip()
    if lang == "c_header":
        return
    # A name is a definition's where its unit begins on the line and bears it.
    named = {(src.line(u.start), u.name) for u in found if u.kind == "function"}
    own = {u.name for u in _classes_of(src)}
    for m in CALL.finditer(src.code):
        n = src.line(m.start())
        if re.split(r"\W+", m[1])[0] in KEYWORDS or (n, m[1]) in named or _defines(src, m, own):
            continue
        yield "capture", "call", None, file, None, n, n, None, None, m[1]
