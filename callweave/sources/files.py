"""Source trees: listing, ignore rules, hashes, areas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees

# What is left out unless a tree says otherwise.
DEFAULT_IGNORE = ("node_modules/", "__pycache__/", ".git/", "dist/", "build/", "out/", "vendor/", ".venv/", "venv/", "*.min.js", "*.min.css", "*.map", "*.lock", "*.pyc", "*.egg-info/", "coverage/", ".nyc_output/")

# Extensions and their languages.
LANGUAGE = {".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "tsx", ".jsx": "jsx", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".cpp": "cpp", ".c": "c", ".h": "c_header"}
TRACKED = tuple(LANGUAGE)

# Files that mark a folder as a package of its own.
MANIFESTS = ("package.json", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "setup.py")


def ignore_regex(pattern: str) -> str | None:
    """A line of an ignore file as a regex over relative paths."""
    p = pattern.strip()
    if not p or p.startswith("#"):
        return None
    folder, anchored = p.endswith("/"), "/" in p.rstrip("/")
    body, i, p = "", 0, p.strip("/")
    while i < len(p):
        if p.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            body, i = body + ".*", i + 2
        elif p[i] == "[" and "]" in p[i + 1 :]:
            end = p.index("]", i + 1)
            body, i = body + "[" + p[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            body, i = body + {"*": "[^/]*", "?": "[^/]"}.get(p[i], re.escape(p[i])), i + 1
    return ("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)")


def ignored(path: Column, patterns=DEFAULT_IGNORE) -> Column:
    """Whether the last line that matches leaves the path out; `!` lets it in."""
    out = F.lit(False)
    for p in patterns:
        keep = p.strip().startswith("!")
        rx = ignore_regex(p.strip()[1:] if keep else p)
        if rx:
            out = F.when(path.rlike(rx), F.lit(not keep)).otherwise(out)
    return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def read_tree(spark: SparkSession, root: str, patterns=DEFAULT_IGNORE, tracked=TRACKED) -> DataFrame:
    """file (relative), content, hash of the tracked files under root. Tasks list
    the folders, and only what stays is read (trees.py)."""
    listed = trees.list_tree(spark, root, patterns)
    wanted = listed.filter(extension(F.col("file")).isin(*tracked) & ~ignored(F.col("file"), patterns))
    found = trees.read_files(root, wanted)
    return found.select("file", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash"))


def language(path: Column) -> Column:
    out = F
    for ext, lang in LANGUAGE.items():
        out = out.when(extension(path) == ext, lang)
    return out


def detect_areas(files: DataFrame) -> dict[str, str]:
    """Folders under src/; else folders with a manifest, one or two deep; else
    the folders at the top; else the root. Only distinct folders, two deep, are
    brought to the driver."""
    parts = F.split("file", "/")
    one, two = F.when(F.size(parts) > 1, parts[0]), F.when(F.size(parts) > 2, F.get(parts, F.lit(1)))
    leaf = F.element_at(parts, -1)
    rows = files.select(one.alias("a"), two.alias("b"), F.when(leaf.isin(*MANIFESTS) & (F.size(parts) <= 3), F.size(parts) - 1).alias("m")).distinct().collect()
    src = sorted({r["b"] for r in rows if r["a"] == "src" and r["b"]})
    if src:
        return {b: f"src/{b}/" for b in src}
    plain = [r for r in rows if r["a"] and not r["a"].startswith(".")]
    own = {r["a"] for r in plain if r["m"] == 1}
    found = {a: f"{a}/" for a in sorted(own)}
    found |= {r["b"]: f"{r['a']}/{r['b']}/" for r in sorted(plain, key=lambda r: (r["a"], r["b"] or "")) if r["m"] == 2 and r["a"] not in own}
    return found or {a: f"{a}/" for a in sorted({r["a"] for r in plain})} or {"root": "."}
