"""Text that git prints, as frames. git itself is run by the caller; nothing
here starts a process."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def blame(porcelain: DataFrame) -> DataFrame:
    """file, line, author of `git blame --porcelain` (file, text). Only the
    first mention of a commit names its author, who is joined back."""
    lines = porcelain.select("file", F.posexplode(F.split("text", "\n")).alias("pos", "row"))
    head = F.regexp_extract("row", r"^([0-9a-f]{40}) \d+ (\d+)", 1)
    rows = lines.select("file", "pos", "row", F.nullif(head, F.lit("")).alias("sha"), F.try_to_number(F.regexp_extract("row", r"^[0-9a-f]{40} \d+ (\d+)", 1), F.lit("9999999999")).cast("int").alias("line"))
    order = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("sha", F.last("sha", True).over(order))
    mail = rows.filter(F.col("row").startswith("author-mail ")).groupBy("file", "sha").agg(F.min(F.regexp_extract("row", r"^author-mail <?([^>]*)>?", 1)).alias("author"))
    return rows.filter("line is not null").join(mail, ["file", "sha"]).select("file", "line", "author")


def diff_files(diff: DataFrame) -> DataFrame:
    """file, ord of the files that unified diffs (text) change."""
    rows = diff.select(F.posexplode(F.split("text", "\n")).alias("ord", "row")).filter(F.col("row").startswith("+++ b/"))
    return rows.groupBy(F.substring("row", 7, 1 << 30).alias("file")).agg(F.min("ord").cast("long").alias("ord"))


def log_commits(log: DataFrame) -> DataFrame:
    """file, ts of `git log --name-only --format=%x01%ct` texts: each is cut at
    its commits, whose first line is the time and whose other lines are files."""
    commits = log.select(F.explode(F.split("text", "\x01")).alias("commit")).filter("trim(commit) <> ''")
    lines = F.split("commit", "\n")
    at = F.timestamp_seconds(F.trim(lines[0]).try_cast("long"))
    return commits.select(F.explode(F.filter(lines, lambda x, i: (i > 0) & (F.trim(x) != ""))).alias("file"), at.alias("ts")).filter("ts is not null")


def status_files(status: DataFrame) -> DataFrame:
    """file, status of `git status --porcelain -u` text."""
    rows = status.select(F.explode(F.split("text", "\n")).alias("row")).filter("length(row) > 3")
    code = F.substring("row", 1, 2)
    kind = F.when(code.contains("D"), "D").when(code.contains("?") | code.contains("A"), "A").otherwise("M")
    return rows.select(F.element_at(F.split(F.substring("row", 4, 1 << 30), " -> "), -1).alias("file"), kind.alias("status"))
