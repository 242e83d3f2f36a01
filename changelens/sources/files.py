"""Source trees, change history and diffs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changelens.functions.paths import LANGUAGES, is_skipped, is_test, language_of

MOST_BYTES, MOST_LINES, MOST_FILES = 4 << 20, 50_000, 20_000


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, content) of the files below root."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://", 1)[-1].rstrip("/").removeprefix("/")
    path = F.regexp_replace("path", "^(?:[a-z]+:/*)?" + base.replace(".", "\\.") + "/", "")
    return own.select(path.alias("path"), F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("content"))


def inventory(files: DataFrame, test_globs: tuple[str, ...] = (), most_files: int = MOST_FILES) -> DataFrame:
    """File facts of files(path, bytes, content) in known languages: (path, language,
    loc, is_test, bytes). Very large files are data, not code."""
    lines = F.char_length("content") - F.char_length(F.replace("content", F.lit("\n"), F.lit("")))
    loc = lines + F.when(F.col("content").endswith("\n") | (F.col("content") == ""), 0).otherwise(1)
    own = files.where((F.col("bytes") <= MOST_BYTES) & ~is_skipped(F.col("path")))
    own = own.select("path", language_of(F.col("path")).alias("language"), loc.cast("int").alias("loc"), is_test(F.col("path"), test_globs).alias("is_test"), "bytes")
    known = list(dict.fromkeys(LANGUAGES.values()))
    return own.where(F.col("language").isin(*known) & (F.col("loc") <= MOST_LINES)).orderBy("path").limit(most_files)


def python_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").endswith(".py") & ~is_skipped(F.col("path"))).orderBy("path")


def history(log: DataFrame, most_commits: int = 4000) -> DataFrame:
    """(commit, author, path) from raw logs: log(line_no, line), where a line that
    begins with \\x01 is `commit\\x1fauthor` and the lines under it are paths."""
    # log text is one repository's history; a single order is what a log is
    w = Window.partitionBy("repo").orderBy("line_no")
    head = F.col("line").startswith("\x01")
    own = log.withColumn("nth", F.sum(head.cast("int")).over(w)).withColumn("head", F.last(F.when(head, F.col("line")), ignorenulls=True).over(w))
    own = own.where(~head & (F.trim("line") != "") & (F.col("nth").between(1, most_commits)))
    parts = F.split(F.substring("head", 2, 100_000), "\x1f")
    return own.select("repo", parts[0].alias("commit"), parts[1].alias("author"), F.col("line").alias("path"))


def hunks(diffs: DataFrame) -> DataFrame:
    """(id, path, start_line, end_line) of the lines that unified diffs add or change;
    a hunk that only deletes marks the line before it. diffs(id, text)."""
    lines = diffs.select("id", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line"))
    w = Window.partitionBy("id").orderBy("no")
    target = F.when(F.col("line").startswith("+++ "), F.regexp_replace("line", r"^\+\+\+ (?:b/)?", ""))
    own = lines.withColumn("path", F.last(target, ignorenulls=True).over(w)).where(F.col("line").startswith("@@"))
    g = lambda n: F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", n)
    start = g(1).try_cast("int")
    count = F.coalesce(F.nullif(g(2), F.lit("")).try_cast("int"), F.lit(1))
    own = own.select("id", "path", start.alias("start_line"), F.greatest(start, start + count - 1).alias("end_line"))
    return own.where((F.col("path") != "/dev/null") & F.col("start_line").isNotNull())


def changed_paths(names: DataFrame) -> DataFrame:
    """(id, path) from the text of a name-only diff."""
    return names.select("id", F.explode(F.split("text", r"\r?\n")).alias("path")).where(F.trim("path") != "").distinct()


def numstat(lines: DataFrame) -> DataFrame:
    """(id, path, additions, deletions) from numstat lines; binary files count 0."""
    p = F.split("line", "\t")
    n = lambda i: F.coalesce(p[i].try_cast("int"), F.lit(0))
    return lines.where(F.size(p) >= 3).select("id", p[2].alias("path"), n(0).alias("additions"), n(1).alias("deletions"))


def diff_totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("id").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count(F.lit(1)).alias("changed_files"))


def most_inserted(stats: DataFrame) -> DataFrame:
    """numstat() rows with `rank`: files of a diff by their insertions, of equals by path."""
    w = Window.partitionBy("id").orderBy(F.desc("additions"), "path")
    return stats.withColumn("rank", F.row_number().over(w))
