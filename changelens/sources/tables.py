"""Scans of the stored tables: point lookups, ordered and filtered reads, the event
log, transcripts. Filters are plain column predicates, so they reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changelens.schemas import DDL, TERMINAL_STATES, ordinal


def lookup(df: DataFrame, **key) -> DataFrame:
    """The rows with this key."""
    for name, value in key.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def optional(column: str, value) -> Column:
    """Everything where value is None, else rows with that value."""
    return F.lit(True) if value is None else F.coalesce(F.col(column) == F.lit(value), F.lit(False))


def pulls(df: DataFrame, repo: str, state: str | None = None) -> DataFrame:
    return df.where((F.col("repo") == repo) & optional("state", state)).orderBy(F.desc("number"))


def runs(df: DataFrame, repo: str | None = None, pr_number: int | None = None, limit: int = 50) -> DataFrame:
    own = df.where(optional("repo", repo) & optional("pr_number", pr_number))
    return own.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(limit)


def unfinished_runs(df: DataFrame) -> DataFrame:
    return df.where(~F.col("state").isin(*TERMINAL_STATES)).orderBy(F.asc_nulls_first("created_at"), "id")


def jobs(df: DataFrame, run_id: str) -> DataFrame:
    return df.where(F.col("run_id") == run_id).orderBy(F.asc_nulls_first("started_at"), "id")


def observations(df: DataFrame, run_id: str) -> DataFrame:
    return df.where(F.col("run_id") == run_id).orderBy(F.desc_nulls_last("rank_score"), "id")


def norms(df: DataFrame, repo: str) -> DataFrame:
    """Declared ones first, then by confidence and support."""
    own = df.where(F.col("repo") == repo)
    return own.orderBy((F.col("source") == "mined").asc(), F.desc_nulls_last("confidence"), F.desc_nulls_last("support"), "id")


def norms_by_id(df: DataFrame, repo: str) -> DataFrame:
    return df.where(F.col("repo") == repo).orderBy("id")


def events_since(events: DataFrame, cursor: int, run_id: str | None = None, repo: str | None = None, limit: int = 20_000) -> DataFrame:
    own = events.where((F.col("seq") > cursor) & optional("run_id", run_id) & optional("repo", repo))
    return own.orderBy("seq").limit(limit)


def log_head(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"))


def notifications(df: DataFrame, floor: str = "none", repo: str | None = None, unread: bool = False) -> DataFrame:
    own = df.where((ordinal(F.col("level")) >= ordinal(F.lit(floor))) & optional("repo", repo))
    return own.where("acknowledged_at is null") if unread else own


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """Lines of NDJSON transcripts with their file; malformed lines are left out."""
    own = spark.read.schema(DDL["log_lines"] + ", _bad STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    own = own.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return own.where("_bad is null and seq is not null").drop("_bad")


def transcript_text(lines: DataFrame) -> DataFrame:
    """A text for each job file: `[offset stream] text`, in order."""
    line = F.format_string("[%d %s] %s", "offset_ms", "stream", "text")
    own = lines.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("l")))).alias("a"))
    return own.select("file", F.array_join(F.transform("a", lambda x: x["l"]), "\n").alias("text"))


def replayed(lines: DataFrame, skip: int = 0, limit: int = 20_000) -> DataFrame:
    """A page of the lines of all files, one file after another."""
    w = Window.partitionBy("file").orderBy("seq")
    counts = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # a row for each file
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = lines.withColumn("at", F.row_number().over(w)).join(counts.select("file", before.alias("before")), "file")
    own = own.withColumn("position", F.col("before") + F.col("at"))
    return own.where((F.col("position") > skip) & (F.col("position") <= skip + limit)).drop("at", "before")


def taken_while(df: DataFrame, stop: Column, order: list[Column], partition: list[str], limit: int | None = None) -> DataFrame:
    """Rows in order up to the first that `stop` holds for, of each partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    own = df.withColumn("_stop", F.max(F.coalesce(stop, F.lit(False)).cast("int")).over(w)).withColumn("_at", F.row_number().over(w))
    own = own.where("_stop = 0")
    return (own if limit is None else own.where(F.col("_at") <= limit)).drop("_stop", "_at")


def updated_after(pulls_: DataFrame, since: str | None) -> DataFrame:
    """Pulls newer than a cursor, compared as text."""
    return pulls_ if since is None else pulls_.where(F.col("updated_at") > since)


def harvested(pulls_: DataFrame, comments: DataFrame, commits: DataFrame) -> DataFrame:
    """Merged pulls with their comments and commits nested."""
    merged = pulls_.where("merged_at is not null")
    c = comments.groupBy("repo", "number").agg(F.collect_list(F.struct(*[x for x in comments.columns if x not in ("repo", "number")])).alias("review_comments"))
    k = commits.groupBy("repo", "number").agg(F.collect_list(F.struct(*[x for x in commits.columns if x not in ("repo", "number")])).alias("commits"))
    return merged.join(c, ["repo", "number"], "left").join(k, ["repo", "number"], "left")


REVIEW_CORPUS = (
    "number INT, title STRING, merged_at STRING, user STRING, review_comments ARRAY<STRUCT<user: STRUCT<login: STRING>, body: STRING, "
    "diff_hunk: STRING, created_at: STRING>>, commits ARRAY<STRUCT<commit: STRUCT<committer: STRUCT<date: STRING>, author: STRUCT<date: STRING>>>>"
)


def review_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Pulls with comments and commits from a JSON array; nothing from a broken file."""
    return spark.read.schema(REVIEW_CORPUS).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def landed(responses: DataFrame) -> DataFrame:
    """(url, etag, body) as last fetched, from responses(url, fetched_at, status, etag, body)
    that a collector landed: an answer of 304 means the body before still holds, and other
    answers than 200 say nothing."""
    good = responses.where("status = 200").groupBy("url").agg(F.max_by(F.struct("etag", "body"), "fetched_at").alias("r"))
    return good.select("url", "r.etag", "r.body")
