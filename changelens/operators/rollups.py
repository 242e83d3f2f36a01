"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changelens.functions.paths import iso_instant, module_of
from changelens.schemas import LEVELS, ordinal

FAILED, SKIPPED = ("failed", "error"), ("skipped", "xfailed", "xpassed")


def caller_counts(edges: DataFrame, by: list[str] = ["callee"], caller: str = "caller") -> DataFrame:  # noqa: B006
    return edges.groupBy(*by).agg(F.countDistinct(caller).alias("callers"))


def review_counts(comments: DataFrame) -> DataFrame:
    """seen, kept and retention (null where none was seen)."""
    own = comments.agg(F.count(F.lit(1)).alias("seen"), F.coalesce(F.sum(F.col("enforced").cast("long")), F.lit(0)).alias("kept"))
    return own.withColumn("retention", F.try_divide("kept", "seen"))


def retention_rate(kept: Column, seen: Column) -> Column:
    return F.coalesce(F.try_divide(kept, seen), F.lit(0.0))


def spent(spend: DataFrame, run_id: str | None = None, repo: str | None = None, since: float | None = None) -> DataFrame:
    from changelens.sources.tables import optional

    own = spend.where(optional("run_id", run_id) & optional("repo", repo))
    own = own if since is None else own.where(F.col("ts") >= since)
    return own.agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"))


def spend_summary(spend: DataFrame) -> DataFrame:
    sums = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "usd")
    return spend.agg(F.count(F.lit(1)).alias("calls"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))


def spend_by_scope(spend: DataFrame) -> DataFrame:
    """(scope, repo, day, run_id, usd): in all, by repository and day, and by run."""
    own = spend.withColumn("day", F.to_date(F.timestamp_seconds("ts")))
    own = own.groupingSets([[], [F.col("repo"), F.col("day")], [F.col("run_id")]], F.col("repo"), F.col("day"), F.col("run_id"))
    out = own.agg(F.sum("usd").alias("usd"), F.grouping_id().alias("_g"))
    scope = F.when(F.col("_g") == 7, "total").when(F.col("_g") == 1, "repo_day").otherwise("run")
    return out.select(scope.alias("scope"), "repo", "day", "run_id", "usd")


def count_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def findings_counts(observations: DataFrame) -> DataFrame:
    """One row: total, by_kind, cited, uncited."""
    kinds = observations.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("norm_id", F.lit("")) != "").alias("cited")
    )
    entries = F.sort_array(F.collect_list(F.struct("kind", "n")))  # a row for each kind
    own = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.map_from_entries(entries).alias("by_kind"), F.coalesce(F.sum("cited"), F.lit(0)).alias("cited"))
    return own.withColumn("uncited", F.col("total") - F.col("cited"))


#: Rows of a task that brings the touches of a path and commit together, whatever the table's size.
IN_TASK = 1 << 19


def _touches(commits: DataFrame, *by: str) -> DataFrame:
    """(by, commits, authors) of commits(by, path, commit, author): each commit once a path; unnamed authors do not count.

    The largest name of an author is a text, which Spark finds by sorting all rows of a task, before the shuffle as
    well. So rows are dealt by their keys first, in as many parts as they need."""
    n = max(int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-commits.count() // IN_TASK))
    keys = [*dict.fromkeys((*by, "path", "commit"))]
    once = commits.select(*keys, F.nullif("author", F.lit("")).alias("author"))
    once = once.repartition(n, *keys).groupBy(*keys).agg(F.max("author").alias("author"))
    each = once.repartition(n, *by, "author").groupBy(*by, "author").agg(F.count(F.lit(1)).alias("k"))
    return each.groupBy(*by).agg(F.sum("k").alias("commits"), F.count("author").alias("authors"))


def churn(commits: DataFrame) -> DataFrame:
    """(path, commits, authors): each commit once a path; unnamed authors do not count."""
    return _touches(commits, "path")


def module_rollup(files: DataFrame, commits: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, loc, files, test_files, languages, paths, commits, authors, symbols); paths are all of a module's, in order."""
    own = files.withColumn("name", module_of(F.col("path")))
    size = own.groupBy("name").agg(
        F.sum("loc").alias("loc"),
        F.count(F.lit(1)).alias("files"),
        F.count_if("is_test").alias("test_files"),
    )
    paths = own.groupBy("name").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    by_language = own.groupBy("name", "language").agg(F.sum("loc").alias("l"))
    language = by_language.groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "l")))).alias("languages"))
    touched = own.select("name", "path").join(commits, "path")
    change = _touches(touched, "name")
    named = symbols.groupBy(module_of(F.col("file")).alias("name")).agg(F.count(F.lit(1)).alias("symbols"))
    out = size.join(language, "name").join(paths, "name").join(change, "name", "left").join(named, "name", "left")
    return out.fillna(0, ["commits", "authors", "symbols"])


def language_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.sum("loc").alias("loc")).orderBy(F.desc("loc"), "language")


def language_bar(totals: DataFrame, top: int = 7) -> DataFrame:
    """The largest languages and the rest as Other; languages are few."""
    w = Window.orderBy(F.desc("loc"), "language")
    own = totals.withColumn("n", F.row_number().over(w))
    return own.groupBy(F.when(F.col("n") > top, "Other").otherwise(F.col("language")).alias("language")).agg(F.sum("loc").alias("loc"))


def atlas_totals(files: DataFrame, commits: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    f = files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"),
        F.count_if("is_test").alias("test_files"),
        F.countDistinct("language").alias("languages"),
    )
    c = commits.agg(F.countDistinct("commit").alias("commits_window"), F.countDistinct(F.nullif("author", F.lit(""))).alias("contributors"))
    s = symbols.agg(F.count(F.lit(1)).alias("symbols"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    return f.crossJoin(c).crossJoin(s).crossJoin(e)  # single rows


def module_edges(edges: DataFrame, symbols: DataFrame, most: int = 240) -> DataFrame:
    """(source, target, weight): calls between modules."""
    at = symbols.select("fqn", module_of(F.col("file")).alias("m"))
    own = edges.join(at.select(F.col("fqn").alias("caller"), F.col("m").alias("source")), "caller")
    own = own.join(at.select(F.col("fqn").alias("callee"), F.col("m").alias("target")), "callee").where("source <> target")
    return own.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight")).orderBy(F.desc("weight"), "source", "target").limit(most)


def test_topology(modules: DataFrame, most: int = 40) -> DataFrame:
    """One row: modules with and without tests, and the names of untested ones."""
    bare = (F.col("test_files") == 0) & (F.col("symbols") > 0)
    return modules.agg(
        F.count_if(F.col("test_files") > 0).alias("tested"),
        F.count_if(bare).alias("untested"),
        F.sum("test_files").alias("test_files"),
        F.slice(F.sort_array(F.collect_list(F.when(bare, F.col("name")))), 1, most).alias("untested_names"),
    )


def queue(pulls: DataFrame, runs: DataFrame, observations: DataFrame) -> DataFrame:
    """Pulls with their latest run's findings, riskiest first."""
    latest = runs.groupBy("repo", "pr_number").agg(F.max_by(F.struct("id", "state"), F.struct("created_at", "id")).alias("r"))
    latest = latest.select("repo", F.col("pr_number").alias("number"), F.col("r.id").alias("run_id"), F.col("r.state").alias("run_state"))
    kinds = observations.groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("s"), F.sum("rank_score").alias("r"))
    own = kinds.groupBy("run_id").agg(
        F.sum("n").alias("findings"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("by_kind"),
        F.max("s").alias("max_severity"),
        F.round(F.sum("r"), 3).alias("risk"),
    )
    out = pulls.join(latest, ["repo", "number"], "left").join(own, "run_id", "left").fillna(0, ["findings"]).fillna(0.0, ["max_severity", "risk"])
    return out.orderBy(F.desc("risk"), F.desc("findings"), F.desc("number"))


def repo_index(repos: DataFrame, pulls: DataFrame, runs: DataFrame, observations: DataFrame, recent: int = 200) -> DataFrame:
    w = Window.partitionBy("repo").orderBy(F.desc("created_at"), F.desc("id"))
    last = runs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= recent)
    found = observations.select(F.col("run_id").alias("id")).distinct().withColumn("_f", F.lit(True))
    r = last.join(found, "id", "left").groupBy(F.col("repo").alias("slug"))
    r = r.agg(F.count(F.lit(1)).alias("runs"), F.count_if((F.col("state") == "done") & F.col("_f")).alias("flagged"))
    p = pulls.where("state = 'open'").groupBy(F.col("repo").alias("slug")).agg(F.count(F.lit(1)).alias("open_pulls"))
    return repos.join(p, "slug", "left").join(r, "slug", "left").fillna(0, ["open_pulls", "runs", "flagged"])


def sandbox_rollup(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id", "side").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status").isin(*FAILED)).alias("failed"),
        F.count_if(F.col("status").isin(*SKIPPED)).alias("skipped"),
        F.sort_array(F.collect_list(F.when(F.col("status").isin(*FAILED), F.col("nodeid")))).alias("failed_ids"),
    )


def peaks(samples: DataFrame, high_water: DataFrame | None = None) -> DataFrame:
    own = samples.groupBy("job_id").agg(F.max("rss_mb").alias("peak_rss_mb"), F.max("cpu_pct").alias("peak_cpu_pct"))
    if high_water is None:
        return own
    return own.join(high_water, "job_id", "left").withColumn("peak_rss_mb", F.coalesce("high_water_mb", "peak_rss_mb")).drop("high_water_mb")


def discard_rate(survivors: Column, seen: Column) -> Column:
    return F.coalesce(1 - F.try_divide(survivors, seen), F.lit(0.0))


def last_commits(commits: DataFrame) -> DataFrame:
    """(number, last): each pull's latest commit time; committer before author."""
    at = F.coalesce(iso_instant(F.col("committer_date")), iso_instant(F.col("author_date")))
    return commits.groupBy("number").agg(F.max(at).alias("last"))


def drift_level(signals: DataFrame, by: list[str]) -> DataFrame:
    top = F.coalesce(F.max(ordinal(F.col("level"))), F.lit(0))
    return signals.groupBy(*by).agg(F.element_at(F.array(*map(F.lit, LEVELS)), top + 1).alias("level"))


def health(repos: DataFrame, runs: DataFrame, events: DataFrame, spend: DataFrame) -> DataFrame:
    from changelens.schemas import TERMINAL_STATES

    r = repos.agg(F.count(F.lit(1)).alias("repos"))
    q = runs.agg(F.count_if(F.col("state") == "queued").alias("queued"), F.count_if(~F.col("state").isin("queued", *TERMINAL_STATES)).alias("running"))
    e = events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"))
    s = spend.agg(F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 6).alias("usd"))
    return r.crossJoin(q).crossJoin(e).crossJoin(s)  # single rows


def brain_page(norms: DataFrame, comments: DataFrame) -> DataFrame:
    n = norms.agg(F.count_if(F.col("source") == "mined").alias("mined"), F.count_if(F.col("source") != "mined").alias("declared"))
    return n.crossJoin(review_counts(comments).withColumn("retention", F.round("retention", 3)))  # single rows
