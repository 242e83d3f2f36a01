"""Acceptance of answers, retention, liveness, test outcomes, report projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import ellipsis
from changelens.schemas import ASSESSMENTS, TERMINAL_STATES, literal_map


def retained(events: DataFrame, runs: DataFrame, cutoff: float) -> DataFrame:
    """Events that stay: new ones, and old ones of runs that are not over or not known."""
    over = runs.where(F.col("state").isin(*TERMINAL_STATES)).select(F.col("id").alias("run_id")).distinct().withColumn("_over", F.lit(True))
    own = events.join(over, "run_id", "left")
    goes = (F.col("ts") < cutoff) & (F.col("run_id").isNull() | F.coalesce("_over", F.lit(False)))
    return own.where(~goes).select(*events.columns)


def live(artefacts: DataFrame, runs: DataFrame, cutoff: float, protect_commits: bool = False) -> DataFrame:
    """Artefacts(kind, run_id, created_at) that stay: new ones and those of runs under way;
    commits of old runs under way are not protected unless asked for."""
    going = runs.where(~F.col("state").isin(*TERMINAL_STATES)).select(F.col("id").alias("run_id")).distinct().withColumn("_on", F.lit(True))
    own = artefacts.join(going, "run_id", "left")
    safe = F.coalesce("_on", F.lit(False)) & (F.lit(protect_commits) | (F.col("kind") != "commit"))
    return own.where((F.col("created_at") >= cutoff) | safe).drop("_on")


def accepted(answers: DataFrame, observations: DataFrame, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(taken, refused with reason): answers(observation_id, pos, assessment, reasoning,
    confidence, citations with `resolved`), the first for a known finding counts."""
    known = observations.select(F.col("id").alias("observation_id")).distinct().withColumn("_known", F.lit(True))
    first = answers.groupBy("observation_id").agg(F.min("pos").alias("_first"))
    own = answers.join(known, "observation_id", "left").join(first, "observation_id")
    good = F.size(F.filter("citations", lambda c: c["resolved"]))
    reason = (
        F.when(F.col("_known").isNull(), "unknown finding")
        .when(F.col("pos") != F.col("_first"), "answered before")
        .when(~F.coalesce(F.col("assessment").isin(*ASSESSMENTS), F.lit(False)), "unknown assessment")
        .when(F.coalesce(good, F.lit(0)) < 1, "no citation resolves")
    )
    own = own.withColumn("reason", reason).drop("_known", "_first")
    taken = own.where("reason is null").drop("reason")
    taken = taken.withColumns(
        {
            "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")),
            "reasoning": ellipsis(F.col("reasoning"), most),
            "citations": F.filter("citations", lambda c: c["resolved"]),
        }
    )
    return taken, own.where("reason is not null")


def missing_answers(shown: Column, answered: Column) -> Column:
    return F.array_except(shown, answered)


def is_due(now: float, hours: float) -> Column:
    return F.col("built_at").isNull() | (F.lit(now) - F.col("built_at") >= hours * 3600)


def filled_outcomes(asked: DataFrame, reported: DataFrame, suites: DataFrame) -> DataFrame:
    """Every test asked for: what was reported, else how its suite ended."""
    own = asked.join(reported, ["suite", "nodeid"], "left").join(suites.select("suite", F.col("outcome").alias("_s")), "suite", "left")
    return own.withColumn("status", F.coalesce("status", "_s")).drop("_s")


def steady(first: DataFrame, second: DataFrame) -> DataFrame:
    """Tests that passed in both rounds."""
    return first.where("status = 'passed'").join(second.where("status = 'passed'").select("nodeid"), "nodeid", "left_semi")


def validated_on_base(rounds: DataFrame, need: int = 2) -> DataFrame:
    """(nodeid, kept): rounds(nodeid, round, status); a test must pass `need` rounds and fail none."""
    own = rounds.groupBy("nodeid").agg(F.count_if(F.col("status") == "passed").alias("p"), F.count(F.lit(1)).alias("n"))
    return own.select("nodeid", ((F.col("p") >= need) & (F.col("p") == F.col("n"))).alias("kept"))


def calibrated(measured: DataFrame) -> DataFrame:
    return measured.withColumns(
        {"memory_mb": F.greatest(F.lit(1), F.ceil(2 * F.col("rss_kb") / 1024)), "timeout_s": F.greatest(F.lit(1), F.ceil(3 * F.col("wall_s")))}
    )


def declared_discount(confidence: Column, claims: Column, fqn: Column) -> Column:
    """Half the confidence where the change was announced by name, or the end of one."""
    short = F.element_at(F.split(fqn, r"\."), -1)
    hit = F.exists(claims, lambda c: (c == fqn) | (c == short) | F.endswith(fqn, F.concat(F.lit("."), c)))
    return F.when(F.coalesce(hit, F.lit(False)), confidence * 0.5).otherwise(confidence)


def pipeline_nodes(events: DataFrame, nodes: list[str]) -> DataFrame:
    """A row for each node with its last state, idle without one."""
    dim = events.sparkSession.createDataFrame([(i, n) for i, n in enumerate(nodes)], "pos INT, node STRING")
    last = events.groupBy("node").agg(F.max_by("state", "seq").alias("state"))
    return dim.join(last, "node", "left").fillna("idle", ["state"]).orderBy("pos")


def last_event(events: DataFrame, run_id: str, kind: str) -> DataFrame:
    return events.where((F.col("run_id") == run_id) & (F.col("type") == kind)).agg(F.max_by("payload", "seq").alias("payload"))


def coverage_statement(probes: DataFrame) -> DataFrame:
    """(run_id, verified, skipped, complete) of probes(run_id, probe, ran, reason)."""
    return probes.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("ran"), F.col("probe")))).alias("verified"),
        F.sort_array(F.collect_list(F.when(~F.col("ran"), F.struct("probe", "reason")))).alias("skipped"),
        F.bool_and("ran").alias("complete"),
    )


def packet_text(packets: DataFrame, body: int = 2000, quote: int = 200) -> DataFrame:
    head = F.concat(F.lit("# "), F.col("path"))
    norms = F.transform("norms", lambda n: F.concat(F.lit("- "), n["statement"], F.lit(": "), F.substring(n["quote"], 1, quote)))
    return packets.withColumn("prompt", F.concat_ws("\n", head, F.substring("body", 1, body), F.array_join(norms, "\n")))


def replay_lines(text: Column, most: int = 400) -> Column:
    """A line as one or two: a long embedded JSON value stands on its own."""
    at = F.locate("{", text)
    long = (at > 1) & (F.char_length(text) - at + 1 > most)
    return F.when(long, F.array(F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.char_length(text)))).otherwise(F.array(text))


def timeline(lines: DataFrame) -> DataFrame:
    text = F.when(F.col("stream") == "stderr", F.concat(F.lit("stderr: "), "text")).otherwise(F.col("text"))
    return lines.select("offset_ms", text.alias("text"), "seq").orderBy("seq")


def profile(norms: DataFrame, comments: DataFrame) -> DataFrame:
    """One JSON document a repository. Norms of a repository are a few dozen."""
    n = norms.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("id", "statement", "confidence", "support"))).alias("norms"))
    c = comments.groupBy("repo").agg(F.count(F.lit(1)).alias("seen"), F.count_if("enforced").alias("kept"))
    own = n.join(c, "repo", "left").withColumn("retention", F.coalesce(F.try_divide("kept", "seen"), F.lit(0.0)))
    return own.select("repo", F.to_json(F.struct("norms", "seen", "kept", "retention")).alias("document"))


def tool_kind(kind: Column, nodes: dict[str, str]) -> Column:
    return F.try_element_at(literal_map(nodes), kind)
