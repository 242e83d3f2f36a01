"""Tables of change-verification data as Spark DDL, and ordered enumerations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DDL = {
    "repos": "slug STRING, url STRING, default_branch STRING, package_roots ARRAY<STRING>, toolchain STRING, added_at DOUBLE, atlas_sha STRING",
    "pulls": "repo STRING, number INT, title STRING, body STRING, author STRING, base_sha STRING, head_sha STRING, state STRING, updated_at STRING, additions INT, deletions INT, changed_files INT, draft BOOLEAN, seen_at DOUBLE",
    "runs": "id STRING, repo STRING, pr_number INT, base_sha STRING, head_sha STRING, state STRING, trigger STRING, created_at DOUBLE, started_at DOUBLE, finished_at DOUBLE, error STRING, usd_spent DOUBLE, superseded_by STRING, charter_impact STRING",
    "jobs": "id STRING, run_id STRING, kind STRING, side STRING, argv ARRAY<STRING>, state STRING, exit_code INT, outcome STRING, started_at DOUBLE, finished_at DOUBLE, idempotency_key STRING, log_path STRING",
    "observations": "id STRING, run_id STRING, kind STRING, symbol STRING, what_changed STRING, how_we_know STRING, evidence_ref STRING, severity DOUBLE, confidence DOUBLE, rank_score DOUBLE, norm_id STRING, relevance STRING, relevance_note STRING",
    "adjudications": "observation_id STRING, assessment STRING, reasoning STRING, citations ARRAY<STRUCT<type: STRING, ref: STRING, quote: STRING>>, model STRING, usd DOUBLE",
    "suggestions": "observation_id STRING, summary STRING, rationale STRING, patch_sketch STRING, confidence DOUBLE, citations ARRAY<STRUCT<type: STRING, ref: STRING, quote: STRING>>",
    "symbols": "repo STRING, fqn STRING, kind STRING, file STRING, line_start INT, line_end INT, lang STRING",
    "call_edges": "repo STRING, caller STRING, callee STRING",
    "norms": "repo STRING, id STRING, statement STRING, scope STRING, support INT, distinct_reviewers INT, confidence DOUBLE, evidence_prs ARRAY<INT>, source STRING, quote STRING, evidence ARRAY<STRUCT<pr: INT, url: STRING, `where`: STRING>>, clustered_by STRING, named_by STRING, embedding ARRAY<FLOAT>",
    "review_comments": "repo STRING, comment_key STRING, pr_number INT, reviewer_login STRING, body STRING, path STRING, html_url STRING, created_at STRING, enforced BOOLEAN",
    "brain_state": "repo STRING, harvested_through STRING, built_at DOUBLE, comments INT, enforced INT, note STRING",
    "atlases": "repo STRING, sha STRING, built_at DOUBLE, payload STRING",
    "llm_spend": "ts DOUBLE, run_id STRING, repo STRING, model STRING, stage STRING, input_tokens BIGINT, output_tokens BIGINT, cache_read_tokens BIGINT, cache_write_tokens BIGINT, usd DOUBLE, cached BOOLEAN",
    "events": "seq BIGINT, ts DOUBLE, run_id STRING, repo STRING, type STRING, payload STRING",
    "charters": "repo STRING, sha STRING, number INT, name STRING, summary STRING, claims ARRAY<STRUCT<kind: STRING, text: STRING, source: STRING>>, version STRING, license STRING, toolchain STRING, entry_points ARRAY<STRING>, modules ARRAY<STRUCT<module: STRING, doc: STRING, source: STRING>>, public_api ARRAY<STRING>, dependencies ARRAY<STRING>, standards ARRAY<STRING>, built_at DOUBLE",
    "charter_changes": "repo STRING, from_sha STRING, to_sha STRING, level STRING, signals ARRAY<STRUCT<kind: STRING, level: STRING, detail: STRING, evidence: STRING>>, created_at DOUBLE",
    "notifications": "id STRING, repo STRING, kind STRING, level STRING, sha STRING, title STRING, body STRING, created_at DOUBLE, acknowledged_at DOUBLE",
    "schema_version": "version INT",
    "files": "repo STRING, sha STRING, path STRING, content STRING",
    "file_facts": "path STRING, language STRING, loc INT, is_test BOOLEAN, bytes BIGINT",
    "commits": "commit STRING, author STRING, path STRING",
    "test_results": "run_id STRING, side STRING, nodeid STRING, status STRING",
    "side_outcomes": "run_id STRING, side STRING, outcome STRING, duration_s DOUBLE, peak_rss_mb INT",
    "log_lines": "stream STRING, seq INT, offset_ms INT, text STRING",
    "samples": "job_id STRING, offset_ms INT, cpu_pct DOUBLE, rss_mb INT, pids INT",
}

# States in order, and those that end a run.
RUN_STATES = ("queued", "preparing", "image_build", "base_run", "head_run", "probing", "adjudicating", "rendering", "done")
TERMINAL_STATES = ("done", "failed", "cancelled")
LEVELS = ("none", "minor", "notable", "major")
# How severe each kind of finding is.
SEVERITY = {
    "behavior_change": 1.0,
    "test_removed": 0.7,
    "api_change": 0.8,
    "coverage_gap": 0.5,
    "lint_regression": 0.3,
    "timeout": 0.9,
    "oom": 0.9,
    "install_failed": 0.6,
    "collection_error": 0.7,
}
ASSESSMENTS = ("intended", "likely_unintended", "needs_review", "misleading")
CLAIM_KINDS = ("summary", "purpose", "capability", "target", "constraint")
CITATION_TYPES = ("norm", "test", "diff", "code")


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def literal_map(values: dict) -> Column:
    """A dict as a map column."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def ordinal(level: Column, order: tuple[str, ...] = LEVELS) -> Column:
    """Place in an ordered enumeration; null if it is not in it."""
    return F.try_element_at(literal_map({v: i for i, v in enumerate(order)}), level)


def violations(df: DataFrame, table: str) -> DataFrame:
    """df with a column `reject_reason`, null for rows that keep the record's rules."""
    between = lambda c: F.col(c).between(0.0, 1.0)
    rules: dict[str, list[tuple[Column, str]]] = {
        "observations": [
            (~between("confidence"), "confidence outside 0..1"),
            (~between("severity"), "severity outside 0..1"),
            (F.coalesce(F.trim("what_changed"), F.lit("")) == "", "what_changed is empty"),
            (F.coalesce(F.trim("how_we_know"), F.lit("")) == "", "how_we_know is empty"),
        ],
        "adjudications": [
            (F.coalesce(F.size("citations"), F.lit(0)) < 1, "no citation"),
            (~F.col("assessment").isin(*ASSESSMENTS), "unknown assessment"),
            (F.coalesce(F.trim("reasoning"), F.lit("")) == "", "reasoning is empty"),
        ],
        "suggestions": [(F.coalesce(F.size("citations"), F.lit(0)) < 1, "no citation"), (~between("confidence"), "confidence outside 0..1")],
        "claims": [(~F.col("kind").isin(*CLAIM_KINDS), "unknown kind"), (~F.col("source").contains(":"), "source has no line")],
        "citations": [(~F.col("type").isin(*CITATION_TYPES), "unknown type"), (F.coalesce(F.trim("ref"), F.lit("")) == "", "ref is empty")],
    }
    reason = F.lit(None).cast("string")
    for bad, why in reversed(rules[table]):
        reason = F.when(bad, F.lit(why)).otherwise(reason)
    return df.withColumn("reject_reason", reason)


def validated(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the rules, and the rest with the reason."""
    marked = violations(df, table)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")
