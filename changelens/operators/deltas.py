"""Differences between two sides: tests, public surface, lint, sets, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.paths import is_public, observation_id, symbol_of_nodeid
from changelens.schemas import SEVERITY, literal_map

PASSING = ("passed",)
BROKEN = ("failed", "error")


def behaviour_delta(base: DataFrame, head: DataFrame, run_id: str | None = None) -> DataFrame:
    """Tests that passed and now fail, or are gone: base/head(nodeid, status)."""
    both = base.where(F.col("status").isin(*PASSING)).select("nodeid").join(head.select("nodeid", F.col("status").alias("now")), "nodeid", "left")
    kind = F.when(F.col("now").isNull(), "test_removed").when(F.col("now").isin(*BROKEN), "behavior_change")
    own = both.withColumn("kind", kind).where("kind is not null")
    return own.select(
        observation_id(F.col("kind"), symbol_of_nodeid(F.col("nodeid")), F.col("nodeid"), None if run_id is None else F.lit(run_id)).alias("id"),
        "kind",
        symbol_of_nodeid(F.col("nodeid")).alias("symbol"),
        F.when(F.col("kind") == "test_removed", "passed before and is gone").otherwise("passed before and fails now").alias("what_changed"),
        F.col("nodeid").alias("evidence_ref"),
        F.when(F.col("kind") == "test_removed", SEVERITY["test_removed"]).otherwise(SEVERITY["behavior_change"]).alias("severity"),
        F.when(F.col("kind") == "test_removed", 0.75).otherwise(0.9).alias("confidence"),
    )


# What is said of a suite that broke as a whole.
SUITE_BROKE = {
    "timeout": "the suite did not finish within its time limit at head",
    "oom": "the suite was killed for exceeding its memory limit at head",
    "collection_error": "the suite could not be collected at head",
    "install_failed": "the environment for this repo could not be built",
}


def outcome_delta(outcomes: DataFrame) -> DataFrame:
    """Findings (id, run_id, kind, ...) of suites that broke as wholes at head and not the same way at base:
    outcomes(run_id, side, outcome, duration_s, peak_rss_mb), the last two as far as they are known."""
    have = {c: F.col(c) if c in outcomes.columns else F.lit(None) for c in ("duration_s", "peak_rss_mb")}
    side = lambda s, c: F.max(F.when(F.col("side") == s, c))
    own = outcomes.groupBy("run_id").agg(
        side("base", F.col("outcome")).alias("base"),
        side("head", F.col("outcome")).alias("kind"),
        side("head", have["duration_s"].cast("double")).alias("_s"),
        side("head", have["peak_rss_mb"].cast("long")).alias("_mb"),
    )
    own = own.where(F.col("kind").isin(*SUITE_BROKE) & ~F.col("base").eqNullSafe(F.col("kind")))
    evidence, suite = F.concat(F.lit("outcome:"), F.col("kind")), F.lit("(suite)")
    took = F.concat(F.lit("; head ran for "), F.format_string("%.1f", F.bround(F.coalesce("_s", F.lit(0.0)), 1)), F.lit("s"))
    memory = F.when(F.col("_mb") > 0, F.concat(F.lit(", peak memory "), F.col("_mb").cast("string"), F.lit(" MB"))).otherwise("")
    return own.select(
        observation_id(F.col("kind"), suite, evidence, F.col("run_id").cast("string")).alias("id"),
        "run_id",
        "kind",
        suite.alias("symbol"),
        F.element_at(literal_map(SUITE_BROKE), F.col("kind")).alias("what_changed"),
        F.concat(F.lit("base run outcome "), F.coalesce("base", F.lit("unknown")), F.lit(", head run outcome "), F.col("kind"), took, memory).alias("how_we_know"),
        evidence.alias("evidence_ref"),
        F.element_at(literal_map({k: SEVERITY[k] for k in SUITE_BROKE}), F.col("kind")).alias("severity"),
        F.lit(0.95).alias("confidence"),
        "base",
    )


def surface_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """(fqn, change): public symbols removed, added or of another kind."""
    b = base.where(is_public(F.col("fqn"))).select("fqn", F.col("kind").alias("was"))
    h = head.where(is_public(F.col("fqn"))).select("fqn", F.col("kind").alias("now"))
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "changed")
    return b.join(h, "fqn", "full_outer").select("fqn", change.alias("change"), "was", "now").where("change is not null")


def signature_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """As surface_delta, by signature, and no part of a name may begin with `_`."""
    b = base.where(is_public(F.col("fqn"), strict=True)).select("fqn", F.col("signature").alias("was"))
    h = head.where(is_public(F.col("fqn"), strict=True)).select("fqn", F.col("signature").alias("now"))
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "changed")
    return b.join(h, "fqn", "full_outer").select("fqn", change.alias("change"), "was", "now").where("change is not null")


LINT = ["path", "code", "message"]


def lint_delta(base: DataFrame, head: DataFrame, cap: int | None = 25) -> DataFrame:
    """Findings of head that base has not, whatever their lines; repeated ones stay.
    With a cap the rest of each tool (column `tool`, if there is one) is summed up in one row."""
    keys = [c for c in ("tool",) if c in head.columns]
    new = head.join(base.select(*keys, *LINT).distinct(), [*keys, *LINT], "left_anti")
    if cap is None:
        return new
    from pyspark.sql.window import Window

    new = new.select(*keys, *LINT)
    if keys:
        first = Window.partitionBy(*keys).orderBy(*LINT)
        kept = new.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= cap).drop("_n")
    else:
        kept = new.orderBy(*LINT).limit(cap)
    more = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
    note = F.format_string("%d more findings", F.col("n") - cap).alias("message")
    return kept.union(more.select(*keys, F.lit("").alias("path"), F.lit("more").alias("code"), note))


def lint_set_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    return head.select(*LINT).subtract(base.select(*LINT))


def comparable_lint(sides: DataFrame) -> DataFrame:
    """(tool, comparable, reason): a tool's findings count only if it passed on both sides."""
    ok = lambda s: F.max(F.when((F.col("side") == s) & (F.col("outcome") == "passed"), 1).otherwise(0)) == 1
    own = sides.groupBy("tool").agg(ok("base").alias("b"), ok("head").alias("h"))
    reason = F.when(~F.col("b"), "did not run at base").when(~F.col("h"), "did not run at head")
    return own.select("tool", (F.col("b") & F.col("h")).alias("comparable"), reason.alias("reason"))


def vanished(stored: DataFrame, seen: DataFrame, keys: list[str], cap: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Stored open rows that were not seen; with a cap just that many were looked at."""
    looked = seen if cap is None else seen.orderBy(*(order or [F.col(k) for k in keys])).limit(cap)
    return stored.where("state = 'open'").join(looked.select(*keys), keys, "left_anti")


def new_or_moved(current: DataFrame, known: DataFrame, keys: list[str], head: str = "head_sha") -> DataFrame:
    old = known.select(*keys, F.col(head).alias("_known"))
    return current.join(old, keys, "left").where(F.col("_known").isNull() | (F.col("_known") != F.col(head))).drop("_known")


def both_ways(before: Column, after: Column) -> Column:
    """(gone, new) of two arrays, sorted."""
    return F.struct(F.array_sort(F.array_except(before, after)).alias("gone"), F.array_sort(F.array_except(after, before)).alias("new"))


def symmetric_difference(before: Column, after: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(before, after), F.array_except(after, before)))


def deduped_in_order(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(position).alias(position))


def gated(observations: DataFrame, norms: DataFrame) -> DataFrame:
    """Only observations whose declared norm exists."""
    return observations.join(norms.select(F.col("id").alias("norm_id")).distinct(), "norm_id", "left_semi")


def all_ids(base: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """Each key of either side once."""
    return base.select(key).union(head.select(key)).distinct()
