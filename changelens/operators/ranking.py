"""Scores, ranks and top lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changelens.schemas import literal_map, ordinal

# Weights of a finding by relevance, and of a norm by scope.
RELEVANCE_WEIGHT = {"core": 1.0, "supporting": 0.75, "peripheral": 0.4}
SCOPE_WEIGHT = {"repo": 1.0, "module": 0.8, "project": 0.6}
# Which kind of change explains an update best, best first.
HEADLINE_ORDER = (
    "purpose", "toolchain", "entry_points", "public_api_removed", "license",
    "modules_removed", "version", "non_goals", "constraints", "dependencies_removed",
    "public_api_added", "modules_added", "dependencies_added", "standards",
)


def centrality(callers: Column, widest: Column) -> Column:
    return F.when(F.coalesce(widest, F.lit(0)) == 0, 0.5).otherwise(0.5 + 0.5 * callers / widest)


def centrality_v1(callers: Column, widest: Column) -> Column:
    return F.when(F.coalesce(widest, F.lit(0)) == 0, 1.0).otherwise((1 + callers) / (1 + widest))


def centrality_rank(edges: DataFrame, callee: str, caller: str) -> DataFrame:
    """(symbol, callers, centrality) for each callee; the widest is of the whole graph."""
    counts = edges.groupBy(F.col(callee).alias("symbol")).agg(F.countDistinct(caller).alias("callers"))
    widest = counts.agg(F.max("callers").alias("widest"))  # one row
    return counts.crossJoin(F.broadcast(widest)).select(
        "symbol", "callers", F.round(centrality(F.col("callers"), F.col("widest")), 6).alias("centrality")
    )


def ranked(observations: DataFrame, callers: DataFrame) -> DataFrame:
    """rank_score = severity x confidence x centrality x relevance, rounded before sorting."""
    widest = callers.agg(F.max("callers").alias("_w"))
    own = observations.join(callers.select(F.col("callee").alias("symbol"), "callers"), "symbol", "left").crossJoin(F.broadcast(widest))
    weight = F.coalesce(F.try_element_at(literal_map(RELEVANCE_WEIGHT), F.col("relevance")), F.lit(1.0))
    score = F.col("severity") * F.col("confidence") * centrality(F.coalesce("callers", F.lit(0)), F.col("_w")) * weight
    return own.withColumn("rank_score", F.round(score, 6)).drop("callers", "_w").orderBy(F.desc("rank_score"), "id")


def ranked_v1(findings: DataFrame, callers: DataFrame, norms: DataFrame) -> DataFrame:
    own = findings.join(callers.select(F.col("callee").alias("symbol"), "callers"), "symbol", "left").fillna(0, ["callers"])
    widest = own.agg(F.max("callers").alias("_w"))
    own = own.crossJoin(F.broadcast(widest)).join(norms.select(F.col("id").alias("norm_id"), "scope"), "norm_id", "left")
    weight = F.coalesce(F.try_element_at(literal_map(SCOPE_WEIGHT), F.col("scope")), F.lit(1.0))
    score = F.col("severity") * F.col("confidence") * centrality_v1(F.col("callers"), F.col("_w")) * weight
    return own.withColumn("score", score).drop("callers", "_w", "scope").orderBy(F.desc("score"), "symbol", "kind", "how_we_know")


def demoted(observations: DataFrame, adjudications: DataFrame) -> DataFrame:
    bad = adjudications.where("assessment = 'misleading'").select(F.col("observation_id").alias("id")).distinct().withColumn("_m", F.lit(True))
    own = observations.join(bad, "id", "left")
    return own.withColumn("confidence", F.when(F.col("_m"), F.round(F.col("confidence") * 0.5, 4)).otherwise(F.col("confidence"))).drop("_m")


def hotspots(modules: DataFrame, limit: int = 12) -> DataFrame:
    """modules(name, loc, files, test_files, commits, authors): much changed, large, untested."""
    widest = modules.agg(F.max("commits").alias("_c"), F.max("loc").alias("_l"))  # one row
    own = modules.where("files > 0").crossJoin(F.broadcast(widest))
    churn = F.col("commits") / F.when(F.col("_c") > 0, F.col("_c")).otherwise(1)
    size = F.col("loc") / F.when(F.col("_l") > 0, F.col("_l")).otherwise(1)
    bare = 1.0 - F.col("test_files") / F.col("files")
    own = own.withColumn("_s", churn * size * bare).where("_s > 0")
    return (
        own.select(
            "name",
            F.round("_s", 4).alias("score"),
            F.round(churn, 3).alias("churn_factor"),
            F.round(size, 3).alias("size_factor"),
            F.round(bare, 3).alias("untested_factor"),
            "commits",
            "loc",
            "authors",
        )
        .orderBy(F.desc("score"), F.desc("loc"), "name")
        .limit(limit)
    )


def headline(signals: DataFrame, by: list[str]) -> DataFrame:
    """The signal of the highest level that explains best."""
    top = Window.partitionBy(*by)
    own = signals.withColumn("_o", ordinal(F.col("level"))).withColumn("_t", F.max("_o").over(top)).where("_o = _t")
    place = F.coalesce(F.try_element_at(literal_map({k: i for i, k in enumerate(HEADLINE_ORDER)}), F.col("kind")), F.lit(99))
    rest = [c for c in signals.columns if c not in by]
    return own.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(place, F.col("kind"))).alias("_r")).select(*by, "_r.*")


def touched_first(symbols: DataFrame, limit: int = 5) -> DataFrame:
    return symbols.orderBy(F.desc("touched"), "fqn").limit(limit)


def public_surface(symbols: DataFrame, limit: int = 400) -> DataFrame:
    from changelens.functions.paths import is_public

    return symbols.where(is_public(F.col("fqn"), strict=True)).orderBy("fqn").limit(limit)


def toolchain(markers: DataFrame, known: DataFrame) -> DataFrame:
    """(repo, toolchain): markers(repo, file, depth) against known(toolchain, pos, file); a
    marker at the root is worth 2, one level down 1; nothing found is generic."""
    worth = F.when(F.col("depth") == 0, 2).when(F.col("depth") == 1, 1).otherwise(0)
    score = markers.join(known, "file").groupBy("repo", "toolchain", "pos").agg(F.sum(worth).alias("s")).where("s > 0")
    best = score.groupBy("repo").agg(F.max_by("toolchain", F.struct("s", -F.col("pos"))).alias("toolchain"))
    return markers.select("repo").distinct().join(best, "repo", "left").fillna("generic", ["toolchain"])


# Where in the code a finding's link points.
PLACE = ("file", "line_start", "line_end", "url", "excerpt")
LINK = "pr INT, run STRING, log_line INT, declared BOOLEAN, evidence_urls MAP<STRING, STRING>, file STRING, line_start INT, line_end INT, url STRING, excerpt STRING"


def finding_rows(observations: DataFrame, nodes: dict[str, str], links: DataFrame | None = None) -> DataFrame:
    """Findings of a report in order: f0, f1, ... A run has a few hundred at most. links(run_id, id, node, and the
    columns of LINK as far as they are known) say for findings where they come from: their node comes
    before that of the finding's kind, and their place becomes `where`."""
    w = Window.partitionBy("run_id").orderBy(F.desc("rank_score"), "id")
    own = observations.withColumn("_n", F.row_number().over(w) - 1)
    node = F.try_element_at(literal_map(nodes), F.col("kind"))
    if links is not None:
        kinds = dict(part.strip().split(" ", 1) for part in re.split(r",\s(?=\w+ )", LINK))
        known = [F.col(c).cast(k) if c in links.columns else F.lit(None).cast(k) for c, k in kinds.items()]
        their = F.col("node") if "node" in links.columns else F.lit(None).cast("string")
        link = links.select("run_id", "id", their.alias("_node"), *(k.alias(f"_{c}") for c, k in zip(kinds, known)))
        own = own.join(link, ["run_id", "id"], "left").withColumn("where", F.struct(*(F.col(f"_{c}").alias(c) for c in PLACE)))
        own = own.withColumns({c: F.col(f"_{c}") for c in kinds if c not in PLACE})
        node = F.coalesce("_node", node)
    own = own.withColumn("node", node).withColumn("id", F.concat(F.lit("f"), F.col("_n").cast("string")))
    own = own.withColumns({c: F.round(c, 4) for c in ("confidence", "severity") if c in own.columns})
    return own.drop(*(c for c in own.columns if c.startswith("_")))

