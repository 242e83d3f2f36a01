"""What leaves a run: the findings document, findings of recorded behaviour, spend rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.paths import usd_cost

# Version of the document, certainty and weight of a recorded behaviour that changed.
DOCUMENT_VERSION = 1
RECORDED_CONFIDENCE, RECORDED_SEVERITY = 0.9, 1.0


def broken_contract(kind: Column, what: Column, how: Column, norm: Column, node: Column) -> Column:
    """Why a finding may not be shown, null if it may."""
    gone = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(gone(what), "no what_changed")
        .when(gone(how), "no how_we_know")
        .when(norm.isNull() & ~F.coalesce(kind == "behavior_change", F.lit(False)), "no norm")
        .when(node.isNull(), "no node")
    )


def findings_document(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, document) for each of runs(run_id, profile, generated_at): JSON of its
    findings(run_id, pos, kind, symbol, what_changed, how_we_know, norm, confidence, severity,
    node) in order, numbered f0, f1, ..., with counts. A run without findings has an empty
    list; a finding that breaks its contract is an error. A document is one run's report, a
    few hundred findings."""
    why = broken_contract(*(F.col(c) for c in ("kind", "what_changed", "how_we_know", "norm", "node")))
    refused = F.raise_error(F.concat(F.lit("finding "), F.coalesce("symbol", F.lit("")), F.lit(": "), why))
    own = findings.withColumn("what_changed", F.when(why.isNotNull(), refused.cast("string")).otherwise(F.col("what_changed")))
    one = F.struct("pos", "kind", "symbol", "what_changed", "how_we_know", "norm", F.round("confidence", 4).alias("confidence"), F.round("severity", 4).alias("severity"), "node")
    by_run = own.groupBy("run_id").agg(F.array_sort(F.collect_list(one)).alias("f"), F.count("norm").alias("cited"))
    kinds = own.groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id")
    kinds = kinds.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("by_kind"))
    ddl = own.select(one.alias("x")).schema["x"].dataType.simpleString()
    rows = runs.join(by_run, "run_id", "left").join(kinds, "run_id", "left").withColumn("f", F.coalesce("f", F.array().cast(f"array<{ddl}>")))
    fields = ("kind", "symbol", "what_changed", "how_we_know", "norm", "confidence", "severity", "node")
    listed = F.transform("f", lambda x, i: F.struct(F.concat(F.lit("f"), i.cast("string")).alias("id"), *(x[c].alias(c) for c in fields)))
    n, cited = F.size("f"), F.coalesce("cited", F.lit(0))
    counts = F.struct(n.alias("findings"), F.coalesce("by_kind", F.create_map().cast("map<string, bigint>")).alias("by_kind"), cited.alias("cited"), (n - cited).alias("uncited"))
    document = F.struct(F.lit(DOCUMENT_VERSION).alias("schema"), "generated_at", "profile", listed.alias("findings"), counts.alias("counts"))
    return rows.select("run_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def recorded_findings(failed: DataFrame) -> DataFrame:
    """Findings of failed(symbol, pos, block, declared): recorded behaviour of symbols that
    no longer holds, with the failure's block as evidence; half as certain where the change
    was declared."""
    test = F.concat(F.lit("test_char_"), F.col("pos").cast("string"))
    block = F.regexp_replace(F.coalesce("block", F.lit("")), r"^\s+|\s+$", "")
    told = F.coalesce("declared", F.lit(False))
    what = F.concat("symbol", F.lit(": behaviour recorded on base no longer holds at head"), F.when(told, " (declared in the PR description)").otherwise(""))
    return failed.select(
        F.lit("behavior_change").alias("kind"),
        "symbol",
        what.alias("what_changed"),
        F.when(block != "", F.concat_ws("\n", test, block)).otherwise(test).alias("how_we_know"),
        F.when(told, RECORDED_CONFIDENCE * 0.5).otherwise(RECORDED_CONFIDENCE).alias("confidence"),
        F.lit(RECORDED_SEVERITY).alias("severity"),
    )


def spend_rows(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows of the spend table for calls(ts, run_id, repo, model, stage, input_tokens,
    output_tokens, cache_read_tokens, cache_write_tokens, cached): what was cached costs
    nothing, a model without prices(model, price_in, price_out) neither."""
    own = calls.join(prices.select("model", "price_in", "price_out"), "model", "left")
    usd = usd_cost(*(F.col(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "price_in", "price_out")))
    return own.select(*calls.columns, F.when(F.col("cached"), 0.0).otherwise(usd).alias("usd"))
