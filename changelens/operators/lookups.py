"""Joins of findings with what explains them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changelens.functions.paths import code_reference


def with_observation(own: DataFrame, observations: DataFrame, run_id: str) -> DataFrame:
    """Adjudications or suggestions of a run that cite something."""
    ids = observations.where(F.col("run_id") == run_id).select(F.col("id").alias("observation_id"))
    return own.join(ids, "observation_id", "left_semi").where(F.size("citations") > 0)


def callers_of(edges: DataFrame, symbols: DataFrame, repo: str, callee: str, limit: int = 20) -> DataFrame:
    """Direct callers that are known symbols."""
    own = edges.where((F.col("repo") == repo) & (F.col("callee") == callee)).select(F.col("caller").alias("fqn")).distinct()
    return symbols.where(F.col("repo") == repo).join(own, "fqn", "left_semi").orderBy("fqn").limit(limit)


def report(observations: DataFrame, adjudications: DataFrame, suggestions: DataFrame, norms: DataFrame) -> DataFrame:
    a = adjudications.select(F.col("observation_id").alias("id"), F.struct("assessment", "reasoning", "citations").alias("adjudication"))
    s = suggestions.select(F.col("observation_id").alias("id"), F.struct("summary", "rationale", "patch_sketch").alias("suggestion"))
    n = norms.select(F.col("id").alias("norm_id"), F.struct("statement", "evidence_prs").alias("norm"))
    return observations.join(a, "id", "left").join(s, "id", "left").join(n, "norm_id", "left").orderBy(F.desc("rank_score"), "id")


def changed_symbols(symbols: DataFrame, spans: DataFrame, cell: int = 128) -> DataFrame:
    """Symbols whose lines overlap a changed span of their file. Both are filed under the cells of lines that they
    touch, so that in a long file only neighbours are compared."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    own = symbols.withColumn("_row", F.monotonically_increasing_id()).withColumn("_cell", cells(F.col("line_start"), F.col("line_end")))
    their = spans.select("path", "start_line", "end_line").withColumn("_cell", cells(F.col("start_line"), F.col("end_line")))
    hit = (F.col("s.file") == F.col("r.path")) & (F.col("s._cell") == F.col("r._cell")) & (F.col("s.line_start") <= F.col("r.end_line")) & (F.col("r.start_line") <= F.col("s.line_end"))
    return own.alias("s").join(their.alias("r"), hit, "left_semi").dropDuplicates(["_row"]).drop("_row", "_cell")


def lines_for(symbols: DataFrame, coverage: DataFrame) -> DataFrame:
    """(fqn, lines): a symbol's covered lines, from the first path of coverage(path, pos, lines) that ends
    with the symbol's file. Each path is filed under all its endings, and the first of each is found before
    files are looked up, so that equal file names never meet each other."""
    ends = F.transform(F.sequence(F.lit(1), F.char_length("path") + 1), lambda i: F.substring(F.col("path"), i, F.char_length("path")))
    first = coverage.select("path", "pos", F.explode(ends).alias("file")).groupBy("file").agg(F.min_by("path", "pos").alias("path"))
    own = symbols.select("fqn", "file").join(first.hint("merge"), "file").select("fqn", "path")
    once = coverage.groupBy("path").agg(F.min_by("lines", "pos").alias("lines"))
    return own.join(once, "path").select("fqn", "lines")


def coverage_gaps(symbols: DataFrame, covered: DataFrame) -> DataFrame:
    """Symbols whose file was measured (covered: fqn, lines) and of which no body line ran; body is all but
    the first line."""
    own = symbols.join(covered, "fqn").where("line_end > line_start")
    ran = F.size(F.filter(F.coalesce("lines", F.array()), lambda x: (x > F.col("line_start")) & (x <= F.col("line_end"))))
    return own.withColumn("ran", ran).where("ran = 0").drop("lines")


def attach_norms(observations: DataFrame, norms: DataFrame, by_kind: dict[str, str]) -> DataFrame:
    """norm_id by kind, only where that norm exists; what an observation has stays."""
    from changelens.schemas import literal_map

    want = F.try_element_at(literal_map(by_kind), F.col("kind")) if by_kind else F.lit(None).cast("string")
    there = norms.select(F.col("id").alias("_want")).distinct()
    own = observations.withColumn("_want", F.coalesce("norm_id", want)).join(there.withColumn("_there", F.lit(True)), "_want", "left")
    return own.withColumn("norm_id", F.when(F.col("_there"), F.col("_want")).otherwise(F.col("norm_id"))).drop("_want", "_there")


def norm_for_tool(what_changed: Column) -> Column:
    return F.concat(F.lit("declared-lint-"), F.lower(F.split_part(F.trim(what_changed), F.lit(" "), F.lit(1))))


def module_for(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """(symbol, module, doc): the longest documented module that holds the name; of
    equals the first. A name meets modules by its own dotted parts, so this is a join on equality."""
    parts = F.split("symbol", r"\.")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.transform(F.sequence(F.lit(1), F.size("_p") - i + 1), lambda n: F.array_join(F.slice("_p", i, n), "."))))
    own = symbols.select("symbol").where("symbol <> ''").distinct().withColumn("_p", parts)
    both = own.select("symbol", F.explode(F.array_distinct(runs)).alias("module")).join(modules, "module")
    return both.groupBy("symbol").agg(F.max_by(F.struct("module", "doc"), F.struct(F.length("module"), -F.col("pos"))).alias("m")).select("symbol", "m.*")


def callers_per_packet(callers: DataFrame, each: int = 5, most: int = 8) -> DataFrame:
    """(packet, caller, pos): callers(packet, observation_pos, pos, caller), at most five of
    each observation, distinct in order, eight a packet."""
    w = Window.partitionBy("packet", "observation_pos").orderBy("pos")
    own = callers.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each)
    own = own.groupBy("packet", "caller").agg(F.min(F.struct("observation_pos", "pos")).alias("_p"))
    own = own.withColumn("pos", F.row_number().over(Window.partitionBy("packet").orderBy("_p")))
    return own.where(F.col("pos") <= most).drop("_p")


def citation_url(kind: Column, ref: Column, base: str, sha: Column) -> Column:
    c = code_reference(ref)
    return (
        F.when(kind == "code", F.concat(F.lit(base + "/blob/"), sha, F.lit("/"), c["path"], F.lit("#L"), c["start"].cast("string")))
        .when(kind == "diff", F.concat(F.lit(base + "/blob/"), sha, F.lit("/"), ref))
        .when(kind == "norm", F.concat(F.lit("#norm-"), ref))
        .when(kind == "test", F.concat(F.lit(base + "/blob/"), sha, F.lit("/"), F.substring_index(ref, "::", 1)))
    )
