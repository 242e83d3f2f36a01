"""What findings and citations rest on: cited lines, places of findings, related standards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changelens.functions.paths import code_reference
from changelens.functions.text import contains_quote

#: Lines of a file that are one row of the index; a citation spans two rows at most.
BLOCK = 128
#: Bytes of lines that are one task's work, on average.
TEXT_IN_TASK = 1 << 23
#: Code points of an excerpt that stands in for a quote.
EXCERPT = 200
FILE_REF = r"(?U)^([\w./-]+\.\w+):(\d+)"
DEFINITION = r"(?U)^\s*(?:async\s+)?def\s+(\w+)\b"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _plain_path(path: Column) -> Column:
    """Without empty and `.` parts."""
    return F.array_join(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), "/")


def text_parts(lines: DataFrame) -> int:
    """In how many parts lines(text, ...) are dealt, so that a part's memory does not grow with the table."""
    size = lines.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXT_IN_TASK))


def line_blocks(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """lines(side, path, line, text) as an index: (side, path, block, lines), at most BLOCK lines a row."""
    own = lines.withColumn("block", F.floor((F.col("line") - 1) / BLOCK))
    # dealt before lists are gathered, which sorts all rows of a task
    own = own.repartition(parts or text_parts(lines), "side", "path", "block")
    return own.groupBy("side", "path", "block").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("lines"))


def cited_lines(asked: DataFrame, blocks: DataFrame, parts: int | None = None) -> DataFrame:
    """asked(side, path, start, end, ...) with `excerpt`, where all lines from start to end are there.
    A span meets one block or two by equality, so that hot files can be split. Excerpts are dealt in `parts`."""
    keys = asked.columns
    at = lambda c: F.floor((F.col(c) - 1) / BLOCK)
    each = asked.withColumn("block", F.explode(F.sequence(at("start"), at("end")))).join(blocks, ["side", "path", "block"])
    own = F.filter("lines", lambda x: x["line"].between(F.col("start"), F.col("end")))
    part = F.struct("block", F.array_join(F.transform(own, lambda x: x["text"]), "\n").alias("text"))
    each = each.select(*keys, F.size(own).alias("_n"), part.alias("_part"))
    each = each.repartition(parts, *keys) if parts else each
    both = each.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sort_array(F.collect_list("_part")).alias("parts"))
    whole = both.where(F.col("n") == F.col("end") - F.col("start") + 1)
    return whole.select(*keys, F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("excerpt"))


def resolved_citations(
    citations: DataFrame, norms: DataFrame, tests: DataFrame, diff_paths: DataFrame, lines: DataFrame, claims: DataFrame | None = None
) -> DataFrame:
    """citations(type, ref, quote, ...) with `resolved`: the norm (id), test (nodeid) or changed file
    (path, the part of the reference before the first colon) is there; the cited lines(side, path,
    line, text) are there and hold the quote; or a claim of this source (claims: source, text) holds
    it. A claim's source is looked up before files. Where lines or a claim are cited
    without a quote, their beginning is the quote."""
    quote = F.coalesce("quote", F.lit(""))
    own = citations.withColumns({"ref": _stripped(F.col("ref")), "_quote": quote})
    asked = own.select("type", "ref", "_quote").distinct()

    kinds = ((norms, "norm", "id"), (tests, "test", "nodeid"), (diff_paths, "diff", "path"))
    known = [df.select(F.lit(kind).alias("type"), F.col(c).alias("key")) for df, kind, c in kinds]
    known = known[0].union(known[1]).union(known[2]).distinct()
    key = F.when(F.col("type") == "diff", F.substring_index("ref", ":", 1)).otherwise(F.col("ref"))
    there = asked.where("type <> 'code'").withColumn("key", key).join(known, ["type", "key"], "left_semi")
    there = there.select("type", "ref", "_quote", F.lit(None).cast("string").alias("_found"))

    code = asked.where("type = 'code'")
    if claims is None:
        claims = asked.sparkSession.createDataFrame([], "source STRING, text STRING")
    last = F.max_by("text", "pos") if "pos" in claims.columns else F.max("text")
    claim = claims.groupBy(F.col("source").alias("ref")).agg(last.alias("_found"))
    of_claim = code.join(claim, "ref").select("type", "ref", "_quote", "_found")
    of_file = code.join(claim.select("ref"), "ref", "left_anti").withColumn("c", code_reference(F.col("ref"))).where("c is not null")
    of_file = of_file.select("type", "ref", "_quote", "c.side", _plain_path(F.col("c.path")).alias("path"), "c.start", "c.end")
    parts = text_parts(lines)
    of_file = cited_lines(of_file, line_blocks(lines, parts), parts).select("type", "ref", "_quote", F.col("excerpt").alias("_found"))
    holds = (F.col("_quote") == "") | contains_quote(F.col("_found"), F.col("_quote"))
    begin = lambda c: F.substring(c, 1, EXCERPT)
    of_claim = of_claim.where(holds).withColumn("_found", begin(F.col("_found")))
    of_file = of_file.where(holds).withColumn("_found", begin(_stripped(F.col("_found"))))
    good = there.union(of_claim).union(of_file).withColumn("resolved", F.lit(True))
    out = own.join(good, ["type", "ref", "_quote"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    filled = F.when((F.col("_quote") == "") & F.col("_found").isNotNull(), F.col("_found")).otherwise(F.col("quote"))
    return out.withColumn("quote", filled).select(*citations.columns, "resolved")


def observation_path(observations: DataFrame, symbols: DataFrame) -> DataFrame:
    """observations(repo, symbol, evidence_ref, ...) with `path`: of the test, of `path:line`, of what
    stands before a colon and has a slash, of the symbol's file in its repository, the symbol if
    it looks like a file, else (repo)."""
    ref = F.coalesce("evidence_ref", F.lit(""))
    first = F.substring_index(ref, ":", 1)
    from_ref = (
        F.when(ref.contains("::"), F.substring_index(ref, "::", 1))
        .when(ref.rlike(FILE_REF), F.regexp_extract(ref, FILE_REF, 1))
        .when(ref.contains(":") & first.contains("/"), first)
    )
    files = symbols.where("file <> ''").groupBy("repo", F.col("fqn").alias("symbol")).agg(F.min("file").alias("_file"))
    like = F.when(F.col("symbol").contains("/") | F.col("symbol").rlike(r"\.(py|ts|js|go)$"), F.col("symbol"))
    out = observations.join(files, ["repo", "symbol"], "left").withColumn("path", F.coalesce(from_ref, "_file", like, F.lit("(repo)")))
    return out.select(*(c for c in observations.columns if c != "path"), "path")


def definitions(lines: DataFrame) -> DataFrame:
    """(repo, path, name, line): the first line of lines(repo, path, line, text) that defines a function of the name."""
    own = lines.select("repo", "path", "line", F.regexp_extract("text", DEFINITION, 1).alias("name")).where("name <> ''")
    return own.groupBy("repo", "path", "name").agg(F.min("line").alias("line"))


def observation_line(observations: DataFrame, lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """observations(repo, path, symbol, evidence_ref, ...) with `line`: of `path:line`, of the test's
    definition without its parameters, of the symbol; each only where it is in the finding's own file."""
    ref = F.coalesce("evidence_ref", F.lit(""))
    cited = F.when(F.regexp_extract(ref, FILE_REF, 1) == F.col("path"), F.regexp_extract(ref, FILE_REF, 2).try_cast("int"))
    test = F.when(ref.contains("::"), F.substring_index(F.substring_index(ref, "::", -1), "[", 1))
    defined = definitions(lines).withColumnRenamed("line", "_t").withColumnRenamed("name", "_name")
    start = symbols.groupBy("repo", F.col("fqn").alias("symbol"), F.col("file").alias("path")).agg(F.min("line_start").alias("_s"))
    out = observations.withColumn("_name", test).join(defined, ["repo", "path", "_name"], "left").join(start, ["repo", "path", "symbol"], "left")
    return out.withColumn("line", F.coalesce(cited, "_t", "_s")).select(*(c for c in observations.columns if c != "line"), "line")


def related_norms(files: DataFrame, norms: DataFrame, limit: int = 3) -> DataFrame:
    """(path, id, score, rank): 2 for a norm seen at the path, 1 for one seen anywhere below the path's
    directory, and 0.25 for each shared token; a file at the root has no directory. files(path, tokens array),
    norms(id, places array, tokens array), both with `repo` or both without.

    A place meets directories by its own ancestors. Files of one directory with the same tokens rank alike but for the
    norms seen at their own paths, and of norms with the same tokens (of one directory, or of all) only the first `limit`
    by id can be among the best. So kinds of files meet the first norms of each set of tokens, and only then the files."""
    on = [c for c in ("repo",) if c in files.columns]
    words = lambda df, *by: df.groupBy(*by).agg(F.sort_array(F.collect_set("t")).alias("tokens"))
    above = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda n: F.array_join(F.slice("_p", F.lit(1), n), "/"))
    place = norms.select(*on, "id", F.explode("places").alias("path")).distinct()
    below = place.withColumn("_p", F.split("path", "/")).where("size(_p) > 1").select(*on, "id", F.explode(above).alias("d")).where("d <> ''").distinct()
    said = words(norms.select(*on, "id", F.explode_outer("tokens").alias("t")), *on, "id")
    own = files.withColumn("d", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")))
    own = words(own.select(*on, "path", "d", F.explode_outer("tokens").alias("t")), *on, "path", "d")
    kind = own.select(*on, "d", "tokens").distinct()
    first = lambda df, order, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")
    each = lambda df: df.withColumn("t", F.explode("tokens"))
    w = (F.count(F.lit(1)) * 0.25).alias("w")
    # by tokens alone, whatever the directory
    anywhere = each(first(said, ["id"], *on, "tokens")).select(*on, "id", "t")
    shared = each(kind.select(*on, "tokens").distinct()).join(anywhere, [*on, "t"]).groupBy(*on, "tokens", "id").agg(w)
    shared = first(shared, [F.desc("w"), "id"], *on, "tokens")
    shared = kind.join(shared, [*on, "tokens"]).select(*on, "d", "tokens", "id", F.col("w").alias("score"))
    # by tokens within the directory, and by the directory alone
    inside = each(first(below.join(said, [*on, "id"]), ["id"], *on, "d", "tokens")).select(*on, "d", "id", "t")
    both = each(kind).join(inside, [*on, "d", "t"]).groupBy(*on, "d", "tokens", "id").agg(w)
    both = both.select(*on, "d", "tokens", "id", (F.col("w") + 1).alias("score"))
    near = kind.join(first(below, ["id"], *on, "d"), [*on, "d"]).select(*on, "d", "tokens", "id", F.lit(1.0).alias("score"))
    of_kind = shared.union(both).union(near).groupBy(*on, "d", "tokens", "id").agg(F.max("score").alias("score"))
    # the directory of root files is null: a null key meets none, so it has a name no directory has
    named = lambda df: df.withColumn("d", F.coalesce("d", F.lit("")))
    of_kind = first(of_kind, [F.desc("score"), "id"], *on, "d", "tokens")
    met = named(own).join(named(of_kind), [*on, "d", "tokens"]).select(*on, "path", "id", "score")
    exact = own.join(place, [*on, "path"]).join(said.withColumnRenamed("tokens", "_t"), [*on, "id"])
    exact = exact.select(*on, "path", "id", (F.size(F.array_intersect("tokens", "_t")) * 0.25 + 2).alias("score"))
    out = met.union(exact).groupBy(*on, "path", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*on, "path").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
