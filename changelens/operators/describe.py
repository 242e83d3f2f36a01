"""Self-descriptions from source trees: what manifests, prose and modules state, put together
as one row a repository. files(repo, path, content) holds whole trees."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changelens.functions.text import markdown_clean
from changelens.operators.charter import CLAIM_CAPS, blocks, first_known, readme_claims, standards
from changelens.operators.sequences import capped_claims
from changelens.sources import metadata

# Files of prose in their order, and directories that are no part of a product.
README_FILES = ("README.md", "README.rst", "README.txt", "README", "readme.md", "Readme.md")
GUIDANCE_FILES = ("CONTRIBUTING.md", "docs/CONTRIBUTING.md", ".github/CONTRIBUTING.md", "CLAUDE.md", "AGENTS.md")
BESIDE = ("tests", "test", "docs", "examples", "benchmarks")
LEAST_DOC, MOST_MODULES = 8, 60

#: Claims are ordered by what states them, then by place; a shift leaves room for both.
_README, _GUIDANCE, _MODULES = len(metadata.MANIFESTS), len(metadata.MANIFESTS) + 1, len(metadata.MANIFESTS) + 1 + len(GUIDANCE_FILES)
CLAIMS = ("repo", "source_no", "pos", "kind", "text", "source")


def _first_line(source: str) -> str:
    try:
        doc = ast.get_docstring(ast.parse(source)) or ""
    except (SyntaxError, ValueError, RecursionError):
        return ""
    return doc.strip().partition("\n")[0].strip()


def module_docs(files: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(repo, pos, module, doc, source): the first line of what each top-level module says
    about itself, of eight characters at least, 60 a repository: each root's own, those of its
    packages, then its files. Broken files say nothing."""
    roots = metadata.package_roots(files, BESIDE) if roots is None else roots
    below = F.regexp_replace("path", r"/[^/]+$", "")
    name = F.substring_index("path", "/", -1)
    own = files.where(F.col("path").endswith(".py")).select(F.col("repo").cast("string").alias("repo"), "path", "content")
    own = own.withColumn("_d", below).withColumn("_up", F.regexp_replace(below, r"/[^/]+$", "")).withColumn("_init", name == "__init__.py")
    # a file belongs to the root it stands in, or, as a package, to the root above it
    places = F.array(F.struct(F.col("_d").alias("root"), F.when(F.col("_init"), 0).otherwise(2).alias("rank")), F.struct(F.when(F.col("_init") & (F.col("_up") != F.col("_d")), F.col("_up")).alias("root"), F.lit(1).alias("rank")))
    own = own.select("repo", "path", "content", F.inline(places)).join(roots.select(F.col("repo").cast("string").alias("repo"), "root"), ["repo", "root"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.drop(columns="content").assign(doc=[_first_line(c or "") for c in f["content"]])

    said = own.select("repo", "root", "rank", "path", "content").mapInPandas(run, "repo STRING, root STRING, rank INT, path STRING, doc STRING")
    said = said.where(F.char_length("doc") >= LEAST_DOC)
    said = said.withColumn("pos", F.row_number().over(Window.partitionBy("repo").orderBy("root", "rank", "path"))).where(F.col("pos") <= MOST_MODULES)
    up = F.regexp_replace("root", r"[^/]+$", "")
    dotted = F.replace(F.regexp_replace(F.substring("path", F.char_length(up) + 1, F.char_length("path")), r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))
    return said.select("repo", "pos", dotted.alias("module"), markdown_clean(F.col("doc")).alias("doc"), F.concat("path", F.lit(":1")).alias("source"))


def _prose(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims of each repository's first readme that is not empty, and of all its guidance."""
    rank = F.array_position(F.array(*map(F.lit, README_FILES)), F.col("path"))
    readme = files.where(F.col("path").isin(*README_FILES) & (F.col("content") != "")).groupBy("repo").agg(F.min_by(F.struct("path", "content"), rank).alias("f"))
    readme = readme.select("repo", "f.path", F.col("f.content").alias("text"))
    said = readme_claims(readme.select("repo", "text"), "repo", "").withColumnRenamed("owner", "repo").join(readme.select("repo", "path"), "repo")
    said = said.select("repo", F.lit(_README).alias("source_no"), "pos", "kind", "text", F.concat("path", "source").alias("source"))
    no = F.array_position(F.array(*map(F.lit, GUIDANCE_FILES)), F.col("path")).cast("int")
    guides = files.where(F.col("path").isin(*GUIDANCE_FILES)).select(F.concat_ws("\n", "repo", "path").alias("key"), F.col("content").alias("text"))
    rules = blocks(guides, "key").where("is_bullet and length(text) > 20")
    rules = rules.select(F.split_part("key", F.lit("\n"), F.lit(1)).alias("repo"), F.split_part("key", F.lit("\n"), F.lit(2)).alias("path"), "pos", "text")
    rules = rules.select("repo", (no + _GUIDANCE - 1).alias("source_no"), "pos", F.lit("constraint").alias("kind"), "text", F.concat("path", F.lit(":"), (F.col("pos") + 1).cast("string")).alias("source"))
    return said, rules


def described(files: DataFrame, snapshots: DataFrame, public_api: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """A row of the charters table for each of snapshots(repo, sha, number, toolchain,
    built_at): name, version, licence and summary from the first manifest that states them,
    claims by manifest, prose and module, and sets of entry points, dependencies, standards
    and public_api(repo, symbol) names.

    Only snapshots count; one without files gets its repository's last part as its name, empty
    texts and empty lists."""
    own = files.select(F.col("repo").cast("string").alias("repo"), "path", "content").join(snapshots.select("repo").distinct(), "repo", "left_semi")
    stated = metadata.facts(own)
    docs = module_docs(own.join(snapshots.where("toolchain = 'python'").select("repo").distinct(), "repo", "left_semi"), roots)

    one = lambda field: first_known(stated.where(F.col("field") == field), ["repo"], "text", "source_no").withColumnRenamed("text", field)
    summary = stated.where("field = 'summary' and text <> ''").groupBy("repo").agg(F.min_by(F.struct("text", "source"), "source_no").alias("s"))
    summary = summary.select("repo", markdown_clean(F.col("s.text")).alias("summary"), F.col("s.source").alias("_said"))

    readme, rules = _prose(own)
    modules = docs.select("repo", F.lit(_MODULES).alias("source_no"), "pos", F.lit("capability").alias("kind"), F.concat("module", F.lit(": "), "doc").alias("text"), "source")
    manifest = stated.where(F.col("field").isin("target", "capability")).withColumnRenamed("field", "kind")
    claims = reduce(DataFrame.union, (c.select(*CLAIMS) for c in (manifest, readme, rules, modules)))
    claims = claims.withColumn("text", markdown_clean(F.col("text"))).where(F.char_length("text") >= 3)
    place = F.col("source_no").cast("long") * 2**32 + F.col("pos")
    claims = capped_claims(claims.select(F.col("repo").alias("owner"), place.alias("pos"), "kind", "text", "source"), CLAIM_CAPS)
    claims = claims.groupBy(F.col("owner").alias("repo")).agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "text", "source"))).alias("_claims"))

    entries = stated.where("field = 'entry_point'").select("repo", "text").union(metadata.go_commands(own))
    # a command without a name is called after the package, as far as it has one by then
    known = first_known(stated.where((F.col("field") == "name") & (F.col("source_no") <= 2)), ["repo"], "text", "source_no").withColumnRenamed("text", "_name")
    unnamed = stated.where("field = 'unnamed_entry_point'").select("repo", "text").join(known, "repo", "left")
    entries = entries.union(unnamed.select("repo", F.concat(F.coalesce("_name", F.lit("bin")), F.lit(" = "), "text")))
    used = metadata.package_roots(own, BESIDE) if roots is None else roots
    if roots is None:
        used = used.join(own.where("path like 'src/%'").select("repo").distinct(), "repo", "left_semi")
    main = own.where("path like '%/__main__.py'").select("repo", F.regexp_replace("path", "/__main__.py$", "").alias("root"))
    entries = entries.union(main.join(used, ["repo", "root"], "left_semi").select("repo", F.concat(F.lit("python -m "), F.substring_index("root", "/", -1))))

    def names(df: DataFrame, column: str, alias: str) -> DataFrame:
        return df.groupBy("repo").agg(F.sort_array(F.collect_set(column)).alias(alias))

    tools = stated.where("field = 'standard'").select("repo", "text").union(standards(own).select("repo", F.explode("standards")))
    module_list = docs.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("pos", "module", "doc", "source"))).alias("_modules"))
    parts = [
        one("name"), one("version"), one("license").withColumnRenamed("license", "_stated"), metadata.license_line(own).withColumnRenamed("license", "_file"), summary, claims, module_list,
        names(entries, "text", "entry_points"), names(stated.where("field = 'dependency'"), "text", "dependencies"), names(tools, "text", "standards"),
        names(public_api, "symbol", "public_api"),
    ]
    row = reduce(lambda a, b: a.join(b, "repo", "left"), parts, snapshots.select("repo", "sha", "number", "toolchain", "built_at"))
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(c, none)
    first = F.when(F.col("summary") != "", F.array(F.struct(F.lit("summary").alias("kind"), F.col("summary").alias("text"), F.col("_said").alias("source"))))
    rest = F.transform("_claims", lambda c: F.struct(c["kind"].alias("kind"), c["text"].alias("text"), c["source"].alias("source")))
    claim = "array<struct<kind: string, text: string, source: string>>"
    module = F.transform("_modules", lambda m: F.struct(m["module"].alias("module"), m["doc"].alias("doc"), m["source"].alias("source")))
    empty = F.lit("")
    return row.select(
        "repo", "sha", "number",
        F.coalesce("name", F.substring_index("repo", "/", -1)).alias("name"),
        F.coalesce("summary", empty).alias("summary"),
        F.concat(F.coalesce(first, F.array().cast(claim)), F.coalesce(rest, F.array().cast(claim))).alias("claims"),
        F.coalesce("version", empty).alias("version"),
        F.coalesce("_stated", "_file", empty).alias("license"),
        "toolchain",
        listed(F.col("entry_points")).alias("entry_points"),
        F.coalesce(module, F.array().cast("array<struct<module: string, doc: string, source: string>>")).alias("modules"),
        listed(F.col("public_api")).alias("public_api"),
        listed(F.col("dependencies")).alias("dependencies"),
        listed(F.col("standards")).alias("standards"),
        "built_at",
    )


def to_refresh(heads: DataFrame, charters: DataFrame, force: bool = False) -> DataFrame:
    """heads(repo, sha) whose description is of another commit, or all with force."""
    return heads if force else heads.join(charters.select("repo", "sha").distinct(), ["repo", "sha"], "left_anti")
