"""Paths, modules, names, identifiers, money and outcomes as column expressions."""

from __future__ import annotations

import re
from fnmatch import translate

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens.schemas import RUN_STATES, TERMINAL_STATES, literal_map, ordinal

# Language by file extension.
LANGUAGES = {
    ".py": "Python", ".pyi": "Python",
    ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".ts": "TypeScript", ".tsx": "TypeScript",
    ".go": "Go", ".rs": "Rust", ".java": "Java", ".kt": "Kotlin", ".rb": "Ruby",
    ".c": "C", ".h": "C", ".cc": "C++", ".cpp": "C++", ".hpp": "C++",
    ".cs": "C#", ".php": "PHP", ".swift": "Swift", ".scala": "Scala",
    ".sh": "Shell", ".bash": "Shell",
    ".sql": "SQL", ".html": "HTML", ".css": "CSS", ".scss": "CSS",
    ".md": "Markdown", ".rst": "Markdown",
    ".yml": "Config", ".yaml": "Config", ".toml": "Config", ".json": "Config", ".ini": "Config",
}

# Directories that hold no source of the repository itself.
SKIPPED_DIRECTORIES = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "env",
    ".tox", ".nox", "dist", "build", "target", "vendor", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", ".idea", ".vscode", "site-packages", ".next", ".cache", "coverage",
    "htmlcov", ".gradle", "Pods",
)
TEST_DIRECTORIES = ("test", "tests", "__tests__", "spec", "specs")

# Roots outside the product itself.
PERIPHERAL_ROOTS = (
    "tests/", "test/", "testing/", "docs/", "doc/", "examples/", "example/",
    "benchmarks/", "bench/", ".github/", "scripts/", "tools/", "ci/",
)


def language_of(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    return F.coalesce(F.try_element_at(literal_map(LANGUAGES), extension), F.lit("Other"))


def module_of(path: Column, depth: int = 2) -> Column:
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.size(dirs) == 0, "(root)").otherwise(F.array_join(F.slice(dirs, 1, depth), "/"))


def is_test(path: Column, globs: tuple[str, ...] = ()) -> Column:
    low = F.lower(path)
    out = F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, TEST_DIRECTORIES)))
    for g in globs:
        pattern = re.sub(r"\\[zZ]$", "", translate(g.lower())).replace("(?>", "(?:")
        out = out | low.rlike(f"^{pattern}$")
    return out


def is_skipped(path: Column) -> Column:
    """Whether a directory on the path is not walked into."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(*SKIPPED_DIRECTORIES) | (d.startswith(".") & (d != ".github")))


def is_public(fqn: Column, strict: bool = False) -> Column:
    """No part begins with `_`; unless strict, the first part may."""
    parts = F.split(fqn, r"\.")
    own = parts if strict else F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    return ~F.exists(own, lambda x: x.startswith("_"))


def is_peripheral(path: Column, symbol: Column) -> Column:
    pattern = "^(" + "|".join(re.escape(r) for r in PERIPHERAL_ROOTS) + ")"
    return F.coalesce(path.rlike(pattern), F.lit(False)) | F.coalesce(symbol.rlike(pattern), F.lit(False))


def module_fqn(path: Column, root_is_package: Column, root_name: Column) -> Column:
    """Dotted module name of a Python file below a root."""
    dotted = F.replace(F.regexp_replace(path, r"\.pyi?$", ""), F.lit("/"), F.lit("."))
    dotted = F.regexp_replace(dotted, r"(^|\.)__init__$", "")
    return F.when(root_is_package, F.concat_ws(".", root_name, F.nullif(dotted, F.lit("")))).otherwise(dotted)


def symbol_of_nodeid(nodeid: Column) -> Column:
    """What follows the first `::`, dotted; the whole where nothing does."""
    rest = F.regexp_extract(nodeid, r"(?s)^.*?::(.*)$", 1)
    return F.coalesce(F.nullif(F.replace(rest, F.lit("::"), F.lit(".")), F.lit("")), nodeid)


def path_of_evidence(ref: Column) -> Column:
    ref = F.coalesce(ref, F.lit(""))
    return F.when(ref.contains("::"), F.substring_index(ref, "::", 1)).otherwise(F.substring_index(ref, ":", 1))


def strip_container(path: Column, prefix: str = "/src") -> Column:
    return F.ltrim(F.regexp_replace(path, "^" + re.escape(prefix) + "/?", ""), F.lit("/"))


def within_module(candidate: Column, module: Column) -> Column:
    return F.coalesce(
        F.contains(F.concat(F.lit("."), candidate, F.lit(".")), F.concat(F.lit("."), module, F.lit("."))) & (candidate != ""), F.lit(False)
    )


def common_root(paths: Column) -> Column:
    """The directories all paths begin with."""
    parts = F.transform(paths, lambda p: F.split(p, "/"))
    both = lambda a, b: F.slice(
        a,
        F.lit(1),
        F.coalesce(
            F.nullif(F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False), F.lit(0)).cast("int") - 1, F.size(a)
        ),
    )
    return F.array_join(F.reduce(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.element_at(parts, 1), both), "/")


# ---- identifiers ------------------------------------------------------------


def joined_hash(*parts: Column, length: int = 16) -> Column:
    """The first hex digits of SHA-256 over parts joined by NUL."""
    zero = F.decode(F.unhex(F.lit("00")), "UTF-8")
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, zero, p)
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, length)


def observation_id(kind: Column, symbol: Column, evidence: Column, run_id: Column | None = None) -> Column:
    own = joined_hash(kind, symbol, evidence)
    return own if run_id is None else F.concat(run_id, F.lit("-"), own)


def notification_id(repo: Column, kind: Column, sha: Column) -> Column:
    return F.concat(F.lit("n"), joined_hash(repo, kind, sha, length=20))


def comment_key(comment_id: Column, pr: Column, created: Column, body: Column) -> Column:
    own = F.concat(F.lit("h"), F.substring(F.sha1(F.concat_ws("|", pr.cast("string"), created, body).cast("binary")), 1, 16))
    return F.coalesce(F.nullif(comment_id, F.lit(0)).cast("string"), own)


def content_key(**parts: Column) -> Column:
    """SHA-256 of the parts as JSON, in the order of their names."""
    named = F.struct(*(parts[name].alias(name) for name in sorted(parts)))
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}).cast("binary"), 256)


def time_ordered_id(epoch_ms: Column) -> Column:
    """Crockford base 32 of milliseconds, ten digits, sortable as text."""
    digits = F.lit("0123456789ABCDEFGHJKMNPQRSTVWXYZ")
    places = [F.substring(digits, (F.shiftright(epoch_ms.cast("long"), 5 * k).bitwiseAND(F.lit(31).cast("long")) + 1).cast("int"), F.lit(1)) for k in range(9, -1, -1)]
    return F.concat(*places)


# ---- money ------------------------------------------------------------------

CACHE_READ = 0.1
CACHE_WRITE = {"5m": 1.25, "1h": 2.0}


def usd_cost(inputs: Column, outputs: Column, cache_read: Column, cache_write: Column, price_in: Column, price_out: Column, ttl: str = "5m") -> Column:
    """Cost of a call in USD, prices being for a million tokens; 0 without prices."""
    usd = (inputs * price_in + cache_write * price_in * CACHE_WRITE.get(ttl, 1.25) + cache_read * price_in * CACHE_READ + outputs * price_out) / 1_000_000
    return F.coalesce(F.round(usd, 6), F.lit(0.0))


def worst_case_usd(chars: Column, max_tokens: Column, price_in: Column, price_out: Column, ttl: str = "5m") -> Column:
    tokens = F.floor(chars / 3) + 64
    return F.round((tokens * price_in * max(1.0, CACHE_WRITE.get(ttl, 1.25)) + max_tokens * price_out) / 1_000_000, 6)


def estimated_tokens(text: Column) -> Column:
    return F.when(F.char_length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)))


def confidence(support: Column, reviewers: Column) -> Column:
    return F.least(F.lit(1.0), support / 10) * F.least(F.lit(1.0), reviewers / 4)


def day_start(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def iso_instant(text: Column) -> Column:
    """A timestamp from ISO-8601 text, null where it is none."""
    return F.try_to_timestamp(text)


# ---- outcomes and states ----------------------------------------------------


def outcome_v2(exit_code: Column, ok_codes: tuple[int, ...] = ()) -> Column:
    out = F.when(exit_code == 124, "timeout").when(exit_code == 137, "oom").when(exit_code == 125, "install_failed").when(exit_code == 0, "passed")
    if ok_codes:  # a tool that ran and found things has done its work
        return out.when(exit_code.isin(*ok_codes), "passed").otherwise("failed")
    return out.when(exit_code == 2, "collection_error").otherwise("failed")


def outcome_v1(exit_code: Column) -> Column:
    return (
        F.when(exit_code == 0, "passed")
        .when(exit_code == 1, "failed")
        .when(exit_code == 2, "collection_error")
        .when(exit_code == 124, "timeout")
        .when(exit_code == 137, "oom")
        .otherwise("failed")
    )


def can_transition(current: Column, target: Column) -> Column:
    forward = ordinal(target, RUN_STATES) > ordinal(current, RUN_STATES)
    return F.when(current.isin(*TERMINAL_STATES), False).when(target.isin("failed", "cancelled"), True).otherwise(F.coalesce(forward, F.lit(False)))


def progress(state: Column) -> Column:
    place = ordinal(state, RUN_STATES) / (len(RUN_STATES) - 1)
    return F.when(state.isin(*TERMINAL_STATES), 1.0).otherwise(F.coalesce(place, F.lit(0.0)))


def is_safe_revision(rev: Column) -> Column:
    return (rev != "") & ~rev.startswith("-") & ~rev.contains("\u0000") & ~F.exists(F.split(rev, "/"), lambda x: x == "..")


def code_reference(ref: Column) -> Column:
    """side, path, start and end of `side:path:start-end`; null where it is not allowed."""
    pattern = r"^(?:(base|head):)?(.+?):(\d+)(?:-(\d+))?$"
    g = lambda n: F.regexp_extract(ref, pattern, n)
    start = g(3).try_cast("int")
    end = F.coalesce(F.nullif(g(4), F.lit("")).try_cast("int"), start)
    ok = (start >= 1) & (end >= start) & (end - start <= 120) & ~g(2).startswith("/") & ~F.exists(F.split(g(2), "/"), lambda x: x == "..")
    return F.when(
        ok, F.struct(F.coalesce(F.nullif(g(1), F.lit("")), F.lit("head")).alias("side"), g(2).alias("path"), start.alias("start"), end.alias("end"))
    )
