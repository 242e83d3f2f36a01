"""Text functions as column expressions: redaction, cleaning, terms, markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches are masked, in this order.
AWS_KEY_ID = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
LONG_SECRET = r"\b(?![0-9a-f]{40}\b)[A-Za-z0-9/+=]{40}\b"
BEARER = r"\bAB[A-Za-z0-9+/=]{60,}\b"
KEY_VALUE = r"(?i)\b(api[_-]?key|secret|token|password)\b\s*[:=]\s*['\"]?[A-Za-z0-9/+=_-]{12,}['\"]?"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
MASKS = (
    (AWS_KEY_ID, "[REDACTED_AWS_KEY_ID]"),
    (LONG_SECRET, "[REDACTED_SECRET]"),
    (BEARER, "[REDACTED_BEARER_TOKEN]"),
    (KEY_VALUE, "$1=[REDACTED]"),
    (EMAIL, "[REDACTED_EMAIL]"),
)

# Fixed value: how a line of a checker names its rule.
TRAILING_CODE = r"\s*\[([a-z][a-z0-9-]*)\]\s*$"

# Words that carry no topic.
STOP_WORDS = (
    "a an the this that these those is are was were be been being it its of to in on "
    "for with as at by from or and but if then than so we you i me my our your they them "
    "can could would should will just also here there please maybe might do does did "
    "not no yes have has had what which who when where why how all any some more most "
    "very too into out up about over only same new"
).split()

# Comments that only acknowledge.
ACKNOWLEDGEMENT = (
    r"(?i)^(lgtm|looks good|thanks?|thank you|done|fixed|ok(ay)?|nice|\+1|good catch|agreed|"
    r"sounds good|will do|ack|yes|no)\W*$"
)


def redact(text: Column) -> Column:
    for pattern, mask in MASKS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def squash(text: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def without_inline_code(text: Column) -> Column:
    return F.regexp_replace(text, r"`[^`]*`", " ")


def clean_comment(body: Column) -> Column:
    """The prose of a comment; '' where there is nothing to learn from."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), lambda x: ~F.ltrim(x).startswith(">"))
    prose = F.regexp_replace(F.array_join(lines, "\n"), r"(?s)```.*?```", " ")
    prose = F.regexp_replace(F.regexp_replace(prose, r"(?U)@[\w-]+", " "), r"https?://\S+", " ")
    prose = squash(prose)
    count = F.size(F.filter(F.split(squash(without_inline_code(prose)), " "), lambda w: w != ""))
    return F.when(prose.rlike(ACKNOWLEDGEMENT) | (count < 4), "").otherwise(prose)


def stems(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(without_inline_code(text)), F.lit(r"([a-z][a-z0-9_]+)"), 1)
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    return F.transform(kept, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, r"(ing|ed|es|s)$", "")).otherwise(w))


def terms(text: Column) -> Column:
    """Stems, and pairs of neighbouring stems."""
    s = stems(text)
    pairs = F.when(
        F.size(s) > 1,
        F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(1))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(s, pairs)


def slug(text: Column, prefix: str = "") -> Column:
    words = F.slice(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1), 1, 6)
    return F.concat(F.lit(prefix), F.when(F.size(words) > 0, F.array_join(words, "-")).otherwise("norm"))


def ellipsis(text: Column, most: int, keep: int | None = None, mark: str = "…") -> Column:
    keep = most if keep is None else keep
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, keep), F.lit(mark))).otherwise(text)


def first_sentence(text: Column) -> Column:
    """Up to the first end of a sentence, 200 characters at most."""
    flat = squash(text)
    found = F.regexp_extract(flat, r"^(.+?[.!?])(?:\s|$)", 1)
    return ellipsis(F.when(found != "", found).otherwise(flat), 200, 197)


def markdown_clean(text: Column) -> Column:
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]*\)", "$1")
    text = squash(F.regexp_replace(text, r"[*_`]{1,3}", ""))
    return ellipsis(F.regexp_replace(text, r":+$", ""), 300)


def contains_quote(text: Column, quote: Column) -> Column:
    """Whether a quote stands in a text, whatever the white space."""
    return F.coalesce(F.contains(squash(text), squash(quote)), F.lit(False))


def line_of(text: Column, needle: Column) -> Column:
    """Line number of the first occurrence, 1 if there is none."""
    at = F.call_function("locate", needle, text)
    before = F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0)))
    return F.when(at > 0, F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).otherwise(1)


def requirement_name(requirement: Column) -> Column:
    return F.replace(F.lower(F.regexp_extract(requirement, r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)), F.lit("_"), F.lit("-"))


def counted(count: Column, one: str, many: str) -> Column:
    """'1 way', '2 ways'."""
    return F.concat(count.cast("string"), F.when(count == 1, F.lit(" " + one)).otherwise(F.lit(" " + many)))


def sample(items: Column, limit: int = 6) -> Column:
    """The first items and how many more there are."""
    more = F.size(items) - limit
    tail = F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat(F.array_join(F.slice(items, 1, limit), ", "), tail)


def trailing_code(line: Column) -> Column:
    """('message', 'code') of a line that may end in [code]; a code is small letters, digits and dashes."""
    code = F.regexp_extract(line, TRAILING_CODE, 1)
    return F.struct(F.trim(F.regexp_replace(line, TRAILING_CODE, "")).alias("message"), code.alias("code"))


def semver(version: Column) -> Column:
    """(major, minor) of a version, null where it has none."""
    m = lambda g: F.regexp_extract(F.trim(version), r"^v?(\d+)(?:\.(\d+))?", g)
    return F.when(
        m(1) != "",
        F.struct(m(1).try_cast("int").alias("major"), F.coalesce(F.nullif(m(2), F.lit("")).try_cast("int"), F.lit(0)).alias("minor")),
    )


def citation_sentence(prs: Column) -> Column:
    return F.concat(F.lit("This repo required this in "), F.array_join(F.transform(prs, lambda p: F.concat(F.lit("#"), p.cast("string"))), ", "), F.lit("."))


def declared_names(answer: Column) -> Column:
    """Names in a bullet list: marks stripped, up to '(', none with spaces."""
    lines = F.transform(F.split(answer, r"\r?\n"), lambda x: F.trim(F.split_part(F.regexp_replace(x, r"^[\s\-*•`]+|[`\s]+$", ""), F.lit("("), F.lit(1))))
    return F.filter(lines, lambda x: (x != "") & ~x.contains(" "))
