"""Fill-in-the-middle examples: texts cut into prefix, middle and suffix at unit bounds.

A pandas UDF takes Arrow batches. One finditer() pass over a text collects the end offsets
of its units in a compact array (four bytes a unit); two look-ups in it slice the text.
All randomness comes from a SHA-256 of the seed and the document's id, so that a row has
the same cuts wherever, whenever and beside whichever rows it is processed. An output says
by its sentinels where its parts are, and restored() rebuilds the text from output and form.

Forms: `psm` (prefix, suffix, middle), `spm` (suffix, prefix, middle), `plain` (the text as
it is). Plain are texts that are empty or hold a sentinel, and the share that is left out.

Cases: a null text is an empty one; a null id is an empty string in the seed. Repeated rows
are separate rows with equal results. A text of one unit has an empty part or two. Texts of
any length are taken whole; no row waits for another, so an empty table gives no rows and
there is nothing to skew. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units: runs of letters, and each other character.
UNIT = "[A-Za-z]+|[^A-Za-z]"
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"

_CUT_DDL = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """The sentinels, if an output can be taken apart again: none of them may end as another
    (or itself) begins, or hold another."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            overlap = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (i != j)))
            if not a or overlap or (i != j and a in b):
                raise ValueError(f"sentinels {a!r} and {b!r} cannot be told apart in an output")
    return tuple(sentinels)


def draws(seed: int, doc_id: str | None) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def cutter(
    seed: int = 1,
    middle_percent: int = 90,
    spm_percent: int = 20,
    sentinels: tuple[str, str, str] = SENTINELS,
    unit: str = UNIT,
) -> Callable[[str | None, str], tuple]:
    """A function of id and text that gives (n, form, prefix_chars, middle_chars, output)."""
    import regex

    p, s, m = checked(sentinels)
    units = regex.compile(unit)

    def cut(doc_id: str | None, text: str) -> tuple:
        ends = array("I", [0])
        ends.extend(x.end() for x in units.finditer(text))
        n = len(ends) - 1
        one, two, kept, order = draws(seed, doc_id)
        if not text or any(x in text for x in (p, s, m)) or kept % 100 >= middle_percent:
            return n, PLAIN, None, None, text
        low, high = sorted((one % (n + 1), two % (n + 1)))
        a, b = ends[low], ends[high]
        head, middle, tail = text[:a], text[a:b], text[b:]
        if order % 100 < spm_percent:
            return n, SPM, a, b - a, f"{s}{tail}{p}{head}{m}{middle}"
        return n, PSM, a, b - a, f"{p}{head}{s}{tail}{m}{middle}"

    return cut


def restored(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that an output of this form was made from."""
    if form == PLAIN:
        return output
    p, s, m = sentinels
    first, second = (p, s) if form == PSM else (s, p)
    begin, rest = output[len(first) :].split(second, 1)
    end, middle = rest.split(m, 1)
    return begin + middle + end if form == PSM else end + middle + begin


def restored_text(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """restored() as a column."""
    marks = checked(sentinels)

    @F.pandas_udf("string")
    def rebuild(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restored(o, f, marks) for o, f in zip(outputs, forms)], dtype=object)

    return rebuild(output, form)


def fill_in_middle(
    docs: DataFrame,
    seed: int = 1,
    middle_percent: int = 90,
    spm_percent: int = 20,
    sentinels: tuple[str, str, str] = SENTINELS,
    unit: str = UNIT,
    outputs: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256)
    for each row: n units, lengths in code points (null where plain), digests of the output
    and of the text rebuilt from it. Without `outputs` the texts stay in the task."""
    marks = checked(sentinels)

    @F.pandas_udf(_CUT_DDL)
    def cuts(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        cut = cutter(seed, middle_percent, spm_percent, marks, unit)
        rows = []
        for doc_id, text in zip(ids, texts):
            n, form, head, middle, out = cut(doc_id, text)
            digests = (hashlib.sha256(x.encode()).hexdigest() for x in (out, restored(out, form, marks)))
            rows.append((n, form, head, middle, out if outputs else None, *digests))
        names = ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256")
        frame = pd.DataFrame(rows, columns=names, dtype=object)
        return frame.astype({c: "Int64" for c in ("n", "prefix_chars", "middle_chars")})

    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), cuts(F.col(id_col).cast("string"), text).alias("x"))
    own = own.select("doc_id", "x.*")
    return own if outputs else own.drop("output")
