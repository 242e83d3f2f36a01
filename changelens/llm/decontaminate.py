"""Benchmark decontamination: a broadcast set of normalised benchmark n-grams.

Texts are lower-cased (A-Z only) and cut into words of digits, letters and
characters beyond ASCII. A benchmark item gives all its windows of `window`
words; an item with fewer words, but not none, is one window. A training text's
windows are looked up by their numbers for words, so a hit is the very words and
no hash of them. Every word inside an occurrence is hit.

The benchmark is broadcast only up to BLOCK_BYTES of text, as packed arrays of about
five times that; a larger one is dealt into blocks of about that size, the documents
are scanned once for each block, and what is carried on are the spans of hit texts.

Cases: a null or empty text has no words and no hits; an item with null text or
no words has no windows; an item with a null id marks words but is not counted.
Very long texts are scanned whole. Repeated documents get the same result each;
repeated items count once for each distinct id. An empty benchmark hits
nothing; an empty document table gives no rows. Further columns are ignored by
find_hits() and kept by remove().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_rows, spare, written

#: Text bytes of the benchmark that are broadcast at once.
BLOCK_BYTES = 16 << 20

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbours."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for j in range(n):
        out = (out ^ ids[j : j + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Grams:
    """Windows of a block of benchmark items, by numbers for words: for each length the
    windows' sorted hashes, where they begin, and whose they are."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.number: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        parts: list[np.ndarray] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        at = 0
        for k, (_, text) in enumerate(items):
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)], np.int32)
            n = min(window, len(ids))
            if n:
                h, first = np.unique(_hashes(ids, n), return_index=True)
                found.setdefault(n, []).append((h, first + at, np.full(len(h), k, np.int32)))
                parts.append(ids)
                at += len(ids)
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, rows in found.items():
            h, start, item = (np.concatenate(x) for x in zip(*rows))
            order = np.argsort(h, kind="stable")
            self.by_length[n] = (h[order], start[order], item[order])

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words (from, to), merged and in order; ids of the items."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in ws], np.int32)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        spans: list[tuple[int, int]] = []
        items: set = set()
        for n, (h, start, item) in self.by_length.items():
            if len(ids) < n:
                continue
            places = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(places):
                continue
            own = _hashes(ids, n)[places]
            lo, hi = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                p = int(places[k])
                # the very words, not their hash, make a hit
                mine = ids[p : p + n]
                same = [x for x in range(int(lo[k]), int(hi[k])) if np.array_equal(self.ids[start[x] : start[x] + n], mine)]
                if same:
                    spans.append((p, p + n))
                    items.update(self.names[item[x]] for x in same)
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(bench: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    size = bench.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [(r[0], r[1]) for r in bench.where(deal == k).select("item_id", "text").distinct().toLocalIterator()]


_FOUND = "spans array<int>, items array<string>"
_FOUND_PA = [("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]


def _flat(spans: list[tuple[int, int]]) -> list[int]:
    return [x for s in spans for x in s]


def _both(grams: Grams, text: str | None, spans: list[int] | None, items: list[str] | None) -> tuple[list, list[int], list[str]]:
    """The words of a text, and its spans and items by grams and by earlier blocks."""
    ws = words(text)
    found, own = grams.hits(ws)
    if spans:
        found = merged(found + list(zip(spans[::2], spans[1::2])))
    return ws, _flat(found), sorted((own - {None}) | set(items or ()))


def _earlier(docs: DataFrame, bench: DataFrame, window: int, block_bytes: int, text_col: str) -> tuple[DataFrame, list]:
    """docs, with what all blocks of the benchmark but the last found in a text as its last
    two columns, and the last block's items. Only texts with hits are written, by a digest."""
    spark = docs.sparkSession
    key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    names = [spare(docs, "spans"), spare(docs, "items")]
    tables, last = [], None
    for items in _blocks(bench, block_bytes):
        if last is not None:
            grams = spark.sparkContext.broadcast(Grams(last, window))

            def make(grams=grams):
                return lambda r: (r[0], *_both(grams.value, r[1], None, None)[1:])

            schema = pa.schema([("tkey", pa.binary()), *_FOUND_PA])
            own = map_rows(docs.select(key.alias("tkey"), text_col), make, schema, f"tkey binary, {_FOUND}").where("size(spans) > 0")
            tables.append(written(spark, own.dropDuplicates(["tkey"]), "decontaminate"))
        last = items
    if not tables:
        return docs.select("*", *(F.lit(None).cast(t).alias(n) for n, t in zip(names, ("array<int>", "array<string>")))), last
    # a list a block
    found = reduce(DataFrame.union, tables).groupBy("tkey").agg(F.collect_list("spans").alias("s"), F.collect_list("items").alias("i"))

    def join(r):
        pairs = [p for s in r[1] for p in zip(s[::2], s[1::2])]
        return r[0], _flat(merged(pairs)), sorted({x for i in r[2] for x in i})

    schema = pa.schema([("tkey", pa.binary()), *_FOUND_PA])
    found = written(spark, map_rows(found, lambda: join, schema, f"tkey binary, {_FOUND}"), "decontaminate-found")
    for t in tables:
        dropped(spark, t)
    tkey = spare(docs, "tkey")
    found = found.select(F.col("tkey").alias(tkey), F.col("spans").alias(names[0]), F.col("items").alias(names[1]))
    out = docs.withColumn(tkey, key).join(found.hint("merge"), tkey, "left")
    return out.select(*docs.columns, *names), last


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans array<int>, items array<string>): spans are
    from, to, from, to, ... in words; items are ids as strings, sorted."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    state, last = _earlier(base, bench, window, block_bytes, "text")
    out_pa = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), *_FOUND_PA])
    grams = docs.sparkSession.sparkContext.broadcast(Grams(last, window))

    def make():
        def row(r):
            ws, spans, items = _both(grams.value, *r[1:])
            return r[0], len(ws), sum(spans[1::2]) - sum(spans[::2]), spans, items

        return row

    return map_rows(state, make, out_pa, f"doc_id long, n_words long, n_hit long, {_FOUND}")


def hit_digests(hits: DataFrame) -> DataFrame:
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_text(text: str | None, spans: list[int]) -> tuple[str | None, int]:
    """The text without the words of spans, and how many they were; what stands between
    two hit words of one span goes with them."""
    if not text:
        return text, 0
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw.lower())] if spans else []
    out, pos = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(raw[pos : at[a][0]])
        pos = at[b - 1][1]
    out.append(raw[pos:])
    return b"".join(out).decode(), sum(spans[1::2]) - sum(spans[::2])


def remove(
    docs: DataFrame,
    benchmark: DataFrame,
    mode: str = "document",
    window: int = 10,
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs without its contaminated rows (mode "document"), or with the hit spans
    cut out of the texts (mode "span"). Keeps all columns, whatever their names; rows are
    never lost in mode "span", and spans are judged on the input, whatever the blocks."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    state, last = _earlier(docs, bench, window, block_bytes, text_col)
    grams = docs.sparkSession.sparkContext.broadcast(Grams(last, window))
    at, n = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                p = b.slice(lo, 1024)
                texts, earlier = p.column(at).to_pylist(), p.column(n).to_pylist()
                spans = [_both(grams.value, t, s, None)[1] for t, s in zip(texts, earlier)]
                cols = list(p.columns)[:n]
                if mode != "document":
                    cols[at] = pa.array([clean_text(t, s)[0] for t, s in zip(texts, spans)], p.column(at).type)
                own = pa.RecordBatch.from_arrays(cols, names=p.schema.names[:n])
                yield own.filter(pa.array([not s for s in spans], pa.bool_())) if mode == "document" else own

    return state.mapInArrow(run, docs.schema)


ORACLE = """
with norm as (
  select doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
items as (
  select item_id, ws, least(10, len(ws)) as n from (
    select item_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark) where len(ws) > 0),
grams as (
  select distinct item_id, n, array_to_string(ws[i : i + n - 1], ' ') as gram
  from (select item_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as i from items)),
lens as (select distinct n from grams),
places as (
  select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as gram
  from (select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as i from norm, lens where len(ws) >= n)),
found as (select p.doc_id, p.n, p.i, g.item_id from places p join grams g on p.n = g.n and p.gram = g.gram),
hit as (
  select doc_id, count(distinct w) as n_hit
  from (select doc_id, unnest(generate_series(i, i + n - 1)) as w from found) group by 1),
its as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by 1)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit,
  coalesce(i.n_items, 0) as n_items, sha256(coalesce(i.items, '')) as items_sha256,
  coalesce(h.n_hit, 0) > 0 as contaminated
from norm d left join hit h using (doc_id) left join its i using (doc_id)
"""
