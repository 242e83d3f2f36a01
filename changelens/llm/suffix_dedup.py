"""Removal of repeated passages by longest-previous-factor arrays.

What is removed: every byte covered by a `length`-byte string that also starts
elsewhere (keep="none"), or that also starts earlier, by document id and place
(keep="first"). Texts are UTF-8 bytes; no match crosses documents.

A suffix array of all texts would not fit a task, so the texts are first cut into
windows that can match at all. Each window of `length` bytes is filed under the
smallest hash of the GRAM-byte strings in it; equal windows file under equal
hashes. Consecutive windows whose leftmost smallest hash stands at one place make
a segment. Then
  - a hash with one segment has no repeat and is dropped;
  - segments that are equal as wholes repeat as wholes: one stays as their
    representative, the others are repeats of it;
  - representatives that share a hash go to one task: there a suffix array over
    their bytes is built by prefix doubling, and over the array the previous and
    next smaller positions give each place's longest previous factor, and, mirrored,
    its longest later factor. A place repeats where one reaches `length`.
  - a hash with more than MOST_MEMBERS different segments (the edge of a passage that
    very many documents share) would be too much for one task: each of its windows
    becomes a row with a 128-bit hash, and windows are counted by Spark.
Nothing is capped: both ways give the same answer.

Cases: a null text is empty; texts shorter than `length` lose nothing. Very long
texts and texts that repeat themselves are handled like others. Repeated rows and
repeated or null doc_ids are told apart by a row number of a written copy; each
row counts as a document. An empty table gives no rows. Further columns are
ignored by repeats(), and kept by remove_repeats().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_rows, rows_to_batches, shuffles, spare, written

LENGTH, GRAM = 200, 32
#: Different segments of one hash that one task compares.
MOST_MEMBERS = 4_000
BLOCK = 1 << 19

_RNG = np.random.RandomState(20240229)
_TABLES = _RNG.randint(0, 2**62, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """64-bit polynomial hashes of any substring, from running sums."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data) + 1
        have = self.powers.get(which)
        if have is None or len(have[0]) < n:
            size = max(n, BLOCK * 2)
            base = _BASES[which]
            back = pow(base, -1, 2**64)
            up = np.full(size, base, np.uint64)
            down = np.full(size, back, np.uint64)
            up[0] = down[0] = 1
            have = self.powers[which] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        self.down = have[1]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_TABLES[which][data] * have[0][: n - 1], out=self.sums[1:], dtype=np.uint64)

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * self.down[lo])

    def all(self, k: int) -> np.ndarray:
        return _mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from running minima of blocks."""
    n = len(h) - w + 1
    size = -(-len(h) // w) * w
    x = np.full(size, np.uint64(2**64 - 1))
    x[: len(h)] = h
    x = x.reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).reshape(-1)
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def segments(data: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """Of texts that stand one after another in data (starts: where each begins,
    and the end): (text number, first window, last window, hash, content hash)."""
    w = length - gram + 1
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    roll = Rolling(data)
    grams = roll.all(gram)
    low = sliding_min(grams, w)
    sizes = np.diff(starts)
    long = np.flatnonzero(sizes >= length)
    inside = np.zeros(len(low) + 1, np.int8)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long] + sizes[long] - length + 1, -1)
    inside = np.cumsum(inside)[:-1] > 0
    first = np.ones(len(low), bool)
    # the leftmost smallest hash of a window stays behind: equal windows never share a segment
    first[1:] = (low[1:] != low[:-1]) | (grams[: len(low) - 1] == low[:-1])
    first[starts[long]] = True
    first[1:] |= inside[1:] != inside[:-1]
    at = np.flatnonzero(first)
    run = np.diff(np.append(at, len(low)))
    keep = inside[at]
    at, run = at[keep], run[keep]
    text = np.searchsorted(starts, at, "right") - 1
    content = roll.hashes(at, at + run - 1 + length) ^ _mix(run.astype(np.uint64))
    return text, at - starts[text], at - starts[text] + run - 1, low[at], content


# ---- suffix arrays ----------------------------------------------------------


def suffix_ranks(data: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Order of all suffixes by their first `depth` bytes at least, by prefix
    doubling from 8 bytes on, and the ranks at each step (bytes compared, rank)."""
    n = len(data)
    pad = np.zeros(n + 8, np.uint64)
    pad[:n] = data
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | pad[j : j + n]
    # behind the end: shorter first
    levels: list[tuple[int, np.ndarray]] = []
    h = 8
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.ones(n, bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32)
        levels.append((h, rank))
        if h >= depth or rank[order[-1]] == n:
            return order, levels
        second = np.zeros(n, np.int64)
        if h < n:
            second[:-h] = rank[h:]
        key = rank.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        h *= 2


def common_prefix(data: np.ndarray, levels, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at a and b share, up to `most`."""
    n = len(data)
    out = np.zeros(len(a), np.int64)
    for h, rank in reversed(levels):
        for _ in range(2 if h == levels[-1][0] else 1):
            i, j = a + out, b + out
            ok = np.flatnonzero((i + h <= n) & (j + h <= n) & (out < most))
            same = rank[i[ok]] == rank[j[ok]]
            out[ok[same]] += h
    for _ in range(7):
        i, j = a + out, b + out
        ok = np.flatnonzero((i < n) & (j < n) & (out < most))
        same = data[i[ok]] == data[j[ok]]
        out[ok[same]] += 1
    return np.minimum(out, most)


def longest_factors(places: list[int], shared: list[int]) -> tuple[list[int], list[int]]:
    """places: starts of suffixes in suffix order; shared[r]: bytes that r shares
    with r-1. For each rank the longest match with a suffix that starts earlier,
    and with one that starts later. The nearest ranks on either side with a
    smaller (larger) start give them; one pass with a stack finds both sides."""
    n = len(places)
    before, after = [0] * n, [0] * n
    for sign, out in ((1, before), (-1, after)):
        stack: list[tuple[int, int]] = []  # (rank, bytes shared with the entry below it)
        for r in range(n):
            reach = shared[r] if r else 0
            here = sign * places[r]
            while stack and sign * places[stack[-1][0]] > here:
                top, under = stack.pop()
                if reach > out[top]:  # r is the next smaller one of top
                    out[top] = reach
                reach = min(reach, under)
            if stack and reach > out[r]:  # the top is the previous smaller one of r
                out[r] = reach
            stack.append((r, reach))
    return before, after


def repeated_places(
    contexts: list[bytes], runs: list[int], length: int, keep: str
) -> list[tuple[int, int, int]]:
    """contexts in document order, the first `runs` windows of each in question:
    (context, from, to) of window starts whose longest previous factor (or, with
    keep="none", any factor) reaches length."""
    parts = [(t, a, b) for t, a, b in _maybe(contexts, runs, length)]
    found = _factors([contexts[t][a : b + length] for t, a, b in parts], [b - a + 1 for _, a, b in parts], length, keep)
    return [(parts[k][0], parts[k][1] + a, parts[k][1] + b) for k, a, b in found]


def _maybe(contexts: list[bytes], runs: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """(context, from, to) around the windows whose hash occurs twice; what is left
    out cannot repeat here, so the suffix array need not hold it."""
    starts = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    n = np.array(runs)
    at = np.repeat(starts[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    hashes = Rolling(np.frombuffer(b"".join(contexts), np.uint8)).hashes(at, at + length)
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    text = np.repeat(np.arange(len(contexts)), n)[again]
    place = at[again] - starts[text]
    if len(text):
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        last = np.append(first[1:], len(text)) - 1
        yield from zip(text[first].tolist(), place[first].tolist(), place[last].tolist())


def _factors(contexts: list[bytes], runs: list[int], length: int, keep: str) -> list[tuple[int, int, int]]:
    if not contexts:
        return []
    sizes = np.array([len(c) for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    order, levels = suffix_ranks(data, length)
    asked = np.zeros(len(data) + 1, np.int64)
    np.add.at(asked, starts[:-1], 1)
    np.add.at(asked, starts[:-1] + np.array(runs), -1)
    asked = np.cumsum(asked)[:-1] > 0
    sa = order[asked[order]]
    shared = np.zeros(len(sa), np.int64)
    if len(sa) > 1:
        shared[1:] = common_prefix(data, levels, sa[:-1], sa[1:], length)
    near = shared >= length
    part = near.copy()
    part[:-1] |= near[1:]
    at = np.flatnonzero(part)
    if not len(at):
        return []
    before, after = longest_factors(sa[at].tolist(), np.where(near[at], shared[at], 0).tolist())
    hit = np.array(before) >= length
    if keep == "none":
        hit |= np.array(after) >= length
    found = np.sort(sa[at][hit])
    if not len(found):
        return []
    text = np.searchsorted(starts, found, "right") - 1
    cut = np.flatnonzero((np.diff(found) != 1) | (np.diff(text) != 0)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(found)]]) - 1
    return [
        (int(t), int(a), int(b))
        for t, a, b in zip(text[lo], found[lo] - starts[text[lo]], found[hi] - starts[text[lo]])
    ]


# ---- Spark ------------------------------------------------------------------


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Blocks of (ids, bytes of their texts one after another, starts)."""
    ids: list = []
    parts: list[bytes] = []
    size = 0
    for lo in range(0, batch.num_rows, 64):
        piece = batch.slice(lo, 64)
        for i, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
            raw = t.encode() if t else b""
            ids.append(i)
            parts.append(raw)
            size += len(raw)
        if size >= BLOCK:
            yield ids, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
            ids, parts, size = [], [], 0
    if ids:
        yield ids, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def _segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(uid, low, high, kh, ch): windows low to high of a text, filed under kh."""
    schema = pa.schema(
        [("uid", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("kh", pa.int64()), ("ch", pa.int64())]
    )

    def run(batches):
        for b in batches:
            for ids, data, starts in _arrays(b):
                text, lo, hi, kh, ch = segments(data, starts, length, gram)
                cols = [np.array(ids, np.int64)[text], lo.astype(np.int32), hi.astype(np.int32)]
                cols += [np.ascontiguousarray(x).view(np.int64) for x in (kh, ch)]
                for k in range(0, len(lo), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in cols], schema=schema)

    return docs.select("uid", "text").mapInArrow(run, "uid long, low int, high int, kh long, ch long")


def repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none", gram: int = GRAM) -> DataFrame:
    """docs(uid, text), uid unique and not null: (uid, spans array<int>) for texts
    with repeats, spans as from, to, from, to, ... in bytes, merged, in order. A table."""
    spark = docs.sparkSession
    docs = docs.select("uid", "text").where("uid is not null")
    seg = _segments(docs, length, gram)
    # a table of its own, so that the join below can split the rows of a common hash
    common = seg.groupBy("kh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kh")
    common = written(spark, common, "suffix-common")
    # keys grow with the input: never broadcast
    cand = written(spark, seg.join(common.hint("merge"), "kh"), "suffix-candidates")
    kinds = cand.groupBy("kh", "ch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "low", "high")).alias("first"))
    kinds = written(spark, kinds, "suffix-kinds")
    several = kinds.groupBy("kh").agg(F.count(F.lit(1)).alias("members")).where("members > 1")

    whole = cand.join(kinds.where("n > 1").hint("merge"), ["kh", "ch"])
    if keep == "first":
        whole = whole.where((F.col("first.uid") != F.col("uid")) | (F.col("first.low") != F.col("low")))
    whole = whole.select("uid", "low", (F.col("high") + length).alias("end"))

    reps = kinds.join(several.hint("merge"), "kh").select("kh", "members", "first.*")
    wanted = reps.groupBy("uid").agg(
        F.collect_list(F.struct("kh", "low", "high", (F.col("members") > MOST_MEMBERS).alias("hot"))).alias("want")
    )
    ctx_pa = pa.schema(
        [("kh", pa.int64()), ("uid", pa.int64()), ("low", pa.int32()), ("run", pa.int32()), ("ctx", pa.binary()), ("hot", pa.bool_())]
    )

    def cut(batches):
        def rows():
            for b in batches:
                for r in range(b.num_rows):
                    uid, text, want = (c[r].as_py() for c in b.columns)
                    raw = text.encode()
                    for x in want:
                        lo, hi = x["low"], x["high"]
                        yield x["kh"], uid, lo, hi - lo + 1, raw[lo : hi + length], x["hot"]

        yield from rows_to_batches(rows(), ctx_pa)

    ctx = docs.join(wanted.hint("merge"), "uid").select("uid", "text", "want")
    ctx = written(spark, ctx.mapInArrow(cut, "kh long, uid long, low int, run int, ctx binary, hot boolean"), "suffix-contexts")

    span_pa = pa.schema([("uid", pa.int64()), ("low", pa.int32()), ("end", pa.int32())])

    def compare(batches):
        def solved(block: list[tuple]):
            block.sort(key=lambda x: (x[1], x[2]))
            for t, a, b in repeated_places([x[4] for x in block], [x[3] for x in block], length, keep):
                yield block[t][1], block[t][2] + a, block[t][2] + b + length

        def rows():
            block: list[tuple] = []
            size, last = 0, None
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    if size >= BLOCK and row[0] != last:
                        yield from solved(block)
                        block, size = [], 0
                    block.append(row)
                    size += len(row[4])
                    last = row[0]
            if block:
                yield from solved(block)

        yield from rows_to_batches(rows(), span_pa)

    cols = ["kh", "uid", "low", "run", "ctx"]
    few = ctx.where("not hot").select(*cols).repartition(shuffles(spark), "kh").sortWithinPartitions("kh")
    found = few.mapInArrow(compare, "uid long, low int, end int")

    win_pa = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("uid", pa.int64()), ("at", pa.int32())])

    def windows(batches):
        for b in batches:
            for r in range(b.num_rows):
                _, uid, low, run, raw = (c[r].as_py() for c in b.columns)
                data = np.frombuffer(raw, np.uint8)
                h = [Rolling(data, k).all(length)[:run].view(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[0]), pa.array(h[1]), pa.array(np.full(run, uid)), pa.array(np.arange(low, low + run, dtype=np.int32))],
                    schema=win_pa,
                )

    win = ctx.where("hot").select(*cols).repartition(shuffles(spark)).mapInArrow(windows, "h1 long, h2 long, uid long, at int")
    again = win.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "at")).alias("first")).where("n > 1")
    hot = win.join(again.hint("merge"), ["h1", "h2"])
    if keep == "first":
        hot = hot.where((F.col("first.uid") != F.col("uid")) | (F.col("first.at") != F.col("at")))
    hot = hot.select("uid", F.col("at").alias("low"), (F.col("at") + length).alias("end"))

    spans = whole.union(found).union(hot).groupBy("uid").agg(F.collect_list(F.struct("low", "end")).alias("s"))
    out_pa = pa.schema([("uid", pa.int64()), ("spans", pa.list_(pa.int32()))])

    def merge(r):
        out: list[int] = []
        for x in sorted(r[1], key=lambda x: (x["low"], x["end"])):
            if out and x["low"] <= out[-1]:
                out[-1] = max(out[-1], x["end"])
            else:
                out += [x["low"], x["end"]]
        return r[0], out

    out = written(spark, map_rows(spans, lambda: merge, out_pa, "uid long, spans array<int>"), "suffix-spans")
    for x in (common, cand, kinds, ctx):
        dropped(spark, x)
    return out


def _with_uid(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """docs with a further unique column, and its name: the id itself where it is one,
    else a row number of a written copy."""
    spark, uid = docs.sparkSession, spare(docs, "uid")
    twice = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull())
    if twice.isEmpty():
        return docs.withColumn(uid, F.col(id_col).cast("long")), uid
    return written(spark, docs.withColumn(uid, F.monotonically_increasing_id()), "suffix-rows"), uid


def kept_digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) after removing all that
    repeats (keep="none")."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own, uid = _with_uid(base, "doc_id")
    src = own.join(repeats(own.select(uid, "text"), length, "none").hint("merge"), "uid", "left").select("doc_id", "text", "spans")
    out = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    )

    def row(r):
        raw = r[1].encode() if r[1] else b""
        spans = r[2] or []
        kept = hashlib.sha256()
        pos = 0
        for a, b in zip(spans[::2], spans[1::2]):
            kept.update(raw[pos:a])
            pos = b
        kept.update(raw[pos:])
        return r[0], len(raw), sum(spans[1::2]) - sum(spans[::2]), len(spans) // 2, kept.hexdigest()

    return map_rows(src, lambda: row, out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_text(text: str | None, spans: list[int] | None) -> str | None:
    """The text without the spans; a character that a span covers in part stays."""
    if not text or not spans:
        return text
    raw = text.encode()
    out, pos = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append(raw[pos:a])
        pos = b
    out.append(raw[pos:])
    return b"".join(out).decode()


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """docs with repeated passages cut out of `text`; all rows and columns stay,
    whatever their names."""
    own, uid = _with_uid(docs, "doc_id")
    spans = spare(own, "spans")
    found = repeats(own.select(F.col(uid).alias("uid"), "text"), length, keep)
    both = own.join(found.select(F.col("uid").alias(uid), F.col("spans").alias(spans)).hint("merge"), uid, "left")
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                p = b.slice(lo, 1024)
                texts = [cut_text(t, s) for t, s in zip(p.column(at).to_pylist(), p.column(p.num_columns - 1).to_pylist())]
                cols = list(p.columns)[:-1]
                cols[at] = pa.array(texts, cols[at].type)
                yield pa.RecordBatch.from_arrays(cols, names=p.schema.names[:-1])

    return both.select(*docs.columns, spans).mapInArrow(run, docs.schema)
