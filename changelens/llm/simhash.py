"""SimHash near-duplicates by a segment-popcount grid.

Fingerprints: bit i is set where over half the XXH64 values (seed 42) of a text's
word shingles have it. A fingerprint is embedded as the vector of bit counts of
its 16 four-bit segments. One flipped bit moves that vector by one step, so the
Manhattan distance of two vectors is at most the Hamming distance of their
fingerprints. Two fingerprints that differ in two bits at most are both within
one step of a common grid cell. That is the range join: each distinct fingerprint
visits its own cell and the 32 around it; cells with one visitor fall away. What
is left is verified exactly, without pairs: in a shared cell each fingerprint
names the 64-bit points in that cell within one flip, and those that name the
same point differ in two bits at most, so each links to the smallest of them. A
crowded cell or point costs a row for each visitor, never the square.

near_duplicates() asks for a word-shingle Jaccard similarity (0.8 of five words
unless told otherwise). Texts whose whole fingerprints hang together by the grid
join above are one bucket. One 64-bit fingerprint is too coarse for the rest: pairs
at 0.8 differ in about 10 bits. So each text also has TABLES fingerprints of small
sub-bags of its shingles; equal ones are further buckets. That misses a few pairs,
most often of short texts; where the smaller of two sets has SHORT shingles at most,
none is missed: such sets also meet in each of their rarest shingles, as many as
leave no pair of the similarity without a common one (a prefix filter).

Buckets are not worked off as pairs. Two rounds compare each member with one or two
representatives, those that most texts meet, and components join what is verified. In
buckets that still hold several components a link can only be found in what members
share besides the common part: there the prefix filter over all shingles of these
texts, rarest first, with the bounds that sizes, positions and parities set, gives every
remaining candidate exactly. Every candidate is verified on whole shingle sets.

Cases: null and empty texts have no words, fingerprint zero and an empty shingle
set, and are linked like others by Hamming distance; near_duplicates() treats
them as one group of equal texts. Fewer words than a shingle make one shingle.
Texts of any length are taken whole. Repeated rows share fingerprints and
components. Null doc_ids never become a component's id unless all are null. An
empty table gives an empty result. Further columns are ignored, or kept by
deduplicate(), whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, components, dropped, map_rows, shuffles, spare, written
from .parity import flipped, names, parities, unpacked

SEGMENTS, SEGMENT_BITS = 16, 4
#: Sub-bag fingerprints of a text, and shingles in each.
TABLES, SUB_BAG = 20, 5
#: Pairs whose smaller set has so many shingles at most are found exactly.
SHORT = 40
#: Long words of the parities by which candidates of the prefix filter are told apart.
PARITY_WORDS = 8


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    from xxhash import xxh64_intdigest as xxh

    ws = text.encode().lower().split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    n = max(1, len(ws) - k + 1)
    norm = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = ends - np.fromiter(map(len, ws), np.int64, len(ws)) - 1
    lo, hi = starts[:n].tolist(), (ends[min(k, len(ws)) - 1 :] - 1)[:n].tolist()
    return np.array([xxh(norm[a:b], 42) for a, b in zip(lo, hi)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """As a signed 64-bit integer."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 14):
        part = np.ascontiguousarray(h[lo : lo + (1 << 14)]).astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for each row."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(src, lambda: lambda r: (r[0], fingerprint(shingle_hashes(r[1], k))), out, "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """Bit counts of the 16 segments, four bits each, in one long."""
    ones = F.lit(0x1111111111111111)
    out = fp.bitwiseAND(ones)
    for s in range(1, SEGMENT_BITS):
        out = out + F.shiftrightunsigned(fp, s).bitwiseAND(ones)
    return out


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) among distinct fingerprints fps(fp) whose connected components
    are those of all pairs that differ in two bits at most. A table."""
    v = F.col("v")
    steps = [v]
    for sign, end in ((1, SEGMENT_BITS), (-1, 0)):
        for i in range(SEGMENTS):
            count = F.shiftrightunsigned(v, SEGMENT_BITS * i).bitwiseAND(F.lit(7).cast("long"))
            steps.append(F.when(count != end, v + F.lit(sign * (1 << (SEGMENT_BITS * i)))))
    visits = fps.withColumn("v", popcounts(F.col("fp"))).select("fp", F.posexplode(F.array(*steps)).alias("step", "cell"))
    visits = visits.where("cell is not null")
    shared = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
    # shared cells grow with the input: never broadcast
    near = visits.join(shared.hint("merge"), "cell")
    one = F.lit(1).cast("long")
    at = (F.col("step") - 1) % SEGMENTS * SEGMENT_BITS
    flips = F.transform(
        F.sequence(at, at + (SEGMENT_BITS - 1)),
        lambda b: F.when(
            (F.shiftrightunsigned(F.col("fp"), 0).bitwiseAND(F.call_function("shiftleft", one, b)) == 0)
            == (F.col("step") <= SEGMENTS),
            F.col("fp").bitwiseXOR(F.call_function("shiftleft", one, b)),
        ),
    )
    points = near.select("fp", F.explode(F.when(F.col("step") == 0, F.array("fp")).otherwise(flips)).alias("point"))
    points = written(fps.sparkSession, points.where("point is not null"), "simhash-points")
    first = points.groupBy("point").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    found = points.join(first, "point").where("fp <> low")
    found = found.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= 2)
    found = written(fps.sparkSession, found.select(F.col("fp").alias("a"), F.col("low").alias("b")), "simhash-links")
    dropped(fps.sparkSession, points)
    return found


def linked_components(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of two
    differing bits at most."""
    spark = docs.sparkSession
    own = written(spark, fingerprints(docs, k, id_col, text_col), "simhash")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    spread = fps.select("fp").repartition(2 * shuffles(spark), "fp")  # each row becomes 33
    near = links(spread)
    roots = components(spark, near)
    dropped(spark, near)
    member = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_fp = written(spark, member.join(least, "root").select("fp", "component_id"), "simhash-ids")
    dropped(spark, roots)
    return own.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def sub_bags(h: np.ndarray, tables: int = TABLES, size: int = SUB_BAG) -> list[int]:
    """A fingerprint of the `size` shingles that come first in each table's order: bit i
    is set where over half of them, mixed with the table's number, have it."""
    u = np.unique(h)
    seeds = (np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    mixed = (u[None, :] ^ seeds) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    if len(u) > size:
        mixed = np.partition(mixed, size - 1, axis=1)[:, :size]
    if not len(u):
        return [0] * tables
    # the order's hashes are small numbers: mixed again, their bits are fair
    again = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    again ^= again >> np.uint64(29)
    again *= np.uint64(0xBF58476D1CE4E5B9)
    again ^= again >> np.uint64(32)
    bits = np.unpackbits(np.ascontiguousarray(again).view(np.uint8).reshape(tables, -1, 8), axis=2, bitorder="little")
    ones = bits.sum(1, dtype=np.int64) * 2 > again.shape[1]
    fps = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
    return (fps ^ seeds[:, 0]).view(np.int64).tolist()


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(tkey, n, pos, shingle) of sets(tkey, shingles array<long>): for each set of n shingles
    its n - ceil(similarity n) + 1 rarest, pos from 1, without those no other set has. Of
    two sets of this similarity both hold their first common shingle among them."""
    each = sets.select("tkey", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    own = each.join(often.hint("merge"), "shingle").groupBy("tkey", "n")
    own = own.agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))  # one text's shingles
    first = F.slice("s", F.lit(1), F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1)
    own = own.select("tkey", "n", F.posexplode(first).alias("pos", "x")).where("x.df > 1")
    return own.select("tkey", "n", (F.col("pos") + 1).alias("pos"), F.col("x.shingle").alias("shingle"))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs(tkey, other) those whose shingle sets have at least this Jaccard similarity."""
    schema = pa.schema([("tkey", pa.binary()), ("other", pa.binary())])
    own = pairs.join(sets.select("tkey", F.col("shingles").alias("a")).hint("merge"), "tkey")
    both = own.join(sets.select(F.col("tkey").alias("other"), F.col("shingles").alias("b")).hint("merge"), "other")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                u = np.frombuffer(batch.column(2)[r].as_buffer(), np.uint64)
                v = np.frombuffer(batch.column(3)[r].as_buffer(), np.uint64)
                if min(len(u), len(v)) >= similarity * max(len(u), len(v)):
                    shared = len(np.intersect1d(u, v, assume_unique=True))
                    keep[r] = shared >= similarity * (len(u) + len(v) - shared)
            got = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema)
            yield got.filter(pa.array(keep))

    return both.select("tkey", "other", "a", "b").mapInArrow(run, "tkey binary, other binary")


def _mixed(rows: DataFrame) -> DataFrame:
    """rows(bag, tkey, score, root) of the buckets that hold several roots."""
    several = rows.groupBy("bag").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    return rows.join(several.select("bag").hint("merge"), "bag", "left_semi")


def _leaders(rows: DataFrame) -> DataFrame:
    """(bag, x) of rows(bag, tkey, score, root): the member that most texts meet in the
    bucket's largest root, and in the largest other one."""
    of_root = rows.groupBy("bag", "root").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("score", "tkey")).alias("m"))
    of_root = of_root.select("bag", F.struct("n", "root", F.col("m.tkey").alias("tkey")).alias("x"))
    major = of_root.groupBy("bag").agg(F.max("x").alias("major"))
    minor = of_root.join(major.hint("merge"), "bag").where("x.root <> major.root").groupBy("bag").agg(F.max("x").alias("x"))
    return major.select("bag", F.col("major").alias("x")).union(minor)


def _rest(open_sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(tkey, other): all pairs of open_sets(tkey, shingles, parity) with different roots that may
    have this similarity, by the prefix filter with size and position bounds, and by parities: two sets
    have other parities in no more buckets than they may differ in shingles. Texts that are put together
    from common passages meet in these, but their parities tell them apart before they become pairs."""
    own = prefixes(open_sets, similarity).join(roots.hint("merge"), "tkey")
    own = own.join(open_sets.select("tkey", *unpacked("parity", PARITY_WORDS)).hint("merge"), "tkey")
    own = written(open_sets.sparkSession, own, "simhash-prefixes")
    by_root = own.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("c"))
    major = by_root.groupBy("shingle").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1")
    # what the largest component of a shingle shares with itself needs no pair
    asks = own.join(major.select("shingle", F.col("m.root").alias("major")).hint("merge"), "shingle").where("root <> major")
    asks = asks.select("shingle", *(F.col(c).alias(f"a_{c}") for c in ("tkey", "n", "pos", "root", *names(PARITY_WORDS))))
    both = F.ceil(similarity / (1 + similarity) * (F.col("n") + F.col("a_n")) - 1e-9)  # shingles in common, at least
    most = F.least(F.col("n") - F.col("pos"), F.col("a_n") - F.col("a_pos")) + 1  # if this one is the first
    apart = F.col("n") + F.col("a_n") - 2 * both
    close = (most >= both) & (flipped("a_", PARITY_WORDS) <= apart)
    found = own.join(asks.hint("merge"), "shingle").where((F.col("root") != F.col("a_root")) & close)
    pairs = found.select(F.least("tkey", "a_tkey").alias("tkey"), F.greatest("tkey", "a_tkey").alias("other")).distinct()
    out = written(open_sets.sparkSession, pairs, "simhash-pairs")
    dropped(open_sets.sparkSession, own)
    return out


def near_duplicates(
    docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_key, group_key, n_links): documents of a group are joined by a
    chain of equal texts or of pairs whose k-word shingle sets have at least this
    Jaccard similarity; n_links counts the links between different texts that were
    verified for this text (a group hangs together by them, not all of its pairs are
    compared). A table."""
    spark = docs.sparkSession
    key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key.alias("tkey"))

    longs = pa.list_(pa.int64())
    out = pa.schema([("doc_id", pa.int64()), ("tkey", pa.binary()), ("fp", pa.int64()), ("bags", longs), ("short", longs)])
    longest = int(SHORT / similarity + 1e-9)

    def make():
        def bags(r):
            h = shingle_hashes(r[1], k)
            u = np.unique(h)
            return r[0], r[2], fingerprint(h), sub_bags(u), u.view(np.int64).tolist() if len(u) <= longest else []

        return bags

    ddl = "doc_id long, tkey binary, fp long, bags array<long>, short array<long>"
    own = written(spark, map_rows(base, make, out, ddl), "simhash-bags")
    classes = own.groupBy("tkey").agg(*(F.first(c).alias(c) for c in ("fp", "bags", "short")))
    fps = classes.select("fp").distinct().repartition(2 * shuffles(spark), "fp")
    near = links(fps)
    grid = components(spark, near)
    one = classes.join(grid.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    one = one.select("tkey", F.array_append("bags", F.coalesce("root", "fp")).alias("bags"), "short")
    one = written(spark, one, "simhash-classes")
    rare = prefixes(one.select("tkey", F.col("short").alias("shingles")), similarity)
    member = one.select("tkey", F.explode("bags").alias("bag")).union(rare.select("tkey", F.col("shingle").alias("bag")))
    member = written(spark, member, "simhash-members")
    shared = member.groupBy("bag").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a text's buckets are TABLES + 1 and its rarest shingles, a short list
    left = member.join(shared.hint("merge"), "bag").groupBy("tkey").agg(F.sum("n").alias("score"), F.collect_list("bag").alias("bags"))
    left = written(spark, left, "simhash-left")
    for x in (near, grid, one, member):
        dropped(spark, x)

    set_pa = pa.schema([("tkey", pa.binary()), ("shingles", pa.binary())])
    to_set = lambda: lambda r: (r[0], np.unique(shingle_hashes(r[1], k)).tobytes())
    texts = base.join(left.select("tkey").hint("merge"), "tkey", "left_semi").groupBy("tkey").agg(F.first("text").alias("text"))
    sets = written(spark, map_rows(texts, to_set, set_pa, "tkey binary, shingles binary"), "simhash-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        with arrow_rows(spark, 256):  # rows that carry two shingle sets
            good = written(spark, _alike(pairs, sets, similarity), "simhash-good")
        dropped(spark, pairs)
        return good

    rows = left.select(F.explode("bags").alias("bag"), "tkey", "score", F.col("tkey").alias("root"))
    ends = rows.groupBy("bag").agg(F.max(F.struct("score", "tkey")).alias("m"))
    ends = ends.select("bag", F.struct(F.col("m.tkey").alias("root"), F.col("m.tkey").alias("tkey")).alias("x"))
    good: list[DataFrame] = []
    for turn in range(2):
        each = rows.join(ends.hint("merge"), "bag").where("root <> x.root")
        low, high = F.least("tkey", F.col("x.tkey")), F.greatest("tkey", F.col("x.tkey"))
        pairs = each.select(low.alias("tkey"), high.alias("other")).distinct()
        if good:
            pairs = pairs.join(good[0].hint("merge"), ["tkey", "other"], "left_anti")
        good.append(verified(written(spark, pairs, "simhash-pairs")))
        edges = good[0] if turn == 0 else good[0].union(good[1])
        found = components(spark, edges.select(F.col("tkey").alias("a"), F.col("other").alias("b")))
        now = found.select(F.col("node").alias("tkey"), F.col("root").alias("found"))
        now = rows.drop("root").join(now.hint("merge"), "tkey", "left")
        now = written(spark, now.select("bag", "tkey", "score", F.coalesce("found", "tkey").alias("root")), "simhash-rooted")
        over, rows = rows, written(spark, _mixed(now), "simhash-mixed")
        for x in (found, now, over):
            dropped(spark, x)
        ends = _leaders(rows)
    roots = written(spark, rows.select("tkey", "root").distinct(), "simhash-open")
    open_sets = sets.join(roots.select("tkey").hint("merge"), "tkey", "left_semi")
    list_pa = pa.schema([("tkey", pa.binary()), ("shingles", longs), ("parity", longs)])

    def to_lists(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                keys, raw = (c.slice(lo, 64) for c in b.columns)
                own = [np.frombuffer(x.as_buffer(), np.int64) for x in raw]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))
                odd = pa.array([parities(x.view(np.uint64), PARITY_WORDS) for x in own], longs)
                yield pa.RecordBatch.from_arrays([keys, lists, odd], schema=list_pa)

    open_sets = open_sets.mapInArrow(to_lists, "tkey binary, shingles array<long>, parity array<long>")
    open_sets = written(spark, open_sets, "simhash-lists")
    good.append(verified(_rest(open_sets, roots, similarity)))
    edges = reduce(DataFrame.union, good).select(F.col("tkey").alias("a"), F.col("other").alias("b"))
    found = components(spark, edges)
    top = found.select(F.col("node").alias("tkey"), "root")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    count = both.groupBy(F.col("a").alias("tkey")).agg(F.count(F.lit(1)).alias("n_links"))
    groups = (
        own.select("doc_id", "tkey")
        .join(top.hint("merge"), "tkey", "left")
        .join(count.hint("merge"), "tkey", "left")
        .select(
            "doc_id",
            F.col("tkey").alias("text_key"),
            F.coalesce("root", "tkey").alias("group_key"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )
    groups = written(spark, groups, "simhash-groups")
    for x in (own, left, sets, roots, open_sets, rows, found, *good):
        dropped(spark, x)
    return groups


def deduplicate(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id (of equal
    doc_ids, one). Keeps all columns, whatever their names."""
    spark = docs.sparkSession
    groups = near_duplicates(docs, k, similarity)
    none = F.lit(-(2**63))
    keep = groups.groupBy("group_key").agg(F.min_by("text_key", "doc_id").alias("tkey"), F.min("doc_id").alias("id"))
    key, own = spare(docs, "key"), spare(docs, "id")
    keep = keep.select(F.coalesce("tkey", "group_key").alias(key), F.coalesce("id", none).alias(own))
    keep = written(spark, keep, "simhash-keep")
    dropped(spark, groups)
    keyed = docs.withColumns(
        {key: F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))), own: F.coalesce(F.col("doc_id").cast("long"), none)}
    )
    on = [key, own]
    return keyed.join(keep.hint("merge"), on, "left_semi").dropDuplicates(on).select(*docs.columns)
