"""Jaccard join of documents by their n-gram sets, as blocked sparse matrix products.

Documents times n-grams is a sparse matrix of zeros and ones; the product with its own
transpose holds the sizes of all intersections. Two sets of which the larger has b elements
can only be similar enough if they differ in few elements (a bound that follows from the
sizes), and everything below keeps the product to the blocks where that can be.

Sets are cut into parts by a hash of the n-gram, more parts than two similar sets can
differ in elements, so that similar sets have some parts in common, whole. How many parts
there are depends on the level of the larger size; a set near the upper end of a level
is cut for the next level as well. Rows of documents by parts make a much smaller
matrix. Its blocks are the parts that several sets have in common; what has no such
block, or fewer than the bound asks for, is similar to nothing. Equal sets are one row.

Blocks are not multiplied pair by pair. Two rounds multiply each row of a block with one or
two rows that stand for the block, and components join what is similar. A similar pair
that is still apart has a block in which several components are left. In those blocks
overlap counts of parts are accumulated for pairs of different components, within the
bounds: sizes, the number of n-grams that no other open set has (each is a difference),
the buckets of n-grams in which one set is odd and the other even (each holds a difference),
the number of common parts. Every pair that remains is verified on the full matrix: a
task takes a few hundred pairs, multiplies the rows they name (sorted postings, counts
added up for each pair) and compares intersection and union in whole numbers.

Cases: null and empty texts, and those without words, have an empty set and are linked
with nothing: their component is their own id. Fewer words than an n-gram make one. Repeated rows
and equal sets share a component. Null ids never are a component's id unless all are null.
Texts of any length are taken whole. An empty table gives no rows. Further columns are
ignored, whatever their names. n-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, components, dropped, map_rows, written
from .parity import flipped, mixed, names, parities, unpacked
from .simhash import _leaders, _mixed, shingle_hashes

#: Upper end of a level over that of the level below it.
STEP = 1.45
#: Parts beyond the number of differences.
SPARE_PARTS = 8
#: Similar sets have as many parts in common, at least.
LEAST_PARTS = 3
#: Keys that a join side may have to be broadcast; there is a shuffle beyond it.
BROADCAST_ROWS = 1 << 20
#: Pairs that are multiplied at once, and counts that are added up at once.
BLOCK_PAIRS, BLOCK_COUNTS = 256, 1 << 22


def most_apart(sizes: int, per_cent: int) -> int:
    """The most elements in which two linked sets with so many elements together differ."""
    return sizes * (100 - per_cent) // (100 + per_cent)


def levels_of(n: int, per_cent: int) -> list[tuple[int, int]]:
    """(level, its upper end) of all levels in which a set of n meets sets that are no smaller."""
    top = n * 100 // per_cent
    out, level, low, high = [], 0, 1, 1
    while low <= top:
        if high >= n:
            out.append((level, high))
        level, low, high = level + 1, high + 1, max(high + 1, int(high * STEP))
    return out


def signatures(u: np.ndarray, per_cent: int) -> tuple[int, list[int]]:
    """(need, keys) of a set of distinct hashes: two linked sets have `need` keys of the lower
    need in common, at least LEAST_PARTS."""
    keys: list[np.ndarray] = []
    need = 0
    spread = mixed(u ^ np.uint64(0x9E3779B97F4A7C15))
    for level, high in levels_of(len(u), per_cent):
        apart = most_apart(2 * high, per_cent)
        if not apart:
            continue  # linked sets of these sizes are equal
        spare = SPARE_PARTS + apart // 50
        parts = apart + 1 + spare
        part = (spread % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sizes = np.bincount(part, minlength=parts)
        full = np.flatnonzero(sizes)
        sums = np.zeros(parts, np.uint64)
        starts = (np.cumsum(sizes) - sizes)[full]
        sums[full] = np.add.reduceat(mixed(spread[order]), starts)
        # parts that are empty count as common only where too few others are left
        empty = parts - len(full)
        own = full if spare + 1 - empty >= LEAST_PARTS else np.arange(parts)
        common = spare + 1 - (empty if own is full else 0)
        need = min(need or common, common)
        keys.append(mixed(sums[own] ^ mixed((np.uint64(level << 40) + own.astype(np.uint64)))))
    return need, np.concatenate(keys).view(np.int64).tolist() if keys else []


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sparse product of two blocks of rows: sizes of all intersections."""
    out = np.zeros(len(left) * len(right), np.int64)
    if not len(out):
        return out.reshape(len(left), len(right))
    values = np.concatenate(right)
    owners = np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    for i, row in enumerate(left):
        lo = np.searchsorted(values, row, "left")
        count = np.searchsorted(values, row, "right") - lo
        ends = np.cumsum(count)
        begin = 0
        while begin < len(row):
            # as many n-grams as have BLOCK_COUNTS postings, one at least
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BLOCK_COUNTS, "right")))
            c = count[begin:end]
            places = np.arange(c.sum()) + np.repeat(lo[begin:end] - (np.cumsum(c) - c), c)
            out[i * len(right) : (i + 1) * len(right)] += np.bincount(owners[places], minlength=len(right))
            begin = end
    return out.reshape(len(left), len(right))


def _linked(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Of pairs(tkey, other) those whose sets are similar enough."""
    schema = pa.schema([("tkey", pa.int64()), ("other", pa.int64())])
    a = sets.select("tkey", F.col("n").alias("a_n"), F.col("shingles").alias("a"))
    b = sets.select(F.col("tkey").alias("other"), F.col("n").alias("b_n"), F.col("shingles").alias("b"))
    both = pairs.select("tkey", "other").join(a.hint("merge"), "tkey").join(b.hint("merge"), "other")
    both = both.where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * per_cent)

    def rows_of(keys: pa.Array, lists: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray]:
        _, first, place = np.unique(keys.to_numpy(), return_index=True, return_inverse=True)
        return [lists[int(k)].values.to_numpy() for k in first], place

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_PAIRS):
                part = batch.slice(lo, BLOCK_PAIRS)
                left, i = rows_of(part.column(0), part.column(2))
                right, j = rows_of(part.column(1), part.column(3))
                shared = overlaps(left, right)[i, j]
                sizes = np.array([len(x) for x in left])[i] + np.array([len(x) for x in right])[j]
                good = 100 * shared >= per_cent * (sizes - shared)
                pair = pa.RecordBatch.from_arrays([part.column(0), part.column(1)], schema=schema)
                yield pair.filter(pa.array(good))

    return both.select("tkey", "other", "a", "b").mapInArrow(run, "tkey long, other long")


def _apart(sizes: Column, per_cent: int) -> Column:
    return F.floor(sizes * (100 - per_cent) / (100 + per_cent))


def _rest(rows: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(tkey, other): pairs of rows(bag, tkey, score, root) with different roots that can be
    linked. Overlaps of their parts are added up; a pair goes where a bound forbids it."""
    roots = rows.select("tkey").distinct()
    own = sets.join(roots.hint("merge"), "tkey", "left_semi")
    each = own.select("tkey", F.explode("shingles").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("tkey").alias("tkey")).where("c = 1")
    alone = alone.groupBy("tkey").agg(F.count(F.lit(1)).alias("alone"))
    info = own.select("tkey", "n", "need", *unpacked("parity"))
    info = info.join(alone.hint("merge"), "tkey", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    info = info.where(F.col("alone") * 100 <= F.col("n") * (100 - per_cent))
    open_ = written(sets.sparkSession, rows.join(info.hint("merge"), "tkey"), "jaccard-open")
    of_root = open_.groupBy("bag", "root").agg(F.count(F.lit(1)).alias("c"))
    major = of_root.groupBy("bag").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1")
    major = major.select("bag", F.col("m.root").alias("major"))
    asks = open_.join(major.hint("merge"), "bag").where("root <> major")
    asks = asks.select("bag", "major", *(F.col(c).alias(f"a_{c}") for c in ("tkey", "n", "need", "alone", "root", *names())))
    apart = _apart(F.col("n") + F.col("a_n"), per_cent)
    shared = (F.col("n") + F.col("a_n") - apart) / 2  # at least, if they differ in no more
    fits = (
        (F.col("root") != F.col("a_root"))
        & ((F.col("root") == F.col("major")) | (F.col("tkey") > F.col("a_tkey")))
        & (F.least("n", "a_n") * 100 >= F.greatest("n", "a_n") * per_cent)
        & (F.col("n") - F.col("alone") >= shared)
        & (F.col("a_n") - F.col("a_alone") >= shared)
        & (F.col("alone") + F.col("a_alone") <= apart)
        & (flipped("a_") <= apart)
    )
    met = open_.join(asks.hint("merge"), "bag").where(fits)
    low, high = F.least("tkey", "a_tkey").alias("tkey"), F.greatest("tkey", "a_tkey").alias("other")
    pairs = met.groupBy(low, high).agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("need", "a_need")).alias("least"))
    out = written(sets.sparkSession, pairs.where("shared >= least").select("tkey", "other"), "jaccard-pairs")
    dropped(sets.sparkSession, open_)
    return out


def similar_components(
    docs: DataFrame, k: int = 3, per_cent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of a document's set of k-word n-grams and the
    smallest doc_id reachable over links, two sets being linked where 100 times their intersection is
    per_cent times their union or more. A table."""
    spark = docs.sparkSession
    text_key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("text_key")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key, F.col(text_col).alias("text"))
    longs = pa.list_(pa.int64())
    kinds = {"doc_id": pa.int64(), "text_key": pa.binary(), "skey": pa.binary(), "n": pa.int64(), "need": pa.int64(), "parts": longs}
    ddl = "doc_id long, text_key binary, skey binary, n long, need long, parts array<long>"

    def make():
        def row(r):
            u = np.unique(shingle_hashes(r[2], k))
            return r[0], r[1], hashlib.md5(u.tobytes()).digest(), len(u), *signatures(u, per_cent)

        return row

    own = written(spark, map_rows(base, make, pa.schema(list(kinds.items())), ddl), "jaccard-rows")
    same = own.where("n > 0").groupBy("skey").agg(F.min("doc_id").alias("first_doc"), *(F.first(c).alias(c) for c in ("text_key", "n", "need", "parts")))
    classes = written(spark, same.withColumn("tkey", F.monotonically_increasing_id()), "jaccard-classes")

    each = classes.select("tkey", F.explode("parts").alias("bag"))
    shared = each.groupBy("bag").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = each.join(shared.hint("merge"), "bag").groupBy("tkey")
    # a set's parts are fewer than its n-grams
    met = met.agg(F.sum("c").alias("score"), F.collect_list("bag").alias("bags")).where(F.size("bags") >= LEAST_PARTS)
    left = written(spark, met, "jaccard-left")

    few = classes.select("tkey", "text_key", "n", "need").join(left.select("tkey").hint("merge"), "tkey", "left_semi")
    few = written(spark, few, "jaccard-few")
    side = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few.hint("merge")
    texts = base.select("text_key", "text").join(side, "text_key").groupBy("tkey", "n", "need").agg(F.first("text").alias("text"))
    set_pa = pa.schema([("tkey", pa.int64()), ("n", pa.int64()), ("need", pa.int64()), ("parity", longs), ("shingles", longs)])

    def to_set():
        def row(r):
            u = np.unique(shingle_hashes(r[3], k))
            return *r[:3], parities(u), u.view(np.int64).tolist()

        return row

    sets = map_rows(texts, to_set, set_pa, "tkey long, n long, need long, parity array<long>, shingles array<long>")
    sets = written(spark, sets, "jaccard-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        with arrow_rows(spark, BLOCK_PAIRS):
            good = written(spark, _linked(pairs, sets, per_cent), "jaccard-links")
        dropped(spark, pairs)
        return good

    rows = left.select(F.explode("bags").alias("bag"), "tkey", "score", F.col("tkey").alias("root"))
    ends = rows.groupBy("bag").agg(F.max(F.struct("score", "tkey")).alias("m"))
    ends = ends.select("bag", F.struct(F.col("m.tkey").alias("root"), F.col("m.tkey").alias("tkey")).alias("x"))
    good: list[DataFrame] = []
    for _ in range(2):
        low, high = F.least("tkey", F.col("x.tkey")), F.greatest("tkey", F.col("x.tkey"))
        pairs = rows.join(ends.hint("merge"), "bag").where("root <> x.root").select(low.alias("tkey"), high.alias("other")).distinct()
        if good:
            pairs = pairs.join(good[0].hint("merge"), ["tkey", "other"], "left_anti")
        good.append(verified(written(spark, pairs, "jaccard-pairs")))
        edges = reduce(DataFrame.union, good)
        found = components(spark, edges.select(F.col("tkey").alias("a"), F.col("other").alias("b")), "jaccard-components")
        now = found.select(F.col("node").alias("tkey"), F.col("root").alias("found"))
        now = rows.drop("root").join(now.hint("merge"), "tkey", "left")
        now = written(spark, now.select("bag", "tkey", "score", F.coalesce("found", "tkey").alias("root")), "jaccard-rooted")
        over, rows = rows, written(spark, _mixed(now), "jaccard-mixed")
        for x in (found, now, over):
            dropped(spark, x)
        ends = _leaders(rows)
    good.append(verified(_rest(rows, sets, per_cent)))
    edges = reduce(DataFrame.union, good)
    found = components(spark, edges.select(F.col("tkey").alias("a"), F.col("other").alias("b")), "jaccard-components")
    of_class = classes.select("skey", "first_doc", "tkey").join(found.withColumnRenamed("node", "tkey").hint("merge"), "tkey", "left")
    of_class = written(spark, of_class.select("skey", "first_doc", F.coalesce("root", "tkey").alias("root")), "jaccard-roots")
    least = of_class.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_set = of_class.join(least.hint("merge"), "root").select("skey", "component_id", F.lit(True).alias("in_class"))
    out = own.select("doc_id", "skey", F.col("n").alias("n_shingles")).join(of_set.hint("merge"), "skey", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("in_class"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = written(spark, out, "jaccard-out")
    for x in (own, classes, left, few, sets, rows, found, of_class, *good):
        dropped(spark, x)
    return out
