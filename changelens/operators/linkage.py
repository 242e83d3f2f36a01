"""Average linkage of groups that fit no task.

The mean similarity of two clusters is the product of the sums of their unit vectors over the product of
their sizes, so a cluster is one row: its sum and its size. In a round every cluster finds its nearest one
by blocked matrix products, and all pairs that are nearest to each other are joined. For average linkage this gives
the clusters of joining one best pair after another: joining two clusters never brings them nearer to a
third than the nearer of them was. A cluster without any neighbour from the threshold up never gets one, and
takes no part from then on. Late rounds join few pairs, so a group whose clusters fit a task is ended in one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changelens.session import stepped

#: Clusters of a block; two blocks are multiplied in a task, and so many rows of one at a time.
BLOCK, ROWS = 8192, 512
#: Places to which similarities are compared.
PLACES = 12
#: Clusters of a group that one task joins to the end.
IN_TASK = 1 << 15
#: Similarities that a task holds at a time while it joins.
ENTRIES = 1 << 22
#: No cluster is near enough; the nearest one is to be found again.
NONE, UNKNOWN = -1, -2


def _matrix(lists: pa.Scalar) -> np.ndarray:
    rows = lists.values
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def unit_vector(u: str) -> Column:
    """The array divided by its length, which is found once a row and not once an element."""
    length = F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, x: s + x * x)) + F.lit(1e-12)
    return F.zip_with(u, F.array_repeat(length, F.size(u)), lambda x, n: x / n)


def nearest_of(sums: np.ndarray, sizes: np.ndarray, rows: np.ndarray, threshold: float, gone: np.ndarray | None = None) -> np.ndarray:
    """For each of `rows` the cluster with the largest mean cosine, from the threshold up, of equals the first; -1 if there is none."""
    mean = (sums[rows] @ sums.T) / (sizes[rows][:, None] * sizes)
    mean[np.arange(len(rows)), rows] = -np.inf
    if gone is not None:
        mean[:, gone] = -np.inf
    top = mean.max(1)
    # what can be equal to the largest once rounded, and only that is rounded
    i, j = np.nonzero(mean >= np.maximum(top - 2 * 10.0**-PLACES, threshold)[:, None])
    same = np.round(mean[i, j], PLACES) == np.round(top[i], PLACES)
    i, first = np.unique(i[same], return_index=True)
    out = np.full(len(rows), NONE)
    out[i] = j[same][first]
    return out


def joined_best(sums: np.ndarray, sizes: np.ndarray, threshold: float) -> list[list[int]]:
    """Clusters of clusters, given by their sums of unit vectors and sizes, by repeatedly joining the two with
    the largest mean cosine, from the threshold up; of equals those that begin first. They are found along a chain:
    from a cluster to its nearest, and on, until two are nearest to each other, which are joined. What is nearest stays so
    until it is joined itself. That is some two scans of the sums a cluster, and no matrix of all pairs."""
    s, n = np.array(sums, float), np.array(sizes, float)
    first, ids = np.arange(len(s)), np.arange(len(s))
    if len(s):  # what is no number is near to nothing
        ids = np.flatnonzero(~np.isnan(s).any(1))
        s, n = s[ids], n[ids]
    step = max(1, ENTRIES // max(1, len(s)))
    near = np.concatenate([nearest_of(s, n, np.arange(k, min(k + step, len(s))), threshold) for k in range(0, len(s), step)] or [ids])
    live, chain = near != NONE, []
    left = int(live.sum())
    while left:
        if 2 * left <= len(s):  # what is gone takes no part in scans
            place = np.where(live, np.cumsum(live) - 1, UNKNOWN)
            near = np.where(near < 0, near, place[near])[live]
            s, n, ids, chain = s[live], n[live], ids[live], [int(place[c]) for c in chain]
            live = np.ones(left, bool)
        if not chain:
            chain.append(int(live.argmax()))
        a = chain[-1]
        if near[a] == UNKNOWN or near[a] != NONE and not live[near[a]]:
            near[a] = nearest_of(s, n, np.array([a]), threshold, ~live)[0]
        b = int(near[a])
        if b == NONE:
            chain.pop()
            live[a] = False
            left -= 1
        elif b in chain:  # the one before, save for errors of the last place
            a, b = sorted(chain[-2:])
            del chain[-2:]
            near[(near == a) | (near == b)] = UNKNOWN
            near[a] = UNKNOWN
            s[a] += s[b]
            n[a] += n[b]
            first[ids[b]] = ids[a]
            live[b] = False
            left -= 1
        else:
            chain.append(b)
    members: dict[int, list[int]] = {}
    for k in range(len(first)):
        first[k] = first[first[k]]  # that of an earlier one is final
        members.setdefault(int(first[k]), []).append(k)
    return list(members.values())


def nearest_clusters(state: DataFrame, group: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """(group, cid, near): for each row of state(group, cid, n, s) the most similar other one of its group
    with a mean of the threshold or more; of equals the pair that comes first by its ids."""
    size = state.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    own = state.join(size, group).withColumn("_b", F.pmod(F.xxhash64("cid"), F.col("_blocks")).cast("int"))
    packed = own.groupBy(group, "_b").agg(F.sort_array(F.collect_list(F.struct("cid", "n", "s"))).alias("x"))
    packed = packed.select(group, "_b", F.col("x.cid").alias("cid"), F.col("x.n").alias("n"), F.col("x.s").alias("s"))
    packed, _ = stepped(packed, "linkage-blocks", F.lit(True))  # a row holds one block
    left = packed.select(group, *(F.col(c).alias(f"{c}_1") for c in ("_b", "cid", "n", "s")))
    right = packed.select(group, *(F.col(c).alias(f"{c}_2") for c in ("_b", "cid", "n", "s")))
    # blocks of one group against each other: rows are blocks, and far fewer than pairs of clusters
    both = left.join(right.hint("merge"), group).where("_b_1 <= _b_2").repartition(F.col(group), F.col("_b_1"), F.col("_b_2"))
    kind = state.schema[group].dataType
    out = pa.schema([(c, pa.int64()) for c in ("cid", "near")] + [("mean", pa.float64())])

    def best(mean: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest mean of each row, and whose it is: of equals the first, as others are in order."""
        top, near = mean.max(1), np.zeros(len(mean), np.int64)
        # what can be equal to the largest once rounded, and only that is rounded
        i, j = np.nonzero(mean >= np.maximum(top, threshold)[:, None] - 2 * 10.0**-PLACES)
        top = np.round(top, PLACES)
        same = np.round(mean[i, j], PLACES) == top[i]
        i, first = np.unique(i[same], return_index=True)
        near[i] = others[j[same][first]]
        return np.where(top >= threshold, top, -np.inf), near

    def pair(own: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, alone: bool) -> Iterator[tuple]:
        theirs, near = np.full(len(b), -np.inf), np.zeros(len(b), np.int64)
        for k in range(0, len(a), ROWS):
            ids, mean = a[k : k + ROWS], own[k : k + ROWS] @ other.T
            if alone:
                mean[np.arange(len(ids)), np.arange(k, k + len(ids))] = -np.inf
            else:
                more, by = best(mean.T, ids)
                near = np.where(more > theirs, by, near)  # of equals that of the earlier rows
                theirs = np.maximum(theirs, more)
            mine, at = best(mean, b)
            yield ids, at, mine
        yield b, near, theirs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                g, b1, c1, n1, s1, b2, c2, n2, s2 = (batch.column(k)[r] for k in range(9))
                own, other = (_matrix(s) / n.values.to_numpy()[:, None] for s, n in ((s1, n1), (s2, n2)))
                found = pair(own, c1.values.to_numpy(), other, c2.values.to_numpy(), b1.as_py() == b2.as_py())
                ids, near, mean = (np.concatenate(x) for x in zip(*found))
                has = mean > -np.inf
                cols = [pa.array(x[has], f.type) for x, f in zip((ids, near, mean), out)]
                yield pa.RecordBatch.from_arrays([pa.repeat(g, int(has.sum())), *cols], names=[group, *out.names])

    cols = [group, "_b_1", "cid_1", "n_1", "s_1", "_b_2", "cid_2", "n_2", "s_2"]
    found = both.select(*cols).mapInArrow(run, f"{group} {kind.simpleString()}, cid long, near long, mean double")
    order = F.struct("mean", -F.least("cid", "near"), -F.greatest("cid", "near"))
    return found.groupBy(group, "cid").agg(F.max_by("near", order).alias("near"))


def ended(state: DataFrame, group: str, threshold: float) -> DataFrame:
    """(group, cid, _to): what the clusters of state(group, cid, n, s) are joined to in the end, a group being one task's work."""

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("cid")
        ids = df["cid"].tolist()
        res = [(df[group].iloc[0], ids[i], ids[g[0]]) for g in joined_best(np.array(df["s"].tolist()), df["n"].to_numpy(), threshold) for i in g]
        return pd.DataFrame(res, columns=[group, "cid", "_to"])

    # in ranges a group has a part of its own, while by hash two large ones may share one
    own = state.select(group, "cid", "n", "s").repartitionByRange(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), group)
    return own.groupBy(group).applyInPandas(fold, f"{group} {dict(state.dtypes)[group]}, cid LONG, _to LONG")


def linked(rows: DataFrame, group: str, threshold: float, block: int = BLOCK, in_task: int = 0) -> DataFrame:
    """(group, pos, cid): the cluster of each of rows(group, pos, embedding), named by its first member. Groups
    of `in_task` clusters or fewer take no part in rounds; one task each joins what is left of them."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    odd = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    own = rows.where(~F.coalesce(odd, F.lit(False)))  # what is no number is near to nothing
    # equal vectors are joined before all else, and are one cluster to begin with; not so those too short to be a unit
    alone = F.when(F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)) >= 0.5, F.lit(None)).otherwise(F.col("cid"))
    each = own.select(group, F.col("pos").cast("long").alias("cid"), v.alias("u"))
    each = each.withColumn("alone", alone if threshold < 1 - 1e-9 else F.col("cid"))
    once = each.groupBy(group, "u", "alone").agg(F.min("cid").alias("cid"), F.count(F.lit(1)).alias("n"))
    once = once.select(group, "cid", "n", F.transform(unit_vector("u"), lambda x: x * F.col("n")).alias("s"), F.lit(True).alias("live"), "u", "alone")
    once, live = stepped(once, "linkage-equal", F.col("live"))
    state = once.select(group, "cid", "n", "s", "live")
    first = once.where("n > 1").select(group, "u", F.col("cid").alias("_to"))
    copied = each.where("alone is null").join(first, [group, "u"]).select(group, F.col("cid").alias("pos"), "_to")
    member = rows.select(group, F.col("pos").cast("long").alias("pos")).join(copied, [group, "pos"], "left")
    member, _ = stepped(member.select(group, "pos", F.coalesce("_to", "pos").alias("cid")), "linkage-members", F.lit(True))
    rest = []
    while live:
        if in_task:
            few = state.groupBy(group).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") <= in_task).select(group)
            few, some = stepped(few, "linkage-few", F.lit(True))
            if some:
                rest.append(state.join(few, group, "left_semi"))
                state, live = stepped(state.join(few, group, "left_anti"), "linkage", F.col("live"))
                if not live:
                    break
        near, found = stepped(nearest_clusters(state, group, threshold, block), "linkage-near", F.lit(True))
        if not found:
            break
        back = near.select(group, F.col("near").alias("cid"), F.col("cid").alias("near"))
        joined = near.join(back, [group, "cid", "near"], "left_semi").where("cid < near").select(group, "cid", F.col("near").alias("gone"))
        joined, _ = stepped(joined, "linkage-joined", F.lit(True))
        theirs = state.select(group, F.col("cid").alias("gone"), F.col("n").alias("_n"), F.col("s").alias("_s"))
        grown = joined.join(theirs, [group, "gone"]).select(group, "cid", "_n", "_s")
        kept = state.join(near.select(group, "cid"), [group, "cid"], "left_semi").join(joined.select(group, F.col("gone").alias("cid")), [group, "cid"], "left_anti")
        kept = kept.join(grown, [group, "cid"], "left")
        kept = kept.select(
            group,
            "cid",
            (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
            F.when(F.col("_s").isNull(), F.col("s")).otherwise(F.zip_with("s", "_s", lambda x, y: x + y)).alias("s"),
            F.lit(True).alias("live"),
        )
        moved = joined.select(group, F.col("cid").alias("_to"), F.col("gone").alias("cid"))
        step = member.join(moved, [group, "cid"], "left").select(group, "pos", F.coalesce("_to", "cid").alias("cid"))
        member, _ = stepped(step, "linkage-members", F.lit(True), member)
        state, live = stepped(kept, "linkage", F.col("live"), None if in_task else state)
    if rest:
        step = member.join(ended(reduce(DataFrame.union, rest), group, threshold), [group, "cid"], "left")
        member, _ = stepped(step.select(group, "pos", F.coalesce("_to", "cid").alias("cid")), "linkage-members", F.lit(True), member)
    return member


def linked_clusters(rows: DataFrame, group: str, threshold: float, block: int = BLOCK, in_task: int = 0) -> DataFrame:
    """(group, pos, cluster, size, medoid): clusters numbered by their first members; the medoid is the member
    with the largest mean similarity to all of them, of equals the first, found by the product with their sum."""
    member = linked(rows, group, threshold, block, in_task)
    v = F.transform("embedding", lambda x: x.cast("double"))
    own = rows.select(group, F.col("pos").cast("long").alias("pos"), v.alias("u")).join(member, [group, "pos"])
    own = own.select(group, "pos", "cid", unit_vector("u").alias("u"))
    # a component of a sum is a group of its own: no list of members is gathered
    sums = own.select(group, "cid", F.posexplode("u").alias("k", "x")).groupBy(group, "cid", "k").agg(F.sum("x").alias("x"))
    sums = sums.groupBy(group, "cid").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("s"))
    sums = sums.select(group, "cid", F.transform("s", lambda x: x["x"]).alias("s"))
    size = member.groupBy(group, "cid").agg(F.count(F.lit(1)).cast("int").alias("size"))
    dot = F.round(F.aggregate(F.zip_with("u", "s", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), PLACES)
    near = own.join(sums, [group, "cid"]).select(group, "pos", "cid", dot.alias("_d"))
    medoid = near.groupBy(group, "cid").agg(F.max_by("pos", F.struct("_d", -F.col("pos"))).alias("_m"))
    number = F.row_number().over(Window.partitionBy(group).orderBy("cid")) - 1
    named = size.join(medoid, [group, "cid"]).withColumn("cluster", number)
    return member.join(named, [group, "cid"]).select(group, "pos", "cluster", "size", (F.col("pos") == F.col("_m")).alias("medoid"))
