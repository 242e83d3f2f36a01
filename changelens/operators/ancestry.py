"""Commit graphs: generations, merge bases of many pairs at once, reach of many seeds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.session import cut, stepped

#: Doublings that any chain that fits a long takes.
MOST_DOUBLINGS = 64
BASE, HEAD, BOTH = 1, 2, 3


def contracted(parents: DataFrame, keep: DataFrame) -> DataFrame:
    """(commit, parent, steps): parents(commit, parent) without the commits inside of chains, those with
    one parent and one child that `keep` (commit) does not name. Chains are followed by doubling, so a
    straight history of n commits takes log n rounds and becomes one row."""
    edges = parents.where("commit is not null and parent is not null and commit <> parent").select("commit", "parent").distinct()
    edges, _ = stepped(edges, "history", F.lit(True))
    one_parent = edges.groupBy("commit").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("to")).where("n = 1")
    one_child = edges.groupBy(F.col("parent").alias("commit")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("commit")
    inner = one_parent.join(one_child, "commit", "left_semi").join(keep.select("commit"), "commit", "left_anti")
    jumps, more = stepped(inner.select("commit", "to", F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open")), "chains", F.col("open"))
    for _ in range(MOST_DOUBLINGS):
        if not more:
            break
        on = jumps.select(F.col("commit").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"))
        far = jumps.join(on, "to", "left")
        far = far.select("commit", F.coalesce("far", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNotNull().alias("open"))
        jumps, more = stepped(far, "chains", F.col("open"), jumps)
    else:
        raise ValueError("the history has a circle")
    outer = edges.join(jumps.select("commit"), "commit", "left_anti")
    over = jumps.select(F.col("commit").alias("parent"), "to", F.col("steps").alias("more"))
    out = outer.join(over, "parent", "left")
    out = out.select("commit", F.coalesce("to", "parent").alias("parent"), (F.lit(1) + F.coalesce("more", F.lit(0))).alias("steps"))
    return stepped(out.groupBy("commit", "parent").agg(F.max("steps").alias("steps")), "history", F.lit(True))[0]


def generations(edges: DataFrame) -> DataFrame:
    """(commit, generation) of edges(commit, parent, steps): the longest way down to a root, so that a
    commit's is above those of all behind it. A round hands on only what rose in the one before."""
    nodes = edges.select("commit").union(edges.select("parent")).distinct()
    state, risen = stepped(nodes.select("commit", F.lit(0).cast("long").alias("generation"), F.lit(True).alias("rose")), "generations", F.col("rose"))
    most = risen
    for _ in range(most + 1):
        if not risen:
            return state.drop("rose")
        up = state.where("rose").select(F.col("commit").alias("parent"), F.col("generation").alias("g")).join(edges, "parent")
        up = up.groupBy("commit").agg(F.max(F.col("g") + F.col("steps")).alias("g"))
        rose = F.coalesce(F.col("g") > F.col("generation"), F.lit(False))
        step = state.drop("rose").join(up, "commit", "left")
        step = step.select("commit", F.when(rose, F.col("g")).otherwise(F.col("generation")).alias("generation"), rose.alias("rose"))
        state, risen = stepped(step, "generations", F.col("rose"), state)
    raise ValueError("the history has a circle")


def merge_bases(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(base, head, commit): for each of pairs(base, head) the common ancestor of the highest generation, of
    equals the first by name; null where nothing is common. It is a best one: no other common ancestor
    descends from it. Tips count as ancestors of themselves.

    All pairs walk down the contracted history at once. A commit that both tips reach is not walked past,
    and nothing below the generation of a pair's best common ancestor is: what lies there cannot be better."""
    tips = pairs.select(F.col("base").alias("commit")).union(pairs.select(F.col("head").alias("commit"))).where("commit is not null").distinct()
    edges = contracted(parents, tips)
    known = generations(edges)
    own = pairs.select("base", "head").where("base is not null and head is not null").distinct()
    no, _ = stepped(own.withColumn("pair", F.monotonically_increasing_id()), "pairs", F.lit(True))
    start = no.select("pair", F.col("base").alias("commit"), F.lit(BASE).alias("sides")).union(no.select("pair", F.col("head").alias("commit"), F.lit(HEAD).alias("sides")))
    start = start.groupBy("pair", "commit").agg(F.bit_or("sides").alias("sides")).join(known, "commit", "left")
    start = start.select("pair", "commit", "sides", F.coalesce("generation", F.lit(0)).alias("generation"), F.lit(True).alias("fresh"))
    state, fresh = stepped(start, "walk", F.col("fresh"))
    while fresh:
        best = state.where(F.col("sides") == BOTH).groupBy("pair").agg(F.max("generation").alias("floor"))
        walk = state.where(F.col("fresh") & (F.col("sides") != BOTH)).select("pair", "commit", "sides")
        below = walk.join(edges.select("commit", "parent"), "commit").groupBy("pair", F.col("parent").alias("commit")).agg(F.bit_or("sides").alias("more"))
        below = below.join(known, "commit").join(best, "pair", "left").where(F.coalesce(F.col("generation") >= F.col("floor"), F.lit(True)))
        below = below.select("pair", "commit", "more", F.col("generation").alias("_g"))
        step = state.join(below, ["pair", "commit"], "full_outer")
        sides = F.coalesce("sides", F.lit(0)).bitwiseOR(F.coalesce("more", F.lit(0)))
        step = step.select("pair", "commit", sides.alias("sides"), F.coalesce("generation", "_g").alias("generation"), (~F.col("sides").eqNullSafe(sides)).alias("fresh"))
        state, fresh = stepped(step, "walk", F.col("fresh"), state)
    found = state.where(F.col("sides") == BOTH).groupBy("pair").agg(F.min_by("commit", F.struct(-F.col("generation"), F.col("commit"))).alias("commit"))
    return no.join(found, "pair", "left").select("base", "head", "commit")


def reach_of_each(edges: DataFrame, seeds: DataFrame, hops: int | None = 2) -> DataFrame:
    """(seed, node, hop): for every seed what calls it within hops (without a bound: at all), itself at 0;
    edges(caller, callee). Seeds go as bit sets, 64 in a row for each node, that are or-ed
    together before they are shuffled, so a hub costs a row for each 64 seeds and caller; only bits that are
    new to a node go on."""
    numbered = cut(seeds.select(F.col(seeds.columns[0]).alias("seed")).where("seed is not null").distinct().withColumn("no", F.monotonically_increasing_id()))
    own = edges.select("caller", "callee").where("caller is not null and callee is not null").distinct()
    block, bit = F.shiftright("no", 6).alias("block"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("no", F.lit(64)).cast("int"))
    fresh = cut(numbered.groupBy(F.col("seed").alias("node"), block).agg(F.bit_or(bit).alias("bits")))
    known, found, hop = fresh, fresh.withColumn("hop", F.lit(0)), 0
    while hops is None or hop < hops:
        hop += 1
        step = own.join(fresh.withColumnRenamed("node", "callee").hint("merge"), "callee").groupBy(F.col("caller").alias("node"), "block").agg(F.bit_or("bits").alias("bits"))
        old = known.withColumnRenamed("bits", "_old")
        step = step.join(old, ["node", "block"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0)))))
        fresh = cut(step.where("bits <> 0").select("node", "block", "bits"))
        if fresh.isEmpty():
            break
        known = cut(known.union(fresh).groupBy("node", "block").agg(F.bit_or("bits").alias("bits")))
        found = found.union(fresh.withColumn("hop", F.lit(hop)))
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    each = found.select("node", "hop", "block", F.explode(set_bits).alias("bit"))
    return each.withColumn("no", F.col("block") * 64 + F.col("bit")).join(numbered, "no").select("seed", "node", "hop")
