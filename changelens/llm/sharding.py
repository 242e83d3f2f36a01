"""Shards by balanced label propagation, in DataFrame operations only.

Law `rows`: shard sizes differ by one row at most. Documents linked by a common
key (here: equal texts) are drawn together: every linked document begins in a
shard dealt by rank, and in each round those of a link group that are not where
most of their group is move there, as far as the shard's quota leaves room; a full
shard is passed over for the one with the next most. Each move cuts fewer edges
than before, and no shard ever exceeds its quota. Rounds end when none moves, or
after MOST_ROUNDS of them: the law holds either way, edges may then be cut that a
further round would join. Documents without links then fill what is left.

Who is let in, and a document's slot, come from ranks without a global sort: rows
are counted in CHUNKS hash chunks a shard, the counts are summed up over the
chunks (a table of shards times chunks rows), and rows are numbered within a
chunk. Only counts of shards, never links or groups, come to the driver.

Cases: a null text is an empty one, and so linked to empty texts. Repeated rows and
repeated or null doc_ids are separate documents. A group larger than a shard fills
several shards. Fewer documents than shards leave shards empty; an empty table
gives no rows. Text length plays no part in moves; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, written

ROW_BYTES = 8
SPLIT = 64
CHUNKS = SPLIT * SPLIT
MOST_ROUNDS = 64


def _ranked(df: DataFrame, keys: list[str], group: Column, each: Column, out: str) -> DataFrame:
    """df with a gapless rank from 0 for each value of keys, in chunks by the hashes
    of group and each, so that rows of a group mostly follow each other."""
    df = df.withColumns({"_c": F.pmod(F.xxhash64(group), F.lit(SPLIT)) * SPLIT + F.pmod(F.xxhash64(each), F.lit(SPLIT))})
    sums = df.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_c", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*keys, "_c").orderBy(group, each)
    numbered = df.withColumn("_r", F.row_number().over(own) - 1)
    return numbered.join(sums, [*keys, "_c"]).withColumn(out, F.col("_before") + F.col("_r")).drop("_c", "_r", "_before")


def _per_shard(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), shard.cast("int") + 1)


def _by_rank(rank: Column, sizes: list[int]) -> Column:
    """The shard of a rank where shards are filled one after another."""
    shard, upto = F.lit(len(sizes) - 1), sum(sizes)
    for j in range(len(sizes) - 1, -1, -1):
        shard = F.when(rank < upto, F.lit(j)).otherwise(shard)
        upto -= sizes[j]
    return shard.cast("int")


def balanced_shards(docs: DataFrame, n_shards: int = 24, links: list[str] | None = None) -> DataFrame:
    """docs(uid, ...) with columns shard and slot. uid is unique; rows with equal
    values in the columns `links` are linked."""
    spark = docs.sparkSession
    links = links or ["link"]
    total = docs.count()
    quota = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    sizes = docs.groupBy(*links).agg(F.count(F.lit(1)).alias("_g")).where("_g > 1").select(*links)
    sizes = written(spark, sizes, "shard-links")  # so that the join can split a large group
    linked_ids = docs.join(sizes.hint("merge"), links).select("uid", F.xxhash64(*links).alias("_k"), *links)
    one = linked_ids.withColumn("_one", F.lit(0))
    start = _ranked(one, ["_one"], F.col("_k"), F.col("uid"), "_rank")
    n_linked = linked_ids.count()
    begin = [n_linked // n_shards + (k < n_linked % n_shards) for k in range(n_shards)]  # never above the quota
    state = written(spark, start.select("uid", *links, "_k", _by_rank(F.col("_rank"), begin).alias("shard")), "shards")

    def loads(df: DataFrame) -> list[int]:
        got = {r[0]: r[1] for r in df.groupBy("shard").count().collect()}  # a row for each shard
        return [got.get(j, 0) for j in range(n_shards)]

    held = loads(state)
    for _ in range(MOST_ROUNDS):
        room = [q - h for q, h in zip(quota, held)]
        hist = state.groupBy(*links, "shard").agg(F.count(F.lit(1)).alias("_n"))
        best = hist.groupBy(*links).agg(
            F.max(F.struct("_n", (-F.col("shard")).alias("_s"))).alias("_top"),
            F.max(
                F.when(_per_shard(room, F.col("shard")) > 0, F.struct("_n", (-F.col("shard")).alias("_s")))
            ).alias("_open"),
            F.count(F.lit(1)).alias("_shards"),
        )
        best = best.where("_shards > 1 and _open is not null")
        # the full shard with most of a group keeps what it has; the rest goes to the next one with room
        near = hist.join(best.hint("merge"), links)
        better = (F.col("_n") < F.col("_open._n")) | (
            (F.col("_n") == F.col("_open._n")) & (F.col("shard") > -F.col("_open._s"))
        )
        moves = near.where(better).select(*links, "shard", (-F.col("_open._s")).alias("_to"))
        movers = state.join(moves.hint("merge"), [*links, "shard"])
        ranked = _ranked(movers.select("uid", "_k", "_to"), ["_to"], F.col("_k"), F.col("uid"), "_rank")
        let_in = ranked.where(F.col("_rank") < _per_shard(room, F.col("_to"))).select("uid", "_to")
        step = state.join(let_in.hint("merge"), "uid", "left")
        step = step.select("uid", *links, "_k", F.coalesce("_to", "shard").alias("shard"), F.col("_to").isNotNull().alias("_moved"))
        step = written(spark, step, "shards")
        moved = step.where("_moved").count()
        dropped(spark, state)
        state = step.drop("_moved")
        state._changelens_path = step._changelens_path
        if not moved:
            break
        held = loads(state)

    left = [q - h for q, h in zip(quota, loads(state))]
    single = docs.join(state.select("uid").hint("merge"), "uid", "left_anti").select("uid")
    single = _ranked(single.withColumn("_one", F.lit(0)), ["_one"], F.col("uid"), F.col("uid"), "_rank")
    placed = single.select("uid", _by_rank(F.col("_rank"), left).alias("shard")).union(state.select("uid", "shard"))
    placed = _ranked(placed, ["shard"], F.col("uid"), F.col("uid"), "slot")
    return docs.join(placed.hint("merge"), "uid")


def cut_edges(sharded: DataFrame, links: list[str]) -> DataFrame:
    """One row: links between neighbours (size of a group less one) in all, and
    those that shards cut (shards of a group less one)."""
    own = sharded.groupBy(*links, "shard").agg(F.count(F.lit(1)).alias("n")).groupBy(*links)
    own = own.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("s"))
    return own.agg(F.sum(F.col("n") - 1).alias("edges"), F.sum(F.col("s") - 1).alias("cut"))


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("link"),
    )
    slim = written(spark, slim, "shard-rows")  # numbers, no texts: a few per cent of the input
    out = balanced_shards(slim, n_shards, ["link", "text_crc32", "size"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
