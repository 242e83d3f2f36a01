"""Windows over ordered rows: latest, islands, budgets, fair order, samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changelens.functions.paths import can_transition, progress


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; combines on the map side, sorts nothing."""
    rest = [c for c in df.columns if c not in keys]
    own = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return own.select(*keys, *(F.col("_r").getField(c).alias(c) for c in rest)).select(*df.columns)


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """Intervals joined where one begins at most `gap` after those before it end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = df.withColumn("_new", F.when(F.col(start) <= reach + gap, 0).otherwise(1))
    own = own.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def runs_of_integers(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    own = df.select(*keys, n).distinct()
    w = Window.partitionBy(*keys).orderBy(n)
    own = own.withColumn("_g", F.col(n) - F.row_number().over(w))
    return own.groupBy(*keys, "_g").agg(F.min(n).alias("start"), F.max(n).alias("end")).drop("_g")


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, session, start, end, n): rows no further apart than the gap."""
    w = Window.partitionBy(key).orderBy(ts)
    far = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w)) > gap_seconds
    own = df.withColumn("session", F.sum(F.coalesce(far, F.lit(False)).cast("int")).over(w))
    return own.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))


def round_robin(arrivals: DataFrame, group: str, order: list[str], max_depth: int | None = None) -> DataFrame:
    """arrivals with `admitted` (the first max_depth) and `turn`: one of each group
    after another, first come first served within a group."""
    own = arrivals
    if max_depth is not None:
        first = arrivals.orderBy(*order).limit(max_depth).withColumn("_in", F.lit(True))
        own = arrivals.join(first.select(*order, group, "_in"), [*order, group], "left").withColumn("admitted", F.coalesce("_in", F.lit(False))).drop("_in")
    else:
        own = own.withColumn("admitted", F.lit(True))
    w = Window.partitionBy(group, "admitted").orderBy(*order)
    begin = own.groupBy(group, "admitted").agg(F.min(F.struct(*order)).alias("_first"))
    own = own.withColumn("_n", F.row_number().over(w)).join(begin, [group, "admitted"])
    # the turn is a place among all admitted: rounds first, groups by arrival within
    per_round = own.groupBy("admitted", "_n").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("admitted").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_round = per_round.select("admitted", "_n", before.alias("_before"))
    turn = F.row_number().over(Window.partitionBy("admitted", "_n").orderBy("_first"))
    out = own.withColumn("_t", turn).join(per_round, ["admitted", "_n"])
    return out.withColumn("turn", F.when(F.col("admitted"), F.col("_before") + F.col("_t"))).drop("_n", "_t", "_before", "_first")


def within_output_budget(lines: DataFrame, keys: list[str], order: str, size: Column, max_lines: int, max_size: int) -> DataFrame:
    """Lines up to the first that breaks either bound; nothing after it."""
    w = Window.partitionBy(*keys).orderBy(order)
    own = lines.withColumn("_n", F.row_number().over(w)).withColumn("_s", F.sum(size).over(w))
    over = F.max(((F.col("_n") > max_lines) | (F.col("_s") > max_size)).cast("int")).over(w)
    return own.withColumn("_over", over).where("_over = 0").drop("_n", "_s", "_over")


def capped_claims(claims: DataFrame, caps: dict[str, int]) -> DataFrame:
    """claims(owner, pos, kind, text, source): the first of each (kind, text), whatever
    its case, and as many of a kind as its cap."""
    from changelens.schemas import literal_map

    w = Window.partitionBy("owner", "kind", F.lower("text")).orderBy("pos")
    own = claims.withColumn("_d", F.row_number().over(w)).where("_d = 1")
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("owner", "kind").orderBy("pos")))
    return own.where(F.col("_n") <= F.coalesce(F.try_element_at(literal_map(caps), F.col("kind")), F.lit(0))).drop("_d", "_n")


def top_groups(df: DataFrame, keys: list[str], group: str, pos: str, most_groups: int, most_members: int) -> DataFrame:
    """Groups by where they first appear, members by position."""
    own = df.withColumn("_first", F.min(pos).over(Window.partitionBy(*keys, group)))
    own = own.withColumn("_g", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first")))
    own = own.withColumn("_m", F.row_number().over(Window.partitionBy(*keys, group).orderBy(pos)))
    return own.where((F.col("_g") <= most_groups) & (F.col("_m") <= most_members)).drop("_first", "_g", "_m")


def running_before(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("committed", F.coalesce(F.sum(value).over(w), F.lit(0.0)))


class Fold:
    """What a sequence is folded into: take() is given its rows in order, done() follows the last one."""

    def take(self, row) -> Iterator[tuple]:
        return iter(())

    def done(self) -> Iterator[tuple]:
        return iter(())


def folded(df: DataFrame, keys: list[str], order: list[str], begin: Callable[[], Fold], out: str) -> DataFrame:
    """Rows of each key, in order, through a fold of its own. Partitions are sorted by Spark, which spills, and
    read in Arrow batches over which the fold is carried, so a key of any length takes the memory of one batch and its fold."""
    names = [x.split()[0] for x in out.split(", ")]
    # sequences of equal keys are whole in a partition; a key is one sequence by definition
    own = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold = None, None
        for frame in frames:
            rows: list[tuple] = []
            for r in frame.itertuples(index=False):
                at = tuple(getattr(r, k) for k in keys)
                if fold is None or at != key:
                    if fold is not None:
                        rows += fold.done()
                    key, fold = at, begin()
                rows += fold.take(r)
            yield pd.DataFrame(rows, columns=names)
        if fold is not None:
            yield pd.DataFrame(list(fold.done()), columns=names)

    return own.mapInPandas(run, out)


RESERVED = "id LONG, granted BOOLEAN, refused_by STRING"


def reservations(calls: DataFrame, total_cap: float, day_cap: float, run_cap: float) -> DataFrame:
    """calls(ledger, id, repo, day, run_id, usd) in order of id: a call is refused by the
    first cap it would exceed (total, repository and day, run), and then adds nothing."""

    class Ledger(Fold):
        def __init__(self) -> None:
            self.spent: dict[tuple, float] = {}

        def take(self, r):
            scopes = (("total",), total_cap), (("repo_day", r.repo, r.day), day_cap), (("run", r.run_id), run_cap)
            over = [scope[0] for scope, cap in scopes if self.spent.get(scope, 0.0) + r.usd > cap]
            if not over:
                self.spent |= {scope: self.spent.get(scope, 0.0) + r.usd for scope, _ in scopes}
            yield r.id, not over, next(iter(over), None)

    return folded(calls, ["ledger"], ["id"], Ledger, RESERVED)


def excerpts(windows: DataFrame, budget: int) -> DataFrame:
    """windows(packet, side, pos, text): of each packet head windows, then base ones, while
    they fit the budget the sides share; a side ends at its first that does not."""

    class Packet(Fold):
        def __init__(self) -> None:
            self.left, self.ended = budget, set()

        def take(self, r):
            if r.side not in self.ended and len(r.text) <= self.left:
                self.left -= len(r.text)
                yield r.packet, r.side, r.pos, r.text
            else:
                self.ended.add(r.side)

    own = windows.select("packet", "side", "pos", "text").where(F.col("side").isin("head", "base"))
    ddl = ", ".join(f"{c} {kind}" for c, kind in own.dtypes)
    return folded(own.withColumn("_last", F.col("side") == "base"), ["packet"], ["_last", "pos"], Packet, ddl)


def debounced(pushes: DataFrame, key: str, at: str, head: str, window_seconds: float) -> DataFrame:
    """Runs of pushes(key, at, head): a window opens at a push, stays open for its length
    and runs the last head pushed in it; the next push opens another. Of pushes at one time
    the last by head is the last."""

    class Windows(Fold):
        def __init__(self) -> None:
            self.held: tuple | None = None

        def take(self, r):
            own, now, last = getattr(r, key), getattr(r, at), getattr(r, head)
            if self.held is not None and now - self.held[1] < window_seconds:
                self.held = (*self.held[:2], last, self.held[3] + 1)
                return
            yield from self.done()
            self.held = (own, now, last, 1)

        def done(self):
            if self.held is not None:
                yield self.held

    return folded(pushes.select(key, at, head), [key], [at, head], Windows, f"{key} STRING, queued_at DOUBLE, {head} STRING, pushes INT")


def by_widest(df: DataFrame, value: str, out: str, keys: list[str]) -> DataFrame:
    """value by the largest of its partition; 0 where that is 0."""
    widest = df.groupBy(*keys).agg(F.max(value).alias("_w")) if keys else df.agg(F.max(value).alias("_w"))
    both = df.join(widest, keys) if keys else df.crossJoin(F.broadcast(widest))
    return both.withColumn(out, F.coalesce(F.try_divide(F.col(value), F.col("_w")), F.lit(0.0))).drop("_w")


def cpu_percent(readings: DataFrame) -> DataFrame:
    """readings(job_id, at_s, cpu_s) with cpu_pct between a reading and the one before."""
    w = Window.partitionBy("job_id").orderBy("at_s")
    pct = F.try_divide(F.col("cpu_s") - F.lag("cpu_s").over(w), F.col("at_s") - F.lag("at_s").over(w)) * 100
    return readings.withColumn("cpu_pct", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1000.0), pct)), F.lit(0.0)))


def thinned(samples: DataFrame, every: int) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy("offset_ms")
    return samples.withColumn("_n", F.row_number().over(w)).where((F.col("_n") - 1) % max(1, every) == 0).drop("_n")


def unique_slugs(wanted: list[str], taken: set[str] = frozenset()) -> list[str]:
    """Names in order; one that is taken gets -2, -3, ... (a few hundred at most)."""
    used, out = set(taken), []
    for name in wanted:
        own, n = name, 2
        while own in used:
            own, n = f"{name}-{n}", n + 1
        used.add(own)
        out.append(own)
    return out


def last_status(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    return lines.groupBy(*keys).agg(F.max_by("status", order).alias("status"))


def first_answers(answers: DataFrame, key: str, pos: str) -> DataFrame:
    return answers.groupBy(key).agg(F.min_by(F.struct(*[c for c in answers.columns if c != key]), pos).alias("_r")).select(key, "_r.*")


def transitions(states: DataFrame, key: str, order: list[str], state: str = "state") -> DataFrame:
    """states with the one before, whether the step is legal, and progress."""
    prior = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    own = states.withColumn("prior", prior)
    legal = F.when(F.col("prior").isNull(), True).otherwise(can_transition(F.col("prior"), F.col(state)))
    return own.withColumn("legal", legal).withColumn("progress", progress(F.col(state)))


def superseded(runs: DataFrame) -> DataFrame:
    """runs with superseded_by: the next run of the pull, where this one is not done."""
    nxt = F.lead("id").over(Window.partitionBy("repo", "pr_number").orderBy("created_at", "id"))
    return runs.withColumn("superseded_by", F.when(F.col("state") != "done", nxt).otherwise(F.col("superseded_by")))
