"""The event log as a stream: replay then live, change detection, run states, debounce,
queues, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from changelens.schemas import DDL, RUN_STATES, TERMINAL_STATES

EVENTS = DDL["events"]


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_event_time(stream: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    kind = dict(stream.dtypes)[ts]
    at = F.timestamp_seconds(ts) if kind == "double" else F.col(ts).cast("timestamp")
    return stream.withColumn("event_time", at).withWatermark("event_time", delay)


def tail_after(stream: DataFrame, cursor: int, run_id: str | None = None, repo: str | None = None) -> DataFrame:
    """Each event after the cursor once, replayed and live alike."""
    from changelens.sources.tables import optional

    own = stream.where((F.col("seq") > cursor) & optional("run_id", run_id) & optional("repo", repo))
    return with_event_time(own).dropDuplicatesWithinWatermark(["seq"]).drop("event_time")


def split_persisted(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored, transient): events published with seq 0 are never stored."""
    return batch.where("seq > 0"), batch.where("seq = 0")


def tumbling(stream: DataFrame, length: str, by: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    own = with_event_time(stream, delay, ts).groupBy(F.window("event_time", length), *by).agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, gap: str, key: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    own = with_event_time(stream, delay, ts).groupBy(F.session_window("event_time", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


#: Groups whose keys share a call and a state: overhead is by group, not by key.
GROUPS = 1024


def _grouped(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(GROUPS)))


def _ordered(frames: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(order, kind="stable")


def moved_heads(polls: DataFrame) -> DataFrame:
    """polls(repo, number, head_sha, seen_at): a row whenever a pull is new or its head
    moved; the last head of each pull is the state, kept for a group of pulls at once."""
    out = "repo STRING, number INT, head_sha STRING, previous STRING"

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        repos, numbers, heads = state.get if state.exists else ((), (), ())
        last = dict(zip(zip(repos, numbers), heads))
        rows = _ordered(frames, "seen_at")
        found = []
        # a column with nulls comes as floats
        pulls = zip(rows["repo"].tolist(), (None if n != n else int(n) for n in rows["number"].tolist()))
        for pull, head in zip(pulls, rows["head_sha"].tolist()):
            before = last.get(pull)
            if head != before:
                found.append((*pull, head, before))
            last[pull] = head
        state.update(([r for r, _ in last], [n for _, n in last], list(last.values())))
        yield pd.DataFrame(found, columns=["repo", "number", "head_sha", "previous"]).astype({"number": "Int32"})

    held = "repo ARRAY<STRING>, number ARRAY<INT>, head_sha ARRAY<STRING>"
    return _grouped(polls, "repo", "number").groupBy("_group").applyInPandasWithState(step, out, held, "append", GroupStateTimeout.NoTimeout)


def run_states(events: DataFrame) -> DataFrame:
    """events(run_id, seq, state): each step with whether it is legal. A step that is not
    leaves the state as it was; a run that is over stays so. A group of runs shares a state."""
    out = "run_id STRING, seq LONG, prior STRING, state STRING, legal BOOLEAN"
    place = {s: i for i, s in enumerate(RUN_STATES)}

    def step(key, frames, state: GroupState):
        held = dict(zip(*state.get)) if state.exists else {}
        rows = _ordered(frames, "seq")
        prior, legal = [], []
        for run, then in zip(rows["run_id"].tolist(), rows["state"].tolist()):
            now = held.get(run)
            ok = now is None or (
                now not in TERMINAL_STATES
                and (then in ("failed", "cancelled") or place.get(then, -1) > place.get(now, len(place)))
            )
            prior.append(now)
            legal.append(ok)
            if ok:
                held[run] = then
        state.update((list(held), list(held.values())))
        yield rows[["run_id", "seq"]].assign(prior=prior, state=rows["state"], legal=legal)

    own = _grouped(events, "run_id").groupBy("_group")
    return own.applyInPandasWithState(step, out, "run_id ARRAY<STRING>, state ARRAY<STRING>", "append", GroupStateTimeout.NoTimeout)


def debounced(pushes: DataFrame, window_seconds: float, timer: bool = True) -> DataFrame:
    """pushes(repo, number, head_sha, at): the run that starts a window after the first
    push, with the last head pushed in it. A window closes when a later push arrives or,
    without one, when processing time has passed it. Without the timer only pushes close
    windows; a query that is to end (availableNow) needs that, a timer never idles."""
    out = "repo STRING, number INT, head_sha STRING, queued_at DOUBLE, pushes INT"

    def step(key, frames, state: GroupState):
        held = list(state.get) if state.exists else None
        found = []
        if state.hasTimedOut:
            found.append((*key, held[0], held[1], held[2]))
            state.remove()
        else:
            for r in pd.concat(list(frames)).sort_values("at").itertuples(index=False):
                if held is not None and r.at - held[1] < window_seconds:
                    held = [r.head_sha, held[1], held[2] + 1]
                else:
                    if held is not None:
                        found.append((*key, held[0], held[1], held[2]))
                    held = [r.head_sha, float(r.at), 1]
            state.update((held[0], held[1], held[2]))
            if timer:
                state.setTimeoutDuration(max(1, int(window_seconds * 1000)))
        yield pd.DataFrame(found, columns=["repo", "number", "head_sha", "queued_at", "pushes"])

    return pushes.groupBy("repo", "number").applyInPandasWithState(
        step, out, "head_sha STRING, queued_at DOUBLE, pushes INT", "append", GroupStateTimeout.ProcessingTimeTimeout if timer else GroupStateTimeout.NoTimeout
    )


def fair_queue(arrivals: DataFrame, max_depth: int) -> DataFrame:
    """arrivals(lane, arrival, repo, run_id, kind), kind being queue or done: each queued run
    as admitted, or rejected while max_depth runs of its lane are waiting. A queue is
    one lane's state, so lanes are what spreads over tasks."""
    out = "lane STRING, arrival LONG, repo STRING, run_id STRING, admitted BOOLEAN, waiting INT"

    def step(key, frames, state: GroupState):
        waiting = list(state.get[0]) if state.exists else []
        found = []
        for r in pd.concat(list(frames)).sort_values("arrival").itertuples(index=False):
            if r.kind == "done":
                waiting = [x for x in waiting if x != r.run_id]
                continue
            ok = len(waiting) < max_depth
            if ok:
                waiting.append(r.run_id)
            found.append((key[0], r.arrival, r.repo, r.run_id, ok, len(waiting)))
        state.update((waiting,))
        yield pd.DataFrame(found, columns=["lane", "arrival", "repo", "run_id", "admitted", "waiting"])

    return arrivals.groupBy("lane").applyInPandasWithState(step, out, "waiting ARRAY<STRING>", "append", GroupStateTimeout.NoTimeout)


def fair_dispatch(events: DataFrame) -> DataFrame:
    """events(lane, arrival, repo, run_id, kind), kind being queue or next: for each next the
    run that is dispatched, one repository's turn after another, first come first served within
    a repository; null while nothing waits. A lane is one state."""
    out = "lane STRING, arrival LONG, repo STRING, run_id STRING"

    def step(key, frames, state: GroupState):
        # repositories by turn, and the runs of each by arrival
        turns = {repo: list(runs) for repo, runs in state.get[0]} if state.exists else {}
        found = []
        for r in pd.concat(list(frames)).sort_values("arrival").itertuples(index=False):
            if r.kind == "queue":
                turns.setdefault(r.repo, []).append(r.run_id)
            elif turns:
                repo = next(iter(turns))
                run, *rest = turns.pop(repo)
                if rest:
                    turns[repo] = rest
                found.append((key[0], r.arrival, repo, run))
            else:
                found.append((key[0], r.arrival, None, None))
        state.update((list(turns.items()),))
        yield pd.DataFrame(found, columns=["lane", "arrival", "repo", "run_id"])

    waiting = "waiting ARRAY<STRUCT<repo: STRING, runs: ARRAY<STRING>>>"
    return events.groupBy("lane").applyInPandasWithState(step, out, waiting, "append", GroupStateTimeout.NoTimeout)


def buffered(events: DataFrame, capacity: int = 4096) -> DataFrame:
    """(subscriber, taken_at, seq, dropped) of events(subscriber, arrival, kind, seq), kind being event or taken
    (seq: how many the subscriber takes): what each subscriber gets when it takes, and at its next taking how many
    events found its buffer full. A buffer fills and drains; it is one subscriber's state, bounded by its capacity."""
    out = "subscriber STRING, taken_at LONG, seq LONG, dropped LONG"

    def step(key, frames, state: GroupState):
        waiting, dropped = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        found = []
        for r in pd.concat(list(frames)).sort_values("arrival").itertuples(index=False):
            if r.kind == "event":
                if len(waiting) < capacity:
                    waiting.append(int(r.seq))
                else:
                    dropped += 1
                continue
            given, waiting = waiting[: int(r.seq)], waiting[int(r.seq) :]
            # a row without an event tells of drops where nothing waited
            found += [(key[0], r.arrival, x, dropped if k == 0 else 0) for k, x in enumerate(given or [None])] if given or dropped else []
            dropped = 0
        state.update((waiting, dropped))
        frame = pd.DataFrame(found, columns=["subscriber", "taken_at", "seq", "dropped"])
        yield frame.astype({"seq": "Int64"})

    state = "waiting ARRAY<LONG>, dropped LONG"
    return events.groupBy("subscriber").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def offered(batch: DataFrame, buffer: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(taken, dropped) of a batch(subscriber, seq): the first events each subscriber's
    buffer holds, and (subscriber, dropped) counts of those it has no room for."""
    w = Window.partitionBy("subscriber").orderBy("seq")
    own = batch.withColumn("_n", F.row_number().over(w))
    over = own.groupBy("subscriber").agg(F.count_if(F.col("_n") > buffer).alias("dropped"))
    return own.where(F.col("_n") <= buffer).drop("_n"), over


def raised(signals: DataFrame, stored: DataFrame | None = None, webhook_floor: str | None = None) -> DataFrame:
    """Notable and major signals(repo, kind, sha, level, ...) with `id` and `deliver`, once for ever for each
    (repo, kind, sha): those of `stored` (id) were raised before, later ones are remembered by the stream's
    state, which has no watermark. `deliver` holds from the floor on; without one nothing is delivered."""
    from changelens.functions.paths import notification_id
    from changelens.schemas import ordinal

    own = signals.where(F.col("level").isin("notable", "major"))
    own = own.withColumn("id", notification_id(F.col("repo"), F.col("kind"), F.col("sha")))
    if stored is not None:
        own = own.join(stored.select("id"), "id", "left_anti")
    loud = F.lit(False) if webhook_floor is None else ordinal(F.col("level")) >= ordinal(F.lit(webhook_floor))
    return own.dropDuplicates(["id"]).select(*signals.columns, "id", loud.alias("deliver"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there now and stops."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def relearned(batches: DataFrame, checkpoint: str, learn) -> None:
    """Calls learn(batch) for micro-batches that bring newly enforced comments."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.where("enforced").isEmpty():
            learn(batch)

    q = batches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
