import random

import pytest
from pyspark.sql import functions as F

from changelens.streaming import events as ev
from changelens.streaming import replay


def land(spark, rows, ddl, path):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)


def stream(spark, ddl, path):
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)


def out(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).collect())


def test_replay_then_live_delivers_once(spark, tmp_path):
    src = f"{tmp_path}/log"
    row = lambda s: (s, float(s), "r", "repo", "t", "{}")
    land(spark, [row(s) for s in range(1, 6)], ev.EVENTS, src)
    tail = ev.tail_after(ev.event_stream(spark, src), 2)
    ev.run_available(tail, f"{tmp_path}/out", f"{tmp_path}/cp")
    land(spark, [row(s) for s in (4, 5, 6, 7)], ev.EVENTS, src)
    ev.run_available(tail, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert [r[0] for r in out(spark, f"{tmp_path}/out")] == [3, 4, 5, 6, 7]
    stored, gone = ev.split_persisted(spark.createDataFrame([row(0), row(1)], ev.EVENTS))
    assert stored.count() == gone.count() == 1


def test_run_states(spark, tmp_path):
    ddl = "run_id STRING, seq LONG, state STRING"
    src = f"{tmp_path}/s"
    land(spark, [("a", 1, "queued"), ("a", 2, "probing")], ddl, src)
    land(spark, [("a", 3, "base_run"), ("a", 4, "done"), ("a", 5, "failed")], ddl, src)
    ev.run_available(ev.run_states(stream(spark, ddl, src)), f"{tmp_path}/o", f"{tmp_path}/c")
    assert [(r[1], r[4]) for r in out(spark, f"{tmp_path}/o")] in ([(1, True), (2, True), (3, False), (4, True), (5, False)],)


def test_moved_heads_and_queue(spark, tmp_path):
    ddl = "repo STRING, number INT, head_sha STRING, seen_at DOUBLE"
    land(spark, [("r", 1, "a", 1.0), ("r", 1, "a", 2.0), ("r", 1, "b", 3.0)], ddl, f"{tmp_path}/p")
    ev.run_available(ev.moved_heads(stream(spark, ddl, f"{tmp_path}/p")), f"{tmp_path}/po", f"{tmp_path}/pc")
    assert sorted((r[2], r[3]) for r in out(spark, f"{tmp_path}/po")) == [("a", None), ("b", "a")]
    ddl = "lane STRING, arrival LONG, repo STRING, run_id STRING, kind STRING"
    land(spark, [("l", 1, "r", "x", "queue"), ("l", 2, "r", "y", "queue"), ("l", 3, "r", "x", "done"), ("l", 4, "r", "z", "queue")], ddl, f"{tmp_path}/q")
    ev.run_available(ev.fair_queue(stream(spark, ddl, f"{tmp_path}/q"), 1), f"{tmp_path}/qo", f"{tmp_path}/qc")
    assert [(r[3], r[4]) for r in out(spark, f"{tmp_path}/qo")] == [("x", True), ("y", False), ("z", True)]


def test_many_keys_share_states(spark, tmp_path):
    """Python is called and a state is kept for a group of keys, not for each key; what is found is the same."""
    n, shas = ev.GROUPS + 500, random.Random(3)
    polls = [("r", i, shas.choice("ab"), float(t)) for i in range(n) for t in range(2)]
    for t in range(2):
        land(spark, [p for p in polls if p[3] == t], "repo STRING, number INT, head_sha STRING, seen_at DOUBLE", f"{tmp_path}/p")
    ev.run_available(ev.moved_heads(stream(spark, "repo STRING, number INT, head_sha STRING, seen_at DOUBLE", f"{tmp_path}/p")), f"{tmp_path}/po", f"{tmp_path}/pc")
    first, second = ({p[1]: p[2] for p in polls if p[3] == t} for t in range(2))
    want = [("r", i, first[i], None) for i in first] + [("r", i, second[i], first[i]) for i in first if second[i] != first[i]]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/po").collect()), key=str) == sorted(want, key=str)
    assert spark.read.format("statestore").load(f"{tmp_path}/pc").count() <= ev.GROUPS
    steps = [(str(i), 2 * i + t, "done" if t else "queued") for i in range(n) for t in range(2)]
    land(spark, steps, "run_id STRING, seq LONG, state STRING", f"{tmp_path}/s")
    ev.run_available(ev.run_states(stream(spark, "run_id STRING, seq LONG, state STRING", f"{tmp_path}/s")), f"{tmp_path}/so", f"{tmp_path}/sc")
    got = spark.read.parquet(f"{tmp_path}/so")
    assert got.count() == 2 * n and got.where("legal and (prior is null) = (state = 'queued')").count() == 2 * n
    assert spark.read.format("statestore").load(f"{tmp_path}/sc").count() <= ev.GROUPS


def test_debounce(spark, tmp_path):
    ddl = "repo STRING, number INT, head_sha STRING, at DOUBLE"
    land(spark, [("r", 1, "a", 0.0), ("r", 1, "b", 5.0), ("r", 1, "c", 3700.0)], ddl, f"{tmp_path}/d")
    ev.run_available(ev.debounced(stream(spark, ddl, f"{tmp_path}/d"), 3600.0, timer=False), f"{tmp_path}/do", f"{tmp_path}/dc")
    assert out(spark, f"{tmp_path}/do") == [("r", 1, "b", 0.0, 2)]


@pytest.mark.parametrize("kind", ["tumbling", "sessions"])
def test_windows_equal_batch_on_closed_ones(spark, tmp_path, kind):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    s = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    make = (lambda x: ev.tumbling(x, "1 day", ["event_type"])) if kind == "tumbling" else (lambda x: ev.sessions(x, "30 minutes", "user_id"))
    ev.run_available(make(s), f"{tmp_path}/w", f"{tmp_path}/wc")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/w").collect()}
    want = {tuple(r) for r in make(e).where(F.col("end") < "2024-01-29").collect()}
    assert want and want <= got


def test_raised_once(spark, tmp_path):
    ddl = "repo STRING, kind STRING, sha STRING, level STRING, created_at DOUBLE"
    land(spark, [("r", "k", "s", "major", 1.0), ("r", "k", "s", "major", 2.0), ("r", "k", "s2", "minor", 3.0)], ddl, f"{tmp_path}/n")
    ev.run_available(ev.raised(stream(spark, ddl, f"{tmp_path}/n")), f"{tmp_path}/no", f"{tmp_path}/nc")
    assert len(out(spark, f"{tmp_path}/no")) == 1


def test_raised_once_for_ever(spark, tmp_path):
    ddl = "repo STRING, kind STRING, sha STRING, level STRING, created_at DOUBLE"
    week = 7 * 86400.0
    stored = ev.raised(spark.createDataFrame([("r", "k", "old", "major", 0.0)], ddl)).select("id")
    land(spark, [("r", "k", "s", "major", 1.0), ("r", "k", "s", "notable", 2.0), ("r", "k", "old", "major", 3.0), ("q", "k", "s", "notable", 3.0)], ddl, f"{tmp_path}/n")
    ev.run_available(ev.raised(stream(spark, ddl, f"{tmp_path}/n"), stored, "major"), f"{tmp_path}/no", f"{tmp_path}/nc")
    for turn in range(1, 4):  # again a week later each time, after a restart from the checkpoint
        land(spark, [("r", "k", "s", "major", turn * week), ("r", "k", "old", "major", turn * week), ("r", "k", f"new{turn}", "major", turn * week)], ddl, f"{tmp_path}/n")
        ev.run_available(ev.raised(stream(spark, ddl, f"{tmp_path}/n"), stored, "major"), f"{tmp_path}/no", f"{tmp_path}/nc")
    got = [(r.repo, r.sha, r.deliver) for r in spark.read.parquet(f"{tmp_path}/no").collect()]
    assert sorted(x[:2] for x in got) == [("q", "s"), ("r", "new1"), ("r", "new2"), ("r", "new3"), ("r", "s")]
    assert ("q", "s", False) in got and ("r", "new1", True) in got
    quiet = ev.raised(spark.createDataFrame([("r", "k", "s", "major", 1.0)], ddl)).first()
    assert not quiet.deliver and quiet.id.startswith("n") and len(quiet.id) == 21


def test_replay_and_live_tail_to_folders(spark, tmp_path):
    row = lambda s: (s, float(s), f"run{s % 3}", "ab"[s % 2], "t", "{}")
    src, out_, cp = f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/cp"
    open_ = lambda: replay.after(ev.event_stream(spark, src, 1), 2)
    for part in ([0, 0, 1, 2, 3, 4], [4, 5, 5000, 9], [6, 7, 8, 3]):
        land(spark, [row(s) for s in part], ev.EVENTS, src)
    replay.fan_out(open_(), out_, cp, ["repo", "run_id"], once_only=True)
    half = replay.delivered(spark, out_, ev.EVENTS).count()
    replay.fan_out(open_(), out_, cp, ["repo", "run_id"])
    land(spark, [row(s) for s in range(1, 12)], ev.EVENTS, src)  # live, with all that was before
    replay.fan_out(open_(), out_, cp, ["repo", "run_id"])
    got = replay.delivered(spark, out_, ev.EVENTS)
    assert 0 < half < got.count()
    assert sorted((r.seq, r.run_id, r.repo) for r in got.collect()) == sorted((s, f"run{s % 3}", "ab"[s % 2]) for s in [*range(3, 12), 5000])
    assert [tuple(r) for r in replay.gaps(got.withColumn("all", F.lit(1)), ["all"]).collect()] == [(1, 11, 5000)]
    full = spark.createDataFrame([(s,) for s in range(replay.BLOCK)], "seq LONG")
    full.write.parquet(f"{tmp_path}/full/a")
    full.limit(10).write.parquet(f"{tmp_path}/full/b")
    s = spark.readStream.schema("seq LONG").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/full")
    replay.fan_out(replay.once(s).withColumn("one", F.lit(1)), f"{tmp_path}/fo", f"{tmp_path}/fc", ["one"])
    assert replay.delivered(spark, f"{tmp_path}/fo", "seq LONG, one INT").count() == replay.BLOCK


def test_buffers_fill_and_drain(spark, tmp_path):
    ddl = "subscriber STRING, arrival LONG, kind STRING, seq LONG"
    rng = random.Random(5)
    log = [(rng.choice("ab"), i, *rng.choice([("event", i), ("event", i), ("event", i), ("taken", 2)])) for i in range(120)]
    for part in range(4):
        land(spark, log[30 * part : 30 * part + 30], ddl, f"{tmp_path}/b")
    ev.run_available(ev.buffered(stream(spark, ddl, f"{tmp_path}/b"), 3), f"{tmp_path}/bo", f"{tmp_path}/bc")
    want, held, lost = [], {"a": [], "b": []}, {"a": 0, "b": 0}
    for who, at, kind, n in log:
        if kind == "event":
            if len(held[who]) < 3:
                held[who].append(n)
            else:
                lost[who] += 1
        else:
            given, held[who] = held[who][:n], held[who][n:]
            if given or lost[who]:
                want += [(who, at, x, lost[who] if k == 0 else 0) for k, x in enumerate(given or [None])]
            lost[who] = 0
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/bo").collect()), key=repr) == sorted(want, key=repr)
    assert any(x[3] for x in want)
