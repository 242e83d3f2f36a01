import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions import text
from changelens.operators import charter, deltas, findings, graph, grounding, lookups, mining, ranking, rollups, sequences
from changelens.sources import files, sinks, tables


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


TOY = {
    "leaf.py": "def c():\n    return 1\n",
    "middle.py": "from toypkg.leaf import c\n\ndef b():\n    return c()\n",
    "top.py": "from toypkg import middle\n\ndef a():\n    return middle.b()\n",
    "unrelated.py": "class K:\n    @property\n    async def d(self, x, *, y=1, **kw):\n        pass\n",
    "broken.py": "def (",
}


@pytest.fixture(scope="module")
def toy(spark):
    f = spark.createDataFrame([("r", p, s, "toypkg") for p, s in TOY.items()], "repo STRING, path STRING, content STRING, root STRING")
    sym = graph.python_symbols(f).cache()
    return sym, graph.call_edges(graph.python_calls(f), graph.python_imports(f), sym).cache()


def test_call_graph(toy):
    sym, edges = toy
    assert rows(edges, "caller", "callee") == [("toypkg.middle.b", "toypkg.leaf.c"), ("toypkg.top.a", "toypkg.middle.b")]
    assert ("toypkg.unrelated.K.d", "method", 3) in rows(sym, "fqn", "kind", "line_start")
    assert sym.where("fqn like '%K.d'").first().signature == "(self, x, *, y, **kw) defaults=1"


def test_blast_radius(spark, toy):
    sym, edges = toy
    seed = spark.createDataFrame([("toypkg.leaf.c",)], "fqn STRING")
    names = lambda n: [r.fqn.split(".")[-1] for r in graph.blast_radius(edges, sym, seed, n).collect()]
    assert sorted(names(2)) == ["a", "b", "c"] and sorted(names(1)) == ["b", "c"]
    assert rows(graph.callers_within(edges, sym, seed, 2), "fqn") == [("toypkg.middle.b",), ("toypkg.top.a",)]


def test_reach_with_cycles_equals_a_walk(spark):
    rng = random.Random(5)
    e = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(30)}
    df = spark.createDataFrame(list(e), "caller STRING, callee STRING")
    hop, want = {"n0"}, {"n0": 0}
    for h in (1, 2, 3):
        hop = {a for a, b in e if b in hop} - want.keys()
        want |= {n: h for n in hop}
    assert dict(rows(graph.reach(df, spark.createDataFrame([("n0",)], "n STRING"), 3), "node", "hop")) == want


def test_fork_point(spark):
    p = spark.createDataFrame([("m2", "m1"), ("m1", "m0"), ("f2", "f1"), ("f1", "m1")], "commit STRING, parent STRING")
    assert graph.fork_point(p, "m2", "f2").first()[0] == "m1"


def test_average_linkage_goldens():
    v = np.array([[1, 0, 0], [0.98, 0.14, 0], [0, 1, 0]], float)
    assert mining.average_linkage(v, 0.75) == [[0, 1], [2]]
    assert mining.average_linkage(v, 1.0) == [[0], [1], [2]]
    assert mining.average_linkage(v, -1.0) == [[0, 1, 2]]
    assert mining.average_linkage(np.zeros((0, 3)), 0.5) == []


def slow_linkage(v, threshold):
    u = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
    s = u @ u.T
    groups = [[i] for i in range(len(v))]
    while len(groups) > 1:
        best = max(((np.mean([s[i, j] for i in a for j in b]), -x, -y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y))
        if best[0] < threshold:
            break
        x, y = -best[1], -best[2]
        groups[x] += groups.pop(y)
    return sorted(sorted(g) for g in groups)


@pytest.mark.parametrize("seed", range(6))
def test_average_linkage_equals_brute_force(seed):
    v = np.random.default_rng(seed).normal(size=(14, 5))
    assert mining.average_linkage(v, 0.2) == slow_linkage(v, 0.2)


def test_mined_norms(spark):
    say = {
        "CHANGELOG": ["Please add a changelog entry for this change", "This change needs a changelog entry please", "Missing changelog entry for this change", "Add changelog entry here for the change"],
        "TYPES": ["Please annotate the return types of functions", "The return types of functions need annotation", "Annotate return types on these functions please"],
    }
    data = [(100 + k, f"u{k % 3}", t) for k, t in enumerate(x for v in say.values() for x in v)]
    df = spark.createDataFrame([("r", n, u, t, "url", f"2024-01-{n - 99:02d}", True) for n, u, t in data], "repo STRING, pr_number INT, reviewer_login STRING, body STRING, html_url STRING, created_at STRING, enforced BOOLEAN")
    got = mining.mined_norms(df).collect()
    assert len(got) == 2 and all(r.support >= 3 and r.distinct_reviewers >= 2 for r in got)
    assert all(r.quote in [t for _, _, t in data] and list(r.evidence_prs) == sorted(r.evidence_prs, reverse=True) for r in got)
    assert mining.mined_norms(df.withColumn("reviewer_login", F.lit("one"))).count() == 0


def test_enforced_comments(spark):
    pulls = spark.createDataFrame([(1, "2024"), (2, None), (3, "2024")], "number INT, merged_at STRING")
    comments = spark.createDataFrame([(1, "2024-01-01T00:00:00Z"), (1, "2024-01-03T00:00:00Z"), (2, "2024-01-01T00:00:00Z"), (3, "2024-01-01T00:00:00Z"), (1, "bad")], "number INT, created_at STRING")
    commits = spark.createDataFrame([(1, None, "2024-01-02T00:00:00Z"), (2, "2024-01-05T00:00:00Z", None), (1, "junk", None)], "number INT, committer_date STRING, author_date STRING")
    got = mining.enforced_comments(pulls, comments, commits)
    assert rows(got.where("enforced"), "number", "created_at") == [(1, "2024-01-01T00:00:00Z")]


def test_behaviour_and_outcomes(spark):
    base = spark.createDataFrame([("a", "passed"), ("b", "failed"), ("c", "passed")], "nodeid STRING, status STRING")
    head = spark.createDataFrame([("a", "failed"), ("b", "passed")], "nodeid STRING, status STRING")
    assert rows(deltas.behaviour_delta(base, head, "run"), "kind", "symbol") == [("behavior_change", "a"), ("test_removed", "c")]
    o = spark.createDataFrame([("r1", "base", "timeout"), ("r1", "head", "timeout"), ("r2", "base", "passed"), ("r2", "head", "timeout")], "run_id STRING, side STRING, outcome STRING")
    assert rows(deltas.outcome_delta(o), "run_id", "kind") == [("r2", "timeout")]


def test_lint_delta(spark):
    ddl = "path STRING, code STRING, message STRING"
    base = spark.createDataFrame([("a", "E", "x")], ddl)
    head = spark.createDataFrame([("a", "E", "x"), ("b", "E", "y"), ("b", "E", "y")] + [(f"p{i}", "W", "z") for i in range(30)], ddl)
    assert deltas.lint_delta(base, head, None).count() == 32
    assert deltas.lint_delta(base, head).count() == 26
    assert deltas.lint_set_delta(base, head).count() == 31


def test_intervals_equal_a_sorted_merge(spark):
    for seed in range(5):
        rng = random.Random(seed)
        spans = [(s := rng.randrange(100), s + rng.randrange(8)) for _ in range(25)]
        want = []
        for s, e in sorted(spans):
            if want and s <= want[-1][1] + 1:
                want[-1] = (want[-1][0], max(e, want[-1][1]))
            else:
                want.append((s, e))
        df = spark.createDataFrame([(1, s, e) for s, e in spans], "k INT, s INT, e INT")
        assert rows(sequences.merged_intervals(df, ["k"], "s", "e"), "s", "e") == want


def test_round_robin_and_bound(spark):
    df = spark.createDataFrame([(i, "busy" if i != 3 else "quiet") for i in range(6)], "arrival INT, repo STRING")
    got = dict(rows(sequences.round_robin(df, "repo", ["arrival"]), "arrival", "turn"))
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [0, 3, 1, 2, 4, 5]
    assert sequences.round_robin(df, "repo", ["arrival"], 2).where("not admitted").count() == 4


def test_reservations(spark):
    calls = spark.createDataFrame([(1, 1, "a", "d", "r1", 6.0), (1, 2, "a", "d", "r1", 6.0), (1, 3, "a", "d", "r2", 4.0), (1, 4, "b", "d", "r3", 1.0)], "ledger INT, id LONG, repo STRING, day STRING, run_id STRING, usd DOUBLE")
    got = rows(sequences.reservations(calls, 100.0, 10.0, 7.0), "id", "granted", "refused_by")
    assert got == [(1, True, None), (2, False, "repo_day"), (3, True, None), (4, True, None)]


def test_debounce_and_budget(spark):
    p = spark.createDataFrame([("k", 0.0, "a"), ("k", 5.0, "b"), ("k", 11.0, "c")], "key STRING, at DOUBLE, head STRING")
    assert rows(sequences.debounced(p, "key", "at", "head", 10.0), "queued_at", "head", "pushes") == [(0.0, "b", 2), (11.0, "c", 1)]
    w = spark.createDataFrame([("p", "head", 1, "aaaa"), ("p", "head", 2, "bbbbbbbb"), ("p", "head", 3, "c"), ("p", "base", 1, "dd")], "packet STRING, side STRING, pos INT, text STRING")
    assert rows(sequences.excerpts(w, 7), "side", "pos") == [("base", 1), ("head", 1)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id INT, state STRING, added DOUBLE")
    new = spark.createDataFrame([(1, "x", 9.0, 1), (1, "y", 9.0, 2), (3, "z", 9.0, 1)], "id INT, state STRING, added DOUBLE, n INT")
    assert rows(sinks.upsert(old, new, ["id"], "n", keep_old=("added",)), "id", "state", "added") == [(1, "y", 1.0), (2, "b", 2.0), (3, "z", 9.0)]
    assert rows(sinks.insert_or_ignore(old, new.drop("n"), ["id"]), "id") == [(1,), (2,), (3,)]
    assert rows(sinks.swap_partition(old, new.drop("n").limit(0), id=1), "id") == [(2,)]
    assert "x" in sinks.migrated(old, {"x": F.lit(0)}).columns


def test_cascade_backup_restore(spark, tmp_path):
    t = {n: schemas.empty(spark, n) for n in ("repos", "pulls", "runs", "jobs", "observations", "adjudications")}
    t["runs"] = spark.createDataFrame([("r1", "a"), ("r2", "b")], "id STRING, repo STRING")
    t["observations"] = spark.createDataFrame([("o1", "r1"), ("o2", "r2")], "id STRING, run_id STRING")
    t["adjudications"] = spark.createDataFrame([("o1",), ("o2",)], "observation_id STRING")
    left = sinks.cascade(t, "a")
    assert rows(left["runs"], "id") == [("r2",)] and rows(left["adjudications"], "observation_id") == [("o2",)]
    sinks.backup(left, f"{tmp_path}/b")
    assert sinks.restore(spark, f"{tmp_path}/b")["runs"].count() == 1


def test_retention(spark):
    ev = spark.createDataFrame([(1, 1.0, "done"), (2, 1.0, "open"), (3, 1.0, None), (4, 1.0, "unknown"), (5, 9.0, "done")], "seq INT, ts DOUBLE, run_id STRING")
    runs = spark.createDataFrame([("done", "done"), ("open", "probing")], "id STRING, state STRING")
    assert rows(findings.retained(ev, runs, 5.0), "seq") == [(2,), (4,), (5,)]


def snapshot(spark, **more):
    base = dict(repo="r", sha="1", number=1, name="invoicer", summary="turns orders into invoices", claims=[("constraint", "Not a goal: currency", "R:1"), ("purpose", "it makes invoices", "R:2")], version="1.0.0", license="MIT", toolchain="python", entry_points=["inv = invoicer.cli:main"], modules=[("invoicer.core", "the core", "c:1")], public_api=["invoicer.core.total", "invoicer.core.apply"], dependencies=["a"], standards=["ruff"], built_at=0.0)
    ddl = schemas.schema("charters")
    return spark.createDataFrame([tuple((base | more)[f] for f in ddl.names)], ddl)


def test_drift(spark):
    one = snapshot(spark)
    kinds = lambda after: rows(charter.drift(one, after), "kind", "level")
    assert kinds(snapshot(spark, sha="2")) == []
    assert kinds(snapshot(spark, summary="turns orders into invoices.")) == [("purpose", "minor")]
    big = charter.drift(one, snapshot(spark, version="2.0.0", entry_points=[], toolchain="node", public_api=["invoicer.core.total"]))
    assert rows(rollups.drift_level(big, ["repo"]), "level") == [("major",)]
    assert rows(ranking.headline(big, ["repo"]), "kind") == [("toolchain",)]
    assert kinds(snapshot(spark, dependencies=["a", "b"])) == [("dependencies_added", "minor")]
    assert kinds(snapshot(spark, claims=[("purpose", "it makes invoices", "R:2")])) == [("non_goals", "notable")]
    assert charter.evidence_lines(big).count() >= 3
    assert kinds(snapshot(spark, repo="other")) == []


def test_relevance(spark):
    obs = spark.createDataFrame(
        [("1", "behavior_change", "tests.x", "c", "tests/x.py::t"), ("2", "api_change", "invoicer.core.total", "changed", "invoicer/core.py:3"), ("3", "api_change", "invoicer.other", "changed", "x.py:1"), ("4", "lint_regression", "x", "c", "tests/x.py:1"), ("5", "lint_regression", "invoicer.cli.main", "c", "invoicer/cli.py:1"), ("6", "lint_regression", "invoicer.core.f", "c", "invoicer/core.py:1")],
        "id STRING, kind STRING, symbol STRING, what_changed STRING, evidence_ref STRING",
    )
    got = dict(rows(charter.grounded(obs, snapshot(spark), "r"), "id", "relevance"))
    assert got == {"1": "core", "2": "core", "3": "supporting", "4": "peripheral", "5": "core", "6": "supporting"}
    with pytest.raises(ValueError):
        charter.grounded(obs, snapshot(spark), "another")
    assert charter.grounded(obs, None, "r") is obs


README = """# Invoicer
It turns orders into invoices for small shops.

Why
---
- Because a wrapped bullet
  goes on here
- Fewer mistakes than by hand

## Non-goals
Currency conversion is left to others.

```
# not a heading
```
"""


def test_readme(spark):
    df = spark.createDataFrame([("r", README)], "repo STRING, text STRING")
    assert [r[1:] for r in rows(charter.headings(df, "repo"), "repo", "no", "level", "title")][:3] == [(0, 1, "Invoicer"), (3, 2, "Why"), (9, 2, "Non-goals")]
    got = rows(charter.readme_claims(df, "repo"), "kind", "text", "source")
    assert ("purpose", "It turns orders into invoices for small shops.", "README.md:2") in got
    assert ("purpose", "Because a wrapped bullet goes on here", "README.md:6") in got
    assert ("constraint", "Not a goal: Currency conversion is left to others.", "README.md:11") in got


def test_ranking(spark):
    obs = spark.createDataFrame([("a", "s1", 1.0, 0.9, "core"), ("b", "s2", 0.8, 0.9, None), ("c", "s3", 1.0, 0.9, "peripheral")], "id STRING, symbol STRING, severity DOUBLE, confidence DOUBLE, relevance STRING")
    calls = spark.createDataFrame([("s1", 4), ("s2", 0)], "callee STRING, callers INT")
    assert [(r.id, r.rank_score) for r in ranking.ranked(obs, calls).collect()] == [("a", 0.9), ("b", 0.36), ("c", 0.18)]
    none = spark.createDataFrame([("x", 0)], "callee STRING, callers INT")
    assert ranking.ranked(obs, none).where("rank_score = 0").count() == 0


def test_diff_and_files(spark):
    diff = "+++ b/a.py\n@@ -1,2 +3,4 @@\n@@ -9 +12 @@\n@@ -20,3 +25,0 @@\n+++ /dev/null\n@@ -1 +0,0 @@"
    got = rows(files.hunks(spark.createDataFrame([(1, diff)], "id INT, text STRING")), "path", "start_line", "end_line")
    assert got == [("a.py", 3, 6), ("a.py", 12, 12), ("a.py", 25, 25)]
    n = spark.createDataFrame([(1, "3\t1\ta.py"), (1, "-\t-\tx.png")], "id INT, line STRING")
    assert rows(files.diff_totals(files.numstat(n)), "additions", "deletions", "changed_files") == [(3, 1, 2)]
    f = spark.createDataFrame([("a/b.py", 10, "x\ny\n"), ("node_modules/c.js", 1, "x"), ("t/tests/d.go", 1, "x"), ("e.bin", 1, "x")], "path STRING, bytes LONG, content STRING")
    assert rows(files.inventory(f), "path", "loc", "is_test") == [("a/b.py", 2, False), ("t/tests/d.go", 1, True)]


def test_citations(spark):
    c = spark.createDataFrame([("norm", "n1", None), ("norm", "nx", None), ("code", "head:a.py:1-2", "x  = 1"), ("code", "head:a.py:2-9", ""), ("diff", "a.py", None)], "type STRING, ref STRING, quote STRING")
    one = lambda v, ddl: spark.createDataFrame([v], ddl)
    lines = spark.createDataFrame([("head", "a.py", 1, "x = 1"), ("head", "a.py", 2, "y")], "side STRING, path STRING, line INT, text STRING")
    got = grounding.resolved_citations(c, one(("n1",), "id STRING"), one(("t",), "nodeid STRING"), one(("a.py",), "path STRING"), lines)
    assert dict(((r.type, r.ref), r.resolved) for r in got.collect()) == {("norm", "n1"): True, ("norm", "nx"): False, ("code", "head:a.py:1-2"): True, ("code", "head:a.py:2-9"): False, ("diff", "a.py"): True}


def test_related_norms_and_lines(spark):
    f = spark.createDataFrame([("a/b.py", ["x", "y"])], "path STRING, tokens ARRAY<STRING>")
    n = spark.createDataFrame([("n1", ["a/b.py"], []), ("n2", ["a/c.py"], ["x"]), ("n3", ["z.py"], ["x", "y"]), ("n4", [], [])], "id STRING, places ARRAY<STRING>, tokens ARRAY<STRING>")
    assert [(r.id, r.score) for r in grounding.related_norms(f, n).orderBy("rank").collect()] == [("n1", 2.0), ("n2", 1.25), ("n3", 0.5)]


def test_tables(spark, tmp_path):
    (tmp_path / "j1.log").write_text('{"stream":"stdout","seq":1,"offset_ms":5,"text":"hi"}\nbroken\n{"stream":"stderr","seq":2,"offset_ms":7,"text":"no"}\n')
    t = tables.transcript(spark, str(tmp_path))
    assert rows(tables.transcript_text(t), "file", "text") == [("j1.log", "[5 stdout] hi\n[7 stderr] no")]
    assert rows(tables.replayed(t, skip=1), "seq") == [(2,)]
    w = spark.createDataFrame([("r", i, i == 3) for i in range(6)], "repo STRING, n INT, stop BOOLEAN")
    assert rows(tables.taken_while(w, F.col("stop"), [F.col("n")], ["repo"]), "n") == [(0,), (1,), (2,)]


def test_accepted_answers(spark):
    a = spark.createDataFrame(
        [("o1", 1, "intended", "why", 1.7, [("norm", True)]), ("o1", 2, "intended", "why", 0.5, [("norm", True)]), ("o9", 1, "intended", "w", 0.5, [("norm", True)]), ("o2", 1, "odd", "w", 0.5, [("norm", True)]), ("o3", 1, "intended", "w", 0.5, [("norm", False)])],
        "observation_id STRING, pos INT, assessment STRING, reasoning STRING, confidence DOUBLE, citations ARRAY<STRUCT<type: STRING, resolved: BOOLEAN>>",
    )
    taken, refused = findings.accepted(a, spark.createDataFrame([("o1",), ("o2",), ("o3",)], "id STRING"))
    assert rows(taken, "observation_id", "confidence") == [("o1", 1.0)]
    assert {r.reason for r in refused.collect()} == {"answered before", "unknown finding", "unknown assessment", "no citation resolves"}


def test_validation(spark):
    o = spark.createDataFrame([("x", 1.5, 0.5, "a", "b"), ("y", 0.5, 0.5, "a", "b"), ("z", 0.5, 0.5, "", "b")], "id STRING, confidence DOUBLE, severity DOUBLE, what_changed STRING, how_we_know STRING")
    good, bad = schemas.validated(o, "observations")
    assert rows(good, "id") == [("y",)] and bad.count() == 2
    for t in schemas.DDL:
        assert schemas.schema(t).names


def test_rollups(spark):
    r = spark.createDataFrame([("r", "head", "a", "passed"), ("r", "head", "b", "error"), ("r", "head", "c", "xfailed")], "run_id STRING, side STRING, nodeid STRING, status STRING")
    got = rollups.sandbox_rollup(r).first()
    assert (got.total, got.passed, got.failed, got.skipped, got.failed_ids) == (3, 1, 1, 1, ["b"])
    f = spark.createDataFrame([("a", "n"), ("b", ""), ("a", None)], "kind STRING, norm_id STRING")
    one = rollups.findings_counts(f).first()
    assert (one.total, one.by_kind, one.cited, one.uncited) == (3, {"a": 2, "b": 1}, 1, 2)
    c = spark.createDataFrame([("c1", "x", "p"), ("c1", "x", "p"), ("c2", "", "p")], "commit STRING, author STRING, path STRING")
    assert rows(rollups.churn(c), "commits", "authors") == [(2, 1)]
    assert text.STOP_WORDS


def test_calls_of_one_name_are_dealt_over_tasks(spark):
    """2,000 callers of one imported function and of one name that all bear: no task gets all of either."""
    n = 2000
    calls = spark.range(n).select(F.lit("r").alias("repo"), F.format_string("m%d.py", "id").alias("path"), F.format_string("m%d", "id").alias("module"), F.lit("f").alias("caller"), F.explode(F.array(F.lit("g"), F.lit("h"))).alias("name"), F.lit(None).cast("string").alias("attribute"))
    imports = spark.range(n).select(F.lit("r").alias("repo"), F.format_string("m%d.py", "id").alias("path"), F.lit("g").alias("alias"), F.lit("top.g").alias("target"))
    own = spark.range(n).select(F.lit("r").alias("repo"), F.format_string("m%d.K.h", "id").alias("fqn"), F.lit("method").alias("kind"))
    got = graph.call_edges(calls, imports, own.union(spark.createDataFrame([("r", "top.g", "function")], own.schema)), most=1)
    assert got.count() == n and got.where("callee = 'top.g'").count() == n
    few = spark.createDataFrame([("r", "g")], "repo STRING, name STRING")
    asked = calls.where("name = 'g'").withColumn("caller", F.concat("module", F.lit(".f")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [r["count"] for r in graph._dealt(asked, few, ["repo", "name"], "inner").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == n and max(tasks) < n


def test_sources_of_one_partition_are_parsed_by_many_tasks(spark):
    own = spark.range(100).coalesce(1).select(F.lit("r").alias("repo"), F.format_string("m%d.py", "id").alias("path"), F.lit("def f():\n    pass\n").alias("content"), F.lit("").alias("root"))
    found = graph.python_symbols(own)
    assert found.rdd.getNumPartitions() > 1 and found.count() == 100


def test_queries_are_sent_once_as_an_array(spark, monkeypatch):
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(x) or send(x))
    e = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id INT, embedding ARRAY<FLOAT>")
    q = e.where("id < 3").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    assert mining.nearest(q, e, 1).where("id = query_id").count() == 3
    assert len(sent) == 1 and isinstance(sent[0][1], np.ndarray) and sent[0][1].shape == (3, 2)


def test_blocks_keep_their_parts(spark):
    """The parts of texts are not joined into one by their few bytes."""
    own = spark.range(50).coalesce(1).select("id", F.lit("one\n\n- two\n").alias("text"))
    found = charter.blocks(own, "id")
    assert found.rdd.getNumPartitions() > 2 and found.count() == 100


def test_touches_are_dealt_in_as_many_parts_as_they_need(spark, monkeypatch):
    from changelens.operators import rollups

    monkeypatch.setattr(rollups, "IN_TASK", 10, raising=False)
    files = spark.createDataFrame([(f"a/src/{i}.py", "Python", 3, False) for i in range(7)], "path STRING, language STRING, loc INT, is_test BOOLEAN")
    # a commit counts once a path, with the largest of its names; unnamed authors do not count
    data = [(f"a/src/{i % 7}.py", f"c{i % 30}", ("", "x", "y", None)[i % 4]) for i in range(400)]
    commits = spark.createDataFrame(data, "path STRING, commit STRING, author STRING")
    symbols = spark.createDataFrame([], "fqn STRING, file STRING")
    got = rollups.module_rollup(files, commits, symbols)
    kept = {}
    for path, commit, author in data:
        kept[path, commit] = max(kept.get((path, commit), ""), author or "")
    assert [(r.commits, r.authors) for r in got.collect()] == [(len(kept), len(set(kept.values()) - {""}))]
    of_path = {r.path: (r.commits, r.authors) for r in rollups.churn(commits).collect()}
    assert of_path == {p: (sum(k[0] == p for k in kept), len({a for k, a in kept.items() if k[0] == p} - {""})) for p, _, _ in data}
    for df in (got, rollups.churn(commits)):
        assert ", 40)" in df._jdf.queryExecution().executedPlan().toString()


def test_a_module_lists_all_its_paths(spark):
    from changelens.operators import rollups

    names = [f"a/src/{i}.py" for i in range(450)] + ["b/src/x.go"]
    files = spark.createDataFrame([(p, "Python", 3, False) for p in names], "path STRING, language STRING, loc INT, is_test BOOLEAN")
    commits = spark.createDataFrame([], "path STRING, commit STRING, author STRING")
    got = rollups.module_rollup(files, commits, spark.createDataFrame([], "fqn STRING, file STRING"))
    assert {r["name"]: (r.files, r.paths) for r in got.collect()} == {"a/src": (450, sorted(names[:-1])), "b/src": (1, names[-1:])}


def test_tfidf_shuffles_its_rows_once(spark):
    data = [(1, "b a b"), (1, "a c"), (2, "a"), (3, ""), (4, None), (5, "c c c")]
    docs = spark.createDataFrame(data, "doc_id LONG, text STRING")
    out = mining.tfidf(docs, terms_col=F.regexp_extract_all("text", F.lit("([a-z])"), 1))
    tf = {(1, "a"): 2, (1, "b"): 2, (1, "c"): 1, (2, "a"): 1, (5, "c"): 3}
    df = {"a": 2, "b": 1, "c": 2}
    want = {k: (1 + np.log(v)) * (np.log(7 / (1 + df[k[1]])) + 1) for k, v in tf.items()}
    assert {(r.doc_id, r.term): r.weight for r in out.collect()} == pytest.approx(want)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    out.write.format("noop").mode("overwrite").save()
    assert plan.count("Exchange hashpartitioning(term") <= 2 and "hashpartitioning(doc_id" not in plan
