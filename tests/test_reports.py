"""Documents, spend, canonical JSON, norms by vectors, dispatch."""

import json

import pytest
from pyspark.sql import functions as F

from changelens.operators import deltas, mining, reports
from changelens.sources import files, sinks, tables
from changelens.streaming import events as ev

FINDING = "run_id STRING, pos INT, kind STRING, symbol STRING, what_changed STRING, how_we_know STRING, norm STRUCT<id: STRING>, confidence DOUBLE, severity DOUBLE, node STRING"


def test_findings_document(spark):
    own = spark.createDataFrame([("r", 1, "timeout", "b", "w", "h", ("n",), 0.123456, 1.0, "c4"), ("r", 0, "behavior_change", "a", "w", "h", None, 0.9, 1.0, "c4")], FINDING)
    runs = spark.createDataFrame([("r", "p", "t"), ("empty", None, "t")], "run_id STRING, profile STRING, generated_at STRING")
    got = {r.run_id: json.loads(r.document) for r in reports.findings_document(own, runs).collect()}
    assert [(f["id"], f["symbol"], f["confidence"]) for f in got["r"]["findings"]] == [("f0", "a", 0.9), ("f1", "b", 0.1235)]
    assert got["r"]["counts"] == {"findings": 2, "by_kind": {"behavior_change": 1, "timeout": 1}, "cited": 1, "uncited": 1}
    assert got["empty"]["findings"] == [] and got["empty"]["counts"] == {"findings": 0, "by_kind": {}, "cited": 0, "uncited": 0}
    for broken in (("r", 0, "timeout", "a", "w", "h", None, 0.9, 1.0, "c4"), ("r", 0, "behavior_change", "a", "", "h", None, 0.9, 1.0, "c4")):
        with pytest.raises(Exception, match="finding a: no "):
            reports.findings_document(spark.createDataFrame([broken], FINDING), runs).collect()


def test_recorded_findings(spark):
    own = spark.createDataFrame([("m.f", 0, " E 1 \n", False), ("m.g", 1, None, True)], "symbol STRING, pos INT, block STRING, declared BOOLEAN")
    assert [tuple(r)[2:5] for r in reports.recorded_findings(own).collect()] == [
        ("m.f: behaviour recorded on base no longer holds at head", "test_char_0\nE 1", 0.9),
        ("m.g: behaviour recorded on base no longer holds at head (declared in the PR description)", "test_char_1", 0.45),
    ]


def test_spend_rows(spark):
    calls = spark.createDataFrame([(1.0, "a", 1_000_000, 0, 0, 0, False), (2.0, "a", 1_000_000, 0, 0, 0, True), (3.0, "x", 1, 1, 1, 1, False)], "ts DOUBLE, model STRING, input_tokens LONG, output_tokens LONG, cache_read_tokens LONG, cache_write_tokens LONG, cached BOOLEAN")
    prices = spark.createDataFrame([("a", 3.0, 15.0)], "model STRING, price_in DOUBLE, price_out DOUBLE")
    assert sorted((r.ts, r.usd) for r in reports.spend_rows(calls, prices).collect()) == [(1.0, 3.0), (2.0, 0.0), (3.0, 0.0)]


def test_canonical_json(spark, tmp_path):
    a = spark.sql("select named_struct('b', 1, 'a', map('y', 2, 'x', 1), 's', array('q', 'p'), 'l', array(2, 1), 'n', cast(null as int)) as v")
    assert a.select(sinks.canonical_json(a, "v", ("s",)).alias("j")).first().j == '{"a":{"x":1,"y":2},"b":1,"l":[2,1],"n":null,"s":["p","q"]}'
    for _ in range(2):
        sinks.append_json_lines(spark.createDataFrame([(1,)], "rate INT"), f"{tmp_path}/m")
    got = spark.read.json(f"{tmp_path}/m")
    assert got.count() == 2 and got.where("ts > 1e9").count() == 2


def test_small_ones(spark):
    stats = spark.createDataFrame([("d", "b", 1, 0), ("d", "a", 1, 0), ("d", "c", 9, 0)], "id STRING, path STRING, additions INT, deletions INT")
    assert [r.path for r in files.most_inserted(stats).orderBy("rank").collect()] == ["c", "a", "b"]
    pages = spark.createDataFrame([("u", 1, 200, "e", "old"), ("u", 2, 304, None, None), ("u", 3, 500, None, "x"), ("v", 1, 404, None, None)], "url STRING, fetched_at INT, status INT, etag STRING, body STRING")
    assert [tuple(r) for r in tables.landed(pages).collect()] == [("u", "e", "old")]
    one = spark.createDataFrame([("a",), ("b",), (None,)], "t STRING")
    assert {r.t for r in deltas.all_ids(one, one.where("t = 'b'"), "t").collect()} == {"a", "b", None}
    taken, over = ev.offered(spark.createDataFrame([("s", k) for k in range(5)] + [("q", 1)], "subscriber STRING, seq LONG"), 3)
    assert sorted(tuple(r) for r in taken.collect()) == [("q", 1), ("s", 0), ("s", 1), ("s", 2)]
    assert dict(tuple(r) for r in over.collect()) == {"s": 2, "q": 0}


def vectors(df):
    return df.select("repo", "pos", F.when(F.col("text").contains("test"), F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))


def test_norms_by_vectors(spark):
    body = ["please add a test for the empty table here", "this needs a test of the empty case", "a test for broken input would help", "name it after what it returns", "the order of these lines is odd"]
    own = spark.createDataFrame([("r", k, k, f"u{k % 2}", b, "", f"2024-01-0{k + 1}T00:00:00Z", True) for k, b in enumerate(body)], "repo STRING, pos LONG, pr_number INT, reviewer_login STRING, body STRING, html_url STRING, created_at STRING, enforced BOOLEAN")
    got = mining.stated_norms(own, vectors).collect()
    assert [(r.support, r.distinct_reviewers, r.evidence_prs) for r in got] == [(3, 2, [0, 1, 2])] and abs(got[0].confidence - 0.15) < 1e-9
    got = mining.mined_norms(own.drop("pos"), vectorise=vectors, statement=lambda q: F.concat(F.lit("Norm: "), q)).collect()
    assert len(got) == 1 and got[0].support == 3 and got[0].statement.startswith("Norm: ") and got[0].id.startswith("review-norm-")


def test_fair_dispatch(spark, tmp_path):
    rows = [("l", 0, "a", "a1", "queue"), ("l", 1, "a", "a2", "queue"), ("l", 2, "a", "a3", "queue"), ("l", 3, "b", "b1", "queue"), *(("l", k, None, None, "next") for k in (4, 5)), ("l", 6, "c", "c1", "queue"), *(("l", k, None, None, "next") for k in range(7, 11))]
    ddl = "lane STRING, arrival LONG, repo STRING, run_id STRING, kind STRING"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")
    ev.run_available(ev.fair_dispatch(stream), f"{tmp_path}/out", f"{tmp_path}/check")
    got = sorted((r.arrival, r.run_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [r[1] for r in got] == ["a1", "b1", "a2", "c1", "a3", None]
