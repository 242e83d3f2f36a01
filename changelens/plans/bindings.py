"""Queries that bind the operators to the driver's tables, and their SQL twins.

The tables hold no change-verification data, so each query says by its aliases what
stands for what: suppliers call parts, a customer's orders are a pull's runs, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import paths, text
from changelens.operators import charter, deltas, findings, graph, lookups, mining, ranking, rollups, sequences
from changelens.sources import sinks, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("""
with c as (select l_partkey as symbol, count(distinct l_suppkey) as callers from lineitem group by 1)
select symbol, callers, round(0.5 + 0.5 * callers / (select max(callers) from c), 6) as centrality from c
""")
def centrality_rank(spark, d):
    return ranking.centrality_rank(read(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("select l_partkey as callee, count(distinct l_suppkey) as callers from lineitem group by 1")
def caller_counts(spark, d):
    return rollups.caller_counts(read(spark, d, "lineitem").withColumnRenamed("l_partkey", "callee"), ["callee"], "l_suppkey")


@query("""
select o_custkey as repo, o_orderkey as id, o_orderstatus as state, o_totalprice as price from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1
""")
def latest_run_per_key(spark, d):
    own = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    out = sequences.latest_per_key(own, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("price"))


@query("""
with latest as (select o_custkey, o_orderkey from (
    select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1),
obs as (select l_orderkey, count(*) as findings, max(l_discount) as max_severity, round(sum(l_discount * l_quantity), 2) as risk from lineitem group by 1)
select c_custkey as number, l.o_orderkey as run_id, coalesce(findings, 0) as findings, coalesce(max_severity, 0) as max_severity, coalesce(risk, 0) as risk
from customer left join latest l on c_custkey = o_custkey left join obs on l.o_orderkey = obs.l_orderkey
""")
def queue_rollup(spark, d):
    pulls = read(spark, d, "customer").select(F.lit("r").alias("repo"), F.col("c_custkey").alias("number"))
    runs = read(spark, d, "orders").select(
        F.lit("r").alias("repo"), F.col("o_custkey").alias("pr_number"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("created_at")
    )
    obs = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("severity"), (F.col("l_discount") * F.col("l_quantity")).alias("rank_score")
    )
    return rollups.queue(pulls, runs, obs).select("number", "run_id", "findings", "max_severity", F.round("risk", 2).alias("risk"))


@query("""
with last as (select conv_id, max(turn) as last from conversations where role = 'assistant' group by 1)
select c.conv_id, c.turn, coalesce(c.turn < l.last, false) as enforced
from conversations c left join last l using (conv_id) where c.role = 'user'
""")
def enforced_comments(spark, d):
    conv = read(spark, d, "conversations")
    stamp = lambda c: F.date_format(F.timestamp_seconds(F.col(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pulls = conv.select(F.col("conv_id").alias("number"), F.lit("merged").alias("merged_at")).distinct()
    commits = conv.where("role = 'assistant'").select(F.col("conv_id").alias("number"), F.lit(None).cast("string").alias("committer_date"), stamp("turn").alias("author_date"))
    comments = conv.where("role = 'user'").select(F.col("conv_id").alias("number"), "turn", stamp("turn").alias("created_at"))
    return mining.enforced_comments(pulls, comments, commits).select(F.col("number").alias("conv_id"), "turn", "enforced")


@query("""
with last as (select conv_id, max(turn) as last from conversations where role = 'assistant' group by 1),
u as (select coalesce(c.turn < l.last, false) as e from conversations c left join last l using (conv_id) where c.role = 'user')
select count(*) as seen, count(*) filter (e) as kept, round(count(*) filter (e) / count(*), 6) as retention from u
""")
def retention_rate(spark, d):
    return rollups.review_counts(enforced_comments(spark, d)).withColumn("retention", F.round("retention", 6))


_SIDES = """
with b as (select user_id, max(value) as v from events where ts < timestamp '2024-01-16' group by 1),
h as (select user_id, max(value) as v from events where ts >= timestamp '2024-01-16' and user_id % 7 <> 0 group by 1),
base as (select 't/u.py::User::' || user_id as nodeid, case when v >= 50 then 'passed' else 'failed' end as status from b),
head as (select 't/u.py::User::' || user_id as nodeid, case when v >= 180 then 'passed' else 'failed' end as status from h)
"""


def _sides(spark, d):
    e = read(spark, d, "events")
    status = lambda least: F.when(F.max("value") >= least, "passed").otherwise("failed").alias("status")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    nodeid = F.concat(F.lit("t/u.py::User::"), F.col("user_id").cast("string")).alias("nodeid")
    base = e.where(F.col("ts") < middle).groupBy(nodeid).agg(status(50))
    head = e.where((F.col("ts") >= middle) & (F.col("user_id") % 7 != 0)).groupBy(nodeid).agg(status(180))
    return base, head


@query(_SIDES + """
select 'User.' || substr(nodeid, 15) as symbol, case when h.status is null then 'test_removed' else 'behavior_change' end as kind,
  cast(case when h.status is null then 0.7 else 1.0 end as double) as severity, cast(case when h.status is null then 0.75 else 0.9 end as double) as confidence,
  substr(sha256(concat(case when h.status is null then 'test_removed' else 'behavior_change' end, chr(0), 'User.' || substr(nodeid, 15), chr(0), nodeid)), 1, 16) as id
from base b left join head h using (nodeid) where b.status = 'passed' and (h.status is null or h.status = 'failed')
""")
def differential(spark, d):
    return deltas.behaviour_delta(*_sides(spark, d)).select("id", "kind", "symbol", "severity", "confidence")


_PERIODS = """
with s as (select distinct p_type, o_orderdate < timestamp '1995-01-01' as early, p_brand
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey ),
b as (select p_type || '.' || p_brand as fqn, 'x' as k from s where early),
h as (select p_type || '.' || p_brand as fqn, 'x' as k from s where not early)
"""


def _periods(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("early"))
    p = read(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    s = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select("p_type", "early", "p_brand").distinct()
    fqn = F.concat_ws(".", "p_type", "p_brand").alias("fqn")
    return s.where("early").select(fqn, F.lit("x").alias("kind")), s.where("not early").select(fqn, F.lit("x").alias("kind"))


@query(_PERIODS + """
select fqn, case when h.k is null then 'removed' else 'added' end as change from b full join h using (fqn) where b.k is null or h.k is null
""")
def api_diff(spark, d):
    return deltas.surface_delta(*_periods(spark, d)).select("fqn", "change")


@query(_PERIODS + "select fqn from h where fqn not in (select fqn from b)")
def lint_delta(spark, d):
    base, head = _periods(spark, d)
    as_lint = lambda x: x.select(F.lit("p").alias("path"), F.lit("c").alias("code"), F.col("fqn").alias("message"))
    return deltas.lint_delta(as_lint(base), as_lint(head), cap=None).select(F.col("message").alias("fqn"))


@query(_PERIODS + "(select fqn from h except select fqn from b) union (select fqn from b except select fqn from h)")
def symmetric_difference(spark, d):
    base, head = _periods(spark, d)
    kind = F.substring_index("fqn", ".", 1).alias("kind")  # a type, which has a name for each brand at most
    sets = lambda x, name: x.groupBy(kind).agg(F.collect_set("fqn").alias(name))
    both = sets(base, "b").join(sets(head, "h"), "kind", "full_outer")
    none = F.array().cast("array<string>")
    return both.select(F.explode(deltas.symmetric_difference(F.coalesce("b", none), F.coalesce("h", none))).alias("fqn"))


@query("""
select distinct user_id from events where ts < timestamp '2024-01-08'
  and user_id not in (select user_id from events where ts >= timestamp '2024-01-29' and event_type = 'purchase')
""")
def vanished_keys(spark, d):
    e = read(spark, d, "events")
    stored = e.where(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")).select("user_id", F.lit("open").alias("state")).distinct()
    seen = e.where((F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")) & (F.col("event_type") == "purchase"))
    return deltas.vanished(stored, seen, ["user_id"]).select("user_id")


@query("""
select c_custkey as number, last as head from (
  select o_custkey as c_custkey, max(o_orderkey) as last, max(case when o_orderdate < timestamp '1997-01-01' then o_orderkey end) as known
  from orders group by 1) where known is null or known <> last
""")
def moved_heads(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    head = lambda x: x.groupBy(F.col("o_custkey").alias("number")).agg(F.max("o_orderkey").alias("head"))
    known = head(o.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    return deltas.new_or_moved(head(o), known, ["number"], "head")


def _modules(spark, d):
    p = read(spark, d, "part")
    path = F.concat_ws("/", F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("src"), F.concat("p_partkey", F.lit(".py")))
    files = p.select("p_partkey", path.alias("path"), F.when(F.col("p_size") % 2 == 0, "Python").otherwise("Go").alias("language"), F.col("p_size").alias("loc"), (F.col("p_size") < 5).alias("is_test"))
    touches = read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    commits = touches.join(files.select("p_partkey", "path"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("commit"), F.col("o_custkey").cast("string").alias("author"), "path"
    )
    symbols = files.where("loc > 40").select(F.col("p_partkey").cast("string").alias("fqn"), F.col("path").alias("file"))
    return files.drop("p_partkey"), commits, symbols


_MODULES = """
with f as (select p_partkey, replace(p_brand, '#', '') || '/src' as name, p_size as loc, p_size < 5 as is_test from part),
s as (select name, cast(sum(loc) as bigint) as loc, count(*) as files, count(*) filter (is_test) as test_files, count(*) filter (loc > 40) as symbols from f group by 1),
c as (select name, count(distinct (p_partkey, l_orderkey)) as commits, count(distinct o_custkey) as authors
  from lineitem join orders on l_orderkey = o_orderkey join f on l_partkey = p_partkey group by 1),
m as (select s.*, coalesce(commits, 0) as commits, coalesce(authors, 0) as authors from s left join c using (name))
"""


@query(_MODULES + """,
l as (select name, string_agg(language || '=' || loc, ',' order by language) as languages from (
  select name, case when loc % 2 = 0 then 'Python' else 'Go' end as language, sum(loc) as loc from f group by 1, 2) group by 1),
p as (select name, array_to_string(list_sort(list(name || '/' || p_partkey || '.py')), ',') as paths from f group by 1)
select name, loc, files, test_files, commits, authors, symbols, languages, paths from m join l using (name) join p using (name)
""")
def module_rollup(spark, d):
    pairs = F.transform(F.array_sort(F.map_entries("languages")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    own = rollups.module_rollup(*_modules(spark, d))
    return own.select("name", "loc", "files", "test_files", "commits", "authors", "symbols", F.array_join(pairs, ",").alias("languages"), F.array_join("paths", ",").alias("paths"))


@query(_MODULES + """
select name, round(commits / (select max(commits) from m) * (loc / (select max(loc) from m)) * (1.0::double - test_files::double / files), 4) as score, commits, loc, authors
from m where test_files < files order by score desc, loc desc, name limit 12
""")
def hotspots(spark, d):
    return ranking.hotspots(rollups.module_rollup(*_modules(spark, d))).select("name", "score", "commits", "loc", "authors")


@query("""
select r1.r_name as source, r2.r_name as target, count(*) as weight from lineitem
join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation n1 on c_nationkey = n1.n_nationkey join region r1 on n1.n_regionkey = r1.r_regionkey
join supplier on l_suppkey = s_suppkey join nation n2 on s_nationkey = n2.n_nationkey join region r2 on n2.n_regionkey = r2.r_regionkey
where r1.r_name <> r2.r_name group by 1, 2
""")
def module_edges(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    s = read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key))
    file = F.concat("r_name", F.lit("/x.py")).alias("file")
    symbols = c.select(name("c", "c_custkey").alias("fqn"), file).union(s.select(name("s", "s_suppkey").alias("fqn"), file))
    own = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = own.select(name("c", "o_custkey").alias("caller"), name("s", "l_suppkey").alias("callee"))
    return rollups.module_edges(edges, symbols)


@query("""
with t as (select o_custkey as k, datediff('day', date '1990-01-01', o_orderdate::date) as s, datediff('day', date '1990-01-01', o_orderdate::date) + 60 as e from orders),
w as (select *, case when s <= max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as n from t),
i as (select *, sum(n) over (partition by k order by s, e rows unbounded preceding) as g from w)
select k, min(s) as s, max(e) as e from i group by k, g
""")
def interval_merge(spark, d):
    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long")
    own = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), day.alias("s"), (day + 60).alias("e"))
    return sequences.merged_intervals(own, ["k"], "s", "e")


@query("""
select distinct o_orderkey as fqn from orders join customer on o_custkey = c_custkey
where datediff('day', date '1992-01-01', o_orderdate::date) <= (c_custkey % 50) * 40 + 30
  and datediff('day', date '1992-01-01', o_orderdate::date) + 20 >= (c_custkey % 50) * 40
""")
def overlap_join(spark, d):
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))
    symbols = read(spark, d, "orders").select(F.col("o_orderkey").alias("fqn"), F.col("o_custkey").alias("file"), day.alias("line_start"), (day + 20).alias("line_end"))
    at = (F.col("c_custkey") % 50) * 40
    spans = read(spark, d, "customer").select(F.col("c_custkey").alias("path"), at.alias("start_line"), (at + 30).alias("end_line"))
    return lookups.changed_symbols(symbols, spans).select("fqn").distinct()


@query("""
with l as (select user_id, ts, case when epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) over (partition by user_id order by ts))) > 1800 then 1 else 0 end as n from events),
s as (select *, cast(sum(n) over (partition by user_id order by ts) as bigint) as session from l)
select user_id, session, min(ts) as "start", max(ts) as "end", count(*) as n from s group by 1, 2
""")
def session_islands(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = sequences.sessions(e, "user_id", "ts", 1800)
    return out.select("user_id", "session", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def _reach_edges(spark, d):
    """Customers reach nations, nations suppliers' nations' regions, in one graph of names."""
    c = read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("caller"), F.concat(F.lit("n"), "c_nationkey").alias("callee"))
    n = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("caller"), F.concat(F.lit("r"), "n_regionkey").alias("callee"))
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("caller"), F.concat(F.lit("n"), "s_nationkey").alias("callee"))
    back = read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("caller"), F.lit("n0").alias("callee"))
    return c.union(n).union(s).union(back)


@query("""
with recursive e as (
  select 'c' || c_custkey as caller, 'n' || c_nationkey as callee from customer union all
  select 'n' || n_nationkey, 'r' || n_regionkey from nation union all
  select 's' || s_suppkey, 'n' || s_nationkey from supplier union all
  select 'r' || r_regionkey, 'n0' from region),
t as (select 'r1' as node, 0 as hop union all select e.caller, t.hop + 1 from t join e on e.callee = t.node where t.hop < 2)
select node, min(hop) as hop from t group by 1
""")
def reach_2_hops(spark, d):
    return graph.reach(_reach_edges(spark, d), spark.createDataFrame([("r1",)], "node STRING"), 2)


@query("select event_id as seq, user_id, event_type from events where event_id > 500 and event_type = 'click' order by event_id limit 20000")
def replay_since(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type")
    return tables.events_since(e.withColumn("repo", F.col("event_type")), 500, repo="click").drop("repo")


@query("""
select event_id from events where not (ts < timestamp '2024-01-20'
  and user_id in (select user_id from events where event_type = 'error' group by 1 having count(*) > 12))
""")
def retention_prune(spark, d):
    e = read(spark, d, "events")
    over = e.where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 12")
    runs = over.select(F.col("user_id").cast("string").alias("id"), F.lit("done").alias("state"))
    own = e.select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), F.col("user_id").cast("string").alias("run_id"))
    return findings.retained(own, runs, 1705708800).select("event_id")


@query("""
with s as (select user_id as repo, ts::date as day, event_id % 100 as run_id, value as usd from events)
select case when grouping(repo) = 0 then 'repo_day' when grouping(run_id) = 0 then 'run' else 'total' end as scope, repo, day::varchar as day, run_id, round(sum(usd), 4) as usd
from s group by grouping sets ((), (repo, day), (run_id))
""")
def spend_by_scope(spark, d):
    e = read(spark, d, "events")
    own = e.select(F.col("user_id").alias("repo"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_id") % 100).alias("run_id"), F.col("value").alias("usd"))
    return rollups.spend_by_scope(own).withColumns({"usd": F.round("usd", 4), "day": F.col("day").cast("string")})


@query("""
select event_id, round(coalesce(sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0), 4) as committed from events
""")
def running_commitment(spark, d):
    e = read(spark, d, "events")
    return sequences.running_before(e, ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("committed", 4).alias("committed"))


@query("""
with r as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as n,
  min((ts, event_id)) over (partition by user_id) as first from events)
select event_id, user_id, row_number() over (order by n, first) as turn from r
""")
def round_robin(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts")
    return sequences.round_robin(e, "user_id", ["ts", "event_id"]).select("event_id", "user_id", F.col("turn").cast("long").alias("turn"))


@query("""
with w as (select doc_id, source, row_number() over (partition by source order by doc_id) as n, sum(n_chars) over (partition by source order by doc_id) as s from documents)
select doc_id, source from w where n <= 30 and s <= 60000
""")
def output_budget(spark, d):
    own = read(spark, d, "documents").select("doc_id", "source", "n_chars")
    return sequences.within_output_budget(own, ["source"], "doc_id", F.col("n_chars"), 30, 60_000).select("doc_id", "source")


@query("""
select doc_id, regexp_replace(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b', '[REDACTED_EMAIL]', 'g') as text
from documents where regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')
""")
def redact_email(spark, d):
    own = read(spark, d, "documents").where(F.col("text").rlike(text.EMAIL.strip("\\b")))
    return own.select("doc_id", F.regexp_replace("text", text.EMAIL, "[REDACTED_EMAIL]").alias("text"))


def _masked(sql: str) -> str:
    """The masks in SQL. Its patterns have no negative look-ahead, so for the one that has, a mark splits words of 40 hex digits."""
    ahead = "(?![0-9a-f]{40}\\b)"
    for pattern, mask in text.MASKS:
        if ahead in pattern:
            sql = f"regexp_replace({sql}, '\\b([0-9a-f]{{20}})([0-9a-f]{{20}})\\b', '\\1\u00a7\\2', 'g')"
        pattern, mask, marked = pattern.replace(ahead, "").replace("'", "''"), mask.replace("$1", "\\1"), ahead in pattern
        sql = f"regexp_replace({sql}, '{pattern}', '{mask}', 'g')"
        sql = f"replace({sql}, '\u00a7', '')" if marked else sql
    return sql


@query(f"select doc_id, {_masked('text')} as text from documents")
def redact(spark, d):
    return read(spark, d, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(rf"""
with l as (select conv_id, turn, text, array_to_string([x for x in string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) if not starts_with(ltrim(x), '>')], chr(10)) as p from conversations),
s as (select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '(?s)```.*?```', ' ', 'g'), '@[\w-]+', ' ', 'g'), 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g')) as c,
  [w for w in regexp_extract_all(lower(regexp_replace(text, '`[^`]*`', ' ', 'g')), '[a-z][a-z0-9_]+') if w not in ({_STOP})] as stems from l)
select conv_id, turn, case when regexp_matches(c, '{text.ACKNOWLEDGEMENT}') or len([w for w in string_split(trim(regexp_replace(regexp_replace(c, '`[^`]*`', ' ', 'g'), '\s+', ' ', 'g')), ' ') if w <> '']) < 4 then '' else c end as text,
  cast(case when text is null then null else len(stems) + greatest(len(stems) - 1, 0) end as integer) as n_terms from s
""")
def clean_comments(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", text.clean_comment(F.col("text")).alias("text"), F.size(text.terms(F.col("text"))).alias("n_terms"))


@query("""
with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_]+')) as term from documents),
tf as (select doc_id, term, count(*) as tf from t group by 1, 2), df as (select term, count(*) as df from tf group by 1)
select doc_id, term, round((1 + ln(tf)) * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1), 6) as weight from tf join df using (term)
""")
def tfidf(spark, d):
    own = read(spark, d, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z0-9_]+)"), 1)
    return mining.tfidf(own, terms_col=words).withColumn("weight", F.round("weight", 6))


_UNIT = "sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))"


@query(f"""
with v as (select vec_id, label, embedding, {_UNIT} as n from embeddings),
p as (select q.vec_id as query_id, v.vec_id as id, round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: q.embedding[i]::double * v.embedding[i]::double)) / ((q.n + 1e-12) * (v.n + 1e-12)), 6) as similarity
  from v join v q on q.vec_id % 50 = 0)
select query_id, id, similarity from (select *, row_number() over (partition by query_id order by similarity desc, id) as r from p) where r <= 3
""")
def cosine_topk(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    return mining.nearest(q, e, 3).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query()
def norm_clusters(spark, d):
    e = read(spark, d, "embeddings").select("label", F.col("vec_id").alias("pos"), "embedding")
    return mining.clusters(e, "label", 0.2)


@query("""
select case when len(p) <= 1 then '(root)' else array_to_string(p[1 : least(len(p) - 1, 2)], '/') end as module, count(*) as pages
from (select string_split(regexp_replace(url, '^https?://', ''), '/') as p from pages) group by 1
""")
def url_module(spark, d):
    path = F.regexp_replace("url", "^https?://", "")
    return read(spark, d, "pages").groupBy(paths.module_of(path).alias("module")).agg(F.count(F.lit(1)).alias("pages"))


@query("select lang as language, cast(sum(n_chars) as bigint) as loc from documents group by 1")
def language_totals(spark, d):
    return rollups.language_totals(read(spark, d, "documents").select(F.col("lang").alias("language"), F.col("n_chars").alias("loc")))


@query("""
with t as (select p_brand as language, sum(p_size) as loc from part group by 1), r as (select *, row_number() over (order by loc desc, language) as n from t)
select case when n > 7 then 'Other' else language end as language, cast(sum(loc) as bigint) as loc from r group by 1
""")
def language_bar(spark, d):
    t = read(spark, d, "part").groupBy(F.col("p_brand").alias("language")).agg(F.sum("p_size").alias("loc"))
    return rollups.language_bar(t)


@query("""
select doc_id, 0 as no, 1 as level, source as title from documents union all select doc_id, 2, 2, lang from documents
""")
def headings(spark, d):
    """Each document's source as a title and its language as an underlined section."""
    flat = F.regexp_replace("text", r"\s+", " ")
    own = read(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n\n"), "lang", F.lit("\n----\n- "), flat).alias("text"))
    return charter.headings(own, "doc_id").select("doc_id", F.col("no").cast("int").alias("no"), F.col("level").cast("int").alias("level"), "title")


@query("""
with l as (select o_custkey as owner, o_orderkey as pos, case when o_orderpriority like '1%' then 'purpose' when o_orderpriority like '2%' then 'target' else 'constraint' end as kind,
  o_orderpriority || ' ' || (o_orderkey % 9) as text from orders),
u as (select *, row_number() over (partition by owner, kind, lower(text) order by pos) as d from l),
n as (select *, row_number() over (partition by owner, kind order by pos) as n from u where d = 1)
select owner, pos, kind, text from n where n <= case kind when 'purpose' then 2 when 'target' then 1 else 3 end
""")
def claims_with_caps(spark, d):
    p = F.col("o_orderpriority")
    kind = F.when(p.startswith("1"), "purpose").when(p.startswith("2"), "target").otherwise("constraint")
    own = read(spark, d, "orders").select(
        F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("pos"), kind.alias("kind"), F.concat(p, F.lit(" "), (F.col("o_orderkey") % 9).cast("string")).alias("text")
    )
    return sequences.capped_claims(own, {"purpose": 2, "target": 1, "constraint": 3})


def _snapshots(spark, d):
    """Each brand describes itself by its parts' types: even keys before, others after."""
    p = read(spark, d, "part")

    def snap(own, sha):
        kinds = own.groupBy(F.col("p_brand").alias("repo")).agg(
            F.sort_array(F.collect_set("p_type")).alias("public_api"),
            F.sort_array(F.collect_set(F.concat(F.lit("d"), (F.col("p_size") % 11).cast("string")))).alias("dependencies"),
            F.sort_array(F.collect_set(F.concat(F.lit("t"), (F.col("p_partkey") % 6).cast("string")))).alias("standards"),
            F.max("p_size").alias("_v"),
        )
        none = lambda ddl: F.lit(None).cast(ddl)
        return kinds.select(
            "repo", F.lit(sha).alias("sha"), F.lit("").alias("summary"), F.array().cast("array<struct<kind:string,text:string,source:string>>").alias("claims"),
            F.concat(F.lit("1."), F.col("_v").cast("string")).alias("version"), none("string").alias("license"), none("string").alias("toolchain"),
            F.array().cast("array<string>").alias("entry_points"), F.array().cast("array<struct<module:string,doc:string,source:string>>").alias("modules"),
            "public_api", "dependencies", "standards",
        )

    return snap(p.where("p_partkey % 2 = 0"), "a"), snap(p.where("p_partkey % 3 = 0"), "b")


@query("""
with b as (select p_brand as repo, array_agg(distinct p_type) as api, array_agg(distinct p_size % 11) as dep, array_agg(distinct p_partkey % 6) as std, max(p_size) as v from part where p_partkey % 2 = 0 group by 1),
a as (select p_brand as repo, array_agg(distinct p_type) as api, array_agg(distinct p_size % 11) as dep, array_agg(distinct p_partkey % 6) as std, max(p_size) as v from part where p_partkey % 3 = 0 group by 1),
j as (select repo, b.v as bv, a.v as av, len(b.api) as had,
  len(list_filter(b.api, lambda x: not list_contains(a.api, x))) as lost, len(list_filter(a.api, lambda x: not list_contains(b.api, x))) as won,
  len(list_filter(b.dep, lambda x: not list_contains(a.dep, x))) as gone, len(list_filter(a.dep, lambda x: not list_contains(b.dep, x))) as new,
  len(list_filter(b.std, lambda x: not list_contains(a.std, x))) + len(list_filter(a.std, lambda x: not list_contains(b.std, x))) as tools
  from b join a using (repo))
select repo, 'public_api_removed' as kind, case when lost / had >= 0.2 or lost >= 10 then 'major' else 'notable' end as level from j where lost > 0 union all
select repo, 'public_api_added', case when won / had >= 0.3 then 'notable' else 'minor' end from j where won > 0 union all
select repo, 'dependencies_removed', 'notable' from j where gone > 0 union all
select repo, 'dependencies_added', case when new >= 3 then 'notable' else 'minor' end from j where new > 0 union all
select repo, 'standards', 'minor' from j where tools > 0 union all
select repo, 'version', case when av < bv then 'notable' else 'minor' end from j where av <> bv
""")
def drift_signals(spark, d):
    return charter.drift(*_snapshots(spark, d)).select("repo", "kind", "level")


@query("""
select p_partkey as id, case
  when p_size % 5 = 0 then 'core'
  when p_size % 5 = 1 and (p_brand like '%1' or p_type like '%BRASS') then 'core'
  when p_size % 5 = 1 then 'supporting'
  when p_brand like '%2' then 'peripheral'
  when p_brand like '%1' then 'core' else 'supporting' end as relevance from part
""")
def relevance_case(spark, d):
    p = read(spark, d, "part")
    kind = F.when(F.col("p_size") % 5 == 0, "behavior_change").when(F.col("p_size") % 5 == 1, "api_change").otherwise("lint_regression")
    path = F.when(F.col("p_brand").endswith("2"), "tests/x.py").otherwise("src/x.py")
    rel = charter.relevance_case(kind, path, F.col("p_name"), F.lit("changed"), F.col("p_brand").endswith("1"), F.lit(False), F.col("p_type").endswith("BRASS"))
    return p.select(F.col("p_partkey").alias("id"), rel.alias("relevance"))


@query("""
select d.doc_id, contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(substr(q.text, 20, 60), '\\s+', ' ', 'g'))) as resolved
from documents d join documents q on q.doc_id = case when d.doc_id % 3 = 0 then d.doc_id + 1 else d.doc_id end
""")
def citation_check(spark, d):
    own = read(spark, d, "documents").select("doc_id", "text")
    q = own.select(F.col("doc_id").alias("q_id"), F.substring("text", 20, 60).alias("quote"))
    both = own.withColumn("q_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))).join(q, "q_id")
    return both.select("doc_id", text.contains_quote(F.col("text"), F.col("quote")).alias("resolved"))


@query("""
with o as (select event_id, user_id, ts, case event_type when 'view' then 'queued' when 'click' then 'preparing' when 'signup' then 'base_run' when 'purchase' then 'done' else 'failed' end as state from events),
p as (select *, lag(state) over (partition by user_id order by ts, event_id) as prior from o),
r as (select *, list_position(['queued','preparing','image_build','base_run','head_run','probing','adjudicating','rendering','done'], state) as n,
  list_position(['queued','preparing','image_build','base_run','head_run','probing','adjudicating','rendering','done'], prior) as m from p)
select event_id, prior, state, case when prior is null then true when prior in ('done','failed') then false when state = 'failed' then true else coalesce(n > m, false) end as legal,
  case when state in ('done','failed') then 1.0 else (n - 1) / 8 end as progress from r
""")
def state_machine_audit(spark, d):
    e = F.col("event_type")
    state = F.when(e == "view", "queued").when(e == "click", "preparing").when(e == "signup", "base_run").when(e == "purchase", "done").otherwise("failed")
    own = read(spark, d, "events").select("event_id", "user_id", "ts", state.alias("state"))
    return sequences.transitions(own, "user_id", ["ts", "event_id"]).select("event_id", "prior", "state", "legal", "progress")


@query("select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def json_props(spark, d):
    own = sinks.tolerant_json(F.col("props"), "k INT", F.struct(F.lit(None).cast("int").alias("k")))
    return read(spark, d, "events").select("event_id", own["k"].alias("k"))


@query("select d.doc_id, l.quality, l.toxic, d.lang from documents d left join labels l using (doc_id)")
def label_join(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic", "lang")


@query("""
select doc_id, substr(sha256(concat(source, chr(0), lang, chr(0), cast(doc_id as varchar))), 1, 16) as id from documents
""")
def observation_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", paths.observation_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"))


@query("""
with n as (select o_custkey as key, o_orderkey as seq, o_totalprice as price, o_orderstatus as status from orders)
select c_custkey as key, coalesce(x.price, c_acctbal) as price, c_mktsegment as status from customer left join (
  select key, arg_max(price, seq) as price from n group by 1) x on x.key = c_custkey
union all select key, arg_max(price, seq), arg_max(status, seq) from n where key not in (select c_custkey from customer) group by 1
""")
def partial_upsert(spark, d):
    old = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("price"), F.col("c_mktsegment").alias("status"))
    new = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return sinks.upsert(old, new, ["key"], "seq", update=("price",))


@query("""
select o_custkey as nodeid, count(*) as total, count(*) filter (o_orderstatus = 'F') as failed, count(*) filter (o_orderstatus = 'O') as passed, count(*) filter (o_orderstatus not in ('F', 'O')) as skipped,
  coalesce(string_agg(cast(o_orderkey as varchar), ',' order by cast(o_orderkey as varchar)) filter (o_orderstatus = 'F'), '') as failed_ids from orders group by 1
""")
def sandbox_rollup(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "passed").otherwise("skipped")
    own = read(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.lit("head").alias("side"), status.alias("status"), F.col("o_orderkey").cast("string").alias("nodeid"))
    return rollups.sandbox_rollup(own).select(F.col("run_id").alias("nodeid"), "total", "failed", "passed", "skipped", F.array_join("failed_ids", ",").alias("failed_ids"))


@query("""
with s as (select user_id as job, ts, value, lag(value) over (partition by user_id order by ts, event_id) as v0, epoch(ts) as t, lag(epoch(ts)) over (partition by user_id order by ts, event_id) as t0, event_id from events)
select event_id, round(coalesce(greatest(0.0, least(1000.0, case when t <> t0 then (value - v0) / (t - t0) * 100 end)), 0), 4) as cpu_pct from s
where event_id in (select event_id from (select event_id, count(*) over (partition by user_id, ts) as c from events) where c = 1)
""")
def cpu_percent(spark, d):
    from pyspark.sql.window import Window

    e = read(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    once = e.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("user_id", "ts"))).select("event_id", F.col("_c"))
    out = sequences.cpu_percent(e.select("event_id", F.col("user_id").alias("job_id"), at.alias("at_s"), F.col("value").alias("cpu_s")))
    return out.join(once.where("_c = 1").select("event_id"), "event_id", "left_semi").select("event_id", F.round("cpu_pct", 4).alias("cpu_pct"))


@query("""
with r as (select o_orderkey as id, o_custkey as k, o_orderstatus as s, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as nxt from orders)
select id, case when s <> 'F' then nxt end as superseded_by from r
""")
def superseded_runs(spark, d):
    own = read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("r").alias("repo"), F.col("o_custkey").alias("pr_number"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("state"), F.lit(None).cast("bigint").alias("superseded_by"),
    )
    return sequences.superseded(own).select("id", "superseded_by")


@query("""
with recursive c as (
  select user_id % 16 as ledger, event_id as id, user_id || '|' || cast(ts::date as varchar) as day, event_id % 50 as run, value as usd, row_number() over (partition by user_id % 16 order by event_id) as n from events),
r as (
  select ledger, cast(0 as bigint) as n, cast(0 as double) as total, map(cast([] as varchar[]), cast([] as double[])) as spent, cast(null as varchar) as why from (select distinct ledger from c)
  union all
  select ledger, n, case when w is null then total + usd else total end, case when w is null then map_concat(spent, map([day, 'r' || run], [d + usd, s + usd])) else spent end, coalesce(w, '')
  from (select *, case when total + usd > 20000 then 'total' when d + usd > 400 then 'repo_day' when s + usd > 900 then 'run' end as w from (
    select c.*, r.total, r.spent, coalesce(r.spent[c.day], 0) as d, coalesce(r.spent['r' || c.run], 0) as s from r join c on c.ledger = r.ledger and c.n = r.n + 1)))
select c.id, r.why = '' as granted, nullif(r.why, '') as refused_by from r join c using (ledger, n)
""")
def budget_reservations(spark, d):
    own = read(spark, d, "events").select((F.col("user_id") % 16).alias("ledger"), F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("repo"), F.col("ts").cast("date").cast("string").alias("day"), (F.col("event_id") % 50).alias("run_id"), F.col("value").alias("usd"))
    return sequences.reservations(own, 20_000.0, 400.0, 900.0)


@query("""
select l_orderkey as id, round((sum(l_quantity) * 1.0 + sum(l_linenumber) * 8.0 + round(sum(l_discount * 100)) * 2.0) / 1000000, 6) as usd from lineitem group by 1
""")
def token_cost(spark, d):
    own = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    parts = own.agg(F.sum("l_quantity").alias("i"), F.sum("l_linenumber").alias("o"), F.round(F.sum(F.col("l_discount") * 100)).alias("w"))
    usd = paths.usd_cost(F.col("i"), F.col("o"), F.lit(0), F.col("w"), F.lit(1.0), F.lit(8.0), ttl="1h")
    return parts.select("id", usd.alias("usd"))


@query("""
with recursive p as (
  select cast(user_id as varchar) as key, floor(epoch(ts)) as t, cast(event_id as varchar) as head, row_number() over (partition by user_id order by floor(epoch(ts)), cast(event_id as varchar)) as n from events),
r as (
  select key, n, t as opened from p where n = 1
  union all select p.key, p.n, case when p.t - r.opened < 3600 then r.opened else p.t end from r join p on p.key = r.key and p.n = r.n + 1)
select key, cast(opened as double) as queued_at, arg_max(head, n) as head, cast(count(*) as integer) as pushes from r join p using (key, n) group by key, opened
""")
def debounced_pushes(spark, d):
    own = read(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.col("event_id").cast("string").alias("head"))
    return sequences.debounced(own, "key", "at", "head", 3600.0)


@query("""
select p_brand as repo, p_type as kind, count(*) as n from part group by 1, 2
""")
def count_by_kind(spark, d):
    return rollups.count_by(read(spark, d, "part").select(F.col("p_brand").alias("repo"), F.col("p_type").alias("kind")), "repo", "kind")


ALL_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" union all ".join(f"select '{t}' as name, count(*) as rows from {t}" for t in ALL_TABLES))
def table_counts(spark, d):
    return sinks.counts({t: read(spark, d, t) for t in ALL_TABLES})


@query("""
select s_suppkey as id from supplier where s_nationkey in (select c_nationkey from customer where c_acctbal > 9900) order by s_suppkey limit 50
""")
def callers_one_hop(spark, d):
    s = read(spark, d, "supplier").select(F.lit("r").alias("repo"), F.col("s_suppkey").alias("fqn"), "s_nationkey")
    c = read(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("s_nationkey")).distinct()
    edges = s.join(c, "s_nationkey").select("repo", F.col("fqn").alias("caller"), F.lit("x").alias("callee"))
    return lookups.callers_of(edges, s.select("repo", "fqn"), "r", "x", 50).select(F.col("fqn").alias("id"))


from changelens.plans import deeper, further  # noqa: E402, F401  (they register their queries)
