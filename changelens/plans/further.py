"""Further bindings: scans, rewrites, functions, lookups and rollups over whole tables.

A few frames serve them all: orders are runs of a pull (the customer) in a repository (the
priority), line items are observations of a run, customers are pulls of a repository (the
segment), events are an event log, parts are symbols of a file (the type).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens.functions import paths, text
from changelens.operators import deltas, findings, lookups, ranking, reports, rollups, sequences
from changelens.plans.bindings import query, read
from changelens.sources import files, sinks, tables
from changelens.streaming import events

_RUNS = """runs as (select o_orderkey as id, o_orderpriority as repo, o_custkey as pr_number, o_orderdate as created_at, o_totalprice as usd,
  case o_orderstatus when 'F' then 'done' when 'O' then 'queued' else 'base_run' end as state from orders)"""
_OBS = """obs as (select l_orderkey as run_id, l_orderkey * 10 + l_linenumber as id, l_partkey as symbol, l_quantity as rank_score,
  case l_returnflag when 'R' then 'behavior_change' when 'A' then 'api_change' else 'timeout' end as kind, l_tax as confidence from lineitem)"""


def _runs(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("base_run")
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("repo"), F.col("o_custkey").alias("pr_number"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("usd"), state.alias("state"),
    )


def _obs(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "behavior_change").when(F.col("l_returnflag") == "A", "api_change").otherwise("timeout")
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("symbol"),
        F.col("l_quantity").alias("rank_score"), kind.alias("kind"), F.col("l_tax").alias("confidence"),
    )


# ---- scans ------------------------------------------------------------------


@query("select n_nationkey, n_name from nation where n_nationkey = 7")
def scan_lookup(spark, d):
    return tables.lookup(read(spark, d, "nation"), n_nationkey=7).select("n_nationkey", "n_name")


@query("select c_custkey as number, c_mktsegment as repo from customer where c_mktsegment = 'BUILDING' order by 1 desc")
def scan_pulls(spark, d):
    own = read(spark, d, "customer").select(F.col("c_custkey").alias("number"), F.col("c_mktsegment").alias("repo"), F.lit("open").alias("state"))
    return tables.pulls(own, "BUILDING", "open").drop("state")


@query(f"with {_RUNS} select id, state from runs where repo = '1-URGENT' order by created_at desc, id desc limit 50")
def scan_runs(spark, d):
    return tables.runs(_runs(spark, d), "1-URGENT").select("id", "state")


@query(f"with {_RUNS} select id, repo, state from runs where state <> 'done'")
def scan_unfinished_runs(spark, d):
    return tables.unfinished_runs(_runs(spark, d)).select("id", "repo", "state")


@query("select l_linenumber as id, l_quantity as started_at from lineitem where l_orderkey = (select min(l_orderkey) from lineitem)")
def scan_jobs(spark, d):
    own = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("started_at"))
    least = own.agg(F.min("run_id")).first()[0]
    return tables.jobs(own, least).select("id", "started_at")


@query(f"with {_OBS} select id, kind, rank_score from obs where run_id = (select min(l_orderkey) from lineitem)")
def scan_observations(spark, d):
    own = _obs(spark, d)
    return tables.observations(own, own.agg(F.min("run_id")).first()[0]).select("id", "kind", "rank_score")


@query("select p_partkey as id, p_size as support from part where p_brand = 'Brand#12'")
def scan_norms(spark, d):
    own = read(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("repo"), F.when(F.col("p_size") > 25, "mined").otherwise("declared").alias("source"),
        F.col("p_retailprice").alias("confidence"), F.col("p_size").alias("support"),
    )
    return tables.norms(own, "Brand#12").select("id", "support")


@query("select p_partkey as id, p_name as statement from part where p_brand = 'Brand#21' order by 1")
def scan_norms_by_id(spark, d):
    own = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("repo"), F.col("p_name").alias("statement"))
    return tables.norms_by_id(own, "Brand#21").drop("repo")


@query("select max(event_id) as head from events")
def log_head(spark, d):
    return tables.log_head(read(spark, d, "events").select(F.col("event_id").alias("seq")))


@query("select event_id as id, user_id as repo from events where event_type in ('error', 'purchase') and value >= 50")
def scan_notifications(spark, d):
    level = F.when(F.col("event_type") == "error", "major").when(F.col("event_type") == "purchase", "notable").otherwise("minor")
    read_at = F.when(F.col("value") < 50, F.col("value"))
    own = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("repo"), level.alias("level"), read_at.alias("acknowledged_at"))
    return tables.notifications(own, "notable", unread=True).select("id", "repo")


@query("""
with s as (select event_id, user_id, max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id) as over,
  row_number() over (partition by user_id order by ts, event_id) as n from events)
select event_id, user_id from s where over = 0 and n <= 5
""")
def scan_taken_while(spark, d):
    own = tables.taken_while(read(spark, d, "events"), F.col("event_type") == "error", [F.col("ts"), F.col("event_id")], ["user_id"], 5)
    return own.select("event_id", "user_id")


@query("select o_orderkey as number, strftime(o_orderdate, '%Y-%m-%d') as updated_at from orders where strftime(o_orderdate, '%Y-%m-%d') > '1996-06-01'")
def scan_updated_after(spark, d):
    own = read(spark, d, "orders").select(F.col("o_orderkey").alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"))
    return tables.updated_after(own, "1996-06-01")


@query("""
with c as (select l_orderkey as number, count(*) as comments, sum(l_quantity) as q from lineitem group by 1),
k as (select l_orderkey as number, count(*) as commits from lineitem where l_linestatus = 'F' group by 1)
select o_orderkey as number, coalesce(comments, -1) as comments, coalesce(q, 0) as q, coalesce(commits, -1) as commits
from orders left join c on number = o_orderkey left join k on k.number = o_orderkey where o_orderstatus = 'F'
""")
def scan_harvested(spark, d):
    merged = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    p = read(spark, d, "orders").select(F.lit("r").alias("repo"), F.col("o_orderkey").alias("number"), merged.alias("merged_at"))
    li = read(spark, d, "lineitem").select(F.lit("r").alias("repo"), F.col("l_orderkey").alias("number"), "l_quantity", "l_linestatus")
    out = tables.harvested(p, li.drop("l_linestatus"), li.where("l_linestatus = 'F'").drop("l_quantity"))
    q = F.coalesce(F.reduce(F.transform("review_comments", lambda x: x["l_quantity"]), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    size = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(-1)).cast("long")
    return out.select("number", size("review_comments").alias("comments"), q.alias("q"), size("commits").alias("commits"))


# ---- rewrites ---------------------------------------------------------------


@query("""
select c_custkey as key, c_name as name from customer union all
select distinct o_custkey, 'new' from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 20) and o_custkey not in (select c_custkey from customer)
""")
def sink_insert_or_ignore(spark, d):
    old = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    new = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.lit("new").alias("name"))
    return sinks.insert_or_ignore(old, new, ["key"])


@query("""
select c_custkey as key, case when c_custkey in (select o_custkey from orders) then 'replaced' else c_name end as name from customer
union all select distinct o_custkey, 'replaced' from orders where o_custkey not in (select c_custkey from customer)
""")
def sink_replace_rows(spark, d):
    old = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return sinks.replace_rows(old, read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.lit("replaced").alias("name")), ["key"])


@query("""
select p_partkey as id, p_brand as repo, p_size as n from part where p_brand <> 'Brand#13'
union all select s_suppkey, 'Brand#13', s_nationkey from supplier
""")
def sink_swap_partition(spark, d):
    old = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("repo"), F.col("p_size").alias("n"))
    new = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("Brand#13").alias("repo"), F.col("s_nationkey").alias("n"))
    return sinks.swap_partition(old, new, repo="Brand#13")


@query("select 1000 + row_number() over (order by s_nationkey, s_suppkey) as seq, s_suppkey from supplier")
def sink_append_events(spark, d):
    out = sinks.append_events(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), 1000, [F.col("s_nationkey"), F.col("s_suppkey")])
    return out.select(F.col("seq").cast("long").alias("seq"), "s_suppkey")


@query("""
with m as (select n_regionkey as repo, cast(count(*) as integer) as n from nation group by 1)
select s_nationkey % 7 as repo, 's' || s_suppkey as sha, cast(coalesce(n, 0) + row_number() over (partition by s_nationkey % 7 order by s_acctbal nulls first, 's' || s_suppkey) as integer) as number
from supplier left join m on m.repo = s_nationkey % 7
""")
def sink_numbered(spark, d):
    n = read(spark, d, "nation").select(F.col("n_regionkey").alias("repo"), F.col("n_name").alias("sha"), "n_nationkey")
    from pyspark.sql.window import Window

    number = F.row_number().over(Window.partitionBy("repo").orderBy("n_nationkey"))
    old = n.select("repo", "sha", number.alias("number"), F.lit(0.0).alias("built_at"))
    new = read(spark, d, "supplier").select((F.col("s_nationkey") % 7).alias("repo"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("sha"), F.lit(0).alias("number"), F.col("s_acctbal").alias("built_at"))
    return sinks.numbered(old, new).select("repo", "sha", "number")


@query("select event_id as id, case when event_type = 'error' then 'seen' else event_type end as state from events")
def sink_updated(spark, d):
    own = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("state"))
    return sinks.updated(own, F.col("state") == "error", state="seen")


@query(f"""
with {_RUNS}, {_OBS}, gone as (select id from runs where repo = '2-HIGH')
select 'observations' as name, count(*) as rows, cast(sum(id) as bigint) as total from obs where run_id not in (select id from gone)
union all select 'runs', count(*), cast(sum(id) as bigint) from runs where repo <> '2-HIGH'
""")
def sink_cascade(spark, d):
    runs = _runs(spark, d)
    out = sinks.cascade({"runs": runs, "observations": _obs(spark, d), "pulls": runs.select("repo"), "repos": runs.select(F.col("repo").alias("slug"))}, "2-HIGH")
    parts = [out[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum("id").alias("total")) for n in ("runs", "observations")]
    return parts[0].union(parts[1]).select("name", "rows", "total")


@query("select r_regionkey, r_name, 0 as support, 'mined' as source from region")
def sink_migrated(spark, d):
    return sinks.migrated(read(spark, d, "region").select("r_regionkey", "r_name"), {"support": F.lit(0), "source": F.lit("mined"), "r_name": F.lit("lost")})


# ---- functions --------------------------------------------------------------


@query("""
with w as (select p_partkey as id, regexp_extract_all(lower(p_name), '[a-z0-9]+') as w, p_name, p_size from part)
select id, 'review-' || array_to_string(w[1:6], '-') as slug, case when length(p_name) > 12 then substr(p_name, 1, 9) || '…' else p_name end as short,
  cast(greatest(1, length(p_name) // 4) as bigint) as tokens, p_size || case when p_size = 1 then ' way' else ' ways' end as ways,
  least(1.0, p_size / 10) * least(1.0, (p_size % 5) / 4) as confidence from w
""")
def text_of_names(spark, d):
    p = read(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        text.slug(F.col("p_name"), "review-").alias("slug"),
        text.ellipsis(F.col("p_name"), 12, 9).alias("short"),
        paths.estimated_tokens(F.col("p_name")).cast("long").alias("tokens"),
        text.counted(F.col("p_size"), "way", "ways").alias("ways"),
        paths.confidence(F.col("p_size"), F.col("p_size") % 5).alias("confidence"),
    )


@query("select doc_id, length(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) as n from documents where text is not null")
def squashed_length(spark, d):
    own = read(spark, d, "documents").where("text is not null")
    return own.select("doc_id", F.char_length(text.squash(F.col("text"))).cast("long").alias("n"))


_EXTENSIONS = "case lower(regexp_extract(f, '(\\.[^.]+)$', 1)) when '.py' then 'Python' when '.go' then 'Go' when '.ts' then 'TypeScript' else 'Other' end"


@query(f"""
with f as (select p_partkey as id, replace(lower(p_type), ' ', '/') || '/m' || p_partkey || (['.py', '.go', '.ts', '.zzz', ''])[p_size % 5 + 1] as f from part)
select id, {_EXTENSIONS} as language, regexp_replace(replace(regexp_replace(f, '\\.pyi?$', ''), '/', '.'), '(^|\\.)__init__$', '') as fqn,
  split_part(f, ':', 1) as evidence_path, replace('T::a' || id, '::', '.') as symbol from f
""")
def paths_of_files(spark, d):
    p = read(spark, d, "part")
    ends = F.array(*map(F.lit, (".py", ".go", ".ts", ".zzz", "")))
    path = F.concat(F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")), F.lit("/m"), F.col("p_partkey").cast("string"), F.element_at(ends, F.col("p_size") % 5 + 1))
    node = F.concat(path, F.lit("::T::a"), F.col("p_partkey").cast("string"))
    return p.select(
        F.col("p_partkey").alias("id"),
        paths.language_of(path).alias("language"),
        paths.module_fqn(path, F.lit(False), F.lit("")).alias("fqn"),
        paths.path_of_evidence(F.concat(path, F.lit(":3"))).alias("evidence_path"),
        paths.symbol_of_nodeid(node).alias("symbol"),
    )


@query("""
with u as (select page_id, regexp_replace(url, '^https?://', '') as path from pages),
p as (select page_id, path, string_split(lower(path), '/') as parts from u)
select page_id, list_has_any(parts, ['tests', 'test', '__tests__', 'spec', 'specs', 'testing']) as is_test,
  not list_bool_or(list_transform(string_split(path, '.'), lambda x: starts_with(x, '_'))) as is_public, '/src/' || path as stripped from p
""")
def paths_of_pages(spark, d):
    path = F.regexp_replace("url", "^https?://", "")
    return read(spark, d, "pages").select(
        "page_id",
        paths.is_test(path).alias("is_test"),
        paths.is_public(path, strict=True).alias("is_public"),
        F.concat(F.lit("/src/"), paths.strip_container(F.concat(F.lit("/src/"), path))).alias("stripped"),
    )


@query("""
select event_id, 'n' || substr(sha256(concat(user_id, chr(0), event_type, chr(0), event_id)), 1, 20) as notification,
  date_trunc('day', ts) as day, case event_id % 7 when 0 then 'passed' when 1 then 'failed' when 2 then 'collection_error' when 3 then 'timeout' when 4 then 'oom' when 5 then 'install_failed' else 'failed' end as v2,
  case event_id % 7 when 0 then 'passed' when 1 then 'passed' when 2 then 'failed' when 3 then 'timeout' when 4 then 'oom' when 5 then 'install_failed' else 'failed' end as v2_tool,
  case event_id % 7 when 0 then 'passed' when 1 then 'failed' when 2 then 'collection_error' when 3 then 'timeout' when 4 then 'oom' else 'failed' end as v1,
  round(((floor(length(props) / 3) + 64) * 0.8 * 1.25 + event_id * 2.0) / 1000000, 6) as worst from events
""")
def ids_and_outcomes(spark, d):
    codes = F.array(*map(F.lit, (0, 1, 2, 124, 137, 125, 9)))
    code = F.element_at(codes, (F.col("event_id") % 7 + 1).cast("int"))
    return read(spark, d, "events").select(
        "event_id",
        paths.notification_id(F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id").cast("string")).alias("notification"),
        paths.day_start(F.col("ts")).cast("timestamp_ntz").alias("day"),
        paths.outcome_v2(code).alias("v2"),
        paths.outcome_v2(code, (1,)).alias("v2_tool"),
        paths.outcome_v1(code).alias("v1"),
        paths.worst_case_usd(F.char_length("props"), F.col("event_id"), F.lit(0.8), F.lit(2.0)).alias("worst"),
    )


@query("""
select l_orderkey, l_linenumber, case when l_linenumber <= 120 and l_linenumber >= 1 then 'head' end as side,
  'https://h/blob/' || l_orderkey || '/a/b.py#L' || l_linenumber as url,
  'declared-lint-' || lower(split_part(l_returnflag || ' x', ' ', 1)) as norm from lineitem
""")
def citations_of_lines(spark, d):
    li = read(spark, d, "lineitem")
    line = F.col("l_linenumber").cast("string")
    ref = F.concat(F.lit("a/b.py:"), line, F.lit("-"), (F.col("l_linenumber") + 5).cast("string"))
    return li.select(
        "l_orderkey",
        "l_linenumber",
        paths.code_reference(ref)["side"].alias("side"),
        lookups.citation_url(F.lit("code"), ref, "https://h", F.col("l_orderkey").cast("string")).alias("url"),
        lookups.norm_for_tool(F.concat("l_returnflag", F.lit(" x"))).alias("norm"),
    )


@query("""
select p_partkey as id, regexp_extract(p_name, '[^ ]+') as first, contains(p_name, regexp_extract(p_name, '[^ ]+')) as quoted,
  case when p_size % 3 = 0 then 'fix' else '' end as code, 'v' || p_size || '.' || (p_size % 10) as version, cast(p_size as integer) as major, cast(p_size % 10 as integer) as minor,
  'This repo required this in #' || p_size || ', #' || p_partkey || '.' as sentence from part
""")
def text_of_rules(spark, d):
    p = read(spark, d, "part")
    line = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "  [fix]").otherwise(" [Fix]"))
    version = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"))
    first = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    return p.select(
        F.col("p_partkey").alias("id"),
        first.alias("first"),
        text.contains_quote(F.col("p_name"), first).alias("quoted"),
        text.trailing_code(line)["code"].alias("code"),
        version.alias("version"),
        text.semver(version)["major"].alias("major"),
        text.semver(version)["minor"].alias("minor"),
        text.citation_sentence(F.array(F.col("p_size").cast("long"), F.col("p_partkey"))).alias("sentence"),
    )


# ---- lookups ----------------------------------------------------------------


@query(f"with {_OBS} select id as observation_id, symbol from obs where run_id = (select min(l_orderkey) from lineitem) and symbol % 2 = 0")
def with_observation(spark, d):
    o = _obs(spark, d)
    cited = F.when(F.col("symbol") % 2 == 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>"))
    own = o.select(F.col("id").alias("observation_id"), "symbol", cited.alias("citations"))
    return lookups.with_observation(own, o, o.agg(F.min("run_id")).first()[0]).select("observation_id", "symbol")


@query("""
with b as (select p_type || '.' || p_brand as fqn, min(p_size) as s from part where p_size < 30 group by 1),
h as (select p_type || '.' || p_brand as fqn, min(p_size) as s from part where p_size > 10 group by 1)
select fqn, case when h.s is null then 'removed' when b.s is null then 'added' else 'changed' end as change from b full join h using (fqn)
where h.s is null or b.s is null or h.s <> b.s
""")
def signature_delta(spark, d):
    p = read(spark, d, "part").withColumn("fqn", F.concat_ws(".", "p_type", "p_brand"))
    side = lambda cond: p.where(cond).groupBy("fqn").agg(F.min("p_size").cast("string").alias("signature"))
    return deltas.signature_delta(side("p_size < 30"), side("p_size > 10")).select("fqn", "change")


@query(f"""
with {_OBS} select id, case kind when 'api_change' then 'n1' when 'timeout' then null else null end as norm_id from obs
""")
def attach_norms(spark, d):
    o = _obs(spark, d).withColumn("norm_id", F.lit(None).cast("string"))
    norms = spark.createDataFrame([("n1",), ("n2",)], "id STRING")
    return lookups.attach_norms(o, norms, {"api_change": "n1", "timeout": "n9"}).select("id", "norm_id")


@query("""
with r as (select c_nationkey as packet, o_custkey as op, o_orderkey as pos, cast(o_custkey % 23 as varchar) as caller,
  row_number() over (partition by c_nationkey, o_custkey order by o_orderkey) as n from orders join customer on c_custkey = o_custkey),
g as (select packet, caller, min(row(op, pos)) as p from r where n <= 5 group by 1, 2)
select packet, caller, pos from (select packet, caller, row_number() over (partition by packet order by p) as pos from g) where pos <= 8
""")
def callers_per_packet(spark, d):
    own = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = own.select(F.col("c_nationkey").alias("packet"), F.col("o_custkey").alias("observation_pos"), F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 23).cast("string").alias("caller"))
    return lookups.callers_per_packet(own).select("packet", "caller", F.col("pos").cast("long").alias("pos"))


@query(f"""
with {_OBS} select o.id, o.kind, o.rank_score, c.c_name as summary, p.p_brand as statement from obs o
left join customer c on c.c_custkey = o.id left join part p on p.p_partkey = o.symbol
""")
def report_rows(spark, d):
    o = _obs(spark, d).withColumnRenamed("symbol", "norm_id")
    c = read(spark, d, "customer")
    a = c.select(F.col("c_custkey").alias("observation_id"), F.lit("intended").alias("assessment"), F.lit("r").alias("reasoning"), F.array().alias("citations"))
    s = c.select(F.col("c_custkey").alias("observation_id"), F.col("c_name").alias("summary"), F.lit("r").alias("rationale"), F.lit("p").alias("patch_sketch"))
    n = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("statement"), F.array(F.col("p_size")).alias("evidence_prs"))
    return lookups.report(o, a, s, n).select("id", "kind", "rank_score", F.col("suggestion.summary").alias("summary"), F.col("norm.statement").alias("statement"))


# ---- rollups ----------------------------------------------------------------


@query("select sum(o_totalprice) as usd from orders where o_orderpriority = '5-LOW' and o_custkey >= 100")
def spent(spark, d):
    own = read(spark, d, "orders").select(F.lit("x").alias("run_id"), F.col("o_orderpriority").alias("repo"), F.col("o_custkey").cast("double").alias("ts"), F.col("o_totalprice").alias("usd"))
    return rollups.spent(own, repo="5-LOW", since=100.0).select(F.col("usd"))


@query("""
select count(*) as calls, cast(sum(l_orderkey) as bigint) as input_tokens, cast(sum(l_partkey) as bigint) as output_tokens,
  cast(sum(l_suppkey) as bigint) as cache_read_tokens, cast(sum(l_linenumber) as bigint) as cache_write_tokens,
  round(sum(l_tax), 2) as usd from lineitem
""")
def spend_summary(spark, d):
    names = {"l_orderkey": "input_tokens", "l_partkey": "output_tokens", "l_suppkey": "cache_read_tokens", "l_linenumber": "cache_write_tokens", "l_tax": "usd"}
    own = read(spark, d, "lineitem").select(*(F.col(k).alias(v) for k, v in names.items()))
    return rollups.spend_summary(own).withColumn("usd", F.round("usd", 2))


@query(f"""
with {_OBS} select count(*) as total, count(*) filter (symbol % 3 = 0) as cited, count(*) filter (symbol % 3 <> 0) as uncited,
  count(*) filter (kind = 'timeout') as timeouts from obs
""")
def findings_counts(spark, d):
    own = _obs(spark, d).withColumn("norm_id", F.when(F.col("symbol") % 3 == 0, "n"))
    out = rollups.findings_counts(own)
    return out.select("total", "cited", "uncited", F.element_at("by_kind", "timeout").alias("timeouts"))


@query("select l_partkey as path, count(distinct l_orderkey) as commits, count(distinct case when l_suppkey % 5 <> 0 then a end) as authors from (select *, max(case when l_suppkey % 5 <> 0 then lpad(cast(l_suppkey as varchar), 9, '0') end) over (partition by l_partkey, l_orderkey) as a from lineitem) group by 1")
def churn(spark, d):
    author = F.when(F.col("l_suppkey") % 5 != 0, F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).otherwise("")
    return rollups.churn(read(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("commit"), author.alias("author")))


@query("""
select (select count(*) from part) as files, (select cast(sum(p_size) as bigint) from part) as loc, (select count(*) from part where p_size > 40) as test_files,
  (select count(distinct p_brand) from part) as languages, (select count(distinct l_orderkey) from lineitem) as commits_window,
  (select count(distinct l_suppkey) from lineitem) as contributors, (select count(*) from supplier) as symbols, (select count(*) from nation) as edges
""")
def atlas_totals(spark, d):
    f = read(spark, d, "part").select(F.col("p_size").alias("loc"), (F.col("p_size") > 40).alias("is_test"), F.col("p_brand").alias("language"))
    c = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").cast("string").alias("author"))
    return rollups.atlas_totals(f, c, read(spark, d, "supplier"), read(spark, d, "nation"))


@query("""
with m as (select p_type as name, count(*) filter (p_size > 45) as test_files, count(*) as symbols from part group by 1)
select count(*) filter (test_files > 0) as tested, count(*) filter (test_files = 0 and symbols > 0) as untested, cast(sum(test_files) as bigint) as test_files,
  coalesce(array_to_string(list_sort(list(name) filter (test_files = 0 and symbols > 0))[1:40], ','), '') as untested_names from m
""")
def test_topology(spark, d):
    m = read(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.count_if(F.col("p_size") > 45).alias("test_files"), F.count(F.lit(1)).alias("symbols"))
    return rollups.test_topology(m).withColumn("untested_names", F.array_join("untested_names", ","))


@query(f"""
with {_RUNS}, {_OBS}, r as (select * from (select *, row_number() over (partition by repo order by created_at desc, id desc) as n from runs) where n <= 200),
s as (select distinct repo as slug from runs)
select slug, (select count(distinct pr_number) from runs where repo = slug) as open_pulls, (select count(*) from r where repo = slug) as runs,
  (select count(*) from r where repo = slug and state = 'done' and id in (select run_id from obs)) as flagged from s
""")
def repo_index(spark, d):
    runs = _runs(spark, d)
    repos = runs.select(F.col("repo").alias("slug")).distinct()
    pulls = runs.select("repo", "pr_number", F.lit("open").alias("state")).distinct()
    return rollups.repo_index(repos, pulls, runs, _obs(spark, d))


@query("select user_id as job_id, max(value) as peak_rss_mb, max(event_id) as peak_cpu_pct from events group by 1")
def peaks(spark, d):
    return rollups.peaks(read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("value").alias("rss_mb"), F.col("event_id").alias("cpu_pct")))


@query("""
select user_id as repo, (['none', 'minor', 'notable', 'major'])[max(case event_type when 'error' then 3 when 'purchase' then 2 when 'click' then 1 else 0 end) + 1] as level
from events group by 1
""")
def drift_level(spark, d):
    level = F.when(F.col("event_type") == "error", "major").when(F.col("event_type") == "purchase", "notable").when(F.col("event_type") == "click", "minor").otherwise("none")
    return rollups.drift_level(read(spark, d, "events").select(F.col("user_id").alias("repo"), level.alias("level")), ["repo"])


@query("""
select (select count(*) from region) as repos, count(*) filter (o_orderstatus = 'O') as queued, count(*) filter (o_orderstatus not in ('F', 'O')) as running,
  (select max(event_id) from events) as head, (select round(sum(o_totalprice), 2) from orders) as usd from orders
""")
def health(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("seq"))
    return rollups.health(read(spark, d, "region"), _runs(spark, d), e, _runs(spark, d).select("usd")).withColumn("usd", F.round("usd", 2))


@query("""
select count(*) filter (p_size > 25) as mined, count(*) filter (p_size <= 25) as declared, (select count(*) from labels) as seen,
  (select cast(sum(toxic) as bigint) from labels) as kept, (select round(sum(toxic) / count(*), 3) from labels) as retention from part
""")
def brain_page(spark, d):
    n = read(spark, d, "part").select(F.when(F.col("p_size") > 25, "mined").otherwise("declared").alias("source"))
    return rollups.brain_page(n, read(spark, d, "labels").select((F.col("toxic") == 1).alias("enforced")))


# ---- sequences and sets -----------------------------------------------------


@query("""
with k as (select distinct p_brand as repo, p_size as n from part), g as (select repo, n, n - row_number() over (partition by repo order by n) as g from k)
select repo, min(n) as "start", max(n) as "end" from g group by repo, g
""")
def integer_runs(spark, d):
    return sequences.runs_of_integers(read(spark, d, "part").select(F.col("p_brand").alias("repo"), F.col("p_size").alias("n")), ["repo"], "n")


@query("""
with f as (select p_brand, p_type, p_partkey, min(p_partkey) over (partition by p_brand, p_type) as first, row_number() over (partition by p_brand, p_type order by p_partkey) as m from part),
g as (select *, dense_rank() over (partition by p_brand order by first) as g from f)
select p_brand, p_type, p_partkey from g where g <= 4 and m <= 3
""")
def top_groups(spark, d):
    return sequences.top_groups(read(spark, d, "part").select("p_brand", "p_type", "p_partkey"), ["p_brand"], "p_type", "p_partkey", 4, 3)


@query("select p_partkey, round(p_size / max(p_size) over (partition by p_brand), 9) as share from part")
def by_widest(spark, d):
    out = sequences.by_widest(read(spark, d, "part"), "p_size", "share", ["p_brand"])
    return out.select("p_partkey", F.round("share", 9).alias("share"))


@query("select job_id, offset_ms from (select user_id as job_id, event_id as offset_ms, row_number() over (partition by user_id order by event_id) as n from events) where (n - 1) % 5 = 0")
def thinned_samples(spark, d):
    return sequences.thinned(read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("offset_ms")), 5)


@query("select user_id as nodeid, arg_max(event_type, event_id) as status from events group by 1")
def last_status(spark, d):
    return sequences.last_status(read(spark, d, "events").select(F.col("user_id").alias("nodeid"), F.col("event_type").alias("status"), "event_id"), ["nodeid"], "event_id")


@query("select o_custkey as key, min(o_orderkey) as pos, arg_min(o_totalprice, o_orderkey) as answer from orders group by 1")
def first_answers(spark, d):
    own = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("answer"))
    return sequences.first_answers(own, "key", "pos").select("key", "pos", "answer")


@query("select l_partkey as key, min(l_orderkey) as pos from lineitem group by 1")
def deduped_in_order(spark, d):
    return deltas.deduped_in_order(read(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("pos")), ["key"], "pos")


@query(f"with {_OBS} select id, symbol from obs where symbol in (select p_partkey from part where p_size > 40)")
def gated(spark, d):
    norms = read(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("id"))
    return deltas.gated(_obs(spark, d).withColumn("norm_id", F.col("symbol")), norms).select("id", "symbol")


@query("""
select distinct p_type as path, p_brand as code, 'm' || p_size as message from part where p_partkey % 2 = 0
except select p_type, p_brand, 'm' || p_size from part where p_partkey % 2 = 1
""")
def lint_set_delta(spark, d):
    own = read(spark, d, "part").select(F.col("p_type").alias("path"), F.col("p_brand").alias("code"), F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("message"), "p_partkey")
    return deltas.lint_set_delta(own.where("p_partkey % 2 = 1"), own.where("p_partkey % 2 = 0"))


@query("""
with n as (select p_brand as tool, p_type as path, 'c' as code, 'm' || p_partkey as message, row_number() over (partition by p_brand order by p_type, 'm' || p_partkey) as r, count(*) over (partition by p_brand) as c from part)
select tool, path, code, message from n where r <= 25 union all select distinct tool, '', 'more', (c - 25) || ' more findings' from n where c > 25
""")
def lint_capped_by_tool(spark, d):
    own = read(spark, d, "part").select(F.col("p_brand").alias("tool"), F.col("p_type").alias("path"), F.lit("c").alias("code"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("message"))
    return deltas.lint_delta(own.limit(0), own)


@query(f"""
with {_RUNS}, s as (select pr_number as tool, max(case when id % 2 = 0 and state = 'done' then 1 else 0 end) as b, max(case when id % 2 = 1 and state = 'done' then 1 else 0 end) as h from runs group by 1)
select tool, b = 1 and h = 1 as comparable, case when b = 0 then 'did not run at base' when h = 0 then 'did not run at head' end as reason from s
""")
def comparable_lint(spark, d):
    side = F.when(F.col("id") % 2 == 0, "base").otherwise("head")
    return deltas.comparable_lint(_runs(spark, d).select(F.col("pr_number").alias("tool"), side.alias("side"), F.when(F.col("state") == "done", "passed").otherwise("failed").alias("outcome")))


@query("""
with o as (select o_custkey as run_id, max(case when o_orderkey % 2 = 0 then x end) as base, max(case when o_orderkey % 2 = 1 then x end) as head,
    max(case when o_orderkey % 2 = 1 then o_orderkey % 50 end) as s, max(case when o_orderkey % 2 = 1 then o_orderkey end) as mb
  from (select *, case o_orderstatus when 'F' then 'passed' when 'O' then 'timeout' else 'oom' end as x from orders) group by 1)
select run_id || '-' || substr(sha256(concat(head, chr(0), '(suite)', chr(0), 'outcome:' || head)), 1, 16) as id, run_id, head as kind, '(suite)' as symbol,
  case head when 'oom' then 'the suite was killed for exceeding its memory limit at head' else 'the suite did not finish within its time limit at head' end as what_changed,
  'base run outcome ' || coalesce(base, 'unknown') || ', head run outcome ' || head || '; head ran for ' || s || '.5s' || ', peak memory ' || mb || ' MB' as how_we_know,
  'outcome:' || head as evidence_ref, cast(0.9 as double) as severity, cast(0.95 as double) as confidence, base
from o where head in ('timeout', 'oom') and base is distinct from head
""")
def outcome_delta(spark, d):
    x = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "timeout").otherwise("oom")
    side = F.when(F.col("o_orderkey") % 2 == 0, "base").otherwise("head")
    took = (F.col("o_orderkey") % 50 + 0.5).cast("double").alias("duration_s")
    return deltas.outcome_delta(read(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), side.alias("side"), x.alias("outcome"), took, F.col("o_orderkey").alias("peak_rss_mb")))


# ---- ranking ----------------------------------------------------------------


_CALLERS = "c as (select l_partkey as callee, count(distinct l_suppkey) as callers from lineitem group by 1), w as (select max(callers) as w from c)"


@query(f"""
with {_OBS}, {_CALLERS} select id, round(0.8 * confidence * (case when w = 0 then 0.5 else 0.5 + 0.5 * coalesce(callers, 0) / w end), 6) as rank_score
from obs left join c on callee = symbol, w
""")
def ranked(spark, d):
    own = _obs(spark, d).withColumn("severity", F.lit(0.8)).withColumn("relevance", F.lit("none of them"))
    c = rollups.caller_counts(read(spark, d, "lineitem").withColumnRenamed("l_partkey", "callee"), ["callee"], "l_suppkey")
    return ranking.ranked(own, c).select("id", "rank_score")


@query(f"with {_OBS} select id, case when id in (select id from obs where symbol % 4 = 0) then round(confidence * 0.5, 4) else confidence end as confidence from obs")
def demoted(spark, d):
    o = _obs(spark, d)
    verdict = F.when(F.col("symbol") % 4 == 0, "misleading").otherwise("intended")
    return ranking.demoted(o, o.select(F.col("id").alias("observation_id"), verdict.alias("assessment"))).select("id", "confidence")


@query("select p_type || '.' || p_partkey as fqn from part order by 1 limit 400")
def public_surface(spark, d):
    return ranking.public_surface(read(spark, d, "part").select(F.concat_ws(".", "p_type", F.col("p_partkey").cast("string")).alias("fqn")))


@query("select p_partkey as fqn, p_size as touched from part order by p_size desc, p_partkey limit 5")
def touched_first(spark, d):
    return ranking.touched_first(read(spark, d, "part").select(F.col("p_partkey").alias("fqn"), F.col("p_size").alias("touched")))


@query("""
with m as (select p_brand as repo, (['a', 'b', 'c'])[p_size % 3 + 1] as file, case when p_partkey % 5 = 0 then 0 when p_partkey % 5 = 1 then 1 else 2 end as depth from part),
s as (select repo, case file when 'a' then 'python' when 'b' then 'go' end as toolchain, case file when 'a' then 0 else 1 end as pos, sum(case depth when 0 then 2 when 1 then 1 else 0 end) as s from m where file <> 'c' group by 1, 2, 3),
b as (select repo, arg_max(toolchain, s * 10 - pos) as toolchain from s where s > 0 group by 1)
select distinct m.repo, coalesce(b.toolchain, 'generic') as toolchain from m left join b using (repo)
""")
def toolchain(spark, d):
    p = read(spark, d, "part")
    file = F.element_at(F.array(*map(F.lit, "abc")), F.col("p_size") % 3 + 1)
    depth = F.when(F.col("p_partkey") % 5 == 0, 0).when(F.col("p_partkey") % 5 == 1, 1).otherwise(2)
    known = spark.createDataFrame([("python", 0, "a"), ("go", 1, "b")], "toolchain STRING, pos INT, file STRING")
    return ranking.toolchain(p.select(F.col("p_brand").alias("repo"), file.alias("file"), depth.alias("depth")), known)


@query(f"""
with {_OBS}, o as (select run_id, id, max(kind) as kind, max(rank_score) as rank_score, max(confidence) as confidence from obs group by 1, 2)
select run_id, 'f' || (row_number() over (partition by run_id order by rank_score desc, id) - 1) as id, kind, confidence,
  case when id % 3 = 0 then 'seen' when kind = 'timeout' then 'suite' end as node, case when id % 3 = 0 then cast(run_id % 1000 as integer) end as pr,
  case when id % 3 = 0 then 'src/' || id || '.py' end as file, case when id % 3 = 0 then cast(id % 90 as integer) end as line_start from o
""")
def finding_rows(spark, d):
    own = _obs(spark, d).groupBy("run_id", "id").agg(F.max("kind").alias("kind"), F.max("rank_score").alias("rank_score"), F.max("confidence").alias("confidence"))
    file = F.concat(F.lit("src/"), F.col("id").cast("string"), F.lit(".py"))
    links = own.where("id % 3 = 0").select("run_id", "id", F.lit("seen").alias("node"), (F.col("run_id") % 1000).alias("pr"), file.alias("file"), (F.col("id") % 90).alias("line_start"))
    out = ranking.finding_rows(own, {"timeout": "suite"}, links)
    return out.select("run_id", "id", "kind", "confidence", "node", "pr", F.col("where.file").alias("file"), F.col("where.line_start").alias("line_start"))


# ---- findings ---------------------------------------------------------------


@query("""
with a as (select event_id, user_id as run_id, case when event_id % 3 = 0 then 'commit' else 'log' end as kind, value as created_at from events)
select event_id from a where created_at >= 100 or (run_id in (select o_custkey from orders where o_orderstatus <> 'F') and kind <> 'commit')
""")
def live_artefacts(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, "commit").otherwise("log")
    a = read(spark, d, "events").select("event_id", F.col("user_id").alias("run_id"), kind.alias("kind"), F.col("value").alias("created_at"))
    return findings.live(a, _runs(spark, d).select(F.col("pr_number").alias("id"), "state"), 100.0).select("event_id")


@query("select o_custkey as nodeid, count(*) filter (o_orderstatus = 'F') >= 2 and count(*) filter (o_orderstatus <> 'F') = 0 as kept from orders group by 1")
def validated_on_base(spark, d):
    own = read(spark, d, "orders").select(F.col("o_custkey").alias("nodeid"), F.col("o_orderkey").alias("round"), F.when(F.col("o_orderstatus") == "F", "passed").otherwise("failed").alias("status"))
    return findings.validated_on_base(own)


@query("select event_id, greatest(1, ceil(2 * value / 1024)) as memory_mb, greatest(1, ceil(3 * value)) as timeout_s from events")
def calibrated(spark, d):
    return findings.calibrated(read(spark, d, "events").select("event_id", F.col("value").alias("rss_kb"), F.col("value").alias("wall_s"))).select(
        "event_id", F.col("memory_mb").cast("double").alias("memory_mb"), F.col("timeout_s").cast("double").alias("timeout_s")
    )


@query("select distinct nodeid from (select o_custkey as nodeid from orders where o_orderstatus = 'F') where nodeid in (select o_custkey from orders where o_orderstatus = 'O')")
def steady_tests(spark, d):
    own = read(spark, d, "orders").select(F.col("o_custkey").alias("nodeid"), "o_orderstatus", F.lit("passed").alias("status"))
    return findings.steady(own.where("o_orderstatus = 'F'"), own.where("o_orderstatus = 'O'")).select("nodeid").distinct()


@query("""
select n.n_nationkey as nodeid, n.n_regionkey as suite, coalesce(case when s_suppkey is not null then 'passed' end, case when n.n_regionkey = 2 then 'timeout' end) as status
from nation n left join (select s_nationkey, min(s_suppkey) as s_suppkey from supplier where s_acctbal > 5000 group by 1) on s_nationkey = n.n_nationkey
""")
def filled_outcomes(spark, d):
    asked = read(spark, d, "nation").select(F.col("n_nationkey").alias("nodeid"), F.col("n_regionkey").alias("suite"))
    seen = read(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nodeid")).distinct()
    reported = asked.join(seen, "nodeid").withColumn("status", F.lit("passed"))
    return findings.filled_outcomes(asked, reported, spark.createDataFrame([(2, "timeout")], "suite INT, outcome STRING"))


@query("""
select p_brand as run_id, array_to_string(list_sort(list(p_name || p_partkey) filter (p_size % 2 = 0)), ',') as verified,
  cast(count(*) filter (p_size % 2 = 1) as integer) as n_skipped, bool_and(p_size % 2 = 0) as complete from part group by 1
""")
def coverage_statement(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("run_id"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("probe"), (F.col("p_size") % 2 == 0).alias("ran"), F.lit("r").alias("reason"))
    return findings.coverage_statement(p).select("run_id", F.array_join("verified", ",").alias("verified"), F.size("skipped").alias("n_skipped"), "complete")


@query("""
select event_id as seq, cast(event_id as bigint) as offset_ms, case when event_type = 'error' then 'stderr: ' || props else props end as text from events
""")
def timeline(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_id").alias("offset_ms"), F.when(F.col("event_type") == "error", "stderr").otherwise("stdout").alias("stream"), F.col("props").alias("text"))
    return findings.timeline(e).select("seq", "offset_ms", "text")


@query("select arg_max(props, event_id) as payload from events where user_id = 7 and event_type = 'click'")
def last_event(spark, d):
    own = read(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("type"), F.col("props").alias("payload"), F.col("event_id").alias("seq"))
    return findings.last_event(own, 7, "click")


# ---- reports and sources ------------------------------------------------------


@query("""
with p as (select p_partkey, p_brand || '.' || split_part(p_type, ' ', 1) || '.' || p_partkey as symbol from part),
m as (select distinct p_brand as module from part union select distinct p_brand || '.' || split_part(p_type, ' ', 1) from part where p_size > 25)
select symbol, arg_max(module, length(module)) as module from p join m on '.' || symbol || '.' like '%.' || module || '.%' group by symbol
""")
def documented_module(spark, d):
    p = read(spark, d, "part")
    kind = F.concat_ws(".", "p_brand", F.split_part("p_type", F.lit(" "), F.lit(1)))
    modules = p.select(F.col("p_brand").alias("module")).union(p.where("p_size > 25").select(kind)).distinct()
    modules = modules.select(F.lit(0).alias("pos"), "module", F.lit("").alias("doc"))
    return lookups.module_for(p.select(F.concat_ws(".", kind, F.col("p_partkey").cast("string")).alias("symbol")), modules).select("symbol", "module")


@query("select l_orderkey as id, l_partkey * 10 + l_linenumber as path, row_number() over (partition by l_orderkey order by l_quantity desc, l_partkey * 10 + l_linenumber) as rank from lineitem")
def most_inserted(spark, d):
    own = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("path"), F.col("l_quantity").alias("additions"))
    return files.most_inserted(own).select("id", "path", F.col("rank").cast("long").alias("rank"))


@query("""
select event_id as id, event_type as model, case when event_id % 4 = 0 then 0 else round(case event_type when 'click' then value * 3 when 'purchase' then value * 15 else 0 end, 6) end as usd from events
""")
def spend_rows(spark, d):
    calls = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("model"), (F.col("value") * 1_000_000).alias("input_tokens"), *(F.lit(0).alias(f"{c}_tokens") for c in ("output", "cache_read", "cache_write")), (F.col("event_id") % 4 == 0).alias("cached"))
    prices = spark.createDataFrame([("click", 3.0, 0.0), ("purchase", 15.0, 0.0)], "model STRING, price_in DOUBLE, price_out DOUBLE")
    return reports.spend_rows(calls, prices).select("id", "model", "usd")


@query("select user_id as subscriber, greatest(count(*) - 40, 0) as dropped from events group by 1")
def offers_dropped(spark, d):
    return events.offered(read(spark, d, "events").select(F.col("user_id").alias("subscriber"), F.col("event_id").alias("seq")), 40)[1]


@query("select p_brand as run_id, count(*) as findings, count(*) filter (p_size > 10) as cited, arg_min(p_name, p_partkey) as first from part group by 1")
def findings_documents(spark, d):
    p = read(spark, d, "part")
    own = p.select(F.col("p_brand").alias("run_id"), F.col("p_partkey").alias("pos"), F.lit("behavior_change").alias("kind"), F.col("p_name").alias("symbol"), F.lit("w").alias("what_changed"), F.lit("h").alias("how_we_know"), F.when(F.col("p_size") > 10, F.struct(F.col("p_size").alias("id"))).alias("norm"), F.col("p_retailprice").alias("confidence"), F.lit(1.0).alias("severity"), F.lit("c4").alias("node"))
    runs = own.select("run_id", F.lit("").alias("profile"), F.lit("").alias("generated_at")).distinct()
    doc = reports.findings_document(own, runs)
    at = lambda path: F.get_json_object("document", path)
    return doc.select("run_id", at("$.counts.findings").cast("long").alias("findings"), at("$.counts.cited").cast("long").alias("cited"), at("$.findings[0].symbol").alias("first"))


@query("select o_custkey as id from orders union select c_custkey from customer")
def all_ids(spark, d):
    return deltas.all_ids(read(spark, d, "orders").select(F.col("o_custkey").alias("id")), read(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id")
