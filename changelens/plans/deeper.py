"""Bindings of citations, commit graphs, places, streams, source trees and diffs over whole tables.

Documents cut into lines are the files that are cited, a customer's orders are a history of commits, events are the
log that is replayed, parts are source files that are generated as text and parsed again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens.functions import parse, text
from changelens.operators import ancestry, charter, graph, grounding, lookups, mining
from changelens.plans.bindings import query, read
from changelens.session import scratch
from changelens.sources import files, metadata
from changelens.streaming import events, replay

# ---- citations and places ---------------------------------------------------


def _cited(spark, d):
    doc = read(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md"))
    text = lambda n: F.col(n).cast("string")
    start = F.col("doc_id") % 5 + 1
    span = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), (start + F.col("doc_id") % 130).cast("string"))
    first = F.substring(F.element_at("l", 1), 1, 12)
    one = lambda kind, ref, quote: F.struct(F.lit(kind).alias("type"), ref.alias("ref"), quote.alias("quote"))
    own = doc.select(
        "doc_id",
        F.posexplode(
            F.array(
                one("code", span, F.lit(None).cast("string")),
                one("code", F.concat(F.lit("base:"), path, F.lit(":1")), first),
                one("code", F.concat(path, F.lit(":2")), F.lit("claim of")),
                one("norm", F.concat(F.lit("n"), text("doc_id")), F.lit(None).cast("string")),
                one("test", F.concat(F.lit("t::"), text("doc_id")), F.lit("kept")),
                one("diff", F.concat(path, F.lit(":7")), F.lit(None).cast("string")),
                one("code", F.concat(path, F.lit(":3")), F.lit("no such words here")),
            )
        ).alias("pos", "c"),
    )
    lines = doc.select("doc_id", path.alias("path"), F.posexplode("l").alias("n", "text"))
    head = lines.select(F.lit("head").alias("side"), "path", (F.col("n") + 1).alias("line"), "text")
    base = lines.where("doc_id % 2 = 0").select(F.lit("base").alias("side"), "path", (F.col("n") + 1).alias("line"), "text")
    claims = doc.where("doc_id % 10 = 0").select(F.concat(path, F.lit(":2")).alias("source"), F.concat(F.lit("a claim  of "), text("doc_id")).alias("text"))
    norms = read(spark, d, "part").select(F.concat(F.lit("n"), (F.col("p_partkey") * 3).cast("string")).alias("id"))
    tests = read(spark, d, "customer").select(F.concat(F.lit("t::"), (F.col("c_custkey") * 2).cast("string")).alias("nodeid"))
    changed = doc.where("doc_id % 3 = 1").select(path.alias("path"))
    return own.select("doc_id", "pos", "c.*"), norms, tests, changed, head.union(base), claims


@query(r"""
with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l, doc_id % 5 + 1 as s, doc_id % 5 + 1 + doc_id % 130 as e from documents),
flat as (select *, trim(regexp_replace(l[1], '\s+', ' ', 'g')) as one, trim(regexp_replace(substr(l[1], 1, 12), '\s+', ' ', 'g')) as quoted from t),
c as (
  select doc_id, 0 as pos, e - s <= 120 and e <= len(l) as resolved, regexp_replace(array_to_string(l[s:e], chr(10)), '^\s+|\s+$', '', 'g') as found, cast(null as varchar) as quote from t
  union all select doc_id, 1, doc_id % 2 = 0 and contains(one, quoted), regexp_replace(l[1], '^\s+|\s+$', '', 'g'), substr(l[1], 1, 12) from flat
  union all select doc_id, 2, case when doc_id % 10 = 0 then true else len(l) >= 2 and contains(trim(regexp_replace(l[2], '\s+', ' ', 'g')), 'claim of') end, null, 'claim of' from t
  union all select doc_id, 3, doc_id in (select p_partkey * 3 from part), null, null from t
  union all select doc_id, 4, doc_id in (select c_custkey * 2 from customer), null, 'kept' from t
  union all select doc_id, 5, doc_id % 3 = 1, null, null from t
  union all select doc_id, 6, len(l) >= 3 and contains(trim(regexp_replace(l[3], '\s+', ' ', 'g')), 'no such words here'), null, 'no such words here' from t)
select doc_id, pos, resolved, case when resolved and coalesce(quote, '') = '' and found is not null then substr(found, 1, 200) else quote end as quote from c
""")
def grounded_citations(spark, d):
    citations, norms, tests, changed, lines, claims = _cited(spark, d)
    return grounding.resolved_citations(citations, norms, tests, changed, lines, claims).select("doc_id", "pos", "resolved", "quote")


_PLACES = """
with s as (select 'r' || (p_size % 5) as repo, 'pkg.f' || (p_partkey % 400) as symbol, min('src/' || p_size || '.py') as file from part group by 1, 2),
o as (
  select l_orderkey * 10 + l_linenumber as id, 'r' || (l_linenumber % 5) as repo, 'pkg.f' || (l_partkey % 400) as symbol, l_partkey as k, l_linenumber as n,
    case l_linenumber when 1 then 't/a.py::test_' || l_partkey || '[x]' when 2 then 'src/' || (l_suppkey % 50) || '.py:' || l_quantity::bigint when 3 then 'dir/x: y' else 'outcome:oom' end as ref from lineitem)
"""


def _places(spark, d):
    p = read(spark, d, "part")
    repo = lambda c: F.concat(F.lit("r"), (F.col(c) % 5).cast("string")).alias("repo")
    name = lambda c: F.concat(F.lit("pkg.f"), (F.col(c) % 400).cast("string"))
    file = F.concat(F.lit("src/"), F.col("p_size").cast("string"), F.lit(".py"))
    symbols = p.select(repo("p_size"), name("p_partkey").alias("fqn"), file.alias("file"), F.col("p_size").alias("line_start"))
    line = F.col("l_linenumber")
    ref = (
        F.when(line == 1, F.concat(F.lit("t/a.py::test_"), F.col("l_partkey").cast("string"), F.lit("[x]")))
        .when(line == 2, F.concat(F.lit("src/"), (F.col("l_suppkey") % 50).cast("string"), F.lit(".py:"), F.col("l_quantity").cast("long").cast("string")))
        .when(line == 3, "dir/x: y")
        .otherwise("outcome:oom")
    )
    own = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + line).alias("id"), repo("l_linenumber"), name("l_partkey").alias("symbol"), ref.alias("evidence_ref"))
    return own, symbols


@query(_PLACES + """
select id, case n when 1 then 't/a.py' when 2 then regexp_extract(ref, '^[^:]+') when 3 then 'dir/x' else coalesce(file, '(repo)') end as path from o left join s using (repo, symbol)
""")
def observation_paths(spark, d):
    return grounding.observation_path(*_places(spark, d)).select("id", "path")


@query(_PLACES + """,
a as (select o.*, case n when 1 then 't/a.py' when 2 then regexp_extract(ref, '^[^:]+') when 3 then 'dir/x' else coalesce(file, '(repo)') end as path from o left join s using (repo, symbol)),
g as (select 'r' || (p_size % 5) as repo, 'pkg.f' || (p_partkey % 400) as symbol, 'src/' || p_size || '.py' as path, min(p_size) as start from part group by all)
select id, cast(case when n = 2 then cast(regexp_extract(ref, '[0-9]+$') as integer) when n = 1 and k % 7 = 0 then k * 2 + 1 else g.start end as integer) as line from a left join g using (repo, symbol, path)
""")
def observation_lines(spark, d):
    own, symbols = _places(spark, d)
    p = read(spark, d, "part").where("p_partkey % 7 = 0").select(F.explode(F.array(*(F.lit(f"r{i}") for i in range(5)))).alias("repo"), "p_partkey")
    name = F.concat(F.lit("test_"), F.col("p_partkey").cast("string"))
    text = lambda f: F.concat(F.lit(f), name, F.lit("(self):"))
    first = p.select("repo", F.lit("t/a.py").alias("path"), (F.col("p_partkey") * 2 + 1).alias("line"), text("    async def ").alias("text"))
    again = p.select("repo", F.lit("t/a.py").alias("path"), (F.col("p_partkey") * 2 + 2).alias("line"), text("def ").alias("text"))
    return grounding.observation_line(grounding.observation_path(own, symbols), first.union(again), symbols).select("id", F.col("line").cast("int").alias("line"))


@query("""
with f as (select s_suppkey as k, 'm' || (s_nationkey % 5) || '/n' || s_nationkey as dir, s_suppkey % 9 as a, s_suppkey % 4 as b from supplier),
n as (select p_partkey as id, 'm' || (p_size % 5) || '/n' || (p_size % 25) as dir, p_size % 3 as deep, p_partkey % 2000 as at, p_size % 9 as w from part),
s as (
  select f.k, n.id, case when n.deep = 0 and n.dir = f.dir and n.at = f.k then 2.0 when n.dir = f.dir then 1.0 else 0.0 end
    + case when n.w = f.a or n.w = f.b then 0.25 else 0.0 end as score from f join n on n.dir = f.dir or n.w = f.a or n.w = f.b),
r as (select *, row_number() over (partition by k order by score desc, lpad(id::varchar, 9, '0')) as rank from s)
select k, lpad(id::varchar, 9, '0') as id, cast(score as double) as score, cast(rank as integer) as rank from r where rank <= 3
""")
def norms_of_files(spark, d):
    word = lambda c: F.concat(F.lit("w"), c.cast("string"))
    folder = lambda a, b: F.concat(F.lit("m"), a.cast("string"), F.lit("/n"), b.cast("string"), F.lit("/"))
    s = read(spark, d, "supplier").select((F.col("s_suppkey") % 9).alias("a"), (F.col("s_suppkey") % 4).alias("b"), "s_suppkey", "s_nationkey")
    path = F.concat(folder(F.col("s_nationkey") % 5, F.col("s_nationkey")), F.col("s_suppkey").cast("string"))
    own = s.select(path.alias("path"), F.array(word(F.col("a")), word(F.col("b"))).alias("tokens"))
    p = read(spark, d, "part").withColumn("at", F.col("p_partkey") % 2000)
    deep = F.when(F.col("p_size") % 3 == 0, "").otherwise("x/y/")
    place = F.concat(folder(F.col("p_size") % 5, F.col("p_size") % 25), deep, F.col("at").cast("string"))
    norms = p.select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), F.array(place).alias("places"), F.array(word(F.col("p_size") % 9)).alias("tokens"))
    out = grounding.related_norms(own, norms)
    return out.select(F.substring_index("path", "/", -1).cast("long").alias("k"), "id", "score", "rank")


@query("""
with f as (select p_partkey as k, 'pkg' || (p_partkey % 40) || '/f' || p_partkey || '.py' as file, 2 + p_partkey % 5 as s, p_size + 7 as e from part where p_size % 6 <> 0),
c as (select l_partkey as k, list(distinct l_linenumber) as lines from lineitem group by 1)
select f.k as fqn, e as line_end from f join c using (k) where e > s and len([x for x in c.lines if x > s and x <= e]) = 0
""")
def coverage_gaps(spark, d):
    file = F.concat(F.lit("pkg"), (F.col("p_partkey") % 40).cast("string"), F.lit("/f"), F.col("p_partkey").cast("string"), F.lit(".py"))
    p = read(spark, d, "part").withColumn("file", file)
    symbols = p.select(F.col("p_partkey").alias("fqn"), "file", (F.lit(2) + F.col("p_partkey") % 5).alias("line_start"), (F.col("p_size") + 7).alias("line_end"))
    ran = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set("l_linenumber").alias("lines"))  # seven line numbers at most
    measured = p.where("p_size % 6 <> 0").join(ran, "p_partkey").select(F.concat(F.lit("/work/run/"), F.col("file")).alias("path"), F.col("p_partkey").alias("pos"), "lines")
    return lookups.coverage_gaps(symbols, lookups.lines_for(symbols, measured)).select("fqn", F.col("line_end").cast("int").alias("line_end"))


# ---- commit and call graphs -------------------------------------------------

_HISTORY = """
with recursive o as (select o_custkey as k, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderkey) as i from orders),
e as (
  select a.k, a.id as commit, b.id as parent from o a join o b on a.k = b.k and b.i = a.i - case when a.i % 3 = 1 then 2 else 1 end
  union select a.k, a.id, b.id from o a join o b on a.k = b.k and a.i % 4 = 0 and b.i = a.i - 3),
p as (select k, max(id) as head, max(case when i % 2 = 0 then id end) as base from o group by k having max(case when i % 2 = 0 then id end) is not null),
d as (select id as commit, 0 as g from o union select e.commit, d.g + 1 from d join e on e.parent = d.commit),
g as (select commit, max(g) as g from d group by 1),
"""


@query(_HISTORY + """
u as (select k, 'h' as side, head as commit from p union select k, 'b', base from p union select u.k, u.side, e.parent from u join e on e.commit = u.commit),
b as (select a.k, a.commit, g.g from u a join u b on a.k = b.k and a.commit = b.commit and a.side = 'h' and b.side = 'b' join g on g.commit = a.commit)
select p.base, p.head, (select arg_min(b.commit, (-b.g, b.commit)) from b where b.k = p.k) as commit from p
""")
def merge_bases(spark, d):
    from pyspark.sql.window import Window

    o = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))
    o = o.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    back = lambda n: F.lag("id", n).over(Window.partitionBy("k").orderBy("i"))
    up = o.select("id", F.when(F.col("i") % 3 == 1, back(2)).otherwise(back(1)).alias("a"), F.when(F.col("i") % 4 == 0, back(3)).alias("b"))
    parents = up.select(F.col("id").alias("commit"), F.explode(F.array("a", "b")).alias("parent"))
    pairs = o.groupBy("k").agg(F.max(F.when(F.col("i") % 2 == 0, F.col("id"))).alias("base"), F.max("id").alias("head")).where("base is not null")
    return ancestry.merge_bases(parents, pairs.select("base", "head"))


@query("""
with recursive e as (
  select distinct 'c' || o_custkey as caller, 's' || l_suppkey as callee from lineitem join orders on l_orderkey = o_orderkey where l_linenumber >= 6
  union select 'n' || c_nationkey, 'c' || c_custkey from customer union select 'r' || n_regionkey, 'n' || n_nationkey from nation),
t as (select 's' || s_suppkey as seed, 's' || s_suppkey as node, 0 as hop from supplier union select t.seed, e.caller, t.hop + 1 from t join e on e.callee = t.node where t.hop < 3)
select seed, node, min(hop) as hop from t group by 1, 2
""")
def reach_of_suppliers(spark, d):
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    own = read(spark, d, "lineitem").where("l_linenumber >= 6").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = own.select(name("c", "o_custkey").alias("caller"), name("s", "l_suppkey").alias("callee"))
    edges = edges.union(read(spark, d, "customer").select(name("n", "c_nationkey"), name("c", "c_custkey")))
    edges = edges.union(read(spark, d, "nation").select(name("r", "n_regionkey"), name("n", "n_nationkey")))
    return ancestry.reach_of_each(edges, read(spark, d, "supplier").select(name("s", "s_suppkey").alias("seed")), 3)


def _sources(spark, d):
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit("from top.m"), size, F.lit(" import f"), size, F.lit(" as g\n\nclass K"), k, F.lit(":\n    def m(self, a, *, b=1):\n        return g(a)\n\ndef f"), k, F.lit("(x):\n    return K"), k, F.lit("().m(x)\n"),
    )
    path = F.concat(F.lit("m"), k, F.lit(".py"))
    return read(spark, d, "part").select(F.lit("r").alias("repo"), path.alias("path"), text.alias("content"), F.lit("top").alias("root"))


@query("""
select 'top.m' || p_partkey || '.K' || p_partkey as fqn, 'class' as kind, 3 as line_start, 5 as line_end from part
union all select 'top.m' || p_partkey || '.K' || p_partkey || '.m', 'method', 4, 5 from part
union all select 'top.m' || p_partkey || '.f' || p_partkey, 'function', 7, 8 from part
""")
def source_symbols(spark, d):
    return graph.python_symbols(_sources(spark, d)).select("fqn", "kind", F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"))


@query("select 'top.m' || p_partkey || '.K' || p_partkey || '.m' as caller, 'top.m' || p_size || '.f' || p_size as callee from part where p_size in (select p_partkey from part)")
def source_calls(spark, d):
    own = _sources(spark, d)
    return graph.call_edges(graph.python_calls(own), graph.python_imports(own), graph.python_symbols(own), most=1).select("caller", "callee")


# ---- source trees, diffs and self-descriptions ------------------------------


@query(r"""
with f as (
  select case when doc_id % 4 = 2 then 'src/tests/d' else 'src/d' end || doc_id || case doc_id % 4 when 0 then '.py' when 1 then '.go' when 2 then '.go' else '.bin' end as path, doc_id % 4 as k, coalesce(text, '') as t, strlen(coalesce(text, '')) as b from documents)
select path, case when k = 0 then 'Python' else 'Go' end as language, cast(length(t) - length(replace(t, chr(10), '')) + case when t = '' or t like '%' || chr(10) then 0 else 1 end as integer) as loc,
  k = 2 as is_test, b as bytes from f where k <> 3 and b <= 4194304
""")
def inventory_of_documents(spark, d):
    kind = F.element_at(F.array(*map(F.lit, (".py", ".go", ".go", ".bin"))), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    own = read(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 4 == 2, "src/tests/d").otherwise("src/d"), F.col("doc_id").cast("string"), kind).alias("path"), F.octet_length(text).cast("long").alias("bytes"), text.alias("content"))
    return files.inventory(own, most_files=2**31 - 1)


@query("""
select o_custkey as id, 'p' || o_orderkey as path, o_orderkey % 90 + 1 as start_line, cast(o_orderkey % 90 + 1 + greatest(o_orderkey % 4, 1) - 1 as integer) as end_line from orders where o_orderkey % 7 <> 0
""")
def hunks_of_diffs(spark, d):
    key = F.col("o_orderkey")
    target = F.when(key % 7 == 0, "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/p"), key.cast("string")))
    at = F.concat((key % 90 + 1).cast("string"), F.lit(","), (key % 4).cast("string"))
    part = F.concat(target, F.lit("\n@@ -1,3 +"), at, F.lit(" @@ def f\n+x\n-y"))
    own = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(part)), "\n").alias("text"))
    return files.hunks(own).select("id", "path", F.col("start_line").cast("long").alias("start_line"), "end_line")


@query("select o_custkey as id, cast(sum(o_orderkey % 40) as bigint) as additions, cast(sum(case when o_orderkey % 5 = 0 then 0 else o_orderkey % 11 end) as bigint) as deletions, count(*) as changed_files from orders group by 1")
def diff_totals(spark, d):
    key = F.col("o_orderkey")
    removed = F.when(key % 5 == 0, "-").otherwise((key % 11).cast("string"))
    line = F.concat_ws("\t", (key % 40).cast("string"), removed, key.cast("string"))
    return files.diff_totals(files.numstat(read(spark, d, "orders").select(F.col("o_custkey").alias("id"), line.alias("line"))))


@query("select o_orderpriority as repo, 'c' || o_orderkey as commit, 'a' || o_custkey as author, 'f' || (o_orderkey % 500) || '.py' as path from orders")
def history_of_logs(spark, d):
    key = F.col("o_orderkey")
    head = F.concat(F.lit("\x01c"), key.cast("string"), F.lit("\x1fa"), F.col("o_custkey").cast("string"))
    line = F.array(head, F.lit(""), F.concat(F.lit("f"), (key % 500).cast("string"), F.lit(".py")))
    own = read(spark, d, "orders").select(F.col("o_orderpriority").alias("repo"), "o_orderkey", F.posexplode(line).alias("n", "line"))
    return files.history(own.select("repo", (F.col("o_orderkey") * 3 + F.col("n")).alias("line_no"), "line"), most_commits=2**31 - 1)


@query("""
select p_partkey as k, 2 as pos, false as is_bullet, p_type || ' ' || p_brand as text from part
union all select p_partkey, 6, true, p_name || ' deep ' || p_size from part
union all select p_partkey, 8, true, 'second' from part
union all select p_partkey, 13, false, 'after' from part where p_size % 2 = 0
""")
def blocks_of_texts(spark, d):
    p = read(spark, d, "part")
    size = F.col("p_size").cast("string")
    code = F.lit("```\n- not\nthis\n```\n")
    text = F.concat(
        F.lit("# "), F.col("p_name"), F.lit("\n\n"), F.col("p_type"), F.lit("\n    code\n  "), F.col("p_brand"), F.lit("\n\n- "), F.col("p_name"), F.lit("\n  deep "), size, F.lit("\n1. second\n"), code,
        F.when(F.col("p_size") % 2 == 0, "after").otherwise("| no |"),
    )
    return charter.blocks(p.select(F.col("p_partkey").alias("k"), text.alias("text")), "k")


@query("""
with t as (select p_partkey as k, 'It is made for ' || p_type || ' of the size ' || p_size || '.' as a, 'Counts ' || p_name || ' for you' as b, 'Never sells ' || p_brand || ' abroad' as c from part)
select k as owner, 'purpose' as kind, a as text, 'README.md:3' as source from t
union all select k, 'capability', b, 'README.md:6' from t
union all select k, 'constraint', 'Not a goal: ' || c, 'README.md:9' from t
""")
def claims_of_readmes(spark, d):
    size = F.col("p_size").cast("string")
    text = F.concat(
        F.lit("# Title\n\nIt is made for "), F.col("p_type"), F.lit(" of the size "), size, F.lit(".\n\n## Features\n- Counts "), F.col("p_name"), F.lit(" for you\n\n## Non-goals\nNever sells "), F.col("p_brand"), F.lit(" abroad\n"),
    )
    own = read(spark, d, "part").select(F.col("p_partkey").alias("k"), text.alias("text"))
    return charter.readme_claims(own, "k").select("owner", "kind", "text", "source")


# ---- streams ----------------------------------------------------------------


def _log(spark, d):
    own = read(spark, d, "events")
    return own.select(
        F.col("event_id").cast("long").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"),
        F.concat(F.lit("run"), (F.col("user_id") % 7).cast("string")).alias("run_id"), F.col("event_type").alias("repo"), F.lit("t").alias("type"), F.lit("{}").alias("payload"),
    )


@query("select event_id as seq, 'run' || (user_id % 7) as run_id, event_type as repo from events where event_id > 100")
def replayed_once(spark, d):
    """The log lands in four parts that overlap; the stream takes one batch, is started again and takes the rest."""
    log, place = _log(spark, d), scratch(spark, "log")
    for part in range(4):
        log.where((F.col("seq") % 4 == part) | (F.col("seq") % 9 == part)).write.mode("append").parquet(f"{place}/in")
    open_ = lambda: replay.after(spark.readStream.schema(events.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{place}/in"), 100)
    replay.fan_out(open_(), f"{place}/out", f"{place}/state", ["repo", "run_id"], once_only=True)
    replay.fan_out(open_(), f"{place}/out", f"{place}/state", ["repo", "run_id"])
    return replay.delivered(spark, f"{place}/out", events.EVENTS).select("seq", "run_id", "repo")


@query("""
select distinct 'n' || substr(sha256(concat(user_id, chr(0), event_type, chr(0), cast(ts::date as varchar))), 1, 20) as id, event_type = 'error' as deliver
from events where event_type in ('error', 'purchase')
  and (user_id, event_type, ts::date) not in (select user_id, event_type, ts::date from events where event_id % 10 = 0 and event_type in ('error', 'purchase'))
""")
def raised_once(spark, d):
    """A tenth of the events was told of before; the rest lands in two parts, the second with the first in it."""
    own = read(spark, d, "events")
    level = F.when(F.col("event_type") == "error", "major").when(F.col("event_type") == "purchase", "notable").otherwise("minor")
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    signals = own.select("event_id", F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("kind"), day.alias("sha"), level.alias("level"))
    place = scratch(spark, "signals")
    before = events.raised(signals.where("event_id % 10 = 0"))
    before.select("id").write.parquet(f"{place}/stored")
    stored = spark.read.schema("id STRING").parquet(f"{place}/stored")
    for part in ("event_id % 2 = 0", "true"):
        signals.where(part).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(signals.schema).parquet(f"{place}/in")
        events.run_available(events.raised(stream, stored, "major"), f"{place}/out", f"{place}/state")
    return spark.read.schema("id STRING, deliver BOOLEAN").parquet(f"{place}/out")


@query("""
with c as (select c_custkey as repo, c_custkey as n from customer)
select repo, 'toolchain' as kind, 'major' as level from c where n % 3 = 0
union all select repo, 'license', 'major' from c where n % 4 = 0
union all select repo, 'version', case n % 5 when 0 then 'major' when 1 then 'minor' else 'notable' end from c where n % 5 < 3
union all select repo, 'entry_points', 'major' from c where n % 2 = 0
union all select repo, 'entry_points', 'notable' from c where n % 7 = 0
union all select repo, 'purpose', case n % 6 when 0 then 'notable' else 'major' end from c where n % 6 < 2
union all select repo, 'public_api_removed', case when n % 4 >= 2 then 'major' else 'notable' end from c where n % 4 > 0
union all select repo, 'public_api_added', case when n % 6 >= 3 then 'notable' else 'minor' end from c where n % 6 > 0
union all select repo, 'modules_removed', case when n % 4 >= 3 then 'major' else 'notable' end from c where n % 4 > 0
union all select repo, 'modules_added', case when n % 5 >= 3 then 'notable' else 'minor' end from c where n % 5 > 0
union all select repo, 'dependencies_removed', 'notable' from c where n % 8 = 0
union all select repo, 'dependencies_added', case when n % 5 >= 3 then 'notable' else 'minor' end from c where n % 5 > 0
union all select repo, 'standards', 'minor' from c where n % 9 = 0
union all select repo, 'non_goals', 'notable' from c where n % 10 = 0
union all select repo, 'non_goals', 'minor' from c where n % 11 = 0
union all select repo, 'constraints', 'notable' from c where n % 12 = 0
union all select repo, 'constraints', 'minor' from c where n % 13 = 0
""")
def drift_of_all_kinds(spark, d):
    """Each customer is a repository whose description departs in every way that there is, by its key."""
    n = F.col("c_custkey")
    c = read(spark, d, "customer")

    def some(name, least, count, extra=None):
        """name least, ..., as many as count says."""
        own = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit(name), (i + least).cast("string")))
        own = F.filter(own, lambda x, i: i < count)
        return own if extra is None else F.concat(own, extra)

    module = lambda names: F.transform(names, lambda m: F.struct(m.alias("module"), F.lit("d").alias("doc"), F.lit("s").alias("source")))
    said = lambda when, text: F.when(when, F.array(F.struct(F.lit("constraint").alias("kind"), F.lit(text).alias("text"), F.lit("s").alias("source")))).otherwise(F.array())
    always, none = F.lit(True), F.array().cast("array<string>")
    version = F.element_at(F.array(*map(F.lit, ("2.0.0", "1.3.0", "1.1.0", "1.2.0", "1.2.0"))), (n % 5 + 1).cast("int"))
    before = c.select(
        n.alias("repo"), F.lit("a").alias("sha"), F.lit("python").alias("toolchain"), F.lit("MIT").alias("license"), F.lit("1.2.0").alias("version"),
        F.array(F.lit("a = m:f"), F.lit("b = m:g")).alias("entry_points"), some("api", 0, F.lit(10)).alias("public_api"), F.lit("aaaa").alias("summary"),
        F.concat(said(always, "Not a goal: x"), said(always, "rule a")).alias("claims"), module(some("m", 0, F.lit(4))).alias("modules"),
        F.array(F.lit("x"), F.lit("y")).alias("dependencies"), F.array(F.lit("ruff")).alias("standards"),
    )
    points = F.concat(F.array(F.lit("a = m:f")), F.when(n % 2 != 0, F.array(F.lit("b = m:g"))).otherwise(none), F.when(n % 7 == 0, F.array(F.lit("c = m:h"))).otherwise(none))
    after = c.select(
        n.alias("repo"), F.lit("b").alias("sha"), F.when(n % 3 == 0, "node").otherwise("python").alias("toolchain"),
        F.when(n % 4 == 0, "BSD").when(n % 4 == 1, "").otherwise("MIT").alias("license"), version.alias("version"), points.alias("entry_points"),
        some("api", 0, 10 - n % 4, some("new", 0, n % 6)).alias("public_api"), F.when(n % 6 == 0, "").when(n % 6 == 1, "zzzz").otherwise("aaaa").alias("summary"),
        F.concat(said(n % 10 != 0, "Not a goal: x"), said(n % 11 == 0, "Not a goal: y"), said(n % 12 != 0, "rule a"), said(n % 13 == 0, "rule b")).alias("claims"),
        module(some("m", 0, 4 - n % 4, some("new", 0, n % 5))).alias("modules"),
        F.concat(F.array(F.lit("x")), F.when(n % 8 != 0, F.array(F.lit("y"))).otherwise(none), some("dep", 0, n % 5)).alias("dependencies"),
        F.when(n % 9 == 0, F.array(F.lit("ruff"), F.lit("mypy"))).otherwise(F.array(F.lit("ruff"))).alias("standards"),
    )
    return charter.drift(before, after).select("repo", "kind", "level")


@query(f"""
with t as (select conv_id, turn, [case when length(w) > 4 then regexp_replace(w, '(ing|ed|es|s)$', '') else w end
    for w in regexp_extract_all(lower(regexp_replace(text, '`[^`]*`', ' ', 'g')), '[a-z][a-z0-9_]+') if w not in ({', '.join(f"'{w}'" for w in text.STOP_WORDS)})] as s from conversations),
e as (select conv_id * 1000 + turn as id, unnest(list_concat(s, [s[i] || ' ' || s[i + 1] for i in range(1, len(s))])) as term from t),
tf as (select id, term, count(*) as tf from e group by 1, 2), df as (select term, count(*) as df from tf group by 1)
select id, term, round((1 + ln(tf)) * (ln((1 + (select count(*) from conversations)) / (1 + df)) + 1), 6) as weight from tf join df using (term)
""")
def terms_of_turns(spark, d):
    own = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return mining.tfidf(own, key="id").withColumn("weight", F.round("weight", 6))


# ---- outputs of tools -------------------------------------------------------


@query("""
select p_partkey as id, 't.py::a' || p_partkey as nodeid, 'passed' as status from part where p_partkey % 3 = 0
union all select p_partkey, 't.py::b', case when p_size % 2 = 0 then 'failed' else 'error' end from part where p_partkey % 3 = 0
union all select p_partkey, 'pkg::T' || p_size, 'failed' from part where p_partkey % 3 = 1
union all select p_partkey, 'f' || p_size || '.js::suite > does', 'skipped' from part where p_partkey % 3 = 2
""")
def parsed_tests(spark, d):
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    status = F.when(F.col("p_size") % 2 == 0, "failed").otherwise("error")
    pytest = F.concat(F.lit('collected {2} items\n{"x": 1} {"tests": [{"nodeid": "t.py::a'), k, F.lit('", "outcome": "passed"}, {"nodeid": "t.py::b", "outcome": "'), status, F.lit('"}]}\ndone'))
    go = F.concat(F.lit('{"Action":"run","Package":"pkg","Test":"T'), size, F.lit('"}\nno json\n{"Action":"pass","Package":"pkg"}\n{"Action":"fail","Package":"pkg","Test":"T'), size, F.lit('"}'))
    jest = F.concat(F.lit('> run\n{"testResults":[{"name":"f'), size, F.lit('.js","assertionResults":[{"ancestorTitles":["suite"],"title":"does","status":"pending"}]}]}'))
    turn = F.col("p_partkey") % 3
    own = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(turn == 0, "pytest").when(turn == 1, "go").otherwise("jest").alias("parser"), F.when(turn == 0, pytest).when(turn == 1, go).otherwise(jest).alias("raw"))
    return parse.parsed(own, "test")


@query("""
select p_partkey as id, 'a' || p_size || '.py' as path, 'E' || p_size as code, p_name as message from part where p_partkey % 5 = 0
union all select p_partkey, 'b.js', case when p_size % 2 = 0 then 'rule-' || p_size else 'eslint' end, 'said' from part where p_partkey % 5 = 1
union all select p_partkey, 'c' || p_size || '.ts', 'TS' || (1000 + p_size), 'wrong type' from part where p_partkey % 5 = 2
union all select p_partkey, 'd.py', case when p_size % 2 = 0 then 'arg-type' else 'error' end, 'bad' from part where p_partkey % 5 = 3
union all select p_partkey, 'e.go', 'vet', 'unreachable [code]' from part where p_partkey % 5 = 4
""")
def parsed_lints(spark, d):
    size, even = F.col("p_size").cast("string"), F.col("p_size") % 2 == 0
    raws = (
        ("ruff", F.concat(F.lit('[{"filename": "a'), size, F.lit('.py", "code": "E'), size, F.lit('", "message": "'), F.col("p_name"), F.lit('"}]'))),
        ("eslint", F.concat(F.lit('[{"filePath": "b.js", "messages": [{"ruleId": '), F.when(even, F.concat(F.lit('"rule-'), size, F.lit('"'))).otherwise("null"), F.lit(', "message": "said"}]}, {"filePath": "z.js"}]'))),
        ("tsc", F.concat(F.lit("Starting\nc"), size, F.lit(".ts(3,14): error TS"), (F.col("p_size") + 1000).cast("string"), F.lit(": wrong type\n"))),
        ("mypy", F.concat(F.lit("d.py:7:1: error: bad"), F.when(even, "  [arg-type]").otherwise(""), F.lit("\nd.py:8: note: see\nFound 1 error"))),
        ("vet", F.lit("# pkg\ne.go:3:4: unreachable [code]\n")),
    )
    turn = F.col("p_partkey") % 5
    pick = lambda i: F.element_at(F.array(*(F.lit(r[i]) if isinstance(r[i], str) else r[i] for r in raws)), (turn + 1).cast("int"))
    return parse.parsed(read(spark, d, "part").select(F.col("p_partkey").alias("id"), pick(0).alias("parser"), pick(1).alias("raw")), "lint")


@query("""
select p_partkey as id, case p_partkey % 6 when 0 then '>=' || v || ',<' || (p_size + 1) when 1 then '>=' || v || ',<' || p_size || '.3' when 2 then '==' || v when 3 then '>=' || v || ',<99' when 4 then '' else '==' || v || '.1' end as specifier
from (select *, p_size || '.2' as v from part)
""")
def specifiers(spark, d):
    v = F.concat(F.col("p_size").cast("string"), F.lit(".2"))
    forms = (F.concat(F.lit("^"), v), F.concat(F.lit("~"), v, F.lit("")), v, F.concat(F.lit(" >="), v, F.lit(", <99")), F.lit("*"), F.concat(F.lit("= "), v, F.lit(".1")))
    spec = F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), parse.specifier(spec).alias("specifier"))


@query("""
select o_orderkey as id, 'test_' || o_custkey as name, 'E  ' || o_orderstatus || chr(10) || 'f.py:' || (o_orderkey % 50) as text from orders
union all select o_orderkey, 'T.second', 'boom' from orders where o_orderkey % 3 = 0
""")
def failures_of_logs(spark, d):
    key = F.col("o_orderkey")
    second = F.when(key % 3 == 0, "\n_____ T.second _____\nboom").otherwise("")
    text = F.concat(F.lit("=== FAILURES ===\n______ test_"), F.col("o_custkey").cast("string"), F.lit(" ______\nE  "), F.col("o_orderstatus"), F.lit("\nf.py:"), (key % 50).cast("string"), second, F.lit("\n==== short summary ====\nFAILED x"))
    return parse.failure_blocks(read(spark, d, "orders").select(key.alias("id"), text.alias("text")), "id").select("id", "name", "text")


@query("""
select event_id, '{"a":' || event_id || ',"b":["' || event_type || '"]}' as answer from events where event_id % 4 <> 3 union all select event_id, null from events where event_id % 4 = 3
""")
def answers_in_text(spark, d):
    own = F.concat(F.lit('{"b": ["'), F.col("event_type"), F.lit('"], "a": '), F.col("event_id").cast("string"), F.lit("}"))
    turn = F.col("event_id") % 4
    text = F.when(turn == 0, own).when(turn == 1, F.concat(F.lit("So {that} is\n```json\n"), own, F.lit("\n```\n{}"))).when(turn == 2, F.concat(F.lit("[1] { no } "), own, F.lit(" {")))
    return read(spark, d, "events").select("event_id", parse.first_json(F.coalesce(text, F.lit("nothing {here"))).alias("answer"))


# ---- more streams -----------------------------------------------------------


def _landed(spark, own, parts, name, step):
    """Where the output of step(stream) is: own lands in as many appended parts as there are conditions, and after each
    the stream takes up its state again and reads the part as one batch."""
    place = scratch(spark, name)
    for part in parts:
        own.where(part).write.mode("append").parquet(f"{place}/in")
        events.run_available(step(spark.readStream.schema(own.schema).parquet(f"{place}/in")), f"{place}/out", f"{place}/state")
    return f"{place}/out"


@query("""
select o_orderpriority as repo, cast(o_custkey as integer) as number, o_orderstatus as head_sha, before as previous from (
  select *, lag(o_orderstatus) over (partition by o_orderpriority, o_custkey order by o_orderkey) as before from orders)
where before is null or before <> o_orderstatus
""")
def heads_that_moved(spark, d):
    """Polls land in three parts, so the last head of each pull is carried from batch to batch."""
    own = read(spark, d, "orders").select(
        F.col("o_orderpriority").alias("repo"), F.col("o_custkey").cast("int").alias("number"), F.col("o_orderstatus").alias("head_sha"), F.col("o_orderkey").cast("double").alias("seen_at"),
    )
    low, high = (own.agg(F.expr(f"percentile_approx(seen_at, {p})")).first()[0] for p in (0.3, 0.7))
    parts = (F.col("seen_at") <= low, (F.col("seen_at") > low) & (F.col("seen_at") <= high), F.col("seen_at") > high)
    place = _landed(spark, own, parts, "polls", events.moved_heads)
    return spark.read.schema("repo STRING, number INT, head_sha STRING, previous STRING").parquet(place)


@query("""
with recursive s as (
  select cast(o_custkey as varchar) as run_id, o_orderkey as seq, case o_orderstatus when 'F' then 'done' when 'O' then 'queued' else 'base_run' end as state,
    case o_orderstatus when 'F' then 8 when 'O' then 0 else 3 end as place, row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
r as (
  select run_id, n, seq, cast(null as varchar) as prior, state, true as legal, state as now, place as at_place from s where n = 1
  union all
  select s.run_id, s.n, s.seq, r.now, s.state, r.now <> 'done' and s.place > r.at_place,
    case when r.now <> 'done' and s.place > r.at_place then s.state else r.now end, case when r.now <> 'done' and s.place > r.at_place then s.place else r.at_place end
  from r join s on s.run_id = r.run_id and s.n = r.n + 1)
select run_id, seq, prior, state, legal from r
""")
def states_of_runs(spark, d):
    own = read(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderkey").cast("long").alias("seq"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("base_run").alias("state"),
    )
    middle = own.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    place = _landed(spark, own, (F.col("seq") <= middle, F.col("seq") > middle), "steps", events.run_states)
    return spark.read.schema("run_id STRING, seq LONG, prior STRING, state STRING, legal BOOLEAN").parquet(place)


@query("""
select date_trunc('day', ts) as start, event_type, count(*) as n from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 hour from events) group by 1, 2
""")
def windows_that_closed(spark, d):
    own = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    middle = own.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    place = _landed(spark, own, (F.col("ts") <= F.lit(middle), F.col("ts") > F.lit(middle)), "windows", lambda s: events.tumbling(s, "1 day", ["event_type"]))
    out = spark.read.schema("start TIMESTAMP, end TIMESTAMP, event_type STRING, n LONG").parquet(place)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# ---- manifests and trees ----------------------------------------------------


@query("""
with p as (select 'r' || p_partkey as repo, p_partkey as k, p_size as s, p_name as n from part)
select repo, 'name' as field, 'n' || k as text, 'pyproject.toml:2' as source from p where k % 2 = 0
union all select repo, 'version', '1.' || s, 'pyproject.toml:3' from p where k % 2 = 0
union all select repo, 'summary', n, 'pyproject.toml:4' from p where k % 2 = 0
union all select repo, 'target', 'Python >=3.' || (s % 10), 'pyproject.toml:5' from p where k % 2 = 0
union all select repo, 'dependency', 'req-' || s, 'pyproject.toml:1' from p where k % 2 = 0
union all select repo, 'entry_point', 'run' || s || ' = a:b', 'pyproject.toml:1' from p where k % 2 = 0
union all select repo, 'capability', 'Command `run' || s || '` runs a:b', 'pyproject.toml:8' from p where k % 2 = 0
union all select repo, 'name', 'n' || k, 'package.json:2' from p where k % 2 = 1
union all select repo, 'license', 'L' || s, 'package.json:3' from p where k % 2 = 1
union all select repo, 'target', 'node >' || s, 'package.json:4' from p where k % 2 = 1
union all select repo, 'dependency', 'dep' || s, 'package.json:1' from p where k % 2 = 1
""")
def facts_of_manifests(spark, d):
    p, k, s = read(spark, d, "part"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    toml = F.concat(
        F.lit('[project]\nname = "n'), k, F.lit('"\nversion = "1.'), s, F.lit('"\ndescription = "'), F.col("p_name"), F.lit('"\nrequires-python = ">=3.'), (F.col("p_size") % 10).cast("string"),
        F.lit('"\ndependencies = ["Req_'), s, F.lit('>=1"]\n[project.scripts]\nrun'), s, F.lit(' = "a:b"\n'),
    )
    node = F.concat(F.lit('{\n"name": "n'), k, F.lit('",\n"license": "L'), s, F.lit('",\n"engines": {"node": ">'), s, F.lit('"},\n"dependencies": {"Dep'), s, F.lit('": "1"}}'))
    even = F.col("p_partkey") % 2 == 0
    own = p.select(F.concat(F.lit("r"), k).alias("repo"), F.when(even, "pyproject.toml").otherwise("package.json").alias("path"), F.when(even, toml).otherwise(node).alias("content"))
    return metadata.facts(own).select("repo", "field", "text", "source")


@query("""
select 'r' || p_partkey as repo, 'pytest>=' || p_size || ',<' || (p_size + 1) || case when p_partkey % 2 = 0 then '; ' else '' end || case when p_partkey % 2 = 0 then 'x[e]==' || p_size || ' ; (python_full_version >= ''3.8'')' else '' end as lines from part
""")
def requirements_of_manifests(spark, d):
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    group = F.when(F.col("p_partkey") % 2 == 0, "[tool.poetry.group.test.dependencies]\n").otherwise("[tool.poetry.dev-dependencies]\n")
    extra = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('x = {version = "'), s, F.lit('", extras = ["e"], python = ">=3.8"}\n'))).otherwise('y = {path = "."}\n')
    text = F.concat(group, F.lit('python = "^3.8"\npytest = "^'), s, F.lit('"\n'), extra)
    own = read(spark, d, "part").select(F.concat(F.lit("r"), k).alias("repo"), F.lit("pyproject.toml").alias("path"), text.alias("content"))
    return metadata.dev_requirements(own).select("repo", F.array_join("requirements", "; ").alias("lines"))


@query("""
with f as (select o_custkey as repo, case o_orderkey % 5 when 0 then 'ruff' when 1 then 'mypy' when 2 then 'ci' when 3 then 'eslint' end as s from orders)
select repo, string_agg(distinct s, ',' order by s) as standards from f where s is not null group by 1
""")
def standards_of_trees(spark, d):
    path = F.element_at(F.array(*map(F.lit, (".ruff.toml", "mypy.ini", ".github/workflows/a.yml", "eslint.config.js", "src/ruff.toml"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    own = charter.standards(read(spark, d, "orders").select(F.col("o_custkey").alias("repo"), path.alias("path")))
    return own.select("repo", F.array_join("standards", ",").alias("standards"))


@query("""
with o as (select l_orderkey * 10 + l_linenumber as id, l_linenumber as n, p_partkey as k, p_name as s, p_size % 7 <> 0 as there from lineitem join part on l_partkey = p_partkey)
select id, case when not there then null when n in (1, 2, 5) then 'core' when n = 4 then 'peripheral' else 'supporting' end as relevance,
  case when not there then null when n = 1 then 'changes what the program does — n' || k || ' is for: “' || substr(s, 1, 90) || '”'
    when n = 2 then 'part of the public surface n' || k || ' exposes — in pkg' || k || '.core: “core” (s:2)' when n = 3 then 'not in the public surface this charter records'
    when n = 4 then 'in tests/x.py, outside the product itself' when n = 5 then 'reached from the `run` command — in pkg' || k || ': “all” (s:1)'
    else 'inside n' || k || '''s own code — in pkg' || k || ': “all” (s:1)' end as relevance_note
from o
""")
def relevance_of_findings(spark, d):
    k = F.col("p_partkey").cast("string")
    pkg = F.concat(F.lit("pkg"), k)
    module = lambda name, doc, source: F.struct(name.alias("module"), F.lit(doc).alias("doc"), F.lit(source).alias("source"))
    parts = read(spark, d, "part")
    charters = parts.where("p_size % 7 <> 0").select(
        k.alias("repo"), F.concat(F.lit("n"), k).alias("name"), F.col("p_name").alias("summary"), F.array(F.concat(F.lit("run = "), pkg, F.lit(".cli:main"))).alias("entry_points"),
        F.array(module(pkg, "all", "s:1"), module(F.concat(pkg, F.lit(".core")), "core", "s:2")).alias("modules"), F.array(F.concat(pkg, F.lit(".core.total"))).alias("public_api"),
    )
    n = F.col("l_linenumber")
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs)), F.least(n, F.lit(len(xs))).cast("int"))
    own = read(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey").select(
        (F.col("l_orderkey") * 10 + n).alias("id"), k.alias("repo"), pick("timeout", "api_change", "api_change", "lint_regression").alias("kind"),
        pick("x", F.concat(pkg, F.lit(".core.total")), "other.f", "x", F.concat(pkg, F.lit(".cli:main")), F.lit(None).cast("string")).alias("symbol"), F.lit("c").alias("what_changed"),
        pick("x/y.py::t", F.concat(F.lit("src/"), pkg, F.lit("/core.py:3")), "x.py:1", "tests/x.py:1", "q.py:1", F.concat(F.lit("src/"), pkg, F.lit("/a.py:1"))).alias("evidence_ref"),
    )
    return charter.grounded_each(own, charters).select("id", "relevance", "relevance_note")


@query("""
select p_partkey as id, 'Made of ' || p_name || '.' as first, 'see ' || p_name || ' and size ' || p_size as cleaned, 1 + p_size % 3 as line, 'req-' || p_size || '.x' as requirement from part
""")
def text_of_manuals(spark, d):
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    lines = F.concat(F.repeat(F.lit("row\n"), (F.col("p_size") % 3).cast("int")), F.lit("x needle"), size, F.lit("\nneedle"), size)
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        text.first_sentence(F.concat(F.lit("Made  of "), name, F.lit(".\nNot this. Nor that."))).alias("first"),
        text.markdown_clean(F.concat(F.lit("**see** [`"), name, F.lit("`](http://h/"), size, F.lit(")  and _size_ "), size, F.lit("::"))).alias("cleaned"),
        text.line_of(lines, F.concat(F.lit("needle"), size)).cast("long").alias("line"),
        text.requirement_name(F.concat(F.lit("  Req_"), size, F.lit(".X >=1; python"))).alias("requirement"),
    )


@query("select o_custkey as id, 'f' || o_orderkey || '.py' as path from orders union select o_custkey, 'shared.py' from orders")
def paths_of_diffs(spark, d):
    name = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".py\n \nshared.py\n"))
    return files.changed_paths(read(spark, d, "orders").select(F.col("o_custkey").alias("id"), name.alias("text")))
