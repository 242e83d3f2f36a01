import random

from pyspark.sql import functions as F

from changelens.operators import ancestry, deltas, graph, grounding, lookups


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# ---- citations --------------------------------------------------------------

HEAD = ["import x", "", "def price(cart, percent):", "    total = sum(cart)", "    # no  discount below zero", "    if percent < 0:", "        raise ValueError"]
BASE = [*HEAD[:5], "    if percent <= 0:", *HEAD[6:]]


def world(spark):
    lines = [(s, "shop/pricing.py", n + 1, t) for s, text in (("head", HEAD), ("base", BASE)) for n, t in enumerate(text)]
    lines += [("head", "long.py", n, f"line {n}") for n in range(1, 301)] + [("head", "odd:name.py", 1, "x = 1")]
    return (
        spark.createDataFrame([("declared-tests",)], "id STRING"),
        spark.createDataFrame([("tests/test_a.py::test_one",)], "nodeid STRING"),
        spark.createDataFrame([("shop/pricing.py",)], "path STRING"),
        spark.createDataFrame(lines, "side STRING, path STRING, line INT, text STRING"),
        spark.createDataFrame([("README.md:3", "Older words", 0), ("README.md:3", "Price shopping carts.", 1)], "source STRING, text STRING, pos INT"),
    )


GOOD = [
    ("code", "shop/pricing.py:6", "if percent < 0:"), ("code", "base:shop/pricing.py:6", "if percent <= 0:"), ("code", "shop/pricing.py:4-6", None),
    ("code", "README.md:3", "Price  shopping carts"), ("norm", "declared-tests", None), ("test", "tests/test_a.py::test_one", None),
    ("diff", "shop/pricing.py", None), ("diff", "shop/pricing.py:12", "any"), ("code", "head:./shop//pricing.py:1", "import\tx"),
    ("code", " shop/pricing.py:5 ", "# no discount"), ("code", "long.py:100-220", "line 128 line 129"), ("code", "long.py:120-140", ""), ("code", "odd:name.py:1", "x = 1"),
]
BAD = [
    ("code", "shop/pricing.py:6", "if percent <= 0:"), ("code", "shop/pricing.py:9999", None), ("code", "../../etc/passwd:1", None), ("code", "/etc/passwd:1", None),
    ("code", "long.py:1-122", None), ("code", "shop/missing.py:1", None), ("code", "README.md:3", "Price shopping carts badly."), ("norm", "review-always", None),
    ("test", "tests/test_a.py::never", None), ("diff", "tests/test_a.py", None), ("diff", "head:shop/pricing.py", None), ("code", "long.py:299-301", None),
    ("code", "long.py:0-3", None), ("code", "long.py:9-3", None), ("code", "shop/pricing.py", None), ("other", "declared-tests", None), ("code", "README.md:3", "Older words"),
]


def test_citations_resolve_as_specified(spark):
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(GOOD + BAD)], "pos INT, type STRING, ref STRING, quote STRING")
    got = {r.pos: r for r in grounding.resolved_citations(c, *world(spark)).collect()}
    assert [got[i].resolved for i in range(len(got))] == [True] * len(GOOD) + [False] * len(BAD)
    assert got[2].quote == "\n".join(HEAD[3:6]).strip() and got[3].quote == "Price  shopping carts" and got[7].quote == "any" and got[4].quote is None
    assert got[11].quote == "\n".join(f"line {n}" for n in range(120, 141))[:200] and got[9].ref == "shop/pricing.py:5"
    assert grounding.resolved_citations(c.limit(0), *world(spark)).count() == 0


def test_citations_equal_brute_force(spark):
    rng = random.Random(2)
    files = {f"f{k}.py": [f"w{rng.randint(0, 9)}  v{rng.randint(0, 9)}" for _ in range(rng.choice([1, 127, 128, 129, 260]))] for k in range(6)}
    cites = []
    for i in range(300):
        path, a = rng.choice([*files, "none.py"]), rng.randint(0, 262)
        b = a + rng.choice([0, 1, 5, 120, 121])
        cites.append((i, "code", f"{path}:{a}" if a == b else f"{path}:{a}-{b}", rng.choice(["", f"w{rng.randint(0, 9)} v{rng.randint(0, 9)}"])))
    none = lambda ddl: spark.createDataFrame([], ddl)
    lines = spark.createDataFrame([("head", p, n + 1, t) for p, text in files.items() for n, t in enumerate(text)], "side STRING, path STRING, line INT, text STRING")
    got = grounding.resolved_citations(spark.createDataFrame(cites, "i INT, type STRING, ref STRING, quote STRING"), none("id STRING"), none("nodeid STRING"), none("path STRING"), lines)

    def by_hand(ref, quote):
        path, span = ref.split(":")
        a, b = (span.split("-") * 2)[:2]
        a, b = int(a), int(b)
        text = files.get(path, [])
        return 1 <= a <= b <= len(text) and b - a <= 120 and " ".join(quote.split()) in " ".join(" ".join(text[a - 1 : b]).split())

    assert rows(got, "i", "resolved") == sorted(((i, by_hand(r, q)) for i, _, r, q in cites), key=repr)


def test_places_of_findings(spark):
    s = spark.createDataFrame([("r1", "pkg.f", "a/one.py", 3), ("r2", "pkg.f", "b/two.py", 9), ("r1", "K.test_x", "t/test_x.py", 40)], "repo STRING, fqn STRING, file STRING, line_start INT")
    o = spark.createDataFrame(
        [
            (1, "r1", "pkg.f", "outcome:oom"), (2, "r2", "pkg.f", None), (3, "r1", "lib.py", ""), (4, "r1", "x/y", "zz"), (5, "r1", "nope", "zz"),
            (6, "r1", "pkg.f", "a/one.py:7"), (7, "r1", "pkg.f", "a/other.py:7:4"), (8, "r1", "K.test_x", "t/test_x.py::K::test_x[1-a]"), (9, "r1", "q", "dir/file: text"),
        ],
        "id INT, repo STRING, symbol STRING, evidence_ref STRING",
    )
    placed = grounding.observation_path(o, s)
    assert rows(placed, "id", "path") == [(1, "a/one.py"), (2, "b/two.py"), (3, "lib.py"), (4, "x/y"), (5, "(repo)"), (6, "a/one.py"), (7, "a/other.py"), (8, "t/test_x.py"), (9, "dir/file")]
    text = spark.createDataFrame([("r1", "t/test_x.py", 5, "    async def test_x(self, a):"), ("r1", "t/test_x.py", 8, "def test_x2():"), ("r1", "t/test_x.py", 9, "    def test_x(self):")], "repo STRING, path STRING, line INT, text STRING")
    got = dict(rows(grounding.observation_line(placed, text, s), "id", "line"))
    assert got == {1: 3, 2: 9, 3: None, 4: None, 5: None, 6: 7, 7: 7, 8: 5, 9: None}
    moved = placed.withColumn("path", F.lit("a/elsewhere.py"))
    assert {r.line for r in grounding.observation_line(moved, text, s).collect()} == {None}


def test_related_norms_equal_brute_force(spark):
    rng = random.Random(7)
    part = lambda: "/".join(rng.choices("ab", k=rng.randint(0, 3)) + [f"f{rng.randint(0, 4)}.py"])
    files = [(p, rng.sample("uvwxyz", rng.randint(0, 3))) for p in {part() for _ in range(40)}]
    norms = [(f"n{i:03}", [part() for _ in range(rng.randint(0, 2))], rng.sample("uvwxyz", rng.randint(0, 2))) for i in range(60)]

    def best(path, tokens):
        d = path.rsplit("/", 1)[0] if "/" in path else ""
        out = []
        for i, places, words in norms:
            s = 2.0 if path in places else 1.0 if d and any(p.startswith(d + "/") for p in places) else 0.0
            s += 0.25 * len(set(tokens) & set(words))
            if s:
                out.append((-s, i))
        return [(path, i, -s, k + 1) for k, (s, i) in enumerate(sorted(out)[:3])]

    got = grounding.related_norms(spark.createDataFrame(files, "path STRING, tokens ARRAY<STRING>"), spark.createDataFrame(norms, "id STRING, places ARRAY<STRING>, tokens ARRAY<STRING>"))
    assert rows(got, "path", "id", "score", "rank") == sorted((x for f in files for x in best(*f)), key=repr)


def _joined(df):
    """The most rows that a join of df's plan makes."""
    df.collect()

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            yield from walk(p.executedPlan())
        elif name.endswith("QueryStage"):
            yield from walk(p.plan())
        n = p.metrics().get("numOutputRows")
        if "Join" in name and n.isDefined():
            yield n.get().value()
        kids = p.children()
        for i in range(kids.size()):
            yield from walk(kids.apply(i))

    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_files_and_norms_of_one_word_make_no_pairs(spark):
    n = 1000
    files = spark.range(n).select(F.format_string("a/f%04d.py", "id").alias("path"), F.array(F.lit("w")).alias("tokens"))
    norms = spark.range(n).select(F.format_string("n%04d", "id").alias("id"), F.array(F.format_string("a/f%04d.py", "id")).alias("places"), F.array(F.lit("w")).alias("tokens"))
    got = grounding.related_norms(files, norms)
    assert _joined(got) <= 10 * n
    best = {r.path: r.id for r in got.where("rank = 1 and score = 2.25").collect()}
    assert got.count() == 3 * n and best == {f"a/f{i:04}.py": f"n{i:04}" for i in range(n)}


def test_suite_findings_carry_their_evidence(spark):
    ddl = "run_id STRING, side STRING, outcome STRING, duration_s DOUBLE, peak_rss_mb INT"
    o = spark.createDataFrame([("r", "base", "passed", 3.0, 100), ("r", "head", "oom", 12.25, 512), ("q", "base", "timeout", 1.0, 0), ("q", "head", "timeout", 1.0, 0), ("p", "base", "failed", 1.0, 0), ("p", "head", "timeout", 9.0, 0)], ddl)
    got = {r.run_id: r for r in deltas.outcome_delta(o).collect()}
    assert got.keys() == {"r", "p"}
    r = got["r"]
    assert (r.kind, r.symbol, r.severity, r.confidence, r.evidence_ref) == ("oom", "(suite)", 0.9, 0.95, "outcome:oom")
    assert r.how_we_know == "base run outcome passed, head run outcome oom; head ran for 12.2s, peak memory 512 MB"
    assert got["p"].how_we_know.endswith("head ran for 9.0s") and r.id.startswith("r-") and len(r.id) == 18


# ---- coverage ---------------------------------------------------------------


def test_lines_of_the_first_path_that_ends_with_a_file(spark):
    cov = [("/x/pkg/a.py", 0, [1]), ("/y/mypkg/a.py", 1, [2]), ("b.py", 2, [3]), ("/x/ab.py", 3, [4]), ("/x/pkg/a.py", 9, [8])] + [(f"/m{i}/__init__.py", 10 + i, [i]) for i in range(300)]
    sym = [("s1", "pkg/a.py"), ("s2", "mypkg/a.py"), ("s3", "b.py"), ("s4", "/x/b.py"), ("s5", "")] + [(f"i{i}", f"m{i}/__init__.py") for i in range(300)]
    got = lookups.lines_for(spark.createDataFrame(sym, "fqn STRING, file STRING"), spark.createDataFrame(cov, "path STRING, pos INT, lines ARRAY<INT>"))
    want = []
    for fqn, file in sym:
        for path, pos, lines in sorted(cov, key=lambda x: x[1]):
            if path.endswith(file):
                want.append((fqn, next(c[2] for c in cov if c[0] == path)))
                break
    assert rows(got, "fqn", "lines") == sorted(want, key=repr)
    s = spark.createDataFrame([("a", 1, 4), ("b", 1, 4), ("c", 1, 1), ("d", 1, 4)], "fqn STRING, line_start INT, line_end INT")
    c = spark.createDataFrame([("a", [1]), ("b", [1, 3]), ("c", [])], "fqn STRING, lines ARRAY<INT>")
    assert rows(lookups.coverage_gaps(s, c), "fqn") == [("a",)]


# ---- commit graphs ----------------------------------------------------------


def history(rng, n):
    """Random commits with merges; long straight runs among them."""
    edges, at = [], 0
    for i in range(1, n):
        if rng.random() < 0.25:
            at = rng.randrange(i)
        edges.append((f"c{i:03}", f"c{at:03}"))
        if rng.random() < 0.15:
            edges.append((f"c{i:03}", f"c{rng.randrange(i):03}"))
        at = i
    return edges


def best_ancestors(edges, a, b):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)

    def behind(x):
        seen, todo = {x}, [x]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen

    both = behind(a) & behind(b)
    return {x for x in both if not any(x != y and x in behind(y) for y in both)}


def test_merge_bases_equal_brute_force(spark):
    for seed in (1,):
        rng = random.Random(seed)
        edges = history(rng, 60) + [("z1", "z0"), ("z2", "z1")]
        names = sorted({x for e in edges for x in e} | {"lonely"})
        pairs = [tuple(rng.choices(names, k=2)) for _ in range(300)] + [("c005", "c005"), ("z2", "c050"), ("lonely", "lonely"), ("lonely", "c001")]
        got = ancestry.merge_bases(spark.createDataFrame(edges, "commit STRING, parent STRING"), spark.createDataFrame(pairs, "base STRING, head STRING"))
        got = got.collect()
        assert len(got) == len(set(pairs))
        for r in got:
            best = best_ancestors(edges, r.base, r.head)
            assert (r.commit in best) if best else r.commit is None


def test_merge_base_is_no_short_cut(spark):
    """Both tips merged an old branch of x; their fork y descends from x."""
    e = [("y", "m"), ("m", "x"), ("s", "x"), ("a1", "y"), ("a2", "a1"), ("a3", "a2"), ("a3", "s"), ("b1", "y"), ("b2", "b1"), ("b3", "b2"), ("b3", "s"), ("x", "root")]
    p = spark.createDataFrame(e, "commit STRING, parent STRING")
    assert graph.fork_point(p, "a3", "b3").first()[0] in best_ancestors(e, "a3", "b3")
    straight = spark.createDataFrame([(f"{i:04}", f"{i - 1:04}") for i in range(1, 700)] + [("t", "0200")], "commit STRING, parent STRING")
    assert graph.fork_point(straight, "0699", "t").first()[0] == "0200"
    assert graph.fork_point(straight, "0699", "nobody").count() == 0
    assert ancestry.contracted(straight, spark.createDataFrame([("0699",), ("t",)], "commit STRING")).count() == 3


def test_reach_of_each_seed(spark):
    rng = random.Random(3)
    e = list({(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(90)}) + [(f"n{i}", "hub") for i in range(40)]
    seeds = [f"n{i}" for i in range(40)] + ["hub"] + [f"x{i}" for i in range(80)]
    for hops in (2, None):
        want = set()
        for s in seeds:
            seen, edge, hop = {s: 0}, {s}, 0
            while edge and (hops is None or hop < hops):
                hop += 1
                edge = {a for a, b in e if b in edge} - seen.keys()
                seen |= {n: hop for n in edge}
            want |= {(s, n, h) for n, h in seen.items()}
        got = ancestry.reach_of_each(spark.createDataFrame(e, "caller STRING, callee STRING"), spark.createDataFrame([(s,) for s in seeds], "seed STRING"), hops)
        assert rows(got, "seed", "node", "hop") == sorted(want, key=repr)


def test_folds_carry_over_batches(spark):
    """Sequences longer than a batch, many keys in a partition, a key that ends with a batch."""
    from changelens.operators import sequences

    rng = random.Random(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        calls = [(f"l{i % 5}", i, f"r{rng.randint(0, 2)}", f"d{rng.randint(0, 3)}", f"u{rng.randint(0, 9)}", rng.randint(1, 9) / 2) for i in range(300)]
        got = sequences.reservations(spark.createDataFrame(calls, "ledger STRING, id LONG, repo STRING, day STRING, run_id STRING, usd DOUBLE").repartition(3), 120.0, 40.0, 25.0)
        want, spent = [], {}
        for ledger, i, repo, day, run, usd in calls:
            caps = {"total": (ledger, 120.0), "repo_day": ((ledger, repo, day), 40.0), "run": ((ledger, "run", run), 25.0)}
            why = next((k for k, (s, cap) in caps.items() if spent.get(s, 0.0) + usd > cap), None)
            for s, _ in caps.values():
                spent[s] = spent.get(s, 0.0) + (usd if why is None else 0.0)
            want.append((i, why is None, why))
        assert rows(got, "id", "granted", "refused_by") == sorted(want, key=repr)
        pushes = [(f"k{i % 3}", float(rng.randint(0, 400)), f"h{i:03}") for i in range(200)]
        want = []
        for k in ("k0", "k1", "k2"):
            held = None
            for _, at, head in sorted(p for p in pushes if p[0] == k):
                if held and at - held[1] < 30:
                    held = (k, held[1], head, held[3] + 1)
                else:
                    want += [held] if held else []
                    held = (k, at, head, 1)
            want.append(held)
        got = sequences.debounced(spark.createDataFrame(pushes, "key STRING, at DOUBLE, head STRING"), "key", "at", "head", 30.0)
        assert rows(got, "key", "queued_at", "head", "pushes") == sorted(want, key=repr)
        assert sequences.debounced(spark.createDataFrame([], "key STRING, at DOUBLE, head STRING"), "key", "at", "head", 30.0).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lines_are_dealt_in_parts_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(grounding, "TEXT_IN_TASK", 100, raising=False)
    lines = spark.createDataFrame([("head", "a.py", i, f"line {i:05}") for i in range(1, 301)], "side STRING, path STRING, line INT, text STRING")
    asked = spark.createDataFrame([("head", "a.py", 120, 130), ("head", "a.py", 299, 301)], "side STRING, path STRING, start INT, end INT")
    blocks = grounding.line_blocks(lines)
    assert blocks.rdd.getNumPartitions() == 30
    got = grounding.cited_lines(asked, blocks, 30).collect()
    assert [(r.start, r.excerpt) for r in got] == [(120, "\n".join(f"line {i:05}" for i in range(120, 131)))]
