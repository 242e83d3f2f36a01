"""Small brute-force checks, and the odd cases each operator names in its docstring."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from changelens.llm import common, decontaminate, html_text, media, piece_bpe, quotes, sharding, simhash, suffix_dedup, token_store, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
DDL = "doc_id long, text string"
#: Nulls, empties, ties, repeats, a long text that repeats itself.
ODD = [(1, None), (2, ""), (3, "a"), (4, " \n\t "), (5, "Same text here. " * 20), (6, "Same text here. " * 20), (None, "no id é"), (7, "x " * 20_000), (8, "\x00\x1c ▁<s>日本 😀"), (5, "Same text here. " * 20)]


def frame(spark, rows=ODD, extra=True):
    df = spark.createDataFrame(rows, DDL)
    return df.withColumns({c: F.lit(c) for c in ("n_tokens", "fp", "uid", "spans", "link", "shard", "tkey", "root", "item_id", "key", "id", "_uid", "_spans", "_sh_key", "_sh_id", "_tox_id")}) if extra else df


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# ---- 1 ----------------------------------------------------------------------


def test_suffix_arrays_and_longest_factors():
    rng = random.Random(3)
    for _ in range(60):
        s = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 50)))
        d = np.frombuffer(s, np.uint8)
        order, levels = suffix_dedup.suffix_ranks(d, 64)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        shared = [0, *suffix_dedup.common_prefix(d, levels, order[:-1], order[1:], 64).tolist()]
        before, after = suffix_dedup.longest_factors(order.tolist(), shared)

        def lcp(i, j):
            return next((k for k in range(len(s)) if i + k >= len(s) or j + k >= len(s) or s[i + k] != s[j + k]), len(s))

        for r, i in enumerate(order.tolist()):
            assert before[r] == max((lcp(i, j) for j in range(i)), default=0)
            assert after[r] == max((lcp(i, j) for j in range(i + 1, len(s))), default=0)


def removed(rows, length, keep):
    count, first = Counter(), {}
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            count[b[p : p + length]] += 1
            first.setdefault(b[p : p + length], (k, p))
    out = []
    for k, (i, t) in enumerate(rows):
        b = (t or "").encode()
        m = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if count[w] > 1 and (keep == "none" or first[w] != (k, p)):
                m[p] += 1
                m[p + length] -= 1
        m = np.cumsum(m)[:-1] > 0
        kept = bytes(x for x, y in zip(b, m) if not y)
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        out.append((i, len(b), int(m.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [20_000, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_MEMBERS", most)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80))) + (passage[rng.randint(0, 20) :] if i % 2 else "") + "".join(rng.choice("ab") for _ in range(30))) for i in range(24)]
    rows += [(30, "ha" * 80), (31, "é" * 60), (32, None), (33, rows[1][1])]
    want = removed(rows, 50, "none")
    got = suffix_dedup.kept_digests(frame(spark, rows), 50).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    kept = {r.doc_id: len((r.text or "").encode()) for r in suffix_dedup.remove_repeats(frame(spark, rows), 50).collect()}
    for i, n, cut, _, _ in removed(rows, 50, "first"):
        assert n - cut <= kept[i] <= n - cut + 6  # characters cut in part stay


def test_repeats_odd_cases(spark):
    got = suffix_dedup.kept_digests(frame(spark)).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == sorted((str(i), *x) for i, *x in removed(ODD, 200, "none"))
    assert suffix_dedup.kept_digests(frame(spark, [])).count() == 0
    assert suffix_dedup.remove_repeats(frame(spark)).count() == len(ODD)


# ---- 2 ----------------------------------------------------------------------


@pytest.mark.parametrize("rows", [ODD, [(i, "same" if i < 90 else f"t{i % 70}") for i in range(300)], []])
def test_shards(spark, rows):
    got = sharding.shard_documents(frame(spark, rows), 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    if rows:
        sizes = [len(by.get(k, [])) for k in range(8)]
        assert max(sizes) - min(sizes) <= 1
        groups = defaultdict(set)
        for r in got:
            groups[(r.text_crc32, r.size)].add(r.shard)
        assert sum(len(s) - 1 for s in groups.values()) <= 16  # of 229 links at most; every shard is full from the start


# ---- 3 ----------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><a href="/">Home of all</a></nav>
<div class="cookie-notice">We use cookies</div><{0}><h1>A &amp; B</h1><p>First <b>bo</b>ld para, with   words.<br>More</p><div class="ad">Buy now</div>
<p>Second one&#33;</p><form><label>Mail</label></form></{0}><section id="comments"><p>Nice post indeed</p></section><footer>&copy; all</footer></body></html>"""


def test_main_text():
    weights = html_text.learn([PAGE.format("article")] * 3)
    want = "A & B First bold para, with words. More Second one!"
    for tag in ("article", "main", "div"):
        assert html_text.main_text(PAGE.format(tag), weights) == want
    assert html_text.main_text(PAGE.format("article")[:330], weights).startswith("A & B")
    assert html_text.main_text(None, weights) == html_text.main_text("", weights) == html_text.main_text("<p></p>", weights) == ""
    assert html_text.best_run([1, -3, 2, 2, -1, 3, -9, 6]) == (2, 6)


def test_pages_equal_the_marked_article(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        inner = re.sub(r"</?(p|h1|br)\b[^>]*>", " ", re.sub(r"<!--.*?-->", "", inner, flags=re.S))
        import html

        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    empty = spark.createDataFrame([(1, "u", None), (2, None, "")], "page_id long, url string, html string")
    assert [r.text for r in html_text.extract(empty).collect()] == ["", ""]


def test_articles_keep_their_lists_tables_and_sections(spark):
    weights = html_text.fit(spark.read.parquet(f"{DATA}/pages.parquet"))
    around = "<html><body><nav><a href='/'>Home</a></nav>%s<footer>Imprint</footer></body></html>"
    text = lambda body: html_text.main_text(around % body, weights)
    items = "".join(f"<li><a href='/{k}'>Thing number {k}</a></li>" for k in range(20))
    last = "<p>That was the list of the ten best things we have seen this year in town.</p>"
    got = text(f"<article><h1>Ten things</h1><ul>{items}</ul>{last}</article>")
    assert got.startswith("Ten things Thing number 0") and got.endswith("this year in town.")
    table = "".join(f"<tr><td>Row {k}</td><td>{k * 7}</td></tr>" for k in range(60))
    got = text(f"<article><h1>Figures</h1><p>The figures of the year are these.</p><table>{table}</table>{last}</article>")
    assert "Row 0 0 Row 1 7" in got and got.endswith("this year in town.")
    for part in (
        '<section id="related-work"><p>Others have written of it.</p></section>',
        '<p class="search-results">Results of our search were few.</p>',
        '<div class="side-by-side">Both pictures stand here.</div>',
        '<p>The <span class="share-price">price of a share</span> fell.</p>',
        "<p><label>Fig. 1</label> A figure.</p>",
    ):
        inner = " ".join(re.sub(r"<[^>]*>", "", part).split())
        assert inner in text(f"<article><h1>Title here</h1><p>A paragraph comes first in this.</p>{part}{last}</article>"), part
    for part in ('<div class="share-buttons">Tweet this</div>', '<div id="cookie-notice">We use cookies</div>', '<div class="adBanner">Buy now</div>'):
        assert text(f"<article><h1>Title here</h1><p>A paragraph comes first.</p>{part}{last}</article>").startswith("Title here A paragraph comes first. That was")
    plain = "<div><h1>Title here</h1><p>A paragraph comes first in this text of ours.</p><p>Copyright law is hard.</p></div><div>© 2024 The Paper Ltd</div>"
    assert text(plain) == "Title here A paragraph comes first in this text of ours. Copyright law is hard."
    for part in (">" * 50_000, "</b>" * 50_000, "<i>" * 20_000, '<a href="' * 20_000, "<div class='a" * 5_000):
        assert isinstance(text(f"<article><p>Some words of an article.</p>{part}"), str)
    rows = [(1, "u", PAGE.format("article")), (1, "u", PAGE.format("article")), (None, None, "<p>words " + "long " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    assert sorted(r.n_chars for r in html_text.extract(pages, weights).collect())[-1] == 5 + 5 * 100_000
    assert html_text.extract(pages.limit(0)).count() == 0


# ---- 4 ----------------------------------------------------------------------


def hits(text, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    ws, hit, own = words(text), set(), set()
    for i, t in items:
        iw = words(t)
        n = min(window, len(iw))
        grams = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for p in range(len(ws) - n + 1):
            if tuple(ws[p : p + n]) in grams:
                hit |= set(range(p, p + n))
                if i is not None:
                    own.add(str(i))
    return len(ws), len(hit), sorted(own)


@pytest.mark.parametrize("block", [1 << 25, 60])
def test_hits_equal_brute_force(spark, block):
    items = [(1, "a b c d e f g h i j k l"), (2, "Ünder É9 x"), (3, None), (4, "..."), (None, "q r s"), (10, "a b c d e f g h i j")]
    rows = [(1, "z A b,c d e F g h i j q r s"), (2, "a b c d e f g h i"), (3, "ünder É9 x Ünder é9 X"), (4, "ünder É9 x"), *ODD[:4]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_hits(frame(spark, rows), bench, block_bytes=block).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted((i, *hits(t, items)) for i, t in rows)
    clean = decontaminate.remove(frame(spark, rows), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in rows if not hits(t, items)[1])
    spans = {r.doc_id: r.text for r in decontaminate.remove(frame(spark, rows, False), bench, "span").collect()}
    assert all(hits(t, items)[1] == 0 for t in spans.values()) and len(spans) == len({i for i, _ in rows})
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_hits(frame(spark), none).where("n_hit > 0").count() == 0
    assert decontaminate.find_hits(frame(spark, []), bench).count() == 0


# ---- 5 ----------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string"


def test_quotes(spark):
    m = [
        (1, 0, "user", "Hello there.\nHow are you?"),
        (1, 1, "assistant", "> how  ARE you?\nFine.\n\nAnd you?"),
        (1, 2, "user", "Ann wrote:\n> > How are you?\n> Fine.\n>\n> And you?\n\nGood too."),
        (2, 0, "user", "> Good too.\nInteresting"),
        (1, 3, "user", None),
        (None, 1, "user", "x"),
        (2, 0, "user", "again"),
        (3, 5, "u", "> nowhere\nok"),
        (3, 900, "u", "later"),
    ]
    df = spark.createDataFrame(m, TALK).withColumn("depth", F.lit("clash"))
    got = {(r.conv_id, r.turn, r.own_text): r for r in quotes.link_conversations(df).collect()}
    assert len(got) == len(m)
    a = got[(1, 2, "Good too.")]
    assert (a.n_quotes, a.n_linked, a.reply_turn, a.by_quote, a.depth) == (2, 2, 1, True, 2)
    b = got[(2, 0, "Interesting")]
    assert (b.reply_conv, b.reply_turn, b.root_conv, b.root_turn, b.depth) == (1, 2, 1, 0, 3)
    assert got[(3, 5, "ok")].n_linked == 0 and got[(3, 900, "later")].reply_turn == 5
    assert got[(None, 1, "x")].reply_conv is None and got[(1, 3, "")].reply_turn == 2
    assert quotes.link_conversations(spark.createDataFrame([], TALK)).count() == 0


def test_circle_of_quotes_ends(spark):
    m = [(1, 0, "u", "> beta text\nalpha text"), (2, 0, "u", "> alpha text\nbeta text")]
    got = quotes.link_conversations(spark.createDataFrame(m, TALK)).collect()
    assert {(r.root_conv, r.root_turn, r.depth) for r in got} == {(1, 0, 0)}


def test_latest_place_before_equals_brute_force(spark):
    rng = random.Random(8)
    asked = [(rng.choice("abc"), rng.choice([1, 2, None]), rng.randint(-900, 2000)) for _ in range(400)]
    place = [(rng.choice("abcd"), rng.choice([1, 2, 3]), rng.randint(-900, 2000)) for _ in range(300)]
    frames = (spark.createDataFrame(sorted(set(x), key=str), "h string, conv_id long, turn long") for x in (asked, place))
    got = {(r.h, r.conv_id, r.turn): r.near_turn for r in quotes.latest_before(*frames).collect()}
    want = {}
    for h, c, t in asked:
        before = [p[2] for p in place if p[0] == h and p[1] == c and p[2] < t]
        if before:
            want[h, c, t] = max(before)
    assert got == want


def test_nested_quotes_equal_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    own, rows, quoted = {}, [], {}
    for conv in range(6):
        for turn in range(12):
            lines = []
            if turn:
                back = rng.randrange(turn)
                if rng.random() < 0.7:
                    quoted[conv, turn] = back
                    if (conv, back) in quoted and rng.random() < 0.5:
                        lines += [f">> {x}" for x in own[conv, quoted[conv, back]].split("\n")]
                    lines += [f"> {x.upper() if rng.random() < 0.3 else x}" for x in own[conv, back].split("\n")]
            own[conv, turn] = "\n".join(" ".join(word() for _ in range(5)) for _ in range(rng.randint(1, 3)))
            rows.append((conv, turn, "u", "\n".join([*lines, own[conv, turn]])))
    rng.shuffle(rows)
    got = {(r.conv_id, r.turn): r for r in quotes.link_conversations(spark.createDataFrame(rows, TALK)).collect()}
    for (conv, turn), r in got.items():
        assert r.own_text == own[conv, turn]
        assert r.reply_turn == quoted.get((conv, turn), turn - 1 if turn else None) and r.by_quote == ((conv, turn) in quoted)
        depth, at = 0, turn
        while at:
            at, depth = quoted.get((conv, at), at - 1), depth + 1
        assert r.depth == depth and r.root_turn == 0


# ---- 6 ----------------------------------------------------------------------


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, labels).join(labels, "doc_id").toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    out = got[got.held_out]
    assert (out.predicted == out.toxic).mean() > 0.93
    # labels of held-out rows play no part
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(docs, flipped).toPandas().set_index("doc_id").score
    assert np.allclose(again.loc[got.doc_id].values, got.score.values)


def test_toxicity_models_sum_to_one_and_match_the_definition(spark):
    grams = {"^^^^^a": (3, 9), "^^^^^b": (0, 4), "^^^^ab": (2, 1), "^^^^ba": (1, 0), "^^^ab$": (2, 5), "^^^ba$": (0, 2), "^^^^a$": (4, 4)}
    counts = spark.createDataFrame([(g, *x) for g, x in grams.items()], "gram string, toxic long, ordinary long")
    d, o = toxicity.DISCOUNT, toxicity.ORDER
    alphabet = {g[-1] for g in grams}
    levels = {o: {g: 1 for g in grams}}
    for k in range(o - 1, 0, -1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1

    def shared(gram):
        if not gram:
            return 1 / len(alphabet)
        own = {g: n for g, n in levels[len(gram)].items() if g[:-1] == gram[:-1]}
        if not own:
            return shared(gram[1:])
        total = sum(own.values())
        return max(own.get(gram, 0) - d, 0) / total + d * len(own) / total * shared(gram[1:])

    def likely(gram, c):
        own = {g: x[c] for g, x in grams.items() if g[:-1] == gram[:-1] and x[c]}
        if not own:
            return shared(gram[1:])
        total = sum(own.values())
        return max(own.get(gram, 0) - d, 0) / total + d * len(own) / total * shared(gram[1:])

    for h in {g[:-1] for g in grams}:
        for c in (0, 1):
            assert sum(likely(h + x, c) for x in alphabet) == pytest.approx(1)
    for r in toxicity.likelihoods(counts).collect():
        assert r.p1 == pytest.approx(likely(r.gram, 0)) and r.p0 == pytest.approx(likely(r.gram, 1))
    ratio = {r.key: r.ratio for r in toxicity.log_ratios(counts).collect()}
    words = toxicity._word_sums
    hashes = {k: __import__("xxhash").xxh64_intdigest(k.encode(), 42) for k in ratio}
    order = sorted(ratio, key=hashes.get)
    got = words(["ab", "zz"], np.array([hashes[k] for k in order], np.uint64), np.array([ratio[k] for k in order]))
    one = sum(math.log(likely(g, 0) / likely(g, 1)) for g in ("^^^^^a", "^^^^ab", "^^^ab$"))
    assert got[0] == pytest.approx(one, abs=1e-5) and got[1] == pytest.approx(math.log(likely("^^^^^z", 0) / likely("^^^^^z", 1)), abs=1e-5)


def test_toxicity_rejects_rows_by_their_text(spark):
    rows = [(i, ("kind words of people " * 5) + ("vile scum " * 6 if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    rows += [(None, rows[0][1]), (1, rows[4][1]), (None, rows[1][1])]
    docs = frame(spark, rows).withColumn("tkey", F.lit(7)).withColumn("tkey_", F.lit(8))
    kept = toxicity.keep_ordinary(docs, labels)
    assert kept.columns == docs.columns
    got = kept.groupBy("doc_id").count().collect()
    assert {(r.doc_id, r["count"]) for r in got} == {(i, 1) for i in range(400) if i % 4} | {(None, 1)}
    assert kept.where("tkey = 7 and tkey_ = 8").count() == 301


def test_toxicity_odd_cases(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(frame(spark), labels).where("score between 0 and 1").count() == len(ODD)
    assert toxicity.score(frame(spark, []), labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.keep_ordinary(frame(spark), none).count() == len(ODD)


def test_toxicity_keeps_rare_grams(spark, monkeypatch):
    rng = random.Random(6)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(50)]
    bad = ["zzqxv", "wyyzq", "qxxyw"]
    rows = [(i, " ".join([rng.choice(plain) for _ in range(300)] + (bad if i % 10 == 0 else []))) for i in range(400)]
    docs = spark.createDataFrame(rows, DDL)
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    # no number of grams, and no number of occurrences, sets a threshold
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 5_000, raising=False)
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert min(s for i, s in got.items() if i % 10 == 0) > max(s for i, s in got.items() if i % 10)
    # blocks change nothing
    monkeypatch.setattr(toxicity, "BLOCK_GRAMS", 500, raising=False)
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 150, raising=False)
    again = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert again.keys() == got.keys() and all(abs(again[i] - got[i]) < 1e-9 for i in got)


# ---- 7 ----------------------------------------------------------------------


def print_of(text):
    import xxhash

    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints(spark):
    rows = ODD[:6] + [(9, "One two THREE four"), (10, "a b")]
    got = simhash.linked_components(frame(spark, rows)).collect()
    want = {i: print_of(t) for i, t in rows}
    assert {r.doc_id: r.fp % 2**64 for r in got} == want
    assert {r.component_id for r in got if want[r.doc_id] == 0} == {1}
    assert simhash.linked_components(frame(spark, [])).count() == 0


def test_links_equal_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1, 2**63]
    fps = set(base)
    for _ in range(300):
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    signed = [(x - 2**64 if x >> 63 else x,) for x in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    got = {r.node % 2**64: r.root for r in common.components(spark, edges).collect()}
    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            assert (find(a) == find(b)) == (a in got and b in got and got[a] == got[b])


def test_near_duplicates(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    long = [word() for _ in range(200)]
    edited = list(long)
    edited[50] = "changed"
    other = long[:60] + [word() for _ in range(140)]
    rows = [(1, " ".join(long)), (2, " ".join(edited)), (3, " ".join(other)), (4, " ".join(long)), (5, None), (6, ""), (7, "short text")]
    g = {r.doc_id: bytes(r.group_key) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert g[1] == g[2] == g[4] and g[3] != g[1] and g[5] == g[6] and g[7] not in (g[1], g[5])
    assert sorted(r.doc_id for r in simhash.deduplicate(frame(spark, rows)).collect()) == [1, 3, 5, 7]
    assert simhash.deduplicate(frame(spark)).count() == 6  # white space alone is empty


def test_near_duplicates_of_short_texts_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for n in [8, 9] * 20 + [12, 18, 30, 44, 52]:
        ws = [word() for _ in range(n + 1)]
        rows += [ws, ws[:-1] if rng.random() < 0.5 else ws[1:], ws[: n // 2] + [word() for _ in range(n // 2)]]
    rows = [(i, " ".join(ws)) for i, ws in enumerate(rows)]
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = {x: min(root[i], root[j]) if r in (root[i], root[j]) else r for x, r in root.items()}
    got = {r.doc_id: bytes(r.group_key) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert sum(root[3 * k] == root[3 * k + 1] for k in range(45)) == 45
    for i in sets:
        for j in range(i):
            assert (root[i] == root[j]) == (got[i] == got[j])


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (None, 3)], "a int, b int")
    got = {r.node: r.root for r in common.components(spark, e).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100 and None not in got


# ---- 8 and 10 ---------------------------------------------------------------


def strange(n, alphabet):
    rng = random.Random(n)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    e = piece_bpe.PieceBpe(PIECES)
    texts = [t or "" for _, t in ODD] + strange(800, [*"abcdeéß  .,\n\t▁0123日本語😀'-_<s>ABCthe ", "the", "ing"]) + [r.text for r in documents(spark).limit(40).collect()]
    for t in texts:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert e.encode(t).tolist() == ids and e.decode(ids) == sp.decode(ids)
        n, a, b = e.digest(t)
        assert (n, a) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert b == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert piece_bpe.piece_digests(frame(spark), PIECES).count() == len(ODD)
    one = {r.doc_id: r for r in piece_bpe.encode_pieces(frame(spark), PIECES).collect()}
    assert one[3].decoded == "a" and one[1].ids == [1, 2]
    assert piece_bpe.piece_digests(frame(spark, []), PIECES).count() == 0


def test_words_equal_the_library():
    e = token_store.WordEncoder(WORDS, 2)
    texts = [t for _, t in ODD] + strange(800, [*"abcdeéßÀÉñ  .,\n\t0123'-_ABC'日\x1c\xa0 İΣς", "'s", "<|endoftext|>"])
    for t in texts:
        assert np.frombuffer(e.ids(t), "<u2").tolist() == e.lib.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("rows", [ODD, []])
def test_token_store_round_trip(spark, tmp_path, rows):
    e = token_store.WordEncoder(WORDS, 2)
    path = f"file://{tmp_path}/store"
    token_store.write_store(frame(spark, rows), path, WORDS)
    got = token_store.store_digests(spark, path).collect()
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.frombuffer(e.ids(t), "<u2").tolist() + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    if rows:
        one = token_store.read_store(spark, path, only=[3]).collect()
        assert [r.doc_id for r in one] == [3] and np.frombuffer(bytes(one[0].ids), "<u4")[-1] == 1


def test_store_samples_widths_and_memory(spark, tmp_path, monkeypatch):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.union(spark.createDataFrame([(-1, "long " * 20_000), (None, None)], DDL))
    got = [r.text for r in token_store.sampled(docs).collect()]
    assert len(got) == token_store.SAMPLE_DOCS == len(set(got)) and all(len(t) < 20 for t in got)
    assert token_store.sampled(docs.limit(0)).count() == 0
    assert token_store.id_bytes(WORDS, 1) == 2 and token_store.id_bytes(WORDS, 1 << 16) == 4
    path = f"file://{tmp_path}/wide"
    token_store.write_store(frame(spark), path, WORDS, end_id=1 << 16)
    one = token_store.read_store(spark, path, only=[3]).collect()
    assert np.frombuffer(bytes(one[0].ids), "<u4")[-1] == 1 << 16
    # what is not remembered is encoded each time alike
    text = "ab" * 100 + " " + "日" * 100 + " word"
    e, p = token_store.WordEncoder(WORDS, 2), piece_bpe.PieceBpe(PIECES)
    first = e.ids(text), p.encode(text).tolist()
    assert (e.ids(text), p.encode(text).tolist()) == first
    assert max(map(len, [*e.memo, *e.rare, *p.memo, *p.core_memo])) <= token_store.LONGEST
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 1)
    few = piece_bpe.PieceBpe(PIECES)
    assert few.encode(text).tolist() == first[1] and len(few.compatible_memo) <= 1 and len(few.memo) <= 1


# ---- 9 ----------------------------------------------------------------------


def test_media(spark):
    rng = np.random.default_rng(2)
    base = [rng.normal(size=64) for _ in range(12)]
    rows = [(k * 50, v.tolist()) for k, v in enumerate(base)]
    rows += [(k * 50 + 1, (v * 1.2 + rng.normal(size=64) * 0.05).tolist()) for k, v in enumerate(base)]
    rows += [(9001, None), (9002, []), (9003, [1.0] * 64), (9004, [float("nan")] * 64)]
    images = media.with_media(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v")
    found = {(r.query_id, r.media_id) for r in media.search(images, F.col("media_id") % 50 == 0).collect()}
    want = {(k * 50, k * 50 + 1) for k in range(12)}
    assert len(want & found) >= 0.9 * len(want) and not found - want
    # a cropped copy is found with its shift
    img = media.image_from_vector(base[0].tolist(), 96)
    crop = [(0, bytearray(media.pack(img))), (7, bytearray(media.pack(img[10:, 14:])))]
    got = media.search(spark.createDataFrame(crop, "media_id long, media binary"), F.col("media_id") == 0).collect()
    assert [r.media_id for r in got] == [7] and abs(got[0].dx + 14) <= 2 and abs(got[0].dy + 10) <= 2


def test_media_links_are_counted_for_all_images_of_a_class(spark):
    rng = np.random.default_rng(4)
    a, b, c = (rng.normal(size=64) for _ in range(3))
    near = (a + rng.normal(size=64) * 0.02).tolist()
    rows = [(50, a.tolist()), (7, near), (51, a.tolist()), (52, a.tolist()), (8, b.tolist()), (9, b.tolist()), (100, c.tolist())]
    rows += [(11, None), (12, None), (13, [1.0] * 64), (14, [1.0] * 64), (None, a.tolist()), (7, near)]
    images = media.with_media(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v")
    images = images.withColumns({x: F.lit(1) for x in ("mkey", "rep", "n", "no", "root", "votes", "asked")})
    got = Counter((r.media_id, r.n_links, r.class_id) for r in media.linked_media(images, F.col("media_id") % 50 == 0).collect())
    # 50, 51 and 52 are equal and linked with both rows of 7; 8 and 9 are equal; the others have no corner
    want = [(50, 4, 7), (51, 4, 7), (52, 4, 7), (7, 4, 7), (7, 4, 7), (8, 1, 8), (9, 1, 8), (100, 0, 100)]
    want += [(11, 0, 11), (12, 0, 12), (13, 0, 13), (14, 0, 14), (None, 4, None)]
    assert got == Counter(want)
    assert media.linked_media(images.limit(0), F.col("media_id") % 50 == 0).count() == 0


def test_media_classes_of_near_equal_images(spark):
    """Classes are those of all links; pairs of corners grow with a group of near-equal images, not with its square."""
    rng = np.random.default_rng(6)
    base, asked = rng.normal(size=64), F.col("media_id") % 2 == 0

    def rendered(rows):
        return media.with_media(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v")

    made = {}
    for n in (20, 80):
        images = rendered([(k, (base + rng.normal(size=64) * 0.02).tolist()) for k in range(n)])
        _, _, corners, picked = media._kinds(images, asked)
        met = media.leaders(corners, picked)
        near = media.with_leaders(met)
        edges = media.consensus(near).select(F.col("query_id").alias("a"), F.col("media_id").alias("b"))
        joined = common.components(spark, edges)
        assert met.count() <= media.TABLES * corners.count()
        made[n] = near.count() + media.still_apart(met, picked, joined).count()
    assert made[20] > 0 and made[80] <= 6 * made[20], made
    # groups, strangers, equal images, repeated rows, images without a corner or an id: as by all links
    rows = [(k, (rng.normal(size=64) if k % 3 == 0 else base + rng.normal(size=64) * 0.05).tolist()) for k in range(40)]
    rows += [(100, rows[1][1]), (1, rows[1][1]), (101, rows[3][1]), (103, rows[9][1]), (None, rows[1][1])]
    rows += [(200, None), (201, None), (202, [1.0] * 64), (204, [1.0] * 64)]
    images = rendered(rows).withColumns({x: F.lit(1) for x in ("mkey", "rep", "n", "no", "root", "asked", "lo", "hi")})
    got = media.media_classes(images, asked).collect()
    want = media.linked_media(images, asked).collect()
    assert Counter((r.media_id, r.class_id) for r in got) == Counter((r.media_id, r.class_id) for r in want)
    sizes = Counter(r.class_id for r in got if r.media_id is not None)
    nameless = sum(r.media_id is None for r in got)
    assert nameless == 1 and all(r.class_size == sizes[r.class_id] for r in got if r.media_id is not None), got
    assert max(sizes.values()) >= 20 and {r.class_size for r in got if r.media_id in (200, 201, 202, 204)} == {1}
    assert media.media_classes(images.limit(0), asked).count() == 0
    assert media.media_classes(images, F.lit(False)).where("media_id < 40 and class_id <> media_id").count() == 0


def test_media_query_returns_classes(spark):
    from changelens.llm.queries import QUERIES

    got = QUERIES["op9_media"](spark, DATA)
    assert got.columns == ["media_id", "class_id", "class_size"]
    assert got.count() == spark.read.parquet(f"{DATA}/embeddings.parquet").count()


def test_media_recall_of_crops_turns_and_edits():
    """Of rendered images cut by up to a fifth, turned, brightened and made noisy, nine of ten are found."""
    rng = np.random.default_rng(9)

    def votes(x, y):
        best = 0
        pairs = [(p, q) for p in x for q in y if sum(bin((int(u) ^ int(v)) & (2**64 - 1)).count("1") for u, v in zip(p[4], q[4])) <= media.MOST_DIFFERENT]
        pairs = [(p, q) for p, q in pairs if any(np.array_equal(p[4].view("<u4")[t], q[4].view("<u4")[t]) for t in range(media.TABLES))]
        at = []
        for p, q in pairs:
            turn, s = math.remainder(q[3] - p[3], 2 * math.pi), q[2] / p[2]
            dx = q[0] - s * (math.cos(turn) * p[0] - math.sin(turn) * p[1])
            at.append((p[:3], dx, q[1] - s * (math.sin(turn) * p[0] + math.cos(turn) * p[1]), turn, math.log(s)))
        for v in at:
            near = {w[0] for w in at if abs(w[1] - v[1]) <= media.SHIFT and abs(w[2] - v[2]) <= media.SHIFT and abs(w[4] - v[4]) <= media.SCALE_BIN and abs(math.remainder(w[3] - v[3], 2 * math.pi)) <= media.ANGLE_BIN}
            best = max(best, len(near))
        return best

    edits = {
        "crop": lambda i: i[rng.integers(0, 13) :, rng.integers(0, 13) :],
        "turn": lambda i: np.rot90(i, rng.integers(1, 4)),
        "bright": lambda i: np.clip(i * rng.uniform(0.7, 1.2) + rng.uniform(-20, 20), 0, 255),
        "noise": lambda i: np.clip(i + rng.normal(0, 4, i.shape), 0, 255),
    }
    for name, edit in edits.items():
        found = 0
        for _ in range(30):
            img = media.image_from_vector(rng.normal(size=64).tolist())
            as_stored = lambda i: media.unpack(media.pack(np.ascontiguousarray(i)))
            found += votes(media.features(as_stored(img)), media.features(as_stored(edit(img)))) >= media.MIN_VOTES
        assert found >= 27, (name, found)


def test_media_votes_count_around_every_vote(spark):
    ddl = "q_media_id long, m_media_id long, q_x double, q_y double, q_scale double, q_angle double, m_x double, m_y double, m_scale double, m_angle double"

    def votes(m, shifts, turns, scales=(1.0,)):
        # corners at the query's origin, so that a vote's shift is m's place
        n = max(len(shifts), len(turns), len(scales))
        at = lambda xs, k: xs[k % len(xs)]
        return [(0, m, 0.0, 0.0, 1.0 + k / 1e6, 0.0, float(at(shifts, k)), 0.0, at(scales, k) * (1.0 + k / 1e6), at(turns, k)) for k in range(n)]

    rad = lambda *ds: [d * np.pi / 180 for d in ds]
    rows = votes(1, [0, 0, 0, 20, 25, 30, 35], rad(0))  # three agree, the middle is elsewhere
    rows += votes(2, [0], rad(13, 14, 16, 17)[1:])  # turned by about 15 degrees
    rows += votes(3, [0], rad(179, -179, 178))  # turned by 180 degrees
    rows += votes(4, [0], rad(0), (1.17, 1.2, 1.19))  # on the edge of a scale's bin
    rows += votes(5, [0, 30, 60], rad(0)) + votes(6, [0], rad(0, 90, 180))  # chance
    got = {r.media_id: r.votes for r in media.consensus(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 3}
