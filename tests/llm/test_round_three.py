"""Fill-in-the-middle, hard negatives and the Jaccard join by brute force."""

import hashlib
import random
import re
from math import ceil, floor, inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.llm import fill_middle, hard_negatives, jaccard_join, parity, simhash, toxicity

ODD = [(1, None), (2, ""), (3, "a"), (4, " \n\t "), (5, "Same text here. " * 20), (6, "Same text here. " * 20), (None, "no id é"), (7, "x1 " * 20_000), (8, "\x00\x1c ▁<s>日本 😀"), (5, "Same text here. " * 20)]
CLASH = ("output", "n", "form", "x", "uid", "v", "tkey", "bag", "root", "skey", "need", "parts", "shingles", "text_key", "score")


def frame(spark, rows, ddl="doc_id long, text string"):
    return spark.createDataFrame(rows, ddl).withColumns({c: F.lit(c) for c in CLASH})


# ---- fill in the middle -----------------------------------------------------


def middle_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def by_id(rows):
    return sorted(map(tuple, rows), key=repr)


def test_middles_equal_the_definition(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab Z.\n9é😀<P>SM") for _ in range(rng.randint(0, 60)))) for i in range(400)] + ODD + [(900, "has <M> in it"), (901, "<P><S"), (902, ">S><")]
    got = fill_middle.fill_in_middle(frame(spark, rows)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(*(x := middle_by_hand(*r)), sha(x[5]), sha(r[1] or "")) for r in rows]
    assert by_id(got) == by_id(want)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    short = fill_middle.fill_in_middle(frame(spark, rows), outputs=False)
    assert "output" not in short.columns and by_id(short.collect()) == by_id(x[:5] + x[6:] for x in want)
    again = fill_middle.fill_in_middle(frame(spark, rows)).select("doc_id", fill_middle.restored_text(F.col("output"), F.col("form")).alias("t"))
    assert by_id(again.collect()) == by_id((i, t or "") for i, t in rows)


def test_middles_with_other_marks_and_none(spark):
    rows = [(i, f"word{i} and more words" * (i % 4)) for i in range(60)]
    got = fill_middle.fill_in_middle(frame(spark, rows), seed=7, middle_percent=100, spm_percent=50, sentinels=("\x01a", "\x01b", "\x01c"), unit=r"\s+\S+")
    texts = dict(rows)
    assert all(fill_middle.restored(r.output, r.form, ("\x01a", "\x01b", "\x01c")) == texts[r.doc_id] for r in got.collect())
    assert fill_middle.fill_in_middle(frame(spark, [])).count() == 0
    for bad in (("", "b", "c"), ("aba", "x", "y"), ("ab", "bc", "z"), ("abc", "b", "z"), ("a", "a", "z")):
        with pytest.raises(ValueError):
            fill_middle.checked(bad)


# ---- hard negatives ---------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int"


def negatives_by_hand(rows, anchor, n_pos=5, n_neg=10, low=30, high=90, scale=256):
    own = [(i, lab, [min(max(floor(scale * x), -(2**63)), 2**63 - 1) for x in v], k) for k, (i, v, lab) in enumerate(rows)
           if i is not None and lab is not None and v is not None and all(x is not None and abs(x) < inf for x in v)]
    out = []
    for i, lab, v, k in own:
        if not anchor(i):
            continue
        s = [(min(max(sum(x * y for x, y in zip(v, w)), -(2**63)), 2**63 - 1), j, other, kk) for j, other, w, kk in own if len(w) == len(v)]
        ranked = sorted(s, key=lambda x: (-x[0], x[1]))
        for p in [x for x in ranked if x[2] == lab and x[3] != k][:n_pos]:
            fit = [x for x in ranked if x[2] != lab and ceil_div(low * p[0], 100) <= x[0] <= (high * p[0]) // 100][:n_neg]
            out += [(i, p[1], r + 1, x[1], p[0], x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def ceil_div(a, b):
    return -(-a // b)


@pytest.mark.parametrize("tile, block", [((1024, 2048), 8192), ((3, 7), 4)])
def test_negatives_equal_brute_force(spark, monkeypatch, tile, block):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 6).round(1).tolist(), int(rng.integers(3))) for i in range(150)]
    hot = rng.normal(0, 0.3, 6).round(1).tolist()
    rows += [(i, hot, 1) for i in range(150, 220)]  # a common vector: ties
    rows += [(500, None, 1), (501, [1.0, None, 2.0], 1), (502, [nan] * 6, 2), (503, [inf] * 6, 2), (504, [1.0] * 6, None), (None, [1.0] * 6, 1), (505, [], 1), (510, [], 2), (515, [0.5], 0), (520, [0.7], 0), (525, [0.6], 1)]
    got = hard_negatives.mine(frame(spark, rows, VECTORS).repartition(5), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows, lambda i: i % 5 == 0)


def test_negatives_of_repeated_ids_and_huge_components(spark):
    rows = [(0, [2.0, 1.0], 1), (0, [2.0, 1.0], 1), (1, [1.5, 1.0], 1), (2, [1.0, 0.5], 2), (2, [1.0, 0.5], 2), (3, [0.9, 0.9], 3)]
    got = hard_negatives.mine(frame(spark, rows, VECTORS).coalesce(1), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows, lambda i: i == 0)
    big = [(0, [4e6, 3e5], 1), (1, [4.1e6, -3e5], 1), (2, [2e6, 1e5], 0), (3, [1e30, 1.0], 0), (4, [3e6, 1.0], 2), (5, [-1e30, 1.0], 1)]
    got = hard_negatives.mine(frame(spark, big, VECTORS), F.col("vec_id") <= 1)
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(big, lambda i: i <= 1)
    assert hard_negatives.mine(frame(spark, [], VECTORS), F.col("vec_id") == 0).count() == 0


def test_best_lists_merge():
    rng = random.Random(9)
    for _ in range(30):
        best = hard_negatives.Best(4, 3)
        seen = [[] for _ in range(4)]
        for _ in range(6):
            of = np.array(sorted(rng.sample(range(4), rng.randint(1, 4))))
            ids = np.array(sorted(rng.choices(range(50), k=40)))
            uids = np.arange(40) + 100 * len(seen[0])
            s = np.array([[rng.randint(-2, 2) for _ in ids] for _ in of])
            good = np.array([[rng.random() < 0.7 for _ in ids] for _ in of])
            best.add(of, s, good, ids, uids)
            for r, k in enumerate(of):
                seen[k] += [(-s[r, c], ids[c], uids[c]) for c in range(40) if good[r, c]]
        want = [(k, -x[0], x[1], x[2]) for k in range(4) for x in sorted(seen[k])[:3]]
        assert list(zip(*(x.tolist() for x in best.rows))) == want


# ---- Jaccard join -----------------------------------------------------------


def sets_of(rows, k):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def components_by_hand(rows, k=3, per_cent=90):
    sets = sets_of(rows, k)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= per_cent * len(a | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def edited(rng, words, most):
    out = list(words)
    for _ in range(rng.randint(0, most)):
        at = rng.randrange(len(out))
        out[at : at + rng.randint(0, 1)] = [f"new{rng.randint(0, 10**6)}"] * rng.randint(0, 1)
    return out


@pytest.mark.parametrize("per_cent", [90, 70])
def test_join_equals_brute_force(spark, per_cent):
    rng = random.Random(per_cent)
    rows = list(ODD)
    for family in range(12):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([3, 9, 12, 25, 60, 200, 420]))]
        rows += [(100 + 50 * family + k, " ".join(edited(rng, base, 1 + len(base) // 25))) for k in range(25)]
    chain = [f"c{i}" for i in range(120)]
    rows += [(3000 + i, " ".join(chain[2 * i :] + [f"d{j}" for j in range(2 * i)])) for i in range(25)]  # neighbours only
    passages = [[f"p{i}x{j}" for j in range(30)] for i in range(12)]
    rows += [(4000 + i, " ".join(w for p in rng.sample(passages, 6) for w in p)) for i in range(60)]  # templates
    rng.shuffle(rows)
    got = jaccard_join.similar_components(frame(spark, rows).repartition(4), per_cent=per_cent)
    assert sorted(map(tuple, got.collect()), key=repr) == components_by_hand(rows, per_cent=per_cent)


def test_join_of_nothing(spark):
    assert jaccard_join.similar_components(frame(spark, [])).count() == 0
    assert sorted(map(tuple, jaccard_join.similar_components(frame(spark, [(1, None), (2, " "), (None, "a b")])).collect()), key=repr) == [(1, 0, 1), (2, 0, 2), (None, 1, None)]


def test_linked_sets_have_parts_in_common():
    rng = np.random.default_rng(8)
    for _ in range(400):
        per_cent = int(rng.choice([60, 80, 90, 95]))
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        union_most = n * 100 // per_cent
        out = int(rng.integers(0, n + 1 - ceil(n * per_cent / 100)))
        into = int(rng.integers(0, union_most - n + 1)) if not out else 0
        b = np.unique(np.concatenate([a[out:], rng.integers(0, 2**63, into).astype(np.uint64)]))
        a = np.unique(a)
        shared = len(np.intersect1d(a, b))
        assert 100 * shared >= per_cent * (len(a) + len(b) - shared)
        (need_a, x), (need_b, y) = jaccard_join.signatures(a, per_cent), jaccard_join.signatures(b, per_cent)
        if len(a) != len(b) or (a != b).any():
            assert len(set(x) & set(y)) >= min(need_a, need_b) >= jaccard_join.LEAST_PARTS


def test_products_of_blocks(monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_COUNTS", 7)
    rng = np.random.default_rng(2)
    left = [np.unique(rng.integers(0, 30, rng.integers(0, 25))) for _ in range(9)]
    right = [np.unique(rng.integers(0, 30, rng.integers(0, 25))) for _ in range(6)]
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert jaccard_join.overlaps(left, right).tolist() == want


def test_templates_become_few_pairs():
    """Texts of 15 of 30 passages, none near another: of the pairs that share enough parts almost none has parities near enough."""
    rng = np.random.default_rng(6)
    passages = [rng.integers(0, 2**63, 40).astype(np.uint64) for _ in range(30)]
    sets = [np.unique(np.concatenate([passages[i] for i in rng.choice(30, 15, False)])) for _ in range(400)]
    keys = [set(jaccard_join.signatures(u, 90)[1]) for u in sets]
    odd = [parity.parities(u) for u in sets]
    flips = lambda x, y: sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x, y))
    met = [(i, j) for i in range(400) for j in range(i) if len(keys[i] & keys[j]) >= jaccard_join.LEAST_PARTS]
    left = [(i, j) for i, j in met if flips(odd[i], odd[j]) <= jaccard_join.most_apart(len(sets[i]) + len(sets[j]), 90)]
    assert met and len(left) <= 4


def test_parities_bound_the_difference():
    rng = np.random.default_rng(12)
    for _ in range(100):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, 20) :], rng.integers(0, 2**63, rng.integers(0, 20)).astype(np.uint64)]))
        flipped = sum((x ^ y).bit_count() if (x ^ y) >= 0 else ((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(parity.parities(a), parity.parities(b)))
        assert len(np.setxor1d(a, b)) - 12 <= flipped <= len(np.setxor1d(a, b))


def test_candidates_of_templates_do_not_grow_with_their_square(spark):
    """Texts of 15 of 30 common passages: no pair is near 0.8, and almost none becomes a candidate."""
    rng = np.random.default_rng(4)
    passages = [rng.integers(0, 2**62, 40) for _ in range(30)]
    for n in (100, 200):
        sets = [np.unique(np.concatenate([passages[i] for i in rng.choice(30, 15, False)])) for _ in range(n)]
        rows = [(bytes([i // 256, i % 256]), s.tolist(), parity.parities(s.view(np.uint64), simhash.PARITY_WORDS)) for i, s in enumerate(sets)]
        open_ = spark.createDataFrame(rows, "tkey BINARY, shingles ARRAY<LONG>, parity ARRAY<LONG>")
        roots = open_.select("tkey", F.col("tkey").alias("root"))
        got = {(bytes(r.tkey), bytes(r.other)) for r in simhash._rest(open_, roots, 0.8).collect()}
        near = {(rows[i][0], rows[j][0]) for i in range(n) for j in range(i + 1, n) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
        assert near <= got and len(got) <= len(near) + n // 10


def test_blocks_without_grams_add_nothing(spark, monkeypatch):
    """Many blocks and few histories: most blocks are empty, and the sums stay as they are."""
    none = np.zeros(0, np.uint64)
    assert toxicity._word_sums(["a", "bcd"], none, np.zeros(0)).tolist() == [0.0, 0.0]
    docs = spark.createDataFrame([(i, "aa ab " * 3 if i % 2 else "ba bb " * 3) for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    want = sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, labels).collect())
    monkeypatch.setattr(toxicity, "BLOCK_GRAMS", 1)
    assert sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, labels).collect()) == want
