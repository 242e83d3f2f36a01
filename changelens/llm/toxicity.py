"""Toxicity by class-conditional Kneser-Ney models.

Two character models, toxic and ordinary, give each word its likelihood: interpolated
Kneser-Ney of order ORDER, padded at the word's start. Each class discounts its own
counts at the longest order; below it both back off along one chain of continuation
counts that the classes share, down to equally likely characters, so what is rare in
both is equally likely in both. Every distribution sums to one.

A toxic text is mostly ordinary words, so its words come from both models: a share
SHARE from the toxic one, the rest from the ordinary one. The log-likelihood ratio of
a text, toxic against ordinary, adds log(SHARE e^r + 1 - SHARE) for each word, r being
the word's own log ratio: ordinary words count against, each by log(1 - SHARE) at most,
toxic ones for it. Words whose r is MARGIN or less count with that bound, so only the
others need a table; that moves a word by log(1 + SHARE e^MARGIN) at most. Divided by
the text's number of words, and by its square root, the ratio is two numbers a text,
and a logistic curve fitted on a fold of the labelled rows that no count has seen makes
them a score from 0 to 1.

Counts are of all labelled training rows and none is left out. They and the chain are
gathered and joined by Spark. All distinct words meet the n-grams, as sorted hashes, in
blocks of about BLOCK_GRAMS, a word's parts are summed, and the texts then meet the words
that are evidence in blocks of about BLOCK_BYTES: what is broadcast is bounded.

Cases: null and empty texts have no words and get the score of a text without
evidence. Rows without a label, or with a null one, are scored and not learned
from; of several labels for one doc_id the larger holds. Without
labelled rows all scores are low. Very long texts are scored whole; repeated
rows get the same score. An empty table gives no rows. Further columns are
ignored by score(), and kept by keep_ordinary(), whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, map_rows, rows_to_batches, spare, written

ORDER, DISCOUNT, SHARE, MARGIN = 6, 0.75, 0.005, 2.0
#: N-grams (12 bytes each), and bytes of words, that are broadcast at once.
BLOCK_GRAMS, BLOCK_BYTES = 4_000_000, 64 << 20
#: Words that a worker holds before it hands them on.
HELD_WORDS = 20_000
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1

_WORD = re.compile(r"\w+")
_PAD = "^" * (ORDER - 1)


def _grams(word: str) -> Iterator[str]:
    s = _PAD + word + "$"
    return (s[j : j + ORDER] for j in range(len(word) + 1))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary) summed over all rows of labelled(toxic, text)."""
    schema = pa.schema([("gram", pa.string()), ("toxic", pa.int64()), ("ordinary", pa.int64())])

    def run(batches):
        words = {0: Counter(), 1: Counter()}

        def flush():
            for c in (0, 1):
                own: Counter = Counter()
                for w, n in words[c].items():
                    for g in _grams(w):
                        own[g] += n
                words[c].clear()
                yield from ((g, n, 0) if c else (g, 0, n) for g, n in own.items())

        def rows():
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    for c, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        if text:
                            words[1 if c else 0].update(_WORD.findall(text.lower()))
                    if len(words[0]) + len(words[1]) > HELD_WORDS:
                        yield from flush()
            yield from flush()

        yield from rows_to_batches(rows(), schema)

    found = labelled.select("toxic", "text").mapInArrow(run, "gram string, toxic long, ordinary long")
    return found.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def shared_chain(grams: DataFrame) -> DataFrame:
    """(gram, shared) of grams(gram), distinct and of one length: the likelihood of the last
    character after those between it and the first, by interpolated Kneser-Ney over
    continuation counts: in how many grams one character longer a gram is the end."""
    levels = []
    longer, length = grams.select("gram"), ORDER
    while length > 1:
        length -= 1
        longer = longer.groupBy(F.substring("gram", 2, length).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.append((length, longer))
    # the shortest: single characters, over equally likely ones
    likely = None
    for length, level in reversed(levels):
        history = F.substring("gram", 1, length - 1)
        totals = level.groupBy(history.alias("h")).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
        own = level.withColumns({"h": history, "end": F.substring("gram", 2, length - 1)}).join(totals.hint("merge"), "h")
        below = 1 / F.col("kinds") if likely is None else F.col("below")
        if likely is not None:
            own = own.join(likely.select(F.col("gram").alias("end"), F.col("p").alias("below")).hint("merge"), "end")
        p = (F.col("n") - DISCOUNT) / F.col("all") + DISCOUNT * F.col("kinds") / F.col("all") * below
        likely = own.select("gram", p.alias("p"))
    out = grams.select("gram", F.substring("gram", 2, ORDER - 1).alias("end"))
    return out.join(likely.select(F.col("gram").alias("end"), F.col("p").alias("shared")).hint("merge"), "end").select("gram", "shared")


def likelihoods(counts: DataFrame) -> DataFrame:
    """(gram, history, p0, p1, rest0, rest1) for each gram of counts(gram, toxic, ordinary): the
    likelihood of its last character after the others in the ordinary and the toxic model,
    and what either leaves there to the shared chain."""
    c = counts.select(
        "gram",
        F.substring("gram", 1, ORDER - 1).alias("history"),
        F.col("ordinary").alias("x0"),
        F.col("toxic").alias("x1"),
    )
    seen = [x for i in (0, 1) for x in (F.sum(f"x{i}").alias(f"n{i}"), F.count_if(F.col(f"x{i}") > 0).alias(f"kinds{i}"))]
    by_history = c.groupBy("history").agg(*seen)
    own = c.join(shared_chain(c).hint("merge"), "gram").join(by_history.hint("merge"), "history")

    def rest(i: int) -> Column:
        return F.when(F.col(f"n{i}") > 0, DISCOUNT * F.col(f"kinds{i}") / F.col(f"n{i}")).otherwise(1.0)

    def likely(i: int) -> Column:
        more = F.when(F.col(f"n{i}") > 0, F.greatest(F.col(f"x{i}") - DISCOUNT, F.lit(0.0)) / F.col(f"n{i}"))
        return F.coalesce(more, F.lit(0.0)) + rest(i) * F.col("shared")

    return own.select("gram", "history", *(f(i).alias(f"{n}{i}") for n, f in (("p", likely), ("rest", rest)) for i in (0, 1)))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(key, history, ratio): log P(last character | history) of the toxic model less that of the
    ordinary one, for each gram of counts and, with the history as key, for what was
    never seen after that history (there the shared chain cancels out). A table."""
    own = written(counts.sparkSession, likelihoods(counts), "toxicity-likelihoods")
    never = own.groupBy(F.col("history").alias("key")).agg(F.first(F.log(F.col("rest1") / F.col("rest0"))).alias("ratio"))
    never = never.select("key", F.col("key").alias("history"), "ratio")
    out = own.select(F.col("gram").alias("key"), "history", F.log(F.col("p1") / F.col("p0")).alias("ratio")).union(never)
    out = written(counts.sparkSession, out, "toxicity-ratios")
    dropped(counts.sparkSession, own)
    return out


def distinct_words(docs: DataFrame) -> DataFrame:
    """(word) of all texts of docs(text)."""
    schema = pa.schema([("word", pa.string())])

    def run(batches):
        def rows():
            words: set[str] = set()
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    for text in b.column(0).slice(lo, 256).to_pylist():
                        if text:
                            words.update(_WORD.findall(text.lower()))
                    if len(words) > HELD_WORDS:
                        yield from ((w,) for w in words)
                        words.clear()
            yield from ((w,) for w in words)

        yield from rows_to_batches(rows(), schema)

    return docs.select("text").mapInArrow(run, "word string").distinct()


def _blocks(spark: SparkSession, table: DataFrame, key: str, columns: list[str], blocks: int) -> Iterator[Broadcast]:
    """table(columns: a name, a number) as broadcast dicts, dealt by key; each is given
    up when the next is asked for."""
    for k in range(blocks):
        part = table.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k).select(*columns)
        held = spark.sparkContext.broadcast(dict(map(tuple, part.toLocalIterator())))
        yield held
        held.destroy()


def _word_sums(words: list[str], keys: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """For each word the sum of the ratios of its grams, or of their histories where a gram
    is unknown, by keys (sorted XXH64, seed 42) and their ratios."""
    from xxhash import xxh64_intdigest as xxh

    if not len(keys):  # a block that no history was dealt to
        return np.zeros(len(words))
    grams = [g for w in words for g in _grams(w)]
    of = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
    h = np.array([xxh(g.encode(), 42) for g in grams], np.uint64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = keys[at] == h
    out = np.bincount(of[hit], ratios[at[hit]], len(words))
    miss = np.flatnonzero(~hit)
    h = np.array([xxh(grams[k][:-1].encode(), 42) for k in miss.tolist()], np.uint64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = keys[at] == h
    return out + np.bincount(of[miss[hit]], ratios[at[hit]], len(words))


def evidence(docs: DataFrame, counts: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(word, weight) of the words of docs(text) whose log P(word | toxic) - log P(word |
    ordinary) is over the margin, weight being what the word adds to a text's log-likelihood
    ratio; a table."""
    spark = docs.sparkSession
    ratios = log_ratios(counts)
    words = written(spark, distinct_words(docs), "toxicity-words")
    schema = pa.schema([("word", pa.string()), ("ratio", pa.float64())])
    n, parts = ratios.count(), []
    blocks = max(1, -(-n // BLOCK_GRAMS))
    for k in range(blocks if n else 0):
        part = ratios.where(F.pmod(F.xxhash64("history"), F.lit(blocks)) == k)
        got = part.select(F.xxhash64("key").alias("k"), F.col("ratio").cast("float").alias("ratio")).toArrow()
        keys = got.column(0).to_numpy().view(np.uint64)
        order = np.argsort(keys)
        held = spark.sparkContext.broadcast((keys[order], got.column(1).to_numpy()[order]))

        def run(batches, held=held):
            for b in batches:
                for lo in range(0, b.num_rows, 2048):
                    own = b.column(0).slice(lo, 2048)
                    yield pa.RecordBatch.from_arrays([own, pa.array(_word_sums(own.to_pylist(), *held.value))], schema=schema)

        own = words.mapInArrow(run, "word string, ratio double").where("ratio <> 0")
        parts.append(written(spark, own, "toxicity-parts"))
        held.destroy()
    sums = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "word string, ratio double")
    sums = sums if len(parts) < 2 else sums.groupBy("word").agg(F.sum("ratio").alias("ratio"))
    weight = F.log(F.lit(SHARE) * F.exp(F.least(F.col("ratio"), F.lit(500.0))) + F.lit(1 - SHARE))
    out = written(spark, sums.where(F.col("ratio") > margin).select("word", weight.alias("weight")), "toxicity-evidence")
    for x in (ratios, words, *parts):
        dropped(spark, x)
    return out


def features(total: float, n: int) -> tuple[float, float]:
    """Of a text of n words whose evidence sums up to total, above log(1 - SHARE) a word: its
    log-likelihood ratio for each word, and for the square root of their number, as logs."""
    return (math.log(1e-4 + total / n), math.log(1e-2 + total / math.sqrt(n))) if n else (math.log(1e-4), math.log(1e-2))


def _key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def text_features(base: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, tkey, x, y) for each row of base(doc_id, text), by evidence words(word, weight);
    tkey is a digest of the text. A table."""
    spark = base.sparkSession
    size = words.agg(F.sum(F.octet_length("word") + 100)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = pa.schema([("doc_id", pa.int64()), ("tkey", pa.binary()), ("x", pa.float64()), ("y", pa.float64())])
    ddl = "doc_id long, tkey binary, x double, y double"
    keyed = pa.schema([("tkey", pa.binary()), ("total", pa.float64()), ("n", pa.int64())])
    least = math.log(1 - SHARE)
    parts: list[DataFrame] = []
    for held in _blocks(spark, words, "word", ["word", "weight"], blocks):

        def make(held=held):
            get = held.value.get

            def sums(r):
                ws = _WORD.findall(r[-1].lower()) if r[-1] else []
                total, n = sum([got - least for got in map(get, ws) if got is not None]), len(ws)
                return (*r[:-1], *features(total, n)) if blocks == 1 else (*r[:-1], total, n)

            return sums

        if blocks == 1:
            parts.append(written(spark, map_rows(base.select("doc_id", _key().alias("tkey"), "text"), make, out, ddl), "toxicity-scores"))
        else:  # equal texts have equal sums
            own = map_rows(base.select(_key(), "text"), make, keyed, "tkey binary, total double, n long")
            parts.append(written(spark, own.groupBy("tkey").agg(F.max("total").alias("total"), F.max("n").alias("n")), "toxicity-parts"))
    if blocks == 1:
        return parts[0]
    all_ = reduce(DataFrame.union, parts).groupBy("tkey").agg(F.sum("total").alias("total"), F.max("n").alias("n"))
    own = base.select("doc_id", _key().alias("tkey")).join(all_.hint("merge"), "tkey").select("doc_id", "tkey", "total", "n")
    seen = written(spark, map_rows(own, lambda: lambda r: (*r[:2], *features(*r[2:])), out, ddl), "toxicity-scores")
    for x in parts:
        dropped(spark, x)
    return seen


def logistic(bins: list[tuple[float, float, int, int]], rounds: int = 50) -> list[float]:
    """Weights (constant, x, y) from (x, y, label, rows), by Newton steps with a ridge."""
    if not bins:  # nothing is known: nothing is called toxic
        return [-2.0, 0.0, 0.0]
    a = np.array([[1.0, x, y] for x, y, _, _ in bins])
    label = np.array([b[2] for b in bins], float)
    count = np.array([b[3] for b in bins], float)
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (count * (p - label)) + ridge @ w
        hess = (a * (count * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + ridge
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
    return w.tolist()


def _scores(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tkey, held_out, score, predicted) for each row of docs, and the table it reads."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    own = labels.where("doc_id is not null and toxic is not null")
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # labels grow with the input: never broadcast
    train = (fold != HELD_OUT) & (fold != CALIBRATION)
    counts = written(spark, gram_counts(base.where(train).join(own.where(train).hint("merge"), "doc_id")), "toxicity-counts")
    words = evidence(base, counts)
    seen = text_features(base, words)
    for x in (counts, words):
        dropped(spark, x)
    fitted = seen.where(fold == CALIBRATION).join(own.hint("merge"), "doc_id")
    bins = fitted.groupBy(F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), "toxic").agg(F.count(F.lit(1)).alias("n"))
    w = logistic([(r["x"], r["y"], r["toxic"], r["n"]) for r in bins.collect()])  # a few thousand bins at most
    z = F.lit(w[0]) + F.lit(w[1]) * F.col("x") + F.lit(w[2]) * F.col("y")
    p = 1 / (1 + F.exp(-z))
    scored = seen.select(
        "doc_id",
        "tkey",
        F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
        p.alias("score"),
        (p >= 0.5).cast("int").alias("predicted"),
    )
    return scored, seen


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    return _scores(docs, labels, id_col, text_col)[0].drop("tkey")


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic; all columns stay. Scores depend on texts alone,
    so rows go by their text: null and shared doc_ids make no difference."""
    spark = docs.sparkSession
    scored, seen = _scores(docs, labels, "doc_id", "text")
    key = spare(docs, "tkey")
    bad = written(spark, scored.where("predicted = 1").select(F.col("tkey").alias(key)).distinct(), "toxicity-bad")
    dropped(spark, seen)
    return docs.withColumn(key, _key()).join(bad.hint("merge"), key, "left_anti").select(*docs.columns)
