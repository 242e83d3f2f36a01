"""Hard negatives by blocked dense matrix products.

Vectors are rounded down to whole multiples of 1/scale, so that scores are whole numbers and
results are the same in any order of summation. Anchors are taken in blocks of a bounded
number of rows and bytes; a block is broadcast, and each task multiplies it with its own
candidates, tile by tile, in float64. Products are exact below 2^53; a tile whose bound
lies above that is multiplied in whole numbers of any size.

First pass: each task keeps the best rows of the same label for every anchor, as many as
there may be positives; such lists merge into the lists of all tasks by a ranking with a
limit ahead of the shuffle. Second pass: for each anchor and positive each task keeps the
best rows of other labels whose score lies in the window that the positive's score sets;
they merge the same way. Nothing grows with a label, a vector or a pair: a task holds a
tile of scores and the lists of one block, the driver one block and its positives, and a
block's rows are written before the next one begins. A lost executor costs its tasks of
one block, since candidates are read from a table in the shared folder.

Cases: rows with a null label, a null vector or a null or non-finite component take no part,
and neither do rows with a null id. Labels are whole numbers. Rows with equal ids are rows
of their own: each is an anchor, a positive or a negative by itself, ties between them go
by an order that is fixed once the rows are written. Vectors of different lengths have no
product and are not compared; empty ones have score 0. Components and scores that do not
fit a long are the nearest long. Anchors with no other row of their label, and
positives with nothing in their window, give no rows, nor does an empty table. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, new_path, written

#: Of a block of anchors that is broadcast: rows, and bytes of its vectors.
BLOCK_ROWS, BLOCK_BYTES = 8192, 32 << 20
#: Of a tile of scores: anchors and candidates.
TILE = (1024, 2048)
EXACT = 2**53
_LEAST, _MOST = -(2**63), 2**63 - 1

_DDL = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v array<long>) of the rows that take part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & finite)
    rounded = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return own.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), rounded.alias("v"))


def _numbers(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(np.int64)


def tiles(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[dict]:
    """Candidates (uid, vec_id, label, v), `most` of one vector length at once, by id."""
    for batch in batches:
        uid, ids, labels = (_numbers(c) for c in batch.columns[:3])
        vectors = batch.column(3)
        flat = _numbers(vectors.flatten())
        dims = _numbers(vectors.value_lengths())
        starts = np.cumsum(dims) - dims
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            own = own[np.lexsort((uid[own], ids[own]))]
            for lo in range(0, len(own), most):
                k = own[lo : lo + most]
                v = flat[starts[k][:, None] + np.arange(d)]
                yield {"uid": uid[k], "id": ids[k], "label": labels[k], "v": v, "dim": int(d)}


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b, as longs."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = int(np.abs(a.astype(float)).max()) * int(np.abs(b.astype(float)).max()) * a.shape[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, _LEAST, _MOST).astype(np.int64)


class Best:
    """For each of n lists the k best of (score, id, uid): high scores, then small ids. Can
    be merged: the best of two parts are the best of their lists."""

    def __init__(self, n: int, k: int):
        self.k, self.last = k, np.full(n, _LEAST)
        self.rows = [np.zeros(0, np.int64)] * 4  # list, score, id, uid

    def add(self, of: np.ndarray, s: np.ndarray, good: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        """Scores s of the lists `of` (lines) with candidates in order of their ids (columns), where good."""
        good = good & (s >= self.last[of][:, None])
        if np.count_nonzero(good) > 8 * self.k * len(of) and s.shape[1] > self.k:
            held = np.where(good, s, _LEAST)
            edge = np.partition(held, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k][:, None]
            even = good & (s == edge)
            good = (good & (s > edge)) | (even & (np.cumsum(even, axis=1) <= self.k))
        r, c = np.nonzero(good)
        if len(r):
            self._merge(of[r], s[r, c], ids[c], uids[c])

    def _merge(self, *new: np.ndarray) -> None:
        of, s, ids, uids = (np.concatenate([x, y]) for x, y in zip(self.rows, new))
        order = np.lexsort((uids, ids, np.bitwise_not(s), of))
        of, s, ids, uids = (x[order] for x in (of, s, ids, uids))
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep = place < self.k
        self.rows = [x[keep] for x in (of, s, ids, uids)]
        full = place[keep] == self.k - 1
        self.last[self.rows[0][full]] = self.rows[1][full]


def _block_of(rows: list) -> dict:
    """Anchors by vector length, in one structure that is broadcast."""
    uid, ids, labels = (np.array([r[c] for r in rows], np.int64) for c in ("uid", "vec_id", "label"))
    by_dim: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by_dim.setdefault(len(r["v"]), []).append(i)
    parts = {d: (np.array(i), np.array([rows[j]["v"] for j in i], np.int64).reshape(len(i), d)) for d, i in by_dim.items()}
    return {"uid": uid, "id": ids, "label": labels, "parts": parts}


def blocks(anchors: DataFrame, most_rows: int, most_bytes: int) -> Iterator[dict]:
    """Anchors in blocks; the driver holds one partition's rows and one block."""
    rows: list = []
    held = 0
    for r in anchors.toLocalIterator():
        rows.append(r)
        held += 8 * len(r["v"])
        if len(rows) >= most_rows or held >= most_bytes:
            yield _block_of(rows)
            rows, held = [], 0
    if rows:
        yield _block_of(rows)


def _against(block: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(anchors, scores, candidates) of each tile."""
    for t in tiles(batches, TILE[1]):
        if t["dim"] in block["parts"]:
            index, vectors = block["parts"][t["dim"]]
            for lo in range(0, len(index), TILE[0]):
                yield index[lo : lo + TILE[0]], scores(vectors[lo : lo + TILE[0]], t["v"]), t


def _ranked(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "uid")
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def _positives(candidates: DataFrame, block, most: int) -> DataFrame:
    """(anchor, score, id, uid, rank): an anchor's best other rows of its label; anchor is its
    place in the block."""
    out = pa.schema([(c, pa.int64()) for c in ("anchor", "score", "id", "uid")])

    def run(batches):
        b = block.value
        best = Best(len(b["uid"]), most)
        for of, s, t in _against(b, batches):
            good = (b["label"][of][:, None] == t["label"]) & (b["uid"][of][:, None] != t["uid"])
            best.add(of, s, good, t["id"], t["uid"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best.rows], schema=out)

    return _ranked(candidates.mapInArrow(run, "anchor long, score long, id long, uid long"), ["anchor"], most)


def _negatives(candidates: DataFrame, block, asked, most: int) -> DataFrame:
    """(ask, score, id, uid, rank): the best rows of other labels in the window of each of
    `asked` (anchor's place, lowest and highest score)."""
    out = pa.schema([(c, pa.int64()) for c in ("ask", "score", "id", "uid")])

    def run(batches):
        b, (anchor, low, high) = block.value, asked.value
        slots: list[np.ndarray] = []  # each names one ask of an anchor, or -1
        order = np.argsort(anchor, kind="stable")
        turn = np.arange(len(anchor)) - np.searchsorted(anchor[order], anchor[order])
        for k in range(int(turn.max()) + 1 if len(turn) else 0):
            slot = np.full(len(b["uid"]), -1)
            slot[anchor[order][turn == k]] = order[turn == k]
            slots.append(slot)
        best = Best(len(anchor), most)
        for of, s, t in _against(b, batches):
            other = b["label"][of][:, None] != t["label"]
            for slot in slots:
                ask = slot[of]
                own = ask >= 0
                k = ask[own]
                good = other[own] & (s[own] >= low[k][:, None]) & (s[own] <= high[k][:, None])
                best.add(k, s[own], good, t["id"], t["uid"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best.rows], schema=out)

    return _ranked(candidates.mapInArrow(run, "ask long, score long, id long, uid long"), ["ask"], most)


def mine(
    rows: DataFrame,
    anchors: Column,
    n_positives: int = 5,
    n_negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): anchors are the
    rows where the condition on vec_id holds, positives their best rows of the same label, negatives
    the best rows of other labels whose score is in the window, in per cent of the positive's. A table."""
    spark = rows.sparkSession
    own = usable(rows, id_col, vector_col, label_col, scale).withColumn("uid", F.monotonically_increasing_id())
    own = written(spark, own.select("uid", "vec_id", "label", "v"), "negatives-rows")
    path = new_path(spark, "negatives")
    spark.createDataFrame([], _DDL).write.parquet(path)
    for b in blocks(own.where(anchors), BLOCK_ROWS, BLOCK_BYTES):
        block = spark.sparkContext.broadcast(b)
        # at most n_positives rows for each anchor of the block
        found = _positives(own, block, n_positives).select("anchor", "score", "id").collect()
        anchor, score, ids = (np.array([r[c] for r in found], np.int64) for c in ("anchor", "score", "id"))
        low = np.array([-(-window[0] * int(p) // 100) for p in score], np.int64)
        high = np.array([window[1] * int(p) // 100 for p in score], np.int64)
        asked = spark.sparkContext.broadcast((anchor, low, high))
        got = _negatives(own, block, asked, n_negatives)
        named = [(k, int(b["id"][a]), int(p), int(s)) for k, (a, p, s) in enumerate(zip(anchor, ids, score))]
        names = spark.createDataFrame(named, "ask long, anchor_id long, positive_id long, positive_score long")
        got = got.join(F.broadcast(names), "ask") if named else got.join(names, "ask")
        got = got.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        got.write.mode("append").parquet(path)
        asked.unpersist()
        block.unpersist()
    dropped(spark, own)
    return spark.read.schema(_DDL).parquet(path)
