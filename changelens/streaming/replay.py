"""The event log as one stream, from a cursor on: replayed and live alike, each event once, to a
folder for each run or repository."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from changelens.sources.tables import optional

#: Sequence numbers that share a state: one bit for each, none once all have been seen.
SHIFT = 12
BLOCK = 1 << SHIFT


def once(stream: DataFrame, seq: str = "seq") -> DataFrame:
    """Each sequence number the first time it comes, in whatever order and however late. What has been
    seen is a bit in the state of its block, and a full block costs nothing; no watermark forgets."""
    names = stream.columns

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else bytes(BLOCK // 8)
        if not held:
            return  # all of this block has been delivered
        seen = np.unpackbits(np.frombuffer(held, np.uint8))
        for frame in frames:
            at = frame[seq].to_numpy() - (key[0] << SHIFT)
            _, first = np.unique(at, return_index=True)
            first = np.sort(first[seen[at[first]] == 0])
            seen[at[first]] = 1
            yield frame.iloc[first][names]
        state.update((b"" if seen.all() else np.packbits(seen).tobytes(),))

    own = stream.withColumn("_block", F.shiftright(seq, SHIFT)).groupBy("_block")
    return own.applyInPandasWithState(step, stream.schema, "seen BINARY", "append", GroupStateTimeout.NoTimeout)


def after(stream: DataFrame, cursor: int, run_id: str | None = None, repo: str | None = None) -> DataFrame:
    """Events behind the cursor, of one run or repository if asked for. Transient events (seq 0) are never replayed."""
    return once(stream.where((F.col("seq") > F.lit(max(cursor, 0))) & optional("run_id", run_id) & optional("repo", repo)))


def fan_out(stream: DataFrame, path: str, checkpoint: str, by: list[str], once_only: bool = False) -> None:
    """Writes what is there now to folders by the columns `by`, and stops. A batch that is run again after a
    failure replaces its own folder, so nothing is written twice. once_only takes a single batch."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    query = (writer.trigger(once=True) if once_only else writer.trigger(availableNow=True)).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def delivered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All that fan_out() wrote to a path, with the number of its batch."""
    return spark.read.schema(schema + ", batch LONG").option("basePath", path).parquet(path)


def gaps(events: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """(by, after, before): holes in the sequence numbers of each key."""
    w = Window.partitionBy(*by).orderBy(seq)
    own = events.select(*by, F.col(seq).alias("after"), F.lead(seq).over(w).alias("before"))
    return own.where("before > after + 1")
