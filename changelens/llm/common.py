"""What the training-data operators share: shared storage, Arrow batches, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only on one machine, where the session names
    none, a temporary folder is made and named in the session; a cluster must name one."""
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="changelens-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/changelens/{name}-{uuid.uuid4().hex}"


#: Rows that go to Python at once while a table is written.
ARROW_ROWS = 1024
_ARROW_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python functions that run inside get so many rows at once, or fewer if the session says so."""
    old = spark.conf.get(_ARROW_KEY)
    spark.conf.set(_ARROW_KEY, min(rows, int(old)) if int(old) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(_ARROW_KEY, old)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again."""
    path = new_path(spark, name)
    with arrow_rows(spark, ARROW_ROWS):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._changelens_path = path
    return out


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table that written() made and that no plan reads any more."""
    path = getattr(df, "_changelens_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_to_batches(
    rows: Iterator[tuple], schema: pa.Schema, most_rows: int = 4096, most_bytes: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """Packs tuples into batches that hold few rows and few bytes."""
    cols: list[list] = [[] for _ in schema]
    held = 0
    for row in rows:
        for c, v in zip(cols, row):
            c.append(v)
            if isinstance(v, (bytes, str)):
                held += len(v)
            elif isinstance(v, list):
                held += 40 * len(v)
        if len(cols[0]) >= most_rows or held >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
            cols, held = [[] for _ in schema], 0
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[tuple], tuple | None]], out: pa.Schema, ddl: str
) -> DataFrame:
    """One output row for each input row, in Arrow batches. make() runs once in
    each Python task and returns the row function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()

        def rows() -> Iterator[tuple]:
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    yield from map(fn, zip(*(c.to_pylist() for c in part.columns)))

        yield from rows_to_batches(rows(), out)

    return df.mapInArrow(run, ddl)


def components(spark: SparkSession, edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges(a, b), any orderable type, as (node, root):
    root is the smallest node reachable. Alternates large-star and small-star
    steps until the edge list stays as it is; each step's edges are a table in
    the shared folder, so a lost executor costs one step at most. A node with
    many neighbours is only ever the key of a min() with map-side combine or
    one side of a splittable join; no neighbour list is ever gathered. What is returned
    reads one table, which dropped() deletes."""
    e = edges.where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = written(spark, e, name)
    seen = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while seen[0]:
        both = state.select("u", "v").union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u go to the smallest node around u
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: smaller neighbours and u itself go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        step = written(spark, small.where("u <> v").distinct(), name)
        now = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(spark, state)
        state = step
        if tuple(now) == tuple(seen):
            break
        seen = now
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    out._changelens_path = state._changelens_path
    return out
