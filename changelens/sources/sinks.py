"""Writes expressed as rewrites: upserts, insert-or-ignore, swaps, cascades, backup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None, keep_old: tuple[str, ...] = (), update: tuple[str, ...] | None = None) -> DataFrame:
    """old with the rows of new: of rows with one key the last of new wins. Columns in
    keep_old, or not in update where that is given, stay as they were. One shuffle."""
    columns = old.columns
    stay = set(keep_old) if update is None else {c for c in columns if c not in update}
    stay -= set(keys)
    rank = F.col(order) if order else F.lit(0)
    both = old.select(*columns, F.lit(0).alias("_new"), F.lit(None).cast("double").alias("_at")).unionByName(
        new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in columns], F.lit(1).alias("_new"), rank.cast("double").alias("_at"))
    )
    last, first = F.struct("_new", F.coalesce("_at", F.lit(float("-inf")))), F.struct("_new", F.coalesce("_at", F.lit(float("-inf"))))
    rest = [c for c in columns if c not in keys]
    agg = [(F.min_by(F.struct(c), first) if c in stay else F.max_by(F.struct(c), last)).getField(c).alias(c) for c in rest]
    return both.groupBy(*keys).agg(*agg).select(*columns)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new in place of those with the same keys; others are never removed."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def swap_partition(old: DataFrame, new: DataFrame, **partition) -> DataFrame:
    """All rows of a partition replaced at once, even by none."""
    same = F.lit(True)
    for name, value in partition.items():
        same = same & (F.col(name) == F.lit(value))
    return old.where(~F.coalesce(same, F.lit(False))).unionByName(new.where(same))


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites just the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_events(new: DataFrame, head: int, order: list[Column]) -> DataFrame:
    """new with seq from head + 1 on. Numbers need one order of all new rows, and a
    batch of appended events is small; the log itself is not read."""
    return new.withColumn("seq", F.lit(head).cast("long") + F.row_number().over(Window.orderBy(*order)))


def numbered(old: DataFrame, new: DataFrame) -> DataFrame:
    """New self-descriptions, one for each (repo, sha) not stored yet, numbered on."""
    fresh = new.dropDuplicates(["repo", "sha"]).join(old.select("repo", "sha"), ["repo", "sha"], "left_anti")
    most = old.groupBy("repo").agg(F.max("number").alias("_most"))
    w = Window.partitionBy("repo").orderBy(F.asc_nulls_first("built_at"), "sha")
    number = (F.coalesce("_most", F.lit(0)) + F.row_number().over(w)).cast("int")
    return fresh.join(most, "repo", "left").withColumn("number", number).drop("_most").select(*old.columns)


def updated(df: DataFrame, where: Column, **values) -> DataFrame:
    return df.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def acknowledged(df: DataFrame, ids: list[str], at: float) -> DataFrame:
    return updated(df, F.col("id").isin(*ids) & F.col("acknowledged_at").isNull(), acknowledged_at=at)


def cascade(tables: dict[str, DataFrame], repo: str) -> dict[str, DataFrame]:
    """Tables without a repository and all that hangs on it."""
    out = dict(tables)
    gone_runs = tables["runs"].where(F.col("repo") == repo).select(F.col("id").alias("run_id"))
    gone_obs = tables["observations"].join(gone_runs, "run_id", "left_semi").select(F.col("id").alias("observation_id"))
    for name in ("pulls", "runs"):
        out[name] = tables[name].where(F.col("repo") != repo)
    out["repos"] = tables["repos"].where(F.col("slug") != repo)
    for name in ("jobs", "observations"):
        if name in tables:
            out[name] = tables[name].join(gone_runs, "run_id", "left_anti")
    for name in ("adjudications", "suggestions"):
        if name in tables:
            out[name] = tables[name].join(gone_obs, "observation_id", "left_anti")
    return out


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of all tables, in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def backup(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    counts(tables).coalesce(1).write.parquet(f"{path}/manifest")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a backup; an error if a count is not that of the manifest."""
    manifest = {r["name"]: r["rows"] for r in spark.read.parquet(f"{path}/manifest").collect()}  # a row for each table
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in manifest}
    found = {r["name"]: r["rows"] for r in counts(tables).collect()}
    if found != manifest:
        raise ValueError(f"the backup is damaged: {found} instead of {manifest}")
    return tables


def migrated(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """df with the columns it lacks, at their defaults."""
    return df.withColumns({c: v for c, v in added.items() if c not in df.columns})


def canonical_json(df: DataFrame, column: str, sets: tuple[str, ...] = ()) -> Column:
    """JSON of a column of df with keys in order at every depth, nulls kept, and the arrays
    named in sets sorted: equal values give equal texts."""

    def ordered(c: Column, kind: DataType, name: str) -> Column:
        match kind:
            case StructType():
                fields = [ordered(c[f.name], f.dataType, f.name).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
                return F.when(c.isNotNull(), F.struct(*fields))
            case ArrayType():
                own = F.transform(c, lambda x: ordered(x, kind.elementType, name))
                return F.sort_array(own) if name in sets else own
            case MapType():
                return F.map_from_entries(F.sort_array(F.transform(F.map_entries(c), lambda e: F.struct(e["key"], ordered(e["value"], kind.valueType, name)))))
            case _:
                return c

    return F.to_json(ordered(F.col(column), df.schema[column].dataType, column), {"ignoreNullFields": "false"})


def append_json_lines(rows: DataFrame, path: str) -> None:
    """Appends rows to a folder of JSON lines, with the time they are written at as `ts`."""
    rows.withColumn("ts", F.unix_micros(F.current_timestamp()) / 1e6).write.mode("append").json(path)


def tolerant_json(text: Column, ddl: str, fallback: Column) -> Column:
    return F.coalesce(F.from_json(text, ddl, {"mode": "PERMISSIVE"}), fallback)
