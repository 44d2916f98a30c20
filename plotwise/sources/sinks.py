"""Sinks: append, replace, upsert, run log, reproducible CSV and JSON."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def insert(df: DataFrame, path: str, replace: bool = False) -> None:
    """Adds rows with one time of ingestion."""
    df.withColumn("ingested_at", F.current_timestamp()).write.mode("overwrite" if replace else "append").parquet(path)


def write_csv(df: DataFrame, path: str, *order: Column | str) -> None:
    """Rows in a fixed order; nested values as JSON, quotes doubled."""
    kinds = dict(df.dtypes)
    flat = df.orderBy(*order).select(*((F.to_json(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c)).alias(c) for c in df.columns))
    flat.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", lineSep="\n")


def csv_lines(df: DataFrame) -> DataFrame:
    """One RFC 4180 text per row."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        text = F.coalesce(F.to_json(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c).cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return df.select(F.array_join(F.array(*map(cell, df.columns)), ",").alias("line"))


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def unique_or_fail(df: DataFrame, key: str) -> DataFrame:
    """Fails when a key occurs twice."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    twice = F.raise_error(F.concat(F.lit(f"{key} occurs twice: "), F.col(key).cast("string")))
    counted = n.withColumn("_n", F.when(F.col("_n") == 1, F.col("_n")).otherwise(twice.cast("bigint")))
    return df.join(counted, key).where("_n = 1").drop("_n")


def run_source(spark: SparkSession, name: str, run_id: str, log: str, work) -> DataFrame:
    """Does the work and logs rows or failure; a failure is logged and raised again."""
    row = lambda status, n, error: spark.createDataFrame([(run_id, name, status, n, error)], "run_id string, source string, status string, n_rows bigint, error string").withColumn("ended_at", F.current_timestamp())
    try:
        out = work()
        n = out.count()
    except Exception as error:
        row("failed", None, str(error)[:500]).write.mode("append").parquet(log)
        raise
    row("done", n, None).write.mode("append").parquet(log)
    return out


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one frame that the other has not, as often as it lacks them; times of change are left out."""
    shared = [c for c in a.columns if c in b.columns and not c.endswith("_at")]
    a, b = a.select(*shared), b.select(*shared)
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


class Store:
    """Tables of a folder that are rebuilt together, beside others that are kept from build to build.

    ``build-<n>`` holds the tables of a build; ``manifests/<n>.json``, renamed into place after all of them are written,
    says where each table is.  Readers see the last manifest, so that a build that fails leaves the old tables as they
    are, and all of a build's tables appear at once.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def builds(self) -> list[int]:
        at = self.path(f"{self.folder}/manifests")
        names = [f.getPath().getName() for f in self.files.listStatus(at)] if self.files.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def tables(self) -> dict[str, str]:
        """Name to folder, of the last build; a row a table."""
        done = self.builds()
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{done[-1]}.json").first()[0]) if done else {}

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """A table; with a schema its columns, those that it lacks as nulls."""
        df = self.spark.read.parquet(self.tables()[name])
        if schema is None:
            return df
        return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))

    def rebuild(self, build: dict[str, Callable[[], DataFrame]], kept: dict[str, T.StructType]) -> None:
        """Builds tables anew.  Kept ones stay where they are; they gain the columns that they lack, and are made empty if new."""
        number, now = (self.builds() or [0])[-1] + 1, self.tables()
        place = lambda name: f"{self.folder}/build-{number}/{name}"
        then = {}
        for name, make in build.items():
            make().write.mode("overwrite").parquet(place(name))
            then[name] = place(name)
        for name, schema in kept.items():
            then[name] = now.get(name)
            if name not in now:
                self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(place(name))
                then[name] = place(name)
            elif set(schema.names) - set(self.read(name).columns):
                extra = [c for c in self.read(name).columns if c not in schema.names]
                whole = T.StructType([*schema.fields, *(self.read(name).schema[c] for c in extra)])
                self.read(name, whole).write.mode("overwrite").parquet(place(name))
                then[name] = place(name)
        written = self.path(f"{self.folder}/manifests/{number}.json.tmp")
        out = self.files.create(written, True)
        out.write(json.dumps(then).encode())
        out.close()
        if not self.files.rename(written, self.path(f"{self.folder}/manifests/{number}.json")):
            raise RuntimeError(f"build {number} was made by another run")
