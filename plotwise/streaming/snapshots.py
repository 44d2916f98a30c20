"""Dated snapshots folded into one table: newest attributes, first and last day seen.

The same fold serves batches and streams; it gives the same rows in any order of arrival, and again for files that
come twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fold(rows: DataFrame, keys: list[str], seen: str, order: str, attributes: list[str]) -> DataFrame:
    """One row a key: attributes of the latest (seen, order), and the days between which it was seen."""
    out = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*attributes), F.struct(seen, order)).alias("row"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.max(F.struct(seen, order)).getField(order).alias(order)
    )
    return out.select(*keys, "row.*", "first_seen", "last_seen", order)


def merge(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str, attributes: list[str]) -> DataFrame:
    """Folds a folded batch into the stored table."""
    both = stored.unionByName(incoming)
    out = both.groupBy(*keys).agg(
        F.max_by(F.struct(*attributes), F.struct("last_seen", order)).alias("row"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max(F.struct("last_seen", order)).getField(order).alias(order)
    )
    return out.select(*keys, "row.*", "first_seen", "last_seen", order)


BUCKETS = 64


class Folded:
    """A folded table in a folder, bucketed by key; a batch writes anew only the buckets that it has keys of.

    ``data/v=<batch>/b=<bucket>`` holds what a batch wrote, ``state/<batch>`` which version of each bucket counts after it.
    The state is written last, so that a batch that fails changes nothing, and one that is run again replaces its own
    version.  Versions that the state before a batch does not name are removed with it.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = BUCKETS) -> None:
        self.spark, self.table, self.buckets = spark, table, buckets
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.table}/{name}")

    def batches(self) -> list[int]:
        """Numbers of the batches whose state is kept."""
        if not self.files.exists(self._path("state")):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(self._path("state"))]
        return sorted(int(n) for n in names if n.isdigit() and self.files.exists(self._path(f"state/{n}/_SUCCESS")))

    def state(self, batch: int) -> dict[int, int]:
        """Bucket to version; at most a row a bucket."""
        return {r.b: r.v for r in self.spark.read.parquet(f"{self.table}/state/{batch}").collect()}

    def read(self, versions: dict[int, int], schema=None) -> DataFrame:
        paths = [f"{self.table}/data/v={v}/b={b}" for b, v in sorted(versions.items())]
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def latest(self) -> DataFrame:
        return self.read(self.state(self.batches()[-1]))

    def add(self, new: DataFrame, number: int, keys: list[str], order: str, attributes: list[str]) -> None:
        """Merges a folded batch."""
        before = [n for n in self.batches() if n < number]
        held = self.state(before[-1]) if before else {}
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        new = new.withColumn("b", bucket).persist()
        touched = [r.b for r in new.select("b").distinct().collect()]  # at most a row a bucket
        stored = self.read({b: held[b] for b in touched if b in held}, new.drop("b").schema)
        out = merge(stored, new.drop("b"), keys, order, attributes).withColumn("b", bucket)
        out.repartition(max(1, len(touched)), "b").write.mode("overwrite").partitionBy("b").parquet(f"{self.table}/data/v={number}")
        new.unpersist()
        now = held | {b: number for b in touched}
        self.spark.createDataFrame(list(now.items()), "b int, v int").coalesce(1).write.mode("overwrite").parquet(f"{self.table}/state/{number}")
        if len(before) > 1:
            for b, v in self.state(before[-2]).items():
                if held.get(b) != v and self.files.exists(self._path(f"data/v={v}/b={b}")):
                    self.files.delete(self._path(f"data/v={v}/b={b}"), True)
            self.files.delete(self._path(f"state/{before[-2]}"), True)


def stream_into(source: DataFrame, table: str, checkpoint: str, keys: list[str], seen: str, order: str, attributes: list[str], buckets: int = BUCKETS):
    """Starts a stream that keeps ``table`` folded; returns the query.  What a batch writes grows with the buckets it touches."""

    def into(batch: DataFrame, number: int) -> None:
        Folded(batch.sparkSession, table, buckets).add(fold(batch, keys, seen, order, attributes), number, keys, order, attributes)

    return source.writeStream.foreachBatch(into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, table: str) -> DataFrame:
    return Folded(spark, table).latest()


def read_snapshots(spark: SparkSession, folder: str, schema: str, city: str | None = None) -> DataFrame:
    """Listing files ``<manager>/<YYYY-MM-DD>.json``; only the fields of the schema are read, so that contacts never are."""
    raw = spark.read.schema(schema).json(folder, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json").withColumn("_path", F.col("_metadata.file_path"))
    out = raw.withColumns({"manager": F.regexp_extract("_path", r"([^/]+)/\d{4}-\d{2}-\d{2}\.json$", 1), "seen": F.regexp_extract("_path", r"/(\d{4}-\d{2}-\d{2})\.json$", 1)})
    out = out.where("seen != ''")
    return out.where(F.lower("address.city") == city.lower()) if city else out


def usable(listings: DataFrame) -> DataFrame:
    """Listings of each manager's last day, but for those that are not built yet."""
    last = listings.groupBy("manager").agg(F.max("last_seen").alias("last_seen"))
    built = ~F.coalesce(F.lower(F.trim("status")).isin("in development", "coming soon"), F.lit(False))
    return listings.join(last, ["manager", "last_seen"]).where(built)
