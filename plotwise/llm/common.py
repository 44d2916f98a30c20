"""What the operators of this subpackage share: table access, lineage cuts and Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready_checkpoints(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; only a local session may fall back to a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="plotwise-checkpoint-")
    sc.setCheckpointDir(shared)


def removed(spark: SparkSession, folder: str) -> None:
    """Removes a folder, by the file system that Spark uses for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """A saved ``df`` dealt out by a key to so many tasks that each has about so many rows, and every core some."""
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, key)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: unlike a checkpoint, it does not hand on the partitioning of its plan.

    A plan that is joined and united again and again collects so many partitionings that planning takes longer than running.
    """
    spark = df.sparkSession
    ready_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def portions(batch: pa.RecordBatch, column: str = "text", rows: int = 2048, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, and of little more than so many bytes in the column, whatever the batch holds."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for at, length in enumerate(lengths):
        if at > start and (at - start >= rows or held + length > size):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += length
    if start < len(lengths):
        yield batch.slice(start)


def arrow_map(df: DataFrame, schema: str, rows: Callable[..., tuple]) -> DataFrame:
    """Map each row by ``rows(*values) -> tuple``, some hundred rows at a time whatever the batch size is."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [rows(*values) for values in zip(*(part.column(i).to_pylist() for i in range(len(names))))]
                if types is None:
                    types = _arrow_schema(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, type=field.type) for column, field in zip(zip(*out), types)], schema=types
                )

    return df.mapInArrow(run, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}

    def kind(text: str) -> pa.DataType:
        if text.startswith("array<") and text.endswith(">"):
            return pa.list_(kind(text[6:-1]))
        return kinds[text]

    return pa.schema([pa.field(name, kind(rest)) for name, rest in (part.strip().split(" ", 1) for part in ddl.split(","))])
