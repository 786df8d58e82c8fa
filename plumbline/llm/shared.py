"""What the training-data operators share: intermediate tables and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Row groups of intermediate tables: a writer holds one in memory.
ROW_GROUP = {"parquet.block.size": str(16 << 20)}
#: One text may be larger than this; otherwise so many bytes of text are worked on at once.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one of a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


#: Folders whose last tables a result may still read.
_LEFT: list[str] = []


def sweep(spark: SparkSession, but: tuple[str, ...] = ()) -> None:
    """Deletes the tables that results of this session still read, once those are written elsewhere."""
    for root in [r for r in _LEFT if r not in but]:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _LEFT.remove(root)


class Scratch:
    """Intermediate tables of one run, below shared_dir. They cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.tables = spark, f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex[:12]}", []
        _LEFT.append(self.root)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        """Writes df as Parquet and returns it as read again."""
        df.write.options(**ROW_GROUP).parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def own_table(self, name: str) -> None:
        """A catalog table that goes with this run."""
        self.tables.append(name)

    def release(self, *tables: str) -> None:
        """Deletes tables and lets Spark delete the shuffle files of plans that are done."""
        if tables:
            self.drop(*tables)
        gc.collect()
        self.spark._jvm.System.gc()

    def last(self, df: DataFrame) -> DataFrame:
        """Keeps the result and deletes all else of this run."""
        name = "last"
        out = self.keep(df, name)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for found in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at):
            if (table := found.getPath().getName()) != name:
                self.drop(table)
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        return out

    def drop(self, *tables: str) -> None:
        """Deletes tables (all if none is named) that no later plan reads."""
        for at in [self.path(t) for t in tables] or [self.root]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def tables(sf_dir: str, spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut to about limit bytes of one text column, each with its texts as UTF-8 (null: empty)."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        start, size = 0, 0
        lengths = pa.compute.binary_length(texts).to_pylist()
        for i, n in enumerate(lengths):
            size += n or 0
            if size >= limit or i == len(lengths) - 1:
                part = texts.slice(start, i + 1 - start).to_pylist()
                yield batch.slice(start, i + 1 - start), [x or b"" for x in part]
                start, size = i + 1, 0


def slim(run):
    """run, a function of batches, that returns freed memory to the system at its end, as idle Python workers stay.

    The allocators of Python's libraries and of Arrow else keep what a task once needed beside the executor's heap.
    """

    def slimmed(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return slimmed


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
