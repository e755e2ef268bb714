"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether Spark removes the shuffle files of a query once the query is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder of spark.checkpoint.dir, to cut lineage.

    Unlike cached blocks or local checkpoints, they outlive the executors that wrote
    them. `drop` deletes tables that no later plan reads, `done` all that a result
    doesn't read. Without that setting only a local run has a folder that all see.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="pageloom-")
        self.spark, self.root, self.tables = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}", []

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{len(self.tables) + 1:03d}-{name}"
        conf = self.spark.conf
        before = conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")  # the table is read from now on, what its plan shuffled is of no more use
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(_CLEANUP, before)
        self.tables.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
                self.delete(folder)

    def done(self, out: DataFrame) -> DataFrame:
        """The result, after all tables that it doesn't read are deleted."""
        read = {x.rsplit("/", 2)[1] for x in out.inputFiles()}
        for path in self.tables:
            if path.rsplit("/", 1)[1] not in read:
                self.delete(path)
        return out


def fresh(name: str, *taken: list[str]) -> str:
    """The name, with as many underscores behind it as make it differ from all names that are taken."""
    while any(name.lower() == c.lower() for columns in taken for c in columns):
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the text's UTF-8 bytes, all that a text operator sends to Python."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about `most` in total; a larger item is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[tuple[list, list]]:
    """(ids, texts) of about `most` bytes of text; a null text stays None."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1)
        lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
        for i, j in runs(lengths, most):
            yield ids[i:j], texts.slice(i, j - i).to_pylist()
    release()


def release() -> None:
    """Give the memory of a task's batches back: a worker lives on, idle or for other work."""
    pa.default_memory_pool().release_unused()
