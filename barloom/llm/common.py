"""Helpers shared by the operators: input tables, shared storage, batches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset and all runs in one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_barloom_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark._barloom_shared = own
        spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder that goes away with the driver."""
    path = f"{shared_root(spark)}/barloom-{uuid.uuid4().hex}-{label}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop_path)
    return path


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder once and read it from there.

    Cuts lineage: a lost executor costs a reread of the written files only.
    """
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files below a stored() table that no later step reads.

    The driver's garbage goes too: until then it holds heap, and the shuffle files of the steps before.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    jvm.System.gc()


def guarded(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs), with columns that begin with two underscores, as work's own do, out of the way."""
    hidden = {c: f"barloom_{i}" for i, c in enumerate(docs.columns) if c.startswith("__")}
    return work(docs.withColumnsRenamed(hidden)).withColumnsRenamed({new: old for old, new in hidden.items()})


def is_held_out(doc_id) -> F.Column:
    """True for the quarter of documents whose labels nothing may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def sliced(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about limit characters each, at least one text."""
    begin, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield begin, i
            begin, total = i, 0
        total += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches; then what the task has freed goes back to the system, since a worker keeps it for the next tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)


def record_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )
