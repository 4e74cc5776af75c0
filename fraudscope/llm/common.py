"""Helpers shared by the text operators: stored tables, shipping the package, Arrow maps."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(root)
    target = os.path.join(tempfile.mkdtemp(), f"fraudscope_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.relpath(p, top))
    sc.addPyFile(target)  # read on the driver, then served by Spark itself
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``; the folder itself is made by its writer."""
    return scratch_path(spark, f"llm-{tag}-{uuid.uuid4().hex}")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back (cuts lineage, survives lost executors)."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver drops their handles; jobs of many stages ask for that between stages, so
    that they hold the disk of one stage at a time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into pieces of at most ``rows`` rows (zero-copy)."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema, rows: int = 512) -> DataFrame:
    """``mapInArrow`` over pieces of at most ``rows`` rows, so that a task holds few texts at a time."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            for s in slices(b, rows):
                out = fn(s)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def batch(**columns) -> pa.RecordBatch:
    """A record batch from ``name=(values, arrow type)``."""
    arrays = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v[0], v[1]) for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def worker_cache(name: str, make: Callable):
    """One object per Python worker and name (tokenizers, indexes): built on first use, kept between tasks."""
    if name not in _CACHE:
        _CACHE[name] = make()
    return _CACHE[name]


_CACHE: dict = {}

#: ASCII A-Z to a-z on bytes, everything else unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8 (bytes.split() cuts at those six bytes)."""
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def open_fs(uri: str):
    """(pyarrow file system, path) of a folder named by the cluster; a bare path is a local one."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def new_file(uri: str, name: str) -> tuple[str, str]:
    """A file name of this task attempt only: a repeated task never touches the file of another attempt."""
    files, path = open_fs(uri)
    files.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    return f"{uri.rstrip('/')}/{name}", f"{path.rstrip('/')}/{name}"
