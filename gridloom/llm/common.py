"""What the operators share: folders, sessions, words of a text.

A *word* is a maximal run of characters other than space, TAB, LF, VT, FF and
CR. Those are exactly the bytes at which ``bytes.split()`` splits, so words are
taken from the UTF-8 bytes of a text.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the shared folder is when spark.checkpoint.dir is unset and driver and executors are one process (tests).
LOCAL_SHARED = "file:///tmp/checkpoints/gridloom"

#: Rows, and bytes about, of an Arrow batch at most: documents can be long, so batches stay small. A batch has one row at least.
ARROW_ROWS, ARROW_BYTES = 256, 32 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on, kept by the session as plans are run later: small Arrow batches, this package on the workers' path."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or LOCAL_SHARED).rstrip("/")


#: Paths made so far: those of the process, then those of each open ``temporary``.
_made: list[list[str]] = [[]]


def scratch(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A new path in the shared folder; it goes with the innermost ``temporary``, or the one around that, or ``clean_up``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[-2 if outer and len(_made) > 1 else -1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at its end, but for those written with ``outer``."""
    _made.append([])
    try:
        yield
    finally:
        drop(spark, *_made.pop())


def clean_up(spark: SparkSession) -> None:
    """Delete what this process has left in the shared folder; results that were not written elsewhere can't be read any more."""
    drop(spark, *_made[0])
    _made[0].clear()


def written(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, safe from lost executors."""
    path = scratch(df.sparkSession, name, outer)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete paths in the shared folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with reserved names for all columns but those ``used``, and a function that gives back columns and names as they were."""
    names = [c if c in used else f"\u0001u{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.select(*(F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns, strict=True)))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with names that say nothing: functions over Arrow batches go by position, and Spark takes no dots in the names of their input."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def row_key(columns: Iterable[str]) -> Column:
    """A 64-bit hash of a row's values, which tells null from absent."""
    return F.xxhash64(*(x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string; null counts as empty."""
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return [x or b"" for x in column.cast(pa.large_binary() if big else pa.binary()).to_pylist()]


def batch_of(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """Binaries of one width, without nulls, as rows of bytes."""
    start = column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[start : start + len(column) + 1]
    if len(column) and offsets[-1] - offsets[0] != width * len(column):
        raise ValueError("binaries differ in width")
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[0] + width * len(column)].reshape(-1, width)


def key_blocks(batches: Iterable[pa.RecordBatch], key: int, widths: dict[int, int], rows: int = 1 << 17) -> Iterator[list[np.ndarray]]:
    """A partition sorted by an integer key, in blocks that end where a run of equal keys ends.

    ``widths``: of fixed-size binary columns. A block has about ``rows`` rows, or those of one longer run.
    """
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([fixed(c, widths[i]) if i in widths else c.to_numpy(zero_copy_only=False) for i, c in enumerate(batch.columns)])
        size += batch.num_rows
        if size >= rows and held[0][key][0] != held[-1][key][-1]:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[key], cols[key][-1]))
            yield [c[:cut] for c in cols]
            held, size = [[c[cut:] for c in cols]], len(cols[key]) - cut
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
