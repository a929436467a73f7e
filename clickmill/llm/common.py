"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clickmill.session import scratch_path


#: Rows, and bytes, of a batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def ship(spark: SparkSession) -> None:
    """Let the Python workers of this session import the package from where the driver has it.

    That is enough for executors which see the same path, as in local mode; a cluster gets the package by
    ``--py-files`` or its image, as usual.
    """
    home = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])
    # Batches of documents are held by the JVM and by the worker, for each task at a time.
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and go on from the file: this cuts the lineage,
    survives lost executors and lets later readers take single columns."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, **columns) -> DataFrame:
    """A table of the driver's numbers, 64 bits each. It goes to Spark as Arrow, since lists of rows would start Python workers of
    another kind in every executor, next to those of the operators."""
    return spark.createDataFrame(pa.table({name: pa.array(values, pa.int64()) for name, values in columns.items()}))


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`table` that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


_memories: list[dict] = []


def one_memory(keep: dict | None = None) -> None:
    """Called at the start of a task with what it remembers for later tasks of this worker, if anything: what tasks of other
    operators remembered is given up, so a worker holds one operator's memory at a time."""
    others = [m for m in _memories if m is not keep]
    _memories[:] = [] if keep is None else [keep]
    for other in others:
        other.clear()
    pa.default_memory_pool().release_unused()
    if others:
        gc.collect()
        with contextlib.suppress(AttributeError, OSError):  # another C library has no such call
            ctypes.CDLL(None).malloc_trim(0)


def with_any_names(df: DataFrame, function) -> DataFrame:
    """``mapInArrow`` of a function that keeps the columns of ``df``, whatever their names."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(function, plain.schema).toDF(*df.columns)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def spans(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive rows whose ``sizes`` add up to ``most`` at most, or one row alone."""
    out, begin, held = [], 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > begin and held + size > most:
            out.append((begin, k))
            begin, held = k, 0
        held += size
    return [*out, (begin, len(sizes))] if len(sizes) else out


def runs(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, pa.Array]]]:
    """Rows that come sorted by whole-number ``keys``, gathered per value of them."""
    held: list[pa.RecordBatch] = []
    current: tuple = ()

    def done() -> tuple[tuple, dict[str, pa.Array]]:
        whole = pa.Table.from_batches(held)
        return current, {c: pa.concat_arrays(whole[c].chunks) for c in whole.column_names}

    for part in parts:
        values = [part.column(part.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(max(0, part.num_rows - 1), bool)
        for v in values:
            new |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), part.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            key = tuple(int(v[a]) for v in values)
            if held and key != current:
                yield done()
                held = []
            current = key
            held.append(part.slice(a, b - a))
    if held:
        yield done()
