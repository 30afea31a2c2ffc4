"""Session helpers: building a local session, the shared working folder, cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tapline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.cache.maxEntries", "2000")  # else plans of many stages push out each other's compiled code
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share.

    It is read from ``spark.checkpoint.dir``. Only a session in local mode that has none gets a folder of its
    own; on a cluster a missing setting is an error, since a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tapline-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of working data, on whatever file system it is."""
    system, place = _file_system(spark, folder)
    system.delete(place, True)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def read_note(spark: SparkSession, path: str) -> str | None:
    """A small text file on whatever file system, or None where there is none."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file, replacing what is there."""
    system, place = _file_system(spark, path)
    stream = system.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Delete a folder of working data when the session's program ends, for results that are read later."""

    def gone() -> None:
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the session may have ended first
                remove(spark, folder)

    atexit.register(gone)


def task_count(df: DataFrame, rows: int, rows_per_task: int) -> int:
    """Shuffle partitions for ``rows`` rows: as many as the session asks for, more where a task would get too much."""
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(base, -(-rows // rows_per_task))


def spread(df: DataFrame) -> DataFrame:
    """For rows that Python is to work on: spread them if they come in fewer partitions than there are cores.

    A large input comes in many splits and stays where it is; only a few small files are shuffled, whole rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _hashed(values: np.ndarray) -> np.ndarray:
    """Spark's hash of BIGINT values (Murmur 3 of 32 bits, the seed 42), as hash partitioning uses it."""
    # Seed and constants of the published hash.
    with np.errstate(over="ignore"):
        turn = lambda x, r: x << np.uint32(r) | x >> np.uint32(32 - r)
        h = np.full(len(values), 42, dtype=np.uint32)
        for half in (values & 0xFFFFFFFF, values >> 32):
            h ^= turn(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(8)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        return (h ^ h >> np.uint32(16)).view(np.int32)


def partition_labels(n: int) -> list[int]:
    """``n`` numbers of which hash partitioning into ``n`` partitions, or buckets, sends one to each, in that order."""
    found, start = np.full(n, -1, dtype=np.int64), 0
    while (found < 0).any():
        some = np.arange(start, start + 16 * n, dtype=np.int64)
        at, first = np.unique(_hashed(some).astype(np.int64) % n, return_index=True)
        found[at] = np.where(found[at] < 0, some[first], found[at])
        start += 16 * n
    return found.tolist()
