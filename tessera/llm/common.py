"""Shared helpers: inputs, staged tables, word hashing, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns, whatever their names, never travel."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python: a batch of them must stay small beside an executor's
    memory, by rows and by bytes. Lowers the session's limits where they are higher (they
    never change results) and leaves them so, because plans run after this returns."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(rows)) > 500:
        spark.conf.set(rows, "500")
    if spark.conf.get(size) != "8m":
        spark.conf.set(size, "8m")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where the session names none,
    a folder of our own, if driver and executors are one process; else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="tessera-")
    return _OWN_DIRS[app]


def free_name(df: DataFrame, name: str = "r") -> str:
    """A column name that no column of df has, upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stage(df: DataFrame, name: str, path: str | None = None, codec: str = "snappy", by: str | None = None) -> DataFrame:
    """Write a table to the shared folder (a folder a value of ``by``) and read it back: the
    plan is cut there, later scans prune columns, and a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = path or f"{scratch_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any
    more; otherwise they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Most rows of keys that a join sends to every executor; above, it shuffles.
FEW = 400_000


def few(keys: DataFrame) -> DataFrame:
    """Keys as the small side of a join: broadcast only if counted to be at most FEW."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


def trim() -> None:
    """Give a worker's memory back to the system, a tokenizer's cache that an earlier
    stage left there included; workers outlive their tasks."""
    import ctypes
    import sys

    import pyarrow as pa

    if sys.modules.pop("_tessera_worker", None):
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_parts(texts: list, most: int = 1 << 19):
    """Runs of texts of so many bytes together at most, or of one text."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def word_hashes():
    """A function from UTF-8 texts to (64-bit hashes of all their words, words a text).

    Words stand between ASCII white space; A-Z are lower-cased. A word's hash is a
    polynomial over its bytes, read off prefix sums over all texts at once.
    """
    import numpy as np

    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    base = 0x9E3779B97F4A7C15
    tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def hashes(texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
        if len(raw) > len(tables[0]):
            for i, x in enumerate((base, pow(base, -1, 1 << 64))):
                steps = np.full(max(len(raw), 1 << 19), x, np.uint64)
                steps[0] = 1
                tables[i] = np.cumprod(steps)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * tables[0][: len(raw)], out=sums[1:])
        word = np.concatenate([[False], ~space[raw]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        h = (sums[ends] - sums[starts]) * tables[1][starts]
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        stops = np.cumsum([len(t) + 1 for t in texts])
        counts = np.diff(np.concatenate([[0], np.searchsorted(starts, stops)])) if len(texts) else np.zeros(0, np.int64)
        return h, counts

    return hashes


def rolling(values, k: int):
    """64-bit hashes of all runs of k consecutive values (numpy uint64)."""
    import numpy as np

    n = len(values) - k + 1
    out = np.zeros(n, np.uint64)
    mul = np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        out *= mul
        out += values[i : i + n]
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b): rows (node, root), root the smallest node reached.

    Alternates large-star and small-star steps, so the work of a round is linear in
    the edges and a component of any diameter needs few rounds. Each step is staged.
    A step only ever groups by a node through ``min``, which combines map-side.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), "cc")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = stage(small.where("a <> b").distinct(), "cc")
        mark = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
        before, after = now.agg(mark.alias("s")).first(), small.agg(mark.alias("s")).first()
        drop_staged(now, large)
        now = small
        if before == after:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")
