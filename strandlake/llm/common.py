"""What the operators of this package share: sizing, checkpoints, components."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None
#: Catalyst reports at least this much for plans whose size it doesn't know.
UNKNOWN_BYTES = 1 << 50


def _trim() -> None:
    """Gives freed memory back to the system: a worker outlives its task, and shares its executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def tidy(f: Callable) -> Callable:
    """f, a function of batches or of groups, that gives memory back when it is done."""
    if inspect.isgeneratorfunction(f):

        def batches(it):  # type: ignore[no-untyped-def]
            yield from f(it)
            _trim()

        return batches

    def group(t: pa.Table) -> pa.Table:
        out = f(t)
        _trim()
        return out

    def groups(t: pa.Table, other: pa.Table) -> pa.Table:
        out = f(t, other)
        _trim()
        return out

    return group if len(inspect.signature(f).parameters) == 1 else groups


#: Rows and bytes of the Arrow batches that go to Python workers: texts are long, and a worker holds several batches.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Makes the session's Arrow batches small enough for texts; lower settings stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        try:
            if now is None or int(now) <= 0 or int(now) > most:
                spark.conf.set(key, str(most))
        except ValueError:  # written with a unit: the user's own choice
            pass


#: What a remembered word takes beside its letters and its value, about, and the longest word that is remembered.
OVERHEAD, LONGEST = 200, 64


class Memory:
    """What a worker remembers of words, in two generations of `room` bytes: a full young one becomes the old one, and words still in use come back from there. Long words aren't remembered."""

    def __init__(self, room: int) -> None:
        self.room, self.used = room, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, words: list[str], values: list[bytes]) -> None:
        """Remembers the values; all of one call stay in one generation."""
        kept = {w: v for w, v in zip(words, values, strict=True) if len(w) <= LONGEST}
        self.young |= kept
        self.used += OVERHEAD * len(kept) + 4 * sum(map(len, kept)) + sum(map(len, kept.values()))
        if self.used > self.room:
            self.young, self.old, self.used = {}, self.young, 0

    def known(self, words: list[str]) -> list[bytes | None]:
        """The value of each word, None where it isn't remembered."""
        found = list(map(self.young.get, words))
        if self.old:
            again = [k for k, v in enumerate(found) if v is None and words[k] in self.old]
            values = [self.old[words[k]] for k in again]
            for k, v in zip(again, values, strict=True):
                found[k] = v
            self.put([words[k] for k in again], values)
        return found


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each pair, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a table's text column, about: from the files' sizes, as texts are most of them, or a counting pass where there are none."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    size = int(str(stats.sizeInBytes()))
    if size < UNKNOWN_BYTES:
        return size * 2  # files are compressed about twofold
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of a text column, so that what is made of a run stays bounded."""
    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


def pieces(total: int, target: int, least: int = 64) -> int:
    """How many pieces of about `target` bytes; at least `least`, so that small inputs spread as well."""
    return max(least, -(-total // target))


#: Pieces to aim at where their size may be chosen within bounds.
TASKS = 4096


def tasks(total: int, least: int, most: int) -> int:
    """How many pieces hold `total` bytes, of `least` bytes each, or of more, up to `most`, where they would be more than TASKS."""
    return max(16, -(-total // min(max(least, -(-total // TASKS)), most)))


#: Beyond so many keys hashing spreads them well enough.
MOST_SPREAD = 1 << 16


def spark_hash(keys: np.ndarray) -> np.ndarray:
    """Spark's hash of an int column (Murmur3, 32 bits, seed 42), by which it deals rows to partitions."""
    u = np.uint32

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return x << u(n) | x >> u(32 - n)

    k = turned(keys.astype(np.int32).view(np.uint32) * u(0xCC9E2D51), 15) * u(0x1B873593)
    h = turned(u(42) ^ k, 13) * u(5) + u(0xE6546B64) ^ u(4)
    h = (h ^ h >> u(16)) * u(0x85EBCA6B)
    h = (h ^ h >> u(13)) * u(0xC2B2AE35)
    return (h ^ h >> u(16)).view(np.int32)


def even_keys(n: int, partitions: int) -> np.ndarray:
    """A key for each of 0 .. n - 1, equal to it modulo n, so that Spark deals the keys to partitions in turn: hashing itself would give some partitions several of few keys."""
    keys = np.arange(n, dtype=np.int64)
    if n > MOST_SPREAD:
        return keys
    left, k = np.arange(n), 0
    while len(left) and (k + 1) * n < 1 << 31:
        tried = left + k * n
        fits = spark_hash(tried).astype(np.int64) % partitions == left % partitions
        keys[left[fits]] = tried[fits]
        left, k = left[~fits], k + 1
    return keys


def as_column(keys: np.ndarray) -> Column:
    """Keys as a constant array column."""
    return F.split(F.lit(",".join(map(str, keys.tolist()))), ",").cast("array<int>")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the cluster's checkpoint folder, so that lost executors cost no recomputation of its lineage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    return spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark.sparkContext.master)


def local_folder(master: str) -> str:
    """A new folder of this machine, which serves where all executors run on it only."""
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoints")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u long, v long) as (node, root), root the smallest node; nodes without edges are absent.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Every round is
    two minima per node, with partial aggregation, and two equi-joins that Spark can split
    when a node has very many neighbours; no neighbourhood is ever collected.
    """
    e = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        e = checkpointed(small.where("u > v").distinct())
        # done when every node hangs on one root only, and no root hangs on another node
        n, nodes = e.agg(F.count("*"), F.count_distinct("u")).first()
        if n == nodes and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
