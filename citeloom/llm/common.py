"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a row group of settled tables; a writer holds one in memory.
ROW_GROUP = 16 << 20


#: Texts are long: Arrow batches of the default 64 MB cost a task several times that outside the heap, and leave it in pieces.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches at 2 MB in this session, unless it sets a size of its own."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, "2m")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one of a local session; an error on a cluster."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not known:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="citeloom-")
        sc.setCheckpointDir(known)
    return known


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet below the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/citeloom-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(*tables: DataFrame) -> None:
    """Delete tables that settle() wrote and nothing needs any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            if target.getName().startswith("citeloom-"):
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage: only then does Spark delete the shuffle files of steps that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """Broadcast only below a row limit that was checked; larger sides shuffle."""
    return F.broadcast(df) if rows <= limit else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, rows: int = 2000, column: int = -1, most: int = 1 << 18):
    """Record batches of at most so many rows and about `most` bytes of a text column, so that long texts do not pile up."""
    for b in batches:
        if column < 0:
            ends = range(rows, b.num_rows + rows, rows)
        else:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            ends, at, done = [], 0, 0
            while at < b.num_rows:
                at = min(at + rows, max(at + 1, int(np.searchsorted(size, done + most, "right"))))
                done = int(size[at - 1])
                ends.append(at)
        at = 0
        for end in ends:
            yield b.slice(at, end - at)
            at = end


#: What operators keep in this Python worker, and how to forget it.
KEPT: dict[str, Callable[[], None]] = {}


def alone(owner: str) -> None:
    """Forget what other operators have kept in this worker."""
    for name in [k for k in KEPT if k != owner]:
        KEPT.pop(name)()


def task(owner: str, forget: Callable[[], None] | None = None):
    """For functions over record batches: a worker holds the caches of one operator only, and gives free memory back at the end."""

    def wrap(f):
        @functools.wraps(f)
        def run(batches):
            alone(owner)
            if forget:
                KEPT[owner] = forget
            yield from f(batches)
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

        return run

    return wrap


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(1)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """2**bits powers of an odd base modulo 2**64, and of its inverse."""
    base, both = 0x9E3779B97F4A7C15, []
    for b in (base, pow(base, -1, 1 << 64)):
        row = np.full(1 << bits, b, np.uint64)
        row[0] = 1
        both.append(np.multiply.accumulate(row))
    return both[0], both[1]


def runs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each x[start:end], from one polynomial prefix sum over uint64 values."""
    up, down = powers(max(18, int(len(x)).bit_length()))
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts])


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words; words are hashes."""
    n = max(0, len(words) - width + 1)
    at = np.arange(n)
    return runs(words, at, at + width) if n else np.empty(0, np.uint64)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random 64-bit value for each byte, upper-case letters as lower-case ones.
BYTES = np.random.default_rng(64).integers(0, 1 << 64, 256, np.uint64)
BYTES[65:91] = BYTES[97:123]
LONG_WORD = 64


@dataclass
class Words:
    """The words of some texts: hashes, byte places in `raw`, and where each text begins in them and in raw."""

    raw: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    text_at: np.ndarray

    def of(self, k: int) -> slice:
        return slice(int(self.first[k]), int(self.first[k + 1]))

    def places(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the words of text k, in code points."""
        at, own = int(self.text_at[k]), self.of(k)
        body = np.frombuffer(self.raw, np.uint8)[at : int(self.text_at[k + 1])]
        starts, ends = self.starts[own] - at, self.ends[own] - at
        more = (body & 0xC0) == 0x80
        if more.any():
            before = np.concatenate([[0], np.cumsum(more)])
            starts, ends = starts - before[starts], ends - before[ends]
        return starts, ends


def words_of(texts: list[str | None]) -> Words:
    """Hashes of all words, found byte-wise for all texts at once (ASCII letters count as lower-case ones)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n".join([*parts, b""])
    buf = np.frombuffer(raw, np.uint8)
    text_at = np.cumsum([0, *(len(p) + 1 for p in parts)])
    edge = np.diff(SPACE[buf].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[ends > starts[0]] if len(starts) else ends[:0]  # the last byte is a break
    size = ends - starts
    hashes = runs(BYTES[buf], starts, ends) if len(starts) else np.empty(0, np.uint64)
    for k in np.flatnonzero(size > LONG_WORD):  # polynomials are weak on very long words
        hashes[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]].lower())
    return Words(raw, hashes, starts, ends, np.searchsorted(starts, text_at), text_at)


def shingle_batch(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its k-word shingles (ASCII letters lower-cased).

    Fewer words than k make one shingle; none make none.
    """
    words = words_of(texts)
    rolled, out = windows(words.hashes, k), []
    for t in range(len(texts)):
        at, end = int(words.first[t]), int(words.first[t + 1])
        if end - at >= k:
            part = np.sort(rolled[at : end - k + 1])
            fresh = np.empty(len(part), bool)
            fresh[0] = True
            np.not_equal(part[1:], part[:-1], out=fresh[1:])
            out.append(part[fresh])
        elif end > at:
            out.append(mix64(windows(words.hashes[at:end], end - at) + np.uint64(end - at)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


#: Bits of the odd sketch of a set of at most SMALL_SET items, and of a larger one.
SMALL_SET, BITS, MORE_BITS = 1000, 1024, 4096


def parity(items: np.ndarray) -> list[int]:
    """Odd sketch: bit b tells whether an odd number of items fall on b. Sets that differ in d items differ in d bits at most."""
    bits = BITS if len(items) <= SMALL_SET else MORE_BITS
    odd = np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).tolist()
