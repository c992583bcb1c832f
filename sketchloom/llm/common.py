"""Helpers that several operators share: shared storage, distributed prefix sums and batch text access."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Row id that an operator adds; unlikely to clash with a caller's column.
UID = "__uid"
#: Where no shared folder is configured (tests on one machine), one folder per process.
_own_dir: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (`spark.checkpoint.dir`).

    Only where that setting is absent and all tasks run in this process, as in tests, a local temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            own = tempfile.mkdtemp(prefix="sketchloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _own_dir.append(f"file://{own}")
        base = _own_dir[0]
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Drops the shuffle files of a write when it ends (Spark 4.1): its result is a table then.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_out(df: DataFrame, path: str) -> DataFrame:
    """Write `df` to `path` and read it back: lineage ends there and rows stay fixed.

    Lost executors then only cost a reread. Column order and types are kept. Shuffle files of the write go at once.
    """
    spark = df.sparkSession
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """`write_out` to a new path in the shared folder."""
    return write_out(df, work_dir(df.sparkSession))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate folder that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_column: str = "doc_id"):
    """The fold that no model learns from: crc32 of the id as text, modulo 3, equal to 1. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def _give_back() -> None:
    """Return freed memory to the system: idle Python workers stay beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do it by themselves
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(batch: pa.RecordBatch, name: str, target: int = 2_000_000):
    """Split a batch into runs of rows with about `target` bytes of text, so that working arrays stay small.

    Yields (batch slice, bytes, offsets); one very long text makes a run of its own.
    """
    raw, off = bytes_of(batch.column(name))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(off, off[start] + target, "right")) - 1)
        end = min(end, n)
        yield batch.slice(start, end - start), raw[off[start] : off[end]], off[start : end + 1] - off[start]
        start = end
    _give_back()


def first_free(columns: list[str], name: str) -> str:
    """`name`, with underscores added until no column has it (case aside)."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name += "_"
    return name


def sums_before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """`df` plus, for each name, the sum of its column over the rows that come before in the order.

    One range partitioning: sums of whole partitions, of which there is one row each, plus a window inside each. The
    result is a table read back, so ranges stay fixed. Rows must differ in the order for the sums to be determined.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"__o{i}" for i in range(len(order))]
    keyed = df.withColumns({n: c for n, c in zip(names, order, strict=True)})
    dealt = materialize(keyed.repartitionByRange(parts, *names).withColumn("__part", F.spark_partition_id()))
    whole = dealt.groupBy("__part").agg(*[F.sum(c).alias(f"__s{i}") for i, c in enumerate(sums.values())])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per partition
    whole = whole.select(F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__s{i}").over(earlier), F.lit(0)).alias(f"__s{i}") for i in range(len(sums))])
    inside = Window.partitionBy("__part").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumns({f"__w{i}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for i, c in enumerate(sums.values())})
    rows = rows.join(whole, rows["__part"] == whole["__p"])
    return rows.select(*df.columns, *[(F.col(f"__s{i}") + F.col(f"__w{i}")).alias(n) for i, n in enumerate(sums)])


#: Bits of a sieve: 4 MB, whatever the data.
SIEVE_BITS = 1 << 25


def sieve_of(keys: DataFrame) -> np.ndarray:
    """A bit for each hash that a key of a one-column table has: keys whose bit is not set are not in it."""
    at = F.pmod(F.xxhash64(keys.columns[0]), F.lit(SIEVE_BITS))
    words = keys.select(F.floor(at / 64).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(SIEVE_BITS // 64, np.int64)
    out[np.asarray(words["w"], dtype=np.int64)] = np.asarray(words["b"], dtype=np.int64)
    return out.view(np.uint64)


def sifted(rows: DataFrame, key: str, sieve: np.ndarray, may: bool) -> DataFrame:
    """The rows whose key may be among those of the sieve, or those whose key is surely not.

    Wide rows that a join would only throw away need not be shuffled then; a full sieve stops nothing, and the join
    that follows decides in any case.
    """
    sent = rows.sparkSession.sparkContext.broadcast(sieve)
    names = [f"c{i}" for i in range(len(rows.columns))]
    flat = rows.select(*[F.col(c).alias(n) for c, n in zip(rows.columns, names, strict=True)], F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS)).alias("at"))

    def run(batches):
        for batch in batches:
            at = np.asarray(batch.column("at"))
            hit = (sent.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield batch.select(names).filter(pa.array(hit == may))

    out = flat.mapInArrow(run, flat.drop("at").schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(rows.columns, names, strict=True)])


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in a one-column table. `rows` and `gone` are read more than once: tables, not plans."""
    sieve = sieve_of(gone)
    g = gone.toDF("__gone")
    maybe = sifted(rows, key, sieve, True)
    return sifted(rows, key, sieve, False).unionByName(maybe.join(g, maybe[key] == g["__gone"], "left_anti"))


SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SIGN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all 64 bits (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words (runs of anything but ASCII white space) of a run of texts start and end."""
    full = np.append(~SPACE[raw], False)
    first = np.zeros(len(raw) + 1, bool)
    first[off[:-1]] = True  # a word does not go on into the next text
    before = np.concatenate([[False], full[:-1]])
    return np.flatnonzero(full & (~before | first)), np.flatnonzero(before & (~full | first))


def token_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: int = 256) -> np.ndarray:
    """A 64-bit hash of all bytes of each token, eight at a time; tokens of more than `long` bytes by XXH64."""
    size = ends - starts
    h = mixed(size.astype(np.uint64) + _SIGN)
    padded = np.append(raw, np.zeros(8, np.uint8))
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))  # the bytes from each position on
    short = size <= long
    at, k = np.flatnonzero(short & (size > 0)), 0
    while len(at):
        left = np.minimum(size[at] - k, 8).astype(np.uint64)
        x = eight[starts[at] + k] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        x = (h[at] ^ x) * np.uint64(0xD6E8FEB86659FD93)
        h[at] = x ^ (x >> np.uint64(32))
        k += 8
        at = at[size[at] > k]
    if not short.all():
        from xxhash import xxh64_intdigest

        for i in np.flatnonzero(~short).tolist():
            h[i] = xxh64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return mixed(h)
