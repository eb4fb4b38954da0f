"""Shared pieces of the training-data operators: session settings, written
cuts of the lineage, and vectorised hashing of byte and word windows."""

from __future__ import annotations

import atexit
import ctypes
import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_dir

#: Documents without an id sort behind every other one.
NO_ID = (1 << 63) - 1
#: Bytes that separate words: space and 0x09-0x0D, which bytes.split() uses too.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Session, folder and name of what was written and is there still.
_written: list[tuple[SparkSession, str, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of packed rows that one task takes, and of a batch that a Python
#: worker gets at once.
PART_BYTES, BATCH_BYTES = 12 << 20, 8 << 20


def parts_for(spark: SparkSession, size: float) -> int:
    """Tasks for so many bytes, at least as many as a shuffle has."""
    return max(shuffle_width(spark), int(size // PART_BYTES) + 1)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash; rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def part_slices(hashes: np.ndarray, parts: int):
    """(part, slice) of rising hashes."""
    part = part_of(hashes, parts)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return [(int(part[a]), slice(a, b)) for a, b in zip(edges, edges[1:]) if b > a]


#: Bytes of a file, where it is known how many there will be.
FILE_BYTES = 8 << 20


def cut(df: DataFrame, name: str, size: float | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage
    ends there, so a lost executor costs no earlier stage. size: about how many
    bytes this is, for small results of many tasks to become few files."""
    spark = df.sparkSession
    if size is not None:
        df = df.coalesce(int(size // FILE_BYTES) + 1)
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}/{name}"
    # What is written needs its shuffles no more; Spark drops them at once.
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.append((spark, path.rsplit("/", 1)[0], name))
    return spark.read.schema(df.schema).parquet(path)


def discard_later(spark: SparkSession, path: str) -> None:
    """Delete path when the program ends."""
    _written.append((spark, path, ""))


def drop_cut(*cuts: DataFrame) -> None:
    """Delete what cut() wrote for these; they can't be read afterwards."""
    for df in cuts:
        spark = df.sparkSession
        for path in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
            if "/cut-" in path:
                _drop(path)


def written() -> set[str]:
    """Folders that are there; for drop_since."""
    return {path for _, path, _ in _written}


def drop_since(before: set[str], *keep: str) -> None:
    """Delete what cut() has written since then but for the names to keep."""
    for _, path, name in list(_written):
        if path not in before and name not in keep:
            _drop(path)


def _drop(path: str) -> None:
    for entry in [w for w in _written if w[1] == path]:
        _delete(entry[0], path)
        _written.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path, _ in _written:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


#: What tells rows apart: 128 bits over id and text.
KEYS = ["key1", "key2"]


def row_keys(id_col: str, text_col: str) -> list:
    """The columns KEYS. Rows that repeat an id with another text differ in
    them; whole repeats share them and their results."""
    own = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.xxhash64(*own).alias(KEYS[0]), F.xxhash64(F.lit("key2"), *own).alias(KEYS[1])]


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and KEYS; Arrow batches of it are bounded in
    bytes, whatever the length of a text."""
    bounded_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *row_keys(id_col, text_col))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts of keyed docs."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


# ------------------------------------------------------------ Python workers


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@functools.cache
def _libc():
    """The C library, told to give large freed blocks back at once."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
        return libc
    except (OSError, AttributeError):
        return None


def frugal(run):
    """run(batches) of mapInArrow in a worker that returns what it has freed:
    workers live on between stages, and beside the next one's."""

    def own(batches):
        libc = _libc()
        try:
            yield from run(batches)
        finally:
            if libc is not None:
                libc.malloc_trim(0)

    return own


def planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, all first bytes, then all second ones: high bytes
    are mostly zero, and compress to nothing."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(packed: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def arrow_batch(schema: pa.Schema, rows) -> pa.RecordBatch:
    """A batch of rows given as tuples."""
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


# ---------------------------------------------------------------- hashing

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    base = _INVERSE if inverse else _BASE
    got = _powers.get(str(base))
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        got = _powers[str(base)] = np.multiply.accumulate(steps)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xCA9B0C7EBA1DA115)
    return x ^ (x >> np.uint64(32))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol * base**position modulo 2**64, from 0 to all."""
    values = _BYTES[symbols] if symbols.dtype == np.uint8 else symbols
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(len(values), False), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of symbols[start:end], equal for equal symbols anywhere."""
    return mix((prefix[end] - prefix[start]) * _power(len(prefix), True)[start])


def rolling(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every window of `width` symbols, by start."""
    n = len(prefix) - 1 - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return mix((prefix[width:] - prefix[:n]) * _power(n, True))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACES[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end = word_spans(data)
    return span_hashes(prefix_hashes(data), start, end), start, end


def map_texts(df: DataFrame, of_text, names: list[str], types: list[str]) -> DataFrame:
    """doc_id and the columns that of_text(text) returns as a tuple, a row for
    each row of keyed(df); Arrow keeps null ids and long integers as they are."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(", ".join(["doc_id long", *(f"{n} {t}" for n, t in zip(names, types))]))

    def run(batches):
        out = to_arrow_schema(schema)
        for batch in batches:
            rows = [of_text(t) for t in batch.column("text").to_pylist()]
            cols = zip(*rows) if rows else [()] * len(names)
            arrays = [batch.column("doc_id"), *(pa.array(c, type=f.type) for c, f in zip(cols, list(out)[1:]))]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.select("doc_id", "text").mapInArrow(frugal(run), schema)
