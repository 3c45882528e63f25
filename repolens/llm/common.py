"""Shared helpers: the shared folder, materialised tables, byte views of Arrow text and word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 21

_B = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not getattr(spark, "_repolens_dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark._repolens_dir = "file://" + tempfile.mkdtemp(prefix="repolens-")
    return spark._repolens_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/repolens-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives a lost executor."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours in the shared store through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Columns of row_key.
ROW_KEY = ("k1_", "k2_")


def row_key(key: str, text: str) -> list[Column]:
    """Two longs that name a document: its id, and 63 bits of its text's hash with the sign for rows without an id, whose
    first long is another hash of the text. So any id will do, rows of one id and different texts are different documents,
    and rows of equal id (or none) and equal texts are one."""
    own, h = F.col(key).cast("long"), F.xxhash64(text, F.lit(1)).bitwiseAND(F.lit((1 << 63) - 1))
    return [F.coalesce(own, F.xxhash64(text, F.lit(2))).alias("k1_"), F.when(own.isNull(), h.bitwiseOR(F.lit(-(1 << 63)))).otherwise(h).alias("k2_")]


def longs(batch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def by_bucket(entries: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The buckets that occur, and the packed entries of each, in the order given. No array grows with the number of
    buckets."""
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
    return bucket[head], [entries[i:j].tobytes() for i, j in zip(head, np.r_[head[1:], len(entries)], strict=True)]


def text_view(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow text column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES):
    """(first, last) document ranges of about limit bytes; a longer document stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, PIECE_BYTES + 1)
        inv = np.uint64(pow(int(_B), -1, 1 << 64))
        up, down = np.full(size, _B), np.full(size, inv)
        up[0] = down[0] = _ONE
        _POWERS[0] = np.cumprod(up), np.cumprod(down)
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (data[j] + 1) * B^j for j < i."""
    up, _ = powers(max(1, len(data)))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _ONE) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Not part of a plain word: ASCII that is neither a letter nor a digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (maximal runs of bytes not in gap, within one document) and the first
    word's number of each document, with the total at the end."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~gap[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (first | ~before))
    ends = np.flatnonzero(before & (first | ~inside))
    return starts, ends, np.searchsorted(starts, offsets)
