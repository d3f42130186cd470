"""What the operators of this subpackage share: shared scratch tables, Arrow batches, byte buffers."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_folder

WORD = r"[^\x20\x09-\x0D]+"  # the words of every contract: runs without ASCII white space
BATCH_ROWS, BATCH_BYTES = 4_000, 4 << 20
POWERS = 1 << 20  # of the hash base that a worker keeps
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones((2, 1), np.uint64)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, any executor may be lost."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and bytes, so a Python worker's memory doesn't follow document length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus: the folds by which contracts hold rows out."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[0]
    h ^= h >> np.uint64(29)
    h = h * _MIX[1]
    h ^= h >> np.uint64(32)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(n: int) -> np.ndarray:
    """Powers of the hash base up to n, and of its inverse. At most POWERS of them are kept for the next call."""
    global _powers
    if _powers.shape[1] >= n:
        return _powers[:, :n]
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    grown = np.empty((2, max(n, 1 << 16)), np.uint64)
    for row, base in zip(grown, (_BASE, inverse), strict=True):
        row[0] = 1
        row[1:] = base
        np.multiply.accumulate(row, out=row)
    if len(grown[0]) <= POWERS:
        _powers = grown
    return grown[:, :n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes of bytes (one longer than data); slices of it give hashes of substrings."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][:-1], out=h[1:])
    return h


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes have equal hashes wherever they lie."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [b or b"" for b in texts.cast(pa.binary()).to_pylist()]


def pieces(texts: pa.Array, limit: int = 1 << 20):
    """Slices of about limit bytes (one text at least), as lists of bytes: bounds the memory of numpy temporaries."""
    held, size = [], 0
    for b in as_bytes(texts):
        if held and size + len(b) > limit:
            yield held
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield held
