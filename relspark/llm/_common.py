"""Shared pieces: durable tables, checked broadcasts, and word hashing over whole texts."""

from __future__ import annotations

import atexit
import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of their values, that a broadcast side may have at most.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only where the session names none and runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="relspark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001 - at exit the JVM may be gone already
        return


def durable(df: DataFrame, drop: DataFrame | None = None) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: lineage ends there and a lost executor costs one task.

    ``drop`` is an earlier durable table that nothing reads any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/relspark-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._relspark_path = path
    atexit.register(_remove, spark, path)
    if drop is not None and getattr(drop, "_relspark_path", None):
        _remove(spark, drop._relspark_path)
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows and ``size`` bytes; else as it is (a shuffled join)."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    fixed = sum(_WIDTH.get(kind, 8 if "struct" not in kind else 64) for _, kind in df.dtypes if kind not in ("string", "binary"))
    width = sum(texts, F.lit(fixed)).cast("long").alias("w")
    n, most = df.select(width).limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and most <= size else df


def give_back() -> None:
    """Returns freed memory of a Python worker, which is used again by later tasks, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


# --- words -----------------------------------------------------------------------------------------------------------

_SEG = 1 << 19
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
WS = np.zeros(256, bool)
WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for k, m in (("p", _MULT), ("i", _INV)):
            a = np.full(_SEG + 1, m, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["i"]


def words(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""64-bit hashes, starts and ends (bytes) of the words ``[^\x20\x09-\x0D]+`` of UTF-8 bytes, A-Z lower-cased.

    A polynomial hash from running sums, so that no word becomes a Python object.  Memory beyond the result is
    bounded: long buffers go in segments that are cut at white space (a longer single word is hashed piecewise).
    """
    power, inverse = _powers()
    hs, ss, es = [], [], []
    at, n = 0, len(buf)
    while at < n:
        end = min(n, at + _SEG)
        if end < n:
            cut = max(buf.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:  # one word fills the segment
                stop = end
                while stop < n and not WS[buf[stop]]:
                    stop += 1
                hs.append(_long(buf, at, stop)), ss.append(np.array([at])), es.append(np.array([stop]))
                at = stop
                continue
            end = cut + 1
        a = np.frombuffer(buf, np.uint8, end - at, at)
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = ~WS[a]
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[a]] * power[: len(a)], out=sums[1:])
        hs.append(mix((sums[e] - sums[s]) * inverse[s])), ss.append(s + at), es.append(e + at)
        at = end
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hs), np.concatenate(ss), np.concatenate(es)


def _long(buf: bytes, start: int, end: int) -> np.ndarray:
    power, _ = _powers()
    total, scale = 0, 1
    for at in range(start, end, _SEG):
        a = np.frombuffer(buf, np.uint8, min(_SEG, end - at), at)
        total += int((_BYTE[_LOWER[a]] * power[: len(a)]).sum(dtype=np.uint64)) * scale
        scale = scale * pow(_MULT, _SEG, 1 << 64) % (1 << 64)
    return mix(np.array([total % (1 << 64)], np.uint64))


def word_batches(texts: list[bytes | None], limit: int = _SEG) -> Iterator[tuple]:
    """(first row, rows, bytes, hashes, starts, ends, offsets of each row's words) of runs of whole texts of about ``limit`` bytes."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or b"") < limit):
            size += len(texts[j] or b"") + 1
            j += 1
        buf = b"\n".join(t or b"" for t in texts[i:j])
        h, s, e = words(buf)
        begins = np.fromiter(itertools.accumulate((len(t or b"") + 1 for t in texts[i:j]), initial=0), np.int64, j - i + 1)
        yield i, j - i, buf, h, s, e, np.searchsorted(s, begins)
        i = j
