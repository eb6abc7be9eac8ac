"""What the training-data operators share: stable storage, Arrow text slices, word hashing and components.

Every pass over texts works on the UTF-8 bytes of an Arrow column, a slice of about a megabyte at a
time, so memory doesn't depend on the rows in a batch; a longer document is one slice. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import spread_join

SLICE = 1 << 20  # bytes of text that numpy handles at once (a longer document is one slice)
PIECE = 1 << 18  # of these, bytes for which hashes are summed up at once


_own_dirs: dict[str, str] = {}  # by application, where nothing is configured


def _configured(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset.

    Without that setting a local session takes a temporary folder, any other the user's home in the
    default file system, which must be a shared one.
    """
    if path := _configured(spark):
        return path.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _own_dirs[app] = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        else:
            fs = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
            if fs.getUri().getScheme() == "file":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            _own_dirs[app] = f"{fs.getHomeDirectory().toString()}/lodestone"
    return _own_dirs[app]


#: In force while an intermediate result is written: small Arrow batches, and shuffle files that go with their query.
_WHILE_WRITING = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings with values, as they were before once the block ends."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, computed once.

    The files go with forget(), or at the end of the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    with settings(spark, _WHILE_WRITING):
        df.write.parquet(path)
    p, fs = _file_system(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that no later step reads."""
    for df in frames:
        if path := getattr(df, "_lodestone_path", None):
            p, fs = _file_system(df.sparkSession, path)
            fs.delete(p, True)


def parts(spark: SparkSession, size: int) -> int:
    """How many partitions a shuffle of about size bytes needs: of 32 MB, or for very much data of up to 256 MB."""
    each = min(1 << 28, max(1 << 25, math.isqrt(size << 20)))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def source(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text alone, so that further columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def release() -> None:
    """Give memory that this worker has freed back to the system: a worker stays for later tasks, next to others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE, column: str = "text"):
    """(rows, bytes, offsets) of runs of rows with about limit bytes of text."""
    for b in batches:
        t = b.column(b.schema.get_field_index(column))
        if not (n := len(t)):
            continue
        if t.null_count:
            t = t.fill_null("")
        wide = np.int64 if pa.types.is_large_string(t.type) else np.int32
        _, at, data = t.buffers()
        offs = np.frombuffer(at, wide, n + 1 + t.offset)[t.offset :].astype(np.int64)
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
            yield b.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j
    release()


def pieces(offs: np.ndarray, limit: int = 2 * PIECE):
    """(first, behind the last) of runs of a slice's documents with about limit bytes."""
    i = 0
    while i < len(offs) - 1:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _table(inside) -> np.ndarray:
    return np.array([bool(inside(c)) for c in range(256)])


#: Words of any bytes but the six ASCII spaces; and of letters, digits and non-ASCII.
NON_SPACE = _table(lambda c: c not in b" \t\n\x0b\x0c\r")
ALNUM = _table(lambda c: c >= 0x80 or chr(c).isalnum())
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def word_spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray):
    """Start and end byte of every word, none across two documents."""
    m = inside[buf]
    if not m.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    cut = offs[(offs > 0) & (offs < len(buf))]
    first[cut] = m[cut]
    last[cut - 1] = m[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_OTHER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)  # for a second, independent hash
_R, _R2 = 0x9E3779B97F4A7C15 | 5, 0xD1342543DE82EF95
_pows: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int):
    """base**i and its inverse, modulo 2**64, for i up to n."""
    have = _pows.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 17)
        inv = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inv):
            p = np.full(size, b & (2**64 - 1), _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _pows[base] = have = tuple(out)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, _U)
    out = np.empty(len(starts), _U)
    order = None if (starts[1:] >= starts[:-1]).all() else np.argsort(starts)
    s, e = (starts, ends) if order is None else (starts[order], ends[order])
    i = 0
    while i < len(s):  # a piece at a time: what is computed for each byte stays small
        j = int(np.searchsorted(s, s[i] + PIECE))
        lo, hi = int(s[i]), int(e[i:j].max())
        up, down = _powers(_R, hi - lo)
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(table[buf[lo:hi]] * up[: hi - lo], out=total[1:])
        out[i:j] = mix((total[e[i:j] - lo] - total[s[i:j] - lo]) * down[s[i:j] - lo])
        i = j
    if order is None:
        return out
    back = np.empty_like(out)
    back[order] = out
    return back


def windows_hash(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of k items; the result has k - 1 entries fewer."""
    n = len(words)
    if n < k:
        return np.zeros(0, _U)
    up, down = _powers(_R2, n)
    total = np.zeros(n + 1, _U)
    np.cumsum(words * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def owner(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The document, by its place in the slice, of each byte position."""
    return np.searchsorted(offs, starts, "right") - 1


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links a-b."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with a link, label the smallest node it reaches.

    edges: two long columns, a and b. Alternates the large-star and small-star steps, each a
    group-by and a join, until the links no longer change; no link reaches the driver, and a node
    of very many links is joined by a broadcast of the few such nodes.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(mark) == before or not mark[0]:
            break
        before, last = tuple(mark), edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = materialize(spread_join(both.where("v > u"), least, "u", "n", 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low, "u", "n", 2 * mark[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialize(small.where("u <> v").distinct())
        forget(last, large)
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return pairs.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
