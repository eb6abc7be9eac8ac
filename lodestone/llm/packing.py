"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

No bin holds two documents of one source, nor two of one duplicate cluster (equal words, whatever
their case and spacing). Documents are dealt by row into shards of a bounded number of rows, so a
hot source or cluster is spread evenly, and each shard is packed by itself: longest first, bins
held in the order of their residual with a bitmap of sources and one of clusters each; from the
tightest bin that has room the search goes on to its successors until one is compatible, else a new
bin opens. A document longer than a bin fills whole bins with its first pieces; its rest is packed.

Defined results: null and empty texts have no words and get one row without a bin; a null source
conflicts with nothing; repeated rows are documents of their own, of one cluster; ties go to the
smaller doc_id, nulls first; an empty table gives an empty result; other columns are ignored. Rows are
dealt by their place in the input, so the same rows in other files may meet in other bins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY, SHARD_ROWS, LOOK = 2048, 8192, 256
_OUT = "doc_id long, piece long, start long, n_words long, bin_id long, bin_start long"


def measure(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, source, n, cluster) of each row; the texts go no further."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))

    def run(batches):
        for part, buf, offs in C.text_slices(batches):
            raw, n, cluster = buf.tobytes(), [], []
            for s, e in zip(offs[:-1].tolist(), offs[1:].tolist()):
                w = raw[s:e].lower().split()
                n.append(len(w))
                cluster.append(xxhash.xxh3_64_intdigest(b" ".join(w)) >> 1 if w else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(cluster, pa.int64())], ["doc_id", "source", "n", "cluster"])

    return rows.mapInArrow(run, "doc_id long, source string, n long, cluster long")


def _bits(keys) -> tuple[np.ndarray, int]:
    """A number for each key that comes more than once, -1 for others and nulls."""
    seen: dict = {}
    for k in keys:
        seen[k] = seen.get(k, 0) + 1
    number = {k: i for i, k in enumerate(k for k, n in seen.items() if n > 1 and k is not None)}
    return np.array([number.get(k, -1) for k in keys], np.int64), len(number)


class Bins:
    """Open bins in the order of residual (then age), with their bitmaps."""

    def __init__(self, sources: int, clusters: int):
        self.residual, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bits = np.zeros((64, (sources + 63) // 64 + (clusters + 63) // 64), np.uint64)
        self.shift, self.count = (sources + 63) // 64 * 64, 0

    def _places(self, source: int, cluster: int) -> list[int]:
        return [x for x in (source, self.shift + cluster if cluster >= 0 else -1) if x >= 0]

    def put(self, n: int, capacity: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, where it starts in it): the tightest compatible bin, or a new one."""
        places = self._places(source, cluster)
        i, at = int(np.searchsorted(self.residual, n)), -1
        while i < len(self.residual):
            who = self.number[i : i + LOOK]
            free = np.ones(len(who), bool)
            for p in places:
                free &= (self.bits[who, p >> 6] >> np.uint64(p & 63)) & np.uint64(1) == 0
            if free.any():
                at = i + int(free.argmax())
                break
            i += LOOK
        if at < 0:
            b, left = self.count, capacity
            self.count += 1
            if b >= len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
        else:
            b, left = int(self.number[at]), int(self.residual[at])
            self.residual, self.number = np.delete(self.residual, at), np.delete(self.number, at)
        for p in places:
            self.bits[b, p >> 6] |= np.uint64(1) << np.uint64(p & 63)
        j = int(np.searchsorted(self.residual, left - n, "right"))
        self.residual, self.number = np.insert(self.residual, j, left - n), np.insert(self.number, j, b)
        return b, capacity - left


def pack_shard(doc_id, source, n, cluster, capacity: int = CAPACITY) -> list[tuple]:
    """(row, piece, start, words, bin, start in bin) of each piece of a shard's rows."""
    out, rest = [], []
    for i, words in enumerate(n):
        whole = words // capacity if words else 0
        out += [(i, p, p * capacity, capacity, None, 0) for p in range(whole)]
        if words % capacity:
            rest.append((words % capacity, i, whole))
        elif not words:
            out.append((i, 0, 0, 0, -1, 0))
    s, s_n = _bits(source)
    c, c_n = _bits(cluster)
    bins = Bins(s_n, c_n)
    rest.sort(key=lambda x: (-x[0], -1 if doc_id[x[1]] is None else doc_id[x[1]], x[1]))
    for words, i, piece in rest:
        b, at = bins.put(words, capacity, int(s[i]), int(c[i]))
        out.append((i, piece, piece * capacity, words, b, at))
    full = bins.count  # bins of whole pieces come after the packed ones
    done = []
    for i, piece, start, words, b, at in out:
        if b is None:
            b, full = full, full + 1
        done.append((i, piece, start, words, b, at))
    return done


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, piece, start, n_words, bin_id, bin_start): start is the piece's first word in its document."""
    rows = C.materialize(measure(docs, text_col, id_col, source_col))
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        doc_id, source, n, cluster = (table.column(x).to_pylist() for x in ("doc_id", "source", "n", "cluster"))
        got = pack_shard(doc_id, source, n, cluster, capacity)
        base = table.column("shard")[0].as_py() << 32
        cols = [[doc_id[x[0]] for x in got], *[[x[k] for x in got] for k in (1, 2, 3)], [None if x[4] < 0 else base + x[4] for x in got], [None if x[4] < 0 else x[5] for x in got]]
        return pa.table([pa.array(x, pa.int64()) for x in cols], ["doc_id", "piece", "start", "n_words", "bin_id", "bin_start"])

    return dealt.groupBy("shard").applyInArrow(run, _OUT)
