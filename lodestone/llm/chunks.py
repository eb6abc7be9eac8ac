"""Texts in chunks, and exchanges of packed arrays between chunks and buckets of hashes.

The texts are written once, in rows of a few megabytes (chunks), to the shared folder. A pass over
chunks sends each bucket of the hash space one packed row for each chunk; a pass over buckets answers
each chunk with one packed row. Nothing is exploded to a row for each word or byte: sorted hashes go as
differences, in as few bytes as they need, compressed. Chunks and buckets grow with the square root of
the texts up to MOST bytes, so that rows are few and each holds many entries; their numbers, and those of
the shuffles' partitions, grow with the texts, so a task's share doesn't. (At 100 TB of text there are 3 million
chunks and half as many buckets, and a row holds 3 or 4 hashes: the cost is then near that of a shuffle of
a row for each few words, and a larger MOST, for executors with more memory, lowers it.)

A key that very many texts have (a hot one) can't be told by its bucket alone: the operators count each
key's entries first and deal the entries of hot keys by a longer key.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST, MOST, LEAST_BUCKETS = 1 << 21, 1 << 25, 256  # bytes of text of a chunk; buckets
NO_ID = (1 << 63) - 1  # stands for a null doc_id, which comes after all others
BITS = 28  # of a hash inside its bucket
_U = np.uint64


class Chunks(NamedTuple):
    rows: DataFrame  # chunk, ids, offs, data
    buckets: int
    parts: int  # of a shuffle of all texts


def side(total: int) -> int:
    """The bytes of a chunk where all texts have total bytes."""
    return min(MOST, max(LEAST, math.isqrt(total << 12)))


def make(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Chunks:
    """All rows' texts, packed, compressed and written, in the order of the rows."""
    spark = docs.sparkSession
    rows = C.source(docs, text_col, id_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    limit = side(total)

    def run(batches):
        held, size = [], 0

        def flush():
            lens = np.concatenate([np.diff(o) for _, o, _ in held])
            data = np.concatenate([b for _, _, b in held])
            out = [np.concatenate([x for x, _, _ in held]).tobytes(), np.concatenate([[0], np.cumsum(lens)]).astype(np.int64).tobytes(), zstandard.compress(data.tobytes(), 3)]
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), *[pa.array([x], pa.binary()) for x in out]], ["chunk", "ids", "offs", "data"])

        for rows, buf, offs in C.text_slices(batches, limit):
            held.append((rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64), offs, buf.copy()))
            size += len(buf) + 16 * len(offs)
            if size >= limit:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    made = C.materialize(rows.mapInArrow(run, "chunk long, ids binary, offs binary, data binary"))
    return Chunks(made, max(LEAST_BUCKETS, total // (2 * limit)), C.parts(spark, total))


def unpack(batches, answered: bool = False):
    """(chunk, ids, offs, buf, answers or None) of each chunk."""
    for b in batches:
        at = [b.schema.get_field_index(x) for x in ("chunk", "ids", "offs", "data")]
        told = b.column(b.schema.get_field_index("answers")) if answered else None
        for i in range(b.num_rows):
            c, ids, offs, data = (b.column(k)[i] for k in at)
            raw = lambda x: np.frombuffer(x.as_buffer(), np.int64)
            more = [(x["bucket"].as_py(), x["answer"].as_py()) for x in told[i].values] if answered and told[i].is_valid else None
            yield c.as_py(), raw(ids), raw(offs), np.frombuffer(zstandard.decompress(data.as_py()), np.uint8), more
    C.release()


# ---- keys -------------------------------------------------------------------------------------------
def key(h: np.ndarray, n: int) -> np.ndarray:
    """bucket << BITS | the hash's low bits, of 64-bit hashes."""
    return ((h >> _U(BITS)) % _U(n)) << _U(BITS) | (h & _U((1 << BITS) - 1))


def home(ids: np.ndarray, buf: np.ndarray, n: int, count: int) -> np.ndarray:
    """The bucket, count times, of entries that a chunk sends to be told again."""
    return np.full(count, (int(ids[0]) + len(buf)) % n)


def bucket_of(k: np.ndarray) -> np.ndarray:
    return (k >> _U(BITS)).astype(np.int64)


def inside(k: np.ndarray) -> np.ndarray:
    """What of a key is sent to its bucket."""
    return (k & _U((1 << BITS) - 1)).astype(np.uint32)


def whole(bucket: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The key again, from an answer."""
    return bucket.astype(_U) << _U(BITS) | h.astype(_U)


def among(values: np.ndarray, known: np.ndarray):
    """The place of each value in the sorted known, -1 where it isn't there."""
    if not len(known):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns begin to differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


# ---- packing ----------------------------------------------------------------------------------------
_PLAIN, _SORTED, _SIGNED = 0, 1, 2
_SHORTER, _LONGER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(kinds) -> bytes:
    """Lists of arrays, each list of one length, each perhaps ending in bytes; as short as may be."""
    out = [bytes([len(kinds)])]
    for arrays in kinds:
        blob = arrays[-1] if arrays and isinstance(arrays[-1], bytes) else None
        arrays = arrays if blob is None else arrays[:-1]
        out.append(np.array([len(arrays), len(arrays[0]), -1 if blob is None else len(blob)], np.int64).tobytes())
        for a in arrays:
            how = _SIGNED if a.dtype.kind == "i" else _PLAIN
            if a.dtype.kind == "i":
                a = ((a << 1) ^ (a >> 63)).view(_U)
            elif a.dtype.itemsize >= 4 and len(a) > 1 and (a[1:] >= a[:-1]).all():
                a, how = np.concatenate([a[:1], np.diff(a)]), _SORTED
            a = a.astype("<u8")
            width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
            out += [bytes([how, width]), a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
        if blob is not None:
            out.append(blob)
    return _SHORTER.compress(b"".join(out))


def unpacked(raw: bytes) -> list[list]:
    raw = _LONGER.decompress(raw)
    at, kinds = 1, []
    for _ in range(raw[0]):
        count, n, blob = np.frombuffer(raw, np.int64, 3, at).tolist()
        at += 24
        arrays: list = []
        for _ in range(count):
            how, width = raw[at], raw[at + 1]
            at += 2
            a = np.zeros((n, 8), np.uint8)
            a[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
            a = a.view("<u8").ravel()
            at += n * width
            arrays.append(np.cumsum(a, dtype=_U) if how == _SORTED else (a >> _U(1)).astype(np.int64) ^ -(a & _U(1)).astype(np.int64) if how == _SIGNED else a)
        if blob >= 0:
            arrays.append(raw[at : at + blob])
            at += blob
        kinds.append(arrays)
    return kinds


def merged(parts: list[list]):
    """(which part each entry is of, arrays and perhaps bytes) of one kind's lists."""
    of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    return of, [b"".join(x) if isinstance(x[0], bytes) else np.concatenate(x) for x in zip(*parts)]


def joined(answers) -> list[tuple[np.ndarray, list]] | None:
    """(bucket of each entry, arrays) of each kind of a chunk's answers; None without any."""
    if not answers:
        return None
    kinds = [unpacked(raw) for _, raw in answers]
    out = []
    for parts in zip(*kinds):
        of, arrays = merged(parts)
        out.append((np.array([b for b, _ in answers], np.int64)[of], arrays))
    return out


# ---- the exchange -----------------------------------------------------------------------------------
class Pieces(NamedTuple):
    """Byte strings of data, one for each entry of a kind."""

    start: np.ndarray
    end: np.ndarray
    data: bytes


def exchange(chunks: Chunks, send, solve, answers: DataFrame | None = None) -> DataFrame:
    """(chunk, answers): what solve answers to what send gives each bucket.

    send(ids, offs, buf, answers) -> kinds, each (bucket of each entry, arrays by entry, perhaps Pieces last);
    solve(kinds), each (place of the sender of each entry, arrays, perhaps bytes last)
      -> kinds, each (place of the sender of each answer, arrays).
    """
    n, parts, answered = chunks.buckets, chunks.parts, answers is not None

    def out(batches):
        for chunk, ids, offs, buf, told in unpack(batches, answered):
            dealt = []
            for bucket, arrays in send(ids, offs, buf, told):
                order = np.argsort(bucket, kind="stable")
                pieces = arrays[-1] if isinstance(arrays[-1], Pieces) else None
                arrays = [a[order] for a in (arrays if pieces is None else arrays[:-1])]
                if pieces is not None:
                    pieces = Pieces(pieces.start[order].tolist(), pieces.end[order].tolist(), pieces.data)
                dealt.append((np.searchsorted(bucket[order], np.arange(n + 1)), arrays, pieces))
            has = np.flatnonzero(np.any([at[1:] > at[:-1] for at, _, _ in dealt], axis=0))
            for i in range(0, len(has), 256):
                rows = []
                for k in has[i : i + 256].tolist():
                    kinds = []
                    for at, arrays, pieces in dealt:
                        s, e = int(at[k]), int(at[k + 1])
                        kinds.append([a[s:e] for a in arrays] + ([b"".join(pieces.data[x:y] for x, y in zip(pieces.start[s:e], pieces.end[s:e]))] if pieces else []))
                    rows.append(pack(kinds))
                yield pa.RecordBatch.from_arrays([pa.array(has[i : i + 256], pa.int64()), pa.array(np.full(len(rows), chunk)), pa.array(rows, pa.binary())], ["bucket", "chunk", "packed"])

    def back(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_numpy()
        got = [unpacked(x.as_py()) for x in table.column("packed")]
        said = solve([merged(parts) for parts in zip(*got)])
        cuts, sorted_ = [], []
        for sender, arrays in said:
            order = np.argsort(sender, kind="stable")
            sorted_.append([a[order] for a in arrays])
            cuts.append(np.searchsorted(sender[order], np.arange(len(got) + 1)))
        has = np.flatnonzero(np.any([c[1:] > c[:-1] for c in cuts], axis=0))
        rows = [pack([[a[c[k] : c[k + 1]] for a in arrays] for c, arrays in zip(cuts, sorted_)]) for k in has]
        bucket = table.column("bucket")[0].as_py()
        return pa.table([pa.array(chunk[has], pa.int64()), pa.array(np.full(len(has), bucket), pa.int64()), pa.array(rows, pa.binary())], ["chunk", "bucket", "answer"])

    sent = (chunks.rows if answers is None else with_answers(chunks, answers)).mapInArrow(out, "bucket long, chunk long, packed binary")
    told = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(back, "chunk long, bucket long, answer binary")
    return C.materialize(told.repartition(parts, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers")))  # one entry for each bucket


def with_answers(chunks: Chunks, answers: DataFrame) -> DataFrame:
    return chunks.rows.repartition(chunks.parts, "chunk").join(answers.repartition(chunks.parts, "chunk"), "chunk", "left")


# ---- what operators on repeats share ------------------------------------------------------------------
def counted(k: np.ndarray, ids: np.ndarray, *flags: np.ndarray):
    """Of each distinct key: (key, how often, whether under several ids, flags by or)."""
    order = np.argsort(k)
    at = heads(k[order])
    if not len(at):
        return k, np.zeros(0, np.uint64), np.zeros(0, bool), *[f[:0] for f in flags]
    d = ids[order]
    return k[order][at], np.diff(np.append(at, len(k))).astype(_U), np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at), *[np.logical_or.reduceat(f[order], at) for f in flags]


def of_keys(kind):
    """(order, head of each group, group of each sorted entry) of the entries' first array."""
    order = np.argsort(kind[1][0])
    at = heads(kind[1][0][order])
    group = np.zeros(len(order), np.int64)
    group[at[1:]] = 1
    return order, at, np.cumsum(group)


def copies_sent(ids, offs, buf, long_enough, n):
    """A kind that tells each distinct text that is long enough: 128 bits of its hash, least and greatest id."""
    raw = buf.tobytes()
    which = np.flatnonzero(long_enough)
    h = [hashlib.md5(raw[s:e]).digest() for s, e in zip(offs[which].tolist(), offs[which + 1].tolist())]
    return least_sent(*np.frombuffer(b"".join(h), _U).reshape(-1, 2).T, ids[which], n)


def least_sent(h, second, ids, n):
    """A kind: each distinct pair of hashes with its least and greatest id."""
    order = np.lexsort((second, h))
    h, second, ids = h[order], second[order], ids[order]
    at = heads(h, second)
    low, high = (f.reduceat(ids, at) if len(at) else ids for f in (np.minimum, np.maximum))
    return ((h[at] >> _U(32)) % _U(n)).astype(np.int64), [h[at], second[at], low, high]


def least_told(kind):
    """Of each pair of hashes the least id, told to those that have it with a greater id."""
    sender, (h, second, low, high) = kind
    order = np.lexsort((second, h))
    at = heads(h[order], second[order])
    if not len(at):
        return sender, [h, second, low]
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[order], at), np.diff(np.append(at, len(h))))
    which = np.flatnonzero(least < high)
    return sender[which], [h[which], second[which], least[which]]


def least_of(told, h, second):
    """The least id of each pair of hashes by the answers, NO_ID where none came."""
    _, (a, b, least) = told
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    out = np.full(len(h), NO_ID)
    # equal first hashes with other second ones are next to each other, and all but never occur
    at = np.searchsorted(a, h)
    todo = np.flatnonzero(at < len(a))
    while len(todo):
        todo = todo[a[at[todo]] == h[todo]]
        same = b[at[todo]] == second[todo]
        out[todo[same]] = least[at[todo[same]]]
        todo = todo[~same]
        at[todo] += 1
        todo = todo[at[todo] < len(a)]
    return out


def copies(told, ids, offs, buf, long_enough) -> np.ndarray:
    """Which texts of a chunk are later copies of one with a smaller id."""
    gone = np.zeros(len(ids), bool)
    if told is None or not len(told[1][0]):
        return gone
    raw, which = buf.tobytes(), np.flatnonzero(long_enough)
    h = np.frombuffer(b"".join(hashlib.md5(raw[s:e]).digest() for s, e in zip(offs[which].tolist(), offs[which + 1].tolist())), _U).reshape(-1, 2)
    gone[which] = least_of(told, h[:, 0], h[:, 1]) < ids[which]
    return gone


def windows(x: np.ndarray, k: int, how) -> np.ndarray:
    """how (minimum, for one) over each k entries in a row, by doubling."""
    size, step = 1, x
    while 2 * size <= k:
        step = how(step[:-size], step[size:])
        size *= 2
    return how(step[: len(x) - k + 1], step[k - size : k - size + len(x) - k + 1])


NEVER = _U((1 << 64) - 1)


def anchored(hashes: np.ndarray, live: np.ndarray, ok: np.ndarray, k: int):
    """(first window, last window, anchor's place) of each run of windows with one anchor.

    A window's anchor is, of its k places, the live one whose hash's high half is least, the leftmost of
    several; so it depends on the window's content alone. ok: the windows that lie within a text.
    """
    place = np.arange(len(hashes), dtype=_U)
    best = windows(np.where(live, hashes & _U(0xFFFFFFFF00000000) | place, NEVER), k, np.minimum)[: len(ok)]
    there = ok & (best != NEVER)
    apart = best[1:] != best[:-1]
    none = np.array([True])
    first = np.flatnonzero(there & np.concatenate([none, ~there[:-1] | apart]))
    last = np.flatnonzero(there & np.concatenate([~there[1:] | apart, none])) if len(there) else first
    return first, last, (best[first] & _U(0xFFFFFFFF)).astype(np.int64)


def each(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places from each first to its last."""
    n = last - first + 1
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def removed_spans(cover: np.ndarray):
    """Starts and ends of the runs of true."""
    x = np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))
    return np.flatnonzero(x == 1), np.flatnonzero(x == -1)


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie within length places from a start."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge)[:-1] > 0


def bits(start: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """start + each bit that is set in its mask."""
    e, b = np.nonzero((mask.astype(_U)[:, None] >> np.arange(64, dtype=_U)) & _U(1))
    return start.astype(np.int64)[e] + b


_FOUND = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def report(rows, size: str) -> pa.RecordBatch:
    """A batch of (doc_id, size, removed, spans, sha256 of what is kept, starts, ends)."""
    names = ["doc_id", size, "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
    return pa.RecordBatch.from_arrays([pa.array([None if x == NO_ID else x for x in c] if k == 0 else c, t) for k, (c, t) in enumerate(zip(zip(*rows), _FOUND))], names)


def found_schema(size: str) -> str:
    return f"doc_id long, {size} long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
