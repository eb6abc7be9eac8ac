"""Pairs of texts whose word shingles are alike, found whole by an exact set-similarity join.

Shingles are ordered by how many texts have them, rarest first, counted over all texts. Two sets of a
Jaccard similarity of least or more share one of the first |x| - ceil(least |x|) + 1 shingles of each, so
every pair meets under such a shingle; those that one text alone has come first and meet nothing. Sizes
and the places of the shared shingle bound the overlap (length and positional filters). What passes is
verified on the sets: only shingles that several texts have can be common, so each text keeps the sorted
64-bit hashes of those, and its size. Texts themselves go no further than their chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as K
from . import common as C

HOT = 1 << 10  # texts of a block of a shingle that many texts have


def shingle_slice(buf: np.ndarray, offs: np.ndarray, shingle: int):
    """(document, hash) of each distinct shingle of a slice, ordered by both; a shorter document is one shingle."""
    starts, ends = C.word_spans(buf, offs, C.NON_SPACE)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, doc = C.spans_hash(C.LOWER[buf], starts, ends), C.owner(starts, offs)
    words = np.bincount(doc, minlength=len(offs) - 1)
    first = np.cumsum(words) - words
    s = C.windows_hash(h, shingle)
    whole = doc[: len(s)] == doc[len(doc) - len(s) :]
    docs, out = [doc[: len(s)][whole]], [s[whole]]
    for k in range(1, shingle):
        if len(short := np.flatnonzero(words == k)):
            docs.append(short)
            out.append(C.windows_hash(h, k)[first[short]])
    d, s = np.concatenate(docs), np.concatenate(out)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])])
    return d[new], s[new]


def _own(ids, offs, buf, told, shingle: int, kind: int):
    """shingle_slice() of the texts that aren't copies by the answers' kind, and the copies' places."""
    copy = np.zeros(len(ids), bool)
    if told:
        copy[told[kind][1][0].astype(np.int64)] = True
    d, s = shingle_slice(buf, offs, shingle)
    keep = ~copy[d]
    return d[keep], s[keep], np.flatnonzero(copy)


def sets(chunks: K.Chunks, copies: DataFrame, shingle: int, least: float) -> DataFrame:
    """(doc, size, shared, s, pos) of each text that another may reach least with: how many shingles it has,
    the hashes of those that other texts have too, and of its prefix those hashes with their places.

    copies: (chunk, answers) with the places of those rows of a chunk that don't take part.
    """
    n = chunks.buckets

    def send(ids, offs, buf, answers):
        d, s, gone = _own(ids, offs, buf, K.joined(answers), shingle, 0)
        k, times, _ = K.counted(K.key(s, n), d)
        return [(K.bucket_of(k), [K.inside(k), times]), (K.home(ids, buf, n, len(gone)), [gone.astype(np.uint32)])]

    def count(kinds):
        sender, (h, times) = kinds[0]
        order, at, group = K.of_keys(kinds[0])
        if not len(at):
            return [(sender, [h, times]), kinds[1]]
        total = np.add.reduceat(times[order], at)
        which = np.flatnonzero(total[group] > 1)
        return [(sender[order][which], [h[order][which].astype(np.uint32), total[group[which]]]), kinds[1]]

    told = K.exchange(chunks, send, count, copies)

    def run(batches):
        for _, ids, offs, buf, answers in K.unpack(batches, True):
            if not (told := K.joined(answers)):
                continue
            d, s, _ = _own(ids, offs, buf, told, shingle, 1)
            known = K.whole(told[0][0], told[0][1][0])
            order = np.argsort(known)
            at = K.among(K.key(s, n), known[order])
            often = np.where(at >= 0, told[0][1][1][order][at] if len(order) else 0, 0)
            size = np.bincount(d, minlength=len(ids))
            by = np.lexsort((s, often, d))
            place = np.empty(len(d), np.int64)
            place[by] = np.arange(len(d)) - (np.cumsum(size) - size)[d[by]]
            shared = at >= 0
            first = shared & (place <= size[d] - np.ceil(least * size[d] - 1e-9))
            rows = []
            cut = np.searchsorted(d, np.arange(len(ids) + 1))
            for i in np.unique(d[first]).tolist():
                part = slice(cut[i], cut[i + 1])
                mine = first[part]
                rows.append((int(ids[i]), int(size[i]), s[part][shared[part]].tobytes(), s[part][mine].view(np.int64), place[part][mine]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["doc", "size", "shared", "s", "pos"])

    out = C.materialize(K.with_answers(chunks, told).mapInArrow(run, "doc long, size long, shared binary, s array<long>, pos array<long>"))
    C.forget(told)
    return out


def entries(found: DataFrame) -> DataFrame:
    """(s, doc, pos, size, n, center) of those prefix shingles that n texts, two at least, have there; center: the text that has it earliest."""
    rows = found.select("doc", "size", F.explode(F.arrays_zip("s", "pos")).alias("e")).select("e.s", "doc", "e.pos", "size")
    of = rows.groupBy("s").agg(F.count("*").alias("n"), F.min(F.struct("pos", "size", "doc"))["doc"].alias("center")).where("n > 1")
    of = C.materialize(of)
    total = of.agg(F.sum("n")).first()[0] or 0
    out = C.materialize(C.spread_join(rows, of.withColumn("many", F.col("n")), "s", "many", total))
    C.forget(of)
    return out


def center_pairs(shared: DataFrame) -> DataFrame:
    """(u, v), u > v: each text and the center of each of its shingles; a first guess at the links."""
    return shared.where("doc <> center").select(F.greatest("doc", "center").alias("u"), F.least("doc", "center").alias("v")).distinct()


def all_pairs(shared: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(u, v), u > v: every pair that may reach least and isn't yet in one component; labels: (node, label).

    A shingle of many texts is dealt out in pairs of blocks of about HOT texts, so no task has it alone.
    """
    known = labels.select(F.col("node").alias("doc"), "label").distinct()
    rows = C.materialize(shared.join(known, "doc", "left").select("s", "doc", "pos", "size", F.coalesce("label", "doc").alias("label")))
    apart = rows.groupBy("s").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    apart = C.materialize(apart.select("s", "n", F.col("n").alias("many")))
    left = C.spread_join(rows, apart, "s", "many", apart.agg(F.sum("n")).first()[0] or 0)
    left = C.materialize(left.withColumn("blocks", F.ceil(F.col("n") / HOT).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).drop("n"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = left.select("s", F.col("block").alias("i"), other.alias("j"), *(F.col(x).alias(f"{x}_a") for x in ("doc", "pos", "size", "label")))
    b = left.select("s", other.alias("i"), F.col("block").alias("j"), *(F.col(x).alias(f"{x}_b") for x in ("doc", "pos", "size", "label")))
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("size_a") + F.col("size_b")) - 1e-9)
    rest = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    fits = (F.col("doc_a") > F.col("doc_b")) & (F.col("label_a") != F.col("label_b")) & (rest >= need) & (F.least("size_a", "size_b") >= F.lit(least) * F.greatest("size_a", "size_b") - 1e-9)
    out = C.materialize(a.join(b, ["s", "i", "j"]).where(fits).select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")).distinct())
    C.forget(rows, apart, left)
    return out


def alike(x: bytes, y: bytes, m: int, n: int, least: float) -> bool:
    """Whether two sets of m and n hashes, of which those that may be common are given sorted, have a Jaccard similarity of least."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (m + n - common) - 1e-9


def verified(pairs: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs (u, v) that reach least, by their sets."""
    of = lambda k: found.select(F.col("doc").alias(k), F.col("size").alias(f"size_{k}"), F.col("shared").alias(f"shared_{k}"))
    near = F.least("size_u", "size_v") >= F.lit(least) * F.greatest("size_u", "size_v") - 1e-9

    def run(batches):
        for t in batches:
            u, v, m, n, x, y = (t.column(t.schema.get_field_index(k)) for k in ("u", "v", "size_u", "size_v", "shared_u", "shared_v"))
            ok = pa.array([alike(p.as_buffer(), q.as_buffer(), i, j, least) for p, q, i, j in zip(x, y, m.to_pylist(), n.to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(ok), v.filter(ok)], ["a", "b"])

    return C.materialize(pairs.join(of("u"), "u").join(of("v"), "v").where(near).mapInArrow(run, "a long, b long"))
