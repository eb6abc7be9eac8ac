"""SimHash near-duplicates: Hamming links found with BK-trees.

Two fingerprints that differ in at most r of 64 bits leave at least 4 of r + 4 blocks of bits
untouched, so they meet under one of the C(r + 4, 4) choices of 4 blocks. Fingerprints, each kept
once, are dealt out by those keys; a key fixes so many bits that a group has a proven size. In a
group a BK-tree (children keyed by their Hamming distance to the parent) is walked with all members
at once, down the edges within the radius only, and a spanning forest of the links is emitted.

Defined results: a null or empty text has fingerprint 0 and links like any other; repeated rows
each get a row; a null doc_id stays null and is never a component's smallest id; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations, count
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as K
from . import common as C
from . import setjoin as J

SHINGLE, RADIUS, UNTOUCHED, AT_ONCE = 3, 2, 4, 1 << 15


def _majority(which: np.ndarray, n: np.ndarray, hashes) -> np.ndarray:
    """The bits that over half of each document's hashes have; which: of which document each is, hashes(i, j): some of them."""
    ones = np.zeros((len(n), 64), np.int64)
    for i in range(0, len(which), AT_ONCE):
        own = which[i : i + AT_ONCE]
        bits = np.unpackbits(hashes(i, i + len(own)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    bits = (2 * ones > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(-1)


def _shingles(doc: np.ndarray, docs: int, shingle: int):
    """(document of each shingle, its first word, how many words it has) of words by document; and each document's number of shingles."""
    words = np.bincount(doc, minlength=docs)
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    k = np.minimum(words, shingle)  # a shorter document is one shingle
    n = np.where(words > 0, words - k + 1, 0)
    which = np.repeat(np.arange(docs), n)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), k[which], n


def fingerprint_slice(buf: np.ndarray, offs: np.ndarray, shingle: int) -> np.ndarray:
    """The signed 64-bit fingerprint of each document of a slice, of XXH64 of its shingles."""
    starts, ends = C.word_spans(buf, offs, C.NON_SPACE)
    docs = len(offs) - 1
    if not len(starts):
        return np.zeros(docs, np.int64)
    lens = ends - starts
    text = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
    at = np.concatenate([[0], np.cumsum(lens + 1)])
    place = np.ones(len(text), bool)
    place[at[1:] - 1] = False
    text[place] = C.LOWER[buf[C.NON_SPACE[buf]]]
    which, begin, k, n = _shingles(C.owner(starts, offs), docs, shingle)
    lo, hi = at[begin], at[begin + k] - 1
    raw, h = text.tobytes(), xxhash.xxh64_intdigest
    return _majority(which, n, lambda i, j: np.array([h(raw[s:e], 42) for s, e in zip(lo[i:j].tolist(), hi[i:j].tolist())], np.uint64))


def quick_fingerprints(buf: np.ndarray, offs: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprints of the library's own shingle hashes, which are summed up without a call for each shingle."""
    starts, ends = C.word_spans(buf, offs, C.NON_SPACE)
    docs = len(offs) - 1
    if not len(starts):
        return np.zeros(docs, np.int64)
    h, doc = C.spans_hash(C.LOWER[buf], starts, ends), C.owner(starts, offs)
    which, begin, k, n = _shingles(doc, docs, shingle)
    out = np.zeros(len(which), np.uint64)
    for size in np.unique(k):
        here = np.flatnonzero(k == size)
        out[here] = C.windows_hash(h, int(size))[begin[here]]
    return _majority(which, n, lambda i, j: out[i:j])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp): one row per row of docs."""

    def run(batches):
        for rows, buf, offs in C.text_slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fingerprint_slice(buf, offs, shingle))], ["doc_id", "fp"])

    return C.source(docs, text_col, id_col).mapInArrow(run, "doc_id long, fp long")


def hamming(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class BKTree:
    """A BK-tree over distinct 64-bit values, built and asked a level of values at a time."""

    def __init__(self, values: np.ndarray, index: np.ndarray | None = None):
        index = np.arange(len(values)) if index is None else index
        self.value, self.index, self.children = values[0], index[0], {}
        if len(values) > 1:
            d = hamming(values[1:], self.value)
            for k in np.unique(d):
                at = d == k
                self.children[int(k)] = (values[1:][at], index[1:][at])

    def child(self, k: int) -> "BKTree":
        if isinstance(self.children[k], tuple):
            self.children[k] = BKTree(*self.children[k])
        return self.children[k]

    def within(self, queries: np.ndarray, radius: int):
        """Yields (places of queries, index of a value) for what lies within the radius."""
        todo = [(self, np.arange(len(queries)))]
        while todo:
            node, who = todo.pop()
            d = hamming(queries[who], node.value).astype(int)
            if (near := who[d <= radius]).size:
                yield near, node.index
            for k in node.children:
                if (go := who[np.abs(d - k) <= radius]).size:
                    todo.append((node.child(k), go))


def group_links(values: np.ndarray, radius: int):
    """A spanning forest of the links among distinct values: (value, root)."""
    v = np.unique(values.view(np.uint64))
    lab = np.arange(len(v))
    held, size = [], 0

    def fold(lab):
        a, b = np.concatenate([x for x, _ in held]), np.concatenate([np.full(len(x), y) for x, y in held])
        return C.local_components(len(v), np.concatenate([a, np.arange(len(v))]), np.concatenate([b, lab]))

    for near, at in BKTree(v).within(v, radius):
        if len(near) > 1:
            held.append((near, at))
            size += len(near)
            if size > 1 << 20:
                lab, held, size = fold(lab), [], 0
    if held:
        lab = fold(lab)
    out = lab != np.arange(len(v))
    return v[out].view(np.int64), v[lab[out]].view(np.int64)


def _masks(radius: int, untouched: int = UNTOUCHED) -> list[int]:
    """The bits that each choice of blocks keeps."""
    m = radius + untouched
    edge = [64 * i // m for i in range(m + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(m)]
    return [sum(block[i] for i in c) for c in combinations(range(m), untouched)]


def links(fps: DataFrame, radius: int = RADIUS, untouched: int = UNTOUCHED, solve_group=group_links) -> DataFrame:
    """(a, b): a spanning forest, by group, of the links between distinct fingerprints in column fp."""
    masks = [x - (1 << 64) if x >= 1 << 63 else x for x in _masks(radius, untouched)]
    assert len(masks) == comb(radius + untouched, untouched)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("choice", "key"))
    n = C.parts(fps.sparkSession, 32 * len(masks) * fps.count())

    def run(batches):
        rest = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def solve(c, k, v):
            cut = np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1
            for i, j in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(v)]])):
                if j - i > 1:
                    yield solve_group(v[i:j], radius)

        def emit(found):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in found])) for i in (0, 1)], schema=schema)

        for b in batches:
            now = [b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("choice", "key", "fp")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            c, k, _ = now
            if not len(c):
                continue
            keep = np.flatnonzero((c != c[-1]) | (k != k[-1]))
            end = int(keep[-1]) + 1 if keep.size else 0  # the last group may go on
            rest = [x[end:] for x in now]
            if end:
                yield from emit(list(solve(*[x[:end] for x in now])))
        if rest is not None and len(rest[0]) > 1:
            yield from emit(list(solve(*rest)))

    return keyed.repartition(n, "choice", "key").sortWithinPartitions("choice", "key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id: the smallest doc_id reachable over links."""
    prints = C.materialize(fingerprints(docs, shingle, text_col, id_col))
    reps = C.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    labels = C.materialize(C.components(links(reps.select("fp"), radius)))
    member = labels.select(F.col("node").alias("fp"), "label").join(reps, "fp")
    low = member.groupBy("label").agg(F.min("rep").alias("low"), F.count("*").alias("m"))
    linked = C.spread_join(member.select("fp", "label"), low, "label", "m", labels.count()).select("fp", "low")
    of = reps.join(linked, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id"), "n")
    out = C.spread_join(prints, of, "fp", "n", prints.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- one document of each group, for filtering a corpus -------------------------------------------
NEAR_SHINGLE, SIMILARITY = 2, 0.8


def keep_one(docs: DataFrame, shingle: int = 5, least: float = SIMILARITY, radius: int = RADIUS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stay when one document, that with the smallest doc_id, of each group does.

    Equal word sequences (ASCII letters lower-cased) are grouped first. Of the rest, SimHash (of 2-word
    shingles: they move less than longer ones when a word changes) and the shingles that texts share propose
    first links; then every pair that may reach least and that those links leave apart comes from an exact
    join of the shingle sets, so no pair is missed. A tie counts where the Jaccard similarity of the sets of
    shingles (64-bit hashes) is at least least; texts without words are equal, one of fewer words than a
    shingle is one shingle. Rows without a doc_id stay; rows that repeat a doc_id share its fate; an empty
    table stays empty; all columns stay as they are, whatever their names.
    """
    chunks = K.make(docs.where(F.col(id_col).isNotNull()), text_col, id_col)

    def run(batches):
        for chunk, ids, offs, buf, _ in K.unpack(batches):
            raw = buf.tobytes()
            exact = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(raw[s:e].lower().split())) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())), np.int64).reshape(-1, 2)
            columns = [pa.array(x) for x in (np.full(len(ids), chunk), np.arange(len(ids)), ids, quick_fingerprints(buf, offs, NEAR_SHINGLE), exact[:, 0].copy(), exact[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "row", "doc_id", "fp", "low", "high"])

    def places(table: pa.Table) -> pa.Table:
        row = np.sort(table.column("row").to_numpy())
        return pa.table([table.column("chunk").slice(0, 1), pa.array([K.pack([[row.astype(np.uint32)]])], pa.binary())], ["chunk", "answer"])

    prints = C.materialize(chunks.rows.mapInArrow(run, "chunk long, row long, doc_id long, fp long, low long, high long"))
    firsts = C.materialize(prints.groupBy("low", "high").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.count("*").alias("n")))
    many = firsts.where("n > 1").select(F.struct("low", "high").alias("of"), "first", "n")
    total = many.agg(F.sum("n")).first()[0] or 0
    copies = C.materialize(C.spread_join(prints.select(F.struct("low", "high").alias("of"), "chunk", "row", "doc_id"), many, "of", "n", total).where("doc_id <> first").select("chunk", "row", "doc_id"))
    told = copies.repartition(chunks.parts, "chunk").groupBy("chunk").applyInArrow(places, "chunk long, answer binary")
    told = C.materialize(told.select("chunk", F.array(F.struct(F.lit(0).cast("long").alias("bucket"), "answer")).alias("answers")))
    found = J.sets(chunks, told, shingle, least)
    C.forget(chunks.rows, prints, told)

    reps = C.materialize(firsts.groupBy("fp").agg(F.min("first").alias("rep"), F.count("*").alias("m")))
    rep_a, rep_b = (reps.select(F.col("fp").alias(x), F.col("rep").alias(y)) for x, y in (("a", "u"), ("b", "v")))
    near = links(reps.select("fp"), radius).distinct().join(rep_a, "a").join(rep_b, "b").select("u", "v")
    equal = C.spread_join(firsts.select("fp", F.col("first").alias("u")), reps.withColumnRenamed("rep", "v"), "fp", "m", firsts.count()).where("u <> v").select("u", "v")
    ties = near.unionByName(equal).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    shared = J.entries(found)
    links_ = J.verified(ties.unionByName(J.center_pairs(shared)).distinct(), found, least)
    labels = C.materialize(C.components(links_))
    pairs = J.all_pairs(shared, labels, least)
    links_ = links_.unionByName(J.verified(pairs, found, least))
    gone = C.components(links_).where("node <> label").select(F.col("node").alias("id"))
    gone = C.materialize(gone.unionByName(copies.select(F.col("doc_id").alias("id"))).distinct())
    C.forget(firsts, reps, copies, found, shared, labels, pairs)
    key = next(x for k in count() if (x := f"id_{k}") not in {c.lower() for c in docs.columns})
    return docs.join(gone.withColumnRenamed("id", key), F.col(id_col).cast("long") == F.col(key), "left_anti")
