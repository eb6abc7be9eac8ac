"""Benchmark decontamination: an exact containment join of item windows with documents.

A window is 8 consecutive words of an item (a shorter item is one window). Its shingles, of 3 words or all of
fewer, are ordered by how often they stand in all documents; for whole containment the necessary prefix is
the rarest one alone. One pass over the documents finds the places of prefix shingles; only their 64-bit
hashes are broadcast, BLOCK at a time (more are more passes). The places, each with the words around it, are
joined with the windows on the prefix. A place too near to either end of its document falls away (positional and
length bound), and the words themselves are compared. Equal texts are joined once. Where a side is large Spark
shuffles it and splits skewed keys.

Defined results: null and empty texts have no words; an item without words or without an id is no item;
repeated items each count by their item_id once; an empty benchmark leaves every document clean; repeated
documents, with or without an id, each get a row; further columns of either table are ignored; a very
long text is one slice, whose memory grows with it.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, SHINGLE, BLOCK, MIN_ITEMS, SHORT = 8, 3, 1 << 22, 2, 4


def _words(buf: np.ndarray, offs: np.ndarray):
    low = C.LOWER[buf]
    starts, ends = C.word_spans(low, offs, C.ALNUM)
    return low, starts, ends, C.spans_hash(low, starts, ends)


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k words; those of different k differ."""
    return C.mix(C.windows_hash(h, k) + np.uint64(k)).view(np.int64)


def item_windows(bench: DataFrame, window: int = WINDOW, least: int = 1) -> DataFrame:
    """(item_id, text, k, tokens): the windows of each item of least words or more, with their shingles' hashes."""

    def run(batches):
        for rows, buf, offs in C.text_slices(batches):
            low, starts, ends, h = _words(buf, offs)
            doc = C.owner(starts, offs)
            items = rows.column(0).to_pylist()
            size = np.bincount(doc, minlength=len(items)) if len(doc) else np.zeros(len(items), np.int64)
            first, out = np.cumsum(size) - size, []
            for i, item in enumerate(items):
                n, at = int(size[i]), int(first[i])
                k = min(window, n)
                if n < max(least, 1):
                    continue
                said = [low[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[at : at + n], ends[at : at + n])]
                s = _shingles(h[at : at + n], min(SHINGLE, k))
                out += [(item, " ".join(said[j : j + k]), k, s[j : j + k - min(SHINGLE, k) + 1]) for j in range(n - k + 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())))], ["item_id", "text", "k", "tokens"])

    return C.materialize(bench.mapInArrow(run, "item_id string, text string, k int, tokens array<long>"))


def _blocks(hashes: DataFrame, block: int):
    """Sorted arrays of the distinct hashes in column token, about block of them at a time."""
    distinct = C.materialize(hashes.distinct())
    n = -(-distinct.count() // block)
    for k in range(n):
        yield np.sort(distinct.where(F.pmod(F.xxhash64("token"), F.lit(n)) == k).toArrow()["token"].to_numpy())
    C.forget(distinct)


def shingle_counts(docs: DataFrame, windows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(token, n): how often each shingle of the windows stands in all documents, where it does."""
    out, sizes = None, _sizes(windows)
    for known in _blocks(windows.select(F.explode("tokens").alias("token")), block):
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches, shared=shared):
            v = shared.value
            total = np.zeros(len(v), np.int64)
            for at in _places(batches, v, sizes):
                total += np.bincount(at[2], minlength=len(v))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(v[at]), pa.array(total[at])], ["token", "n"])

        rows = docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return C.materialize(windows.sparkSession.createDataFrame([], "token long, n long") if out is None else out)


def _sizes(windows: DataFrame) -> list[int]:
    """The lengths of shingles that occur: SHINGLE, and less where items are shorter."""
    return sorted(r[0] for r in windows.select(F.least("k", F.lit(SHINGLE))).distinct().collect())


def _places(batches, known: np.ndarray, sizes: list[int]):
    """Of each slice: (slice's rows and words, first word, place in known) of the known shingles in it."""
    for rows, buf, offs in C.text_slices(batches):
        low, starts, ends, h = _words(buf, offs)
        doc, found = C.owner(starts, offs), []
        for k in sizes if len(known) else ():
            s = _shingles(h, k)
            if len(s):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                hit = np.flatnonzero((known[at] == s) & (doc[: len(s)] == doc[k - 1 :]))
                found.append((hit, at[hit]))
        pos, which = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield (rows, offs, low, starts, ends, doc), pos, which


def prefixes(docs: DataFrame, windows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(token, shift, k, text): each distinct window under its rarest shingle, shift words from its start."""
    counts = shingle_counts(docs, windows, block)
    each = windows.select("text", "k", "tokens").distinct().select("text", "k", F.posexplode("tokens").alias("shift", "token"))
    best = each.join(counts, "token", "left").groupBy("text", "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "shift")).alias("best"))
    return C.materialize(best.select("best.token", "best.shift", "k", "text"))


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def candidates(src: DataFrame, under: DataFrame, windows: DataFrame, window: int, block: int):
    """((doc_id, h, n_words) of each row of src, (h, token, pos, left, said) of each place of a prefix in each distinct text).

    src: doc_id, text and the text's key h. left: how many words said has before the place.
    """
    sizes, rows, places = _sizes(windows), None, None
    blocks = list(_blocks(under.select("token"), block)) or [np.zeros(0, np.int64)]
    for known in blocks:
        shared = src.sparkSession.sparkContext.broadcast(known)

        def run(batches, shared=shared):
            kind = pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("said", pa.string())]))
            for (part, offs, low, starts, ends, doc), pos, which in _places(batches, shared.value, sizes):
                size = np.bincount(doc, minlength=len(offs) - 1) if len(doc) else np.zeros(len(offs) - 1, np.int64)
                first = np.cumsum(size) - size
                found: list[list] = [[] for _ in range(len(size))]
                for p, w in zip(pos.tolist(), which.tolist()):
                    d = int(doc[p])
                    i, j = max(int(first[d]), p - window + 1), min(int(first[d] + size[d]), p + window)
                    said = b" ".join(low[s:e].tobytes() for s, e in zip(starts[i:j], ends[i:j])).decode("utf-8", "replace")
                    found[d].append({"token": int(shared.value[w]), "pos": p - int(first[d]), "left": p - i, "said": said})
                ids, h = (part.column(part.schema.get_field_index(x)) for x in ("doc_id", "h"))
                yield pa.RecordBatch.from_arrays([ids, h, pa.array(size, pa.int64()), pa.array(found, kind)], ["doc_id", "h", "n_words", "found"])

        got = C.materialize(src.mapInArrow(run, "doc_id long, h string, n_words long, found array<struct<token:long,pos:int,left:int,said:string>>"))
        each = got.where(F.size("found") > 0).groupBy("h").agg(F.first("found").alias("found")).select("h", F.inline("found"))
        rows, places = (got, each) if rows is None else (rows, places.unionByName(each))
    return rows.select("doc_id", "h", "n_words"), places


def hits(docs: DataFrame, benchmark: DataFrame, window: int, block: int, text_col: str, id_col: str, item_col: str, item_text_col: str, least: int = 1):
    """(rows as of candidates(), (h, text, start, k) of each occurrence of a window in a text, the items' windows)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _key(F.col(text_col)).alias("h"))
    bench = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null")
    windows = item_windows(bench, window, least)
    under = prefixes(src.select("doc_id", "text"), windows, block)
    rows, places = candidates(src, under, windows, window, block)
    here = F.array_join(F.slice(F.split("said", " "), F.col("left") - F.col("shift") + 1, F.col("k")), " ")
    near = places.join(under, "token").where("pos >= shift and left >= shift")
    return rows, near.where(here == F.col("text")).select("h", "text", (F.col("pos") - F.col("shift")).alias("start"), "k"), windows


_SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, starts array<long>, ends array<long>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, starts, ends): items sorted; starts and ends of the maximal hit runs, in words."""
    rows, found, windows = hits(docs, benchmark, window, block, text_col, id_col, item_col, item_text_col)
    found = C.materialize(found.distinct())
    items = found.select("h", "text").distinct().join(windows.select("text", "item_id").distinct(), "text").groupBy("h").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    spans = found.groupBy("h").agg(F.collect_set(F.struct("start", "k")).alias("spans")).join(items, "h")
    # Most texts have no hit and need no join; those that do, be they copied ever so often, are joined by row.
    many = C.materialize(rows.groupBy("h").agg(F.count("*").alias("n")))  # summed up before any join
    right = C.materialize(spans.join(many, "h"))
    total = right.agg(F.sum("n")).first()[0] or 0
    hit = C.spread_join(rows, right, "h", "n", total).select("doc_id", "n_words", "items", "spans")
    free = rows.join(right.select("h"), "h", "left_anti").select("doc_id", "n_words", F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<struct<start:int,k:int>>").alias("spans"))

    def run(batches):
        for b in batches:
            out = []
            for doc, n, items, spans in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("doc_id", "n_words", "items", "spans"))):
                edge = np.zeros(n + 2, np.int64)
                for s in spans or ():
                    edge[s["start"] + 1] += 1
                    edge[s["start"] + s["k"] + 1] -= 1
                step = np.diff(np.concatenate([(np.cumsum(edge) > 0)[:-1].astype(np.int8), [0]]))
                starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                out.append((doc, n, int((ends - starts).sum()), items or [], starts.tolist(), ends.tolist()))
            if out:
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), longs, longs))], [x.split()[0] for x in _SCHEMA.split(", ")])

    return hit.unionByName(free).mapInArrow(run, _SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, in which no whole window of an item occurs.

    An item of fewer words than a window is one window, as in contamination(), if it has SHORT words at
    least; one of fewer words is common speech, which clean documents hold too, and isn't looked for. One
    window is enough here, where report() asks for MIN_ITEMS items.
    """
    _, found, _ = hits(docs, benchmark, window, block, text_col, id_col, item_col, item_text_col, min(SHORT, window))
    gone = C.materialize(found.select("h").distinct())
    key = next(x for k in count() if (x := f"h_{k}") not in {c.lower() for c in docs.columns})
    return docs.join(gone.withColumnRenamed("h", key), _key(F.col(text_col)) == F.col(key), "left_anti")


def report(found: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """The digest columns of what contamination() finds."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"), "items", "starts", "ends",
    )
