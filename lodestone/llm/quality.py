"""A quality classifier: a byte-level convolutional network in numpy, trained here.

Learned embeddings of bytes, filters of 8 bytes at every fourth byte, ReLU; the greatest answer of each
filter in half-chunks of 256 bytes; two neighbouring halves make a chunk of 512 bytes, each overlapping
the next by half, which together cover the whole document; the chunks' greatest and mean answers go
through a small dense layer to one probability. Training takes a bounded sample of labelled rows: SAMPLE of
either class, and of each the whole text or, of one longer than TRAIN_HALVES halves, so many evenly spread
over it. Scoring takes every byte, AT_ONCE halves at a time, so its memory is that of the text.

Defined results: a null or empty text is scored as one chunk of zero bytes; of a document with several
labels the least counts; with one class or none to learn from the score is that class's label, or 0.5;
repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

EMBED, FILTERS, HIDDEN, HALF = 8, 32, 16, 64  # HALF: positions of 4 bytes in half a chunk
AT_ONCE = 256
SAMPLE, TRAIN_HALVES, EPOCHS, BATCH, RATE, SEED = 512, 96, 24, 32, 0.004, 11


def places(offs: np.ndarray, most: int | None = None):
    """(document, first byte, end of the document's bytes) of each half, and the first half of each document."""
    count = np.maximum(1, -(-np.diff(offs) // (4 * HALF)))
    take = np.minimum(count, most) if most else count
    doc = np.repeat(np.arange(len(count)), take)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(take) - take, take)
    k = k * count[doc] // take[doc]  # all of them, or in training so many evenly spread
    return doc, offs[:-1][doc] + 4 * HALF * k, offs[1:][doc], np.cumsum(take) - take


def halves(buf: np.ndarray, at: np.ndarray, end: np.ndarray):
    """(bytes (halves, 260), live positions) of the halves that begin at the places at."""
    where = at[:, None] + np.arange(4 * HALF + 4)
    inside = where < end[:, None]
    grid = np.where(inside, buf[np.minimum(where, max(len(buf) - 1, 0))], 0).astype(np.uint8) if len(buf) else np.zeros(where.shape, np.uint8)
    return grid, np.arange(HALF)[None, :] * 4 < np.maximum(end - at, 1)[:, None]


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        n = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "emb": n(256, EMBED, scale=0.5), "w1": n(4 * EMBED, FILTERS, scale=0.15), "w2": n(4 * EMBED, FILTERS, scale=0.15), "b": np.zeros(FILTERS, np.float32),
            "v": n(2 * FILTERS, HIDDEN, scale=0.15), "c": np.zeros(HIDDEN, np.float32), "u": n(HIDDEN, scale=0.3), "d": np.zeros(1, np.float32),
        }

    def pooled(self, grid, live, keep: bool = False):
        p = self.p
        e = p["emb"][grid].reshape(len(grid), HALF + 1, 4 * EMBED)
        a = e[:, :HALF].reshape(-1, 4 * EMBED) @ p["w1"] + e[:, 1:].reshape(-1, 4 * EMBED) @ p["w2"]
        a = np.maximum(a + p["b"], 0).reshape(len(grid), HALF, FILTERS) * live[:, :, None]
        return (a.max(1), a.argmax(1), e) if keep else a.max(1)

    def head(self, top: np.ndarray, first: np.ndarray):
        """The probability of each document from its halves' answers, and what training needs."""
        p = self.p
        n = np.diff(np.concatenate([first, [len(top)]]))
        last = np.zeros(len(top), bool)
        last[first + n - 1] = True
        alone = np.repeat(n == 1, n)
        chunk = np.maximum(top, np.concatenate([top[1:], top[-1:]]))
        chunk[last & ~alone] = 0  # the last half lies in the chunk before
        chunk[alone] = top[alone]
        chunks = np.maximum(n - 1, 1)
        high, mean = np.maximum.reduceat(chunk, first), np.add.reduceat(chunk, first) / chunks[:, None]
        z = np.concatenate([high, mean], axis=1)
        h = np.maximum(z @ p["v"] + p["c"], 0)
        logit = np.clip(h @ p["u"] + p["d"], -30, 30)
        return 1 / (1 + np.exp(-logit)), (n, alone, last, chunk, chunks, z, h, high)

    def step(self, grid, live, first, y, weight):
        """The gradient of the weighted log loss of a batch."""
        p = self.p
        top, arg, e = self.pooled(grid, live, True)
        prob, (n, alone, last, chunk, chunks, z, h, high) = self.head(top, first)
        g = ((prob - y) * weight / len(y)).astype(np.float32)
        out = {"u": h.T @ g, "d": np.array([g.sum()], np.float32)}
        dh = g[:, None] * p["u"] * (h > 0)
        out["v"], out["c"] = z.T @ dh, dh.sum(0)
        dz = dh @ p["v"].T
        doc = np.repeat(np.arange(len(n)), n)
        dchunk = (dz[:, FILTERS:] / chunks[:, None])[doc]
        best = (chunk == high[doc]) & (chunk > 0)
        dchunk = dchunk + dz[:, :FILTERS][doc] * best / np.maximum(np.add.reduceat(best, first, dtype=np.float32), 1)[doc]
        dchunk[last & ~alone] = 0
        mine = (chunk == top) | alone[:, None]
        dtop = dchunk * mine
        dtop[1:] += (dchunk * ~mine)[:-1]
        dtop *= top > 0
        rows = np.arange(len(top))[:, None]
        x1, x2 = e[rows, arg], e[rows, arg + 1]
        out["w1"], out["w2"], out["b"] = np.einsum("hfk,hf->kf", x1, dtop), np.einsum("hfk,hf->kf", x2, dtop), dtop.sum(0)
        demb = np.zeros_like(p["emb"])
        for w, shift in ((p["w1"], 0), (p["w2"], 4)):
            d = (dtop[:, :, None] * w.T[None]).reshape(-1, EMBED)
            b = grid[rows[:, :, None], 4 * arg[:, :, None] + np.arange(shift, shift + 4)].ravel()
            for k in range(EMBED):
                demb[:, k] += np.bincount(b, d[:, k], 256).astype(np.float32)
        out["emb"] = demb
        return out

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> "Network":
        """examples: (bytes, live positions) of each document's halves."""
        r = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        for epoch in range(epochs):
            order = r.permutation(len(examples))
            for i in range(0, len(order), BATCH):
                who = order[i : i + BATCH]
                grid, live = (np.concatenate([examples[j][k] for j in who]) for k in (0, 1))
                first = np.concatenate([[0], np.cumsum([len(examples[j][0]) for j in who])])[:-1]
                t += 1
                rate = RATE * (1 - epoch / epochs)
                for k, g in self.step(grid, live, first, y[who], weight[who]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
        return self

    def score(self, buf: np.ndarray, offs: np.ndarray, at_once: int = AT_ONCE) -> np.ndarray:
        _, at, end, first = places(offs)
        top = np.concatenate([self.pooled(*halves(buf, at[i : i + at_once], end[i : i + at_once])) for i in range(0, len(at), at_once)])
        return self.head(top, first)[0]


class Constant:
    """The answer where there is nothing to learn from."""

    def __init__(self, value: float):
        self.value = value

    def score(self, buf, offs):
        return np.full(len(offs) - 1, self.value)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality"):
    """Learn from at most sample labelled rows of either class, drawn by a hash of their doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    best = rows.groupBy("y", F.pmod("h", F.lit(sample)).alias("b")).agg(F.min("h").alias("h"))
    chosen = {r.doc_id: r.y for r in rows.join(best.select("y", "h"), ["y", "h"]).select("doc_id", "y").collect()}  # 2 * sample rows at most
    if not chosen:
        return Constant(0.5)
    # Of each text its bytes in so many halves are gathered, however long it is: 25 kB at most.
    wide = 4 * HALF + 4

    def cut(batches):
        for rows, buf, offs in C.text_slices(batches):
            doc, at, end, first = places(offs, TRAIN_HALVES)
            grid, live = halves(buf, at, end)
            edge = np.append(first, len(doc))
            parts = [grid[i:j].tobytes() + np.packbits(live[i:j], axis=1).tobytes() for i, j in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(parts, pa.binary())], ["doc_id", "part"])

    got = C.source(docs, text_col, id_col).where(F.col("doc_id").isin(sorted(chosen))).mapInArrow(cut, "doc_id long, part binary")
    parts = {r.doc_id: r.part for r in got.groupBy("doc_id").agg(F.min("part").alias("part")).collect()}
    ids = sorted(parts)
    y = np.array([chosen[i] for i in ids])
    if not ids or y.min() == y.max():
        return Constant(float(y[0]) if ids else 0.5)

    def example(part):
        n = len(part) // (wide + HALF // 8)
        raw = np.frombuffer(part, np.uint8)
        return raw[: n * wide].reshape(n, wide), np.unpackbits(raw[n * wide :].reshape(n, HALF // 8), axis=1).astype(bool)

    return Network().fit([example(parts[i]) for i in ids], y)


def score(docs: DataFrame, model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rows, buf, offs in C.text_slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(shared.value.score(buf, offs).astype(np.float64))], ["doc_id", "score"])

    return C.source(docs, text_col, id_col).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn on the rows that aren't held out, score all."""
    from .langid import held_out

    held = F.coalesce(held_out("doc_id", 3, 1), F.lit(False))
    model = train(docs, labels.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
