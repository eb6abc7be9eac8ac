"""Language identification by cross-parsing.

For each language a suffix automaton of a bounded labelled sample is turned into a transition table that
restarts at the root where no longer match exists. Parsing a text with it greedily cuts it into longest
matches; the language that needs the fewest phrases for each byte wins. Texts are parsed in blocks, all
blocks of a slice side by side; each block is then entered again in the state the one before it ends in,
until its states are those of the first try, so the phrases are those of one parse from the first byte to
the last.

keep_identified() also rejects a text of JUDGED bytes or more that no language knows: its best parse needs
UNKNOWN phrases for each byte or more, so most of its matches are single bytes.

Defined results: und with score 0 for a null text and one without a letter; a tie goes to the language that sorts first;
with nothing to learn from every text is und; a null doc_id isn't held out; repeated rows each get a row;
further columns are ignored; a very long text is one slice, whose memory grows with it. What is broadcast
holds TABLE_BYTES at most: with very many languages each one's sample is shorter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE_DOCS, SAMPLE_BYTES, TABLE_BYTES, BLOCK = 64, 16000, 256 << 20, 512
UNKNOWN, JUDGED = 0.75, 16
MIN_CHARS, MAX_CHARS = 64, 4096
_FOLD = C.LOWER.copy()
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def automaton(text: bytes) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of text; state 0 is its root."""
    nxt, link, size = [{}], [-1], [0]
    last = 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


class Parser:
    """The tables of all languages over one alphabet; symbol 0 stands for bytes that no sample has."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        folded = {k: _FOLD[np.frombuffer(v, np.uint8)] for k, v in samples.items()}
        seen = np.unique(np.concatenate([*folded.values(), np.zeros(0, np.uint8)]))
        self.symbol = np.zeros(256, np.uint8)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.symbol = self.symbol[_FOLD]
        self.width = a = len(seen) + 1
        number = {int(c): i + 1 for i, c in enumerate(seen)}
        self.tables = []
        for k in self.langs:
            nxt = automaton(folded[k].tobytes())
            fresh = np.ones(a, np.int32)  # 4 * (state * width) + how many phrases ended
            for c, s in nxt[0].items():
                fresh[number[c]] = 4 * s * a
            t = np.tile(fresh + 1, (len(nxt), 1))
            t[0] = fresh
            for i, row in enumerate(nxt):
                for c, s in row.items():
                    t[i, number[c]] = 4 * s * a
            self.tables.append(t.ravel())

    def phrases(self, buf: np.ndarray, offs: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """(documents, languages): phrases of each document's parse."""
        docs = len(offs) - 1
        out = np.zeros((docs, len(self.langs)), np.int64)
        size = np.diff(offs)
        blocks = -(-size // block)
        doc = np.repeat(np.arange(docs), blocks)
        if not len(doc):
            return out
        begin = offs[:-1][doc] + block * (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        length = np.minimum(block, offs[1:][doc] - begin)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        follows = np.flatnonzero(doc[1:] == doc[:-1])  # blocks with a next one in their text
        before, after = place[follows], place[follows + 1]
        final = place[np.flatnonzero(np.append(doc[1:] != doc[:-1], True))]
        doc, begin, length = doc[order], begin[order], length[order]
        sym = np.concatenate([self.symbol[buf], np.zeros(block, np.uint8)])
        live = np.searchsorted(-length, -np.arange(block), "left")  # blocks longer than t
        grid = sym[begin[None, :] + np.arange(block)[:, None]]
        top = int(length[0])
        for k, table in enumerate(self.tables):
            states = np.zeros((top + 1, len(doc)), np.int32)  # before the t-th byte
            ended = np.zeros((top, len(doc)), np.uint8)
            for t in range(top):
                n = live[t]
                v = table.take(states[t, :n] + grid[t, :n])
                ended[t, :n] = v & 3
                states[t + 1, :n] = v >> 2
                states[t + 1, n:] = states[t, n:]
            todo, entry = after, states[top, before]
            while True:
                changed = states[0, todo] != entry
                who, now = todo[changed], entry[changed]
                if not len(who):
                    break
                for t in range(top):
                    states[t, who] = now
                    run = length[who] > t
                    over = who[~run]
                    for u in over:
                        states[t:, u] = states[t, u]
                    who, now = who[run], now[run]
                    if not len(who):
                        break
                    v = table.take(now + grid[t, who])
                    ended[t, who] = v & 3
                    now = v >> 2
                    apart = states[t + 1, who] != now
                    who, now = who[apart], now[apart]
                    if not len(who):
                        break
                else:
                    states[top, who] = now
                todo, entry = after, states[top, before]
            total = ended.sum(0, dtype=np.int64)
            total[final] += states[top, final] > 0
            out[:, k] = np.bincount(doc, total, docs)
        return out


def held_out(of, mod: int, rest: int):
    """Whether a row is kept from learning; one without an id isn't."""
    return F.coalesce(F.pmod(F.crc32(F.col(of).cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def sample_rows(docs: DataFrame, label: str, buckets: int, most: int):
    """At most buckets rows for each label, drawn by the hash of the text, texts of middling length first.

    One row of longs for each label and bucket reaches the driver, then the texts chosen, of each the first
    most characters, more than which no label's sample takes.
    """
    size, h = F.char_length("text"), F.xxhash64("text")
    rank = F.shiftrightunsigned(h, 2) + F.when(size.between(MIN_CHARS, MAX_CHARS), F.lit(0)).otherwise(F.lit(1 << 62))
    rows = docs.where(F.col("text").isNotNull() & F.col(label).isNotNull()).select(label, "text", rank.alias("rank"))
    best = rows.groupBy(label, F.pmod("rank", F.lit(buckets)).alias("b")).agg(F.min("rank").alias("rank")).collect()
    want = sorted({r["rank"] for r in best})
    chosen = rows.where(F.col("rank").isin(want)) if want else rows.limit(0)
    pairs = {(r[label], r["rank"]) for r in best}
    got = chosen.groupBy(label, "rank").agg(F.min(F.substring("text", 1, most)).alias("text")).collect()
    return sorted(((r[label], r["rank"], r["text"]) for r in got if (r[label], r["rank"]) in pairs), key=lambda x: (str(x[0]), x[1]))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Parser:
    """Learn from docs (text and language); at most sample_bytes of text for each language."""
    texts: dict[str, bytes] = {}
    rows = sample_rows(docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")), "lang", sample_docs, sample_bytes)
    sample_bytes = min(sample_bytes, TABLE_BYTES // (2 * 4 * 256 * max(1, len({x for x, *_ in rows}))))  # two states a byte, 256 symbols at most
    for lang, _, text in rows:
        texts[lang] = (texts.get(lang, b"") + b" " + text.encode())[:sample_bytes]
    return Parser({k: v for k, v in texts.items() if v.strip()})


_LETTERS = C._table(lambda c: c < 128 and chr(c).isalpha())


def with_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts of a slice have a letter of any script."""
    has = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_LETTERS[buf], out=has[1:])
    out = has[offs[1:]] > has[offs[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, buf[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def predict(parser: Parser, buf: np.ndarray, offs: np.ndarray):
    """(place of the language or -1 for und, score, phrases for each byte) of each text of a slice."""
    docs = len(offs) - 1
    if not parser.langs:
        return np.full(docs, -1), np.zeros(docs), np.zeros(docs)
    n = parser.phrases(buf, offs) / np.maximum(np.diff(offs), 1)[:, None]
    best, top = n.argmin(axis=1), np.sort(n, axis=1)
    known = with_letter(buf, offs)
    gap = 1 - top[:, 0] / np.maximum(top[:, 1], 1e-12) if len(parser.langs) > 1 else np.ones(docs)
    return np.where(known, best, -1), np.where(known, np.clip(gap, 0, 1), 0.0), np.where(known, top[:, 0], 0.0)


def identify(docs: DataFrame, parser: Parser, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, phrases_per_byte): score is 1 - best / second best."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches):
        names = np.array([*shared.value.langs, "und"], object)
        for rows, buf, offs in C.text_slices(batches):
            best, score, rate = predict(shared.value, buf, offs)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "phrases_per_byte"])

    return C.source(docs, text_col, id_col).mapInArrow(run, "doc_id long, lang_pred string, score double, phrases_per_byte double")


def keep_identified(docs: DataFrame, parser: Parser, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that have a language by identify() and that it knows, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches):
        for rows, buf, offs in C.text_slices(batches, column=text_col):
            best, _, rate = predict(shared.value, buf, offs)
            yield rows.filter(pa.array((best >= 0) & ((rate < UNKNOWN) | (np.diff(offs) < JUDGED))))

    return docs.mapInArrow(run, docs.schema)


def languages(docs: DataFrame) -> DataFrame:
    """Learn on the rows that aren't held out, predict all."""
    parser = train(docs.where(~held_out("doc_id", 4, 2)))
    out = identify(docs, parser)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "phrases_per_byte")
