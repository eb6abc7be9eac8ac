"""Personal data: exact base patterns, and a linear-chain conditional random field over word shapes.

The field labels tokens (runs without white space) with B-kind, I-kind or O. It is trained here, by
gradient ascent on the likelihood of the small table SENTENCES() spells out, and decoded by Viterbi in
numpy, many runs side by side. A token without a digit or an @ can only be O, so the most likely
labelling of a document is that of its maximal runs of other tokens, each between two O's; those runs
are all that need decoding, and nothing is left out by that. A field's span that meets a base span
gives way to it.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive;
repeated rows each get a row; an empty table gives an empty result; further columns are ignored; a very
long text is decoded as one.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BASE, KINDS = ("email", "ip", "card", "phone"), ("email", "ip", "card", "phone", "id")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
ITERATIONS, SEED, RATE, L2 = 150, 7, 0.3, 1e-3

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str):
    """Leftmost matches of local part, @ and dotted domain, in time that grows with the text only."""
    free = 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > free and _LOCAL.match(text[s - 1]):
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at)):
            yield s, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    n = [ord(c) - 48 for c in reversed(digits)]
    return (sum(n[::2]) + sum(x * 2 - 9 * (x > 4) for x in n[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the base patterns."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def SENTENCES(n: int = 320, seed: int = SEED) -> list[list[tuple[str, str]]]:
    """The labelled table: token and label, in invented sentences with and without personal data."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))

    def piece():
        k = r.randint(0, 15)
        if k == 0:
            return [(f"{word()}.{word()}@{word()}.{r.choice(('com', 'org', 'net'))}", "email")]
        if k == 1:
            return [(f"{d(2)}@{word()}{d(1)}.{word()}.com", "email")]
        if k == 2:
            return [(".".join(str(r.randint(0, 255)) for _ in range(4)) + r.choice(("", ".", ",")), "ip")]
        if k == 3:
            return [(d(16), "card")]
        if k == 4:
            return [(d(4), "card") for _ in range(4)]
        if k == 5:
            return [("-".join(d(4) for _ in range(4)), "card")]
        if k == 6:
            return [(f"+{d(1)}", "phone"), (f"({d(3)})", "phone"), (f"{d(3)}-{d(4)}", "phone")]
        if k == 7:
            return [(f"({d(3)})", "phone"), (f"{d(3)}-{d(4)}", "phone")]
        if k == 8:
            return [(f"+{d(2)}", "phone"), (d(3), "phone"), (d(7), "phone")]
        if k == 9:
            return [(f"{d(3)}-{d(2)}-{d(4)}", "id")]
        if k == 10:
            return [(r.choice((d(4), d(1), d(2), d(3) + ",", f"{d(1)}.{d(1)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"({d(4)})", f"{d(2)}%", f"${d(3)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(1)}", f"{d(3)}-{d(3)}", f"{d(6)}")), "O")]
        if k == 11:
            return [(r.choice((f"{word()}{d(2)}", f"{d(3)}{word()}", "".join(r.choice("0123456789abcdef") for _ in range(32)), f"@{word()}", f"https://{word()}.com/{d(3)}")), "O")]
        return [(word(), "O") for _ in range(r.randint(1, 4))]

    out = []
    for _ in range(n):
        row = []
        for _ in range(r.randint(2, 6)):
            row += [(t, "O" if k == "O" else f"{'I' if i else 'B'}-{k}") for i, (t, k) in enumerate(piece())]
        out.append(row)
    return out


# ---- word shapes: a token's features as numbers ------------------------------------------------
_SETS = [C._table(lambda c: chr(c).isdigit() if c < 128 else False), C._table(lambda c: c >= 128 or chr(c).isalpha())] + [C._table(lambda c, x=x: c == ord(x)) for x in "@.-+()"]
_CLASS = np.zeros(256, np.int64)
for _n, _s in enumerate(_SETS):
    _CLASS[_s] = _n + 1
FEATURES = (16, 16, 64, 16, 64, 10, 10, 1)  # how many values each feature has
_OFFSET = np.concatenate([[0], np.cumsum(FEATURES)])
WIDTH = int(_OFFSET[-1]) * 3  # of the token itself, the one before and the one after


def shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(tokens, features): digits, letters, which punctuation, separators, length, first and last class."""
    total = np.zeros((len(_SETS), len(buf) + 1), np.int32)
    for n, s in enumerate(_SETS):
        np.cumsum(s[buf], out=total[n, 1:])
    n = total[:, ends] - total[:, starts]
    size = np.minimum(ends - starts, 63)
    marks = (n[2] > 0) + 2 * (n[3] > 0) + 4 * (n[4] > 0) + 8 * (n[5] > 0) + 16 * (n[6] > 0) + 32 * (n[1] > 0)
    dots = 4 * np.minimum(n[3], 3) + np.minimum(n[4], 3)
    first, last = _CLASS[buf[starts]], _CLASS[buf[ends - 1]]
    both = np.minimum(n[0], 7) * 8 + np.minimum(n[1], 7)
    return np.stack([np.minimum(n[0], 15), np.minimum(n[1], 15), marks, dots, both, first, last, np.zeros_like(size)], axis=1) + _OFFSET[:-1]


class Field:
    """Weights of emissions (features, labels) and transitions (labels, labels)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def emissions(self, f: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        third = WIDTH // 3
        return self.emit[f].sum(1) + self.emit[before + third].sum(1) + self.emit[after + 2 * third].sum(1)

    def decode(self, scores: np.ndarray, run: np.ndarray) -> np.ndarray:
        """The most likely labels; run: which chain each row belongs to, chains one after another."""
        n = len(scores)
        if not n:
            return np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        size = np.diff(np.concatenate([first, [n]]))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        best, back = np.empty_like(scores), np.zeros(scores.shape, np.int8)
        best[first] = scores[first] + self.move[0]  # an O stands before every chain
        for t in range(1, int(size[0])):
            at = first[: np.searchsorted(-size, -t, "left")] + t
            step = best[at - 1][:, :, None] + self.move[None]
            back[at] = step.argmax(1)
            best[at] = step.max(1) + scores[at]
        out = np.zeros(n, np.int64)
        end = first + size - 1
        out[end] = (best[end] + self.move[:, 0]).argmax(1)
        for t in range(int(size[0]) - 1, 0, -1):
            at = first[: np.searchsorted(-size, -t, "left")] + t
            out[at - 1] = back[at, out[at]]
        return out


def _legal() -> np.ndarray:
    """I-kind only follows B-kind or I-kind."""
    ok = np.ones((len(LABELS), len(LABELS)), bool)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            ok[:, j] = [a[2:] == b[2:] and a != "O" for a in LABELS]
    return ok


def train(table=None, iterations: int = ITERATIONS) -> Field:
    """Fit by Adam on the exact gradient, from forward and backward sums over padded sentences."""
    table = SENTENCES() if table is None else table
    lab = {x: i for i, x in enumerate(LABELS)}
    longest, third = max(map(len, table)), WIDTH // 3
    shape = (len(table), longest)
    feats, y, live = np.zeros((*shape, 3 * len(FEATURES)), np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
    for i, row in enumerate(table):
        raw = " ".join(t for t, _ in row).encode()
        buf = np.frombuffer(raw, np.uint8)
        s, e = C.word_spans(buf, np.array([0, len(raw)]), C.NON_SPACE)
        f = shapes(buf, s, e)
        pad = np.broadcast_to(_OFFSET[:-1], (1, len(FEATURES)))
        feats[i, : len(f)] = np.concatenate([f, np.concatenate([pad, f[:-1]]) + third, np.concatenate([f[1:], pad]) + 2 * third], axis=1)
        y[i, : len(f)], live[i, : len(f)] = [lab[k] for _, k in row], True
    k, big = len(LABELS), 1e4
    wall = np.where(_legal(), 0, -big)
    emit, move = np.zeros((WIDTH, k)), np.zeros((k, k))
    one_hot = np.zeros((live.sum(), WIDTH))
    np.add.at(one_hot, (np.arange(len(one_hot))[:, None], feats[live]), 1)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (emit, move)]
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    for step in range(1, iterations + 1):
        sc, mv = np.zeros((*shape, k)), move + wall
        sc[live] = one_hot @ emit
        fw, bw = np.zeros((*shape, k)), np.zeros((*shape, k))
        fw[:, 0] = sc[:, 0] + mv[0]
        for t in range(1, longest):
            fw[:, t] = np.where(live[:, t, None], lse(fw[:, t - 1][:, :, None] + mv[None], 1) + sc[:, t], fw[:, t - 1])
        z = lse(fw[:, -1] + mv[:, 0], 1)
        bw[:, -1] = mv[:, 0]
        for t in range(longest - 2, -1, -1):
            bw[:, t] = np.where(live[:, t + 1, None], lse(mv[None] + (sc[:, t + 1] + bw[:, t + 1])[:, None, :], 2), bw[:, t + 1])
        p = np.exp(fw + bw - z[:, None, None]) * live[:, :, None]
        gap = np.eye(k)[y] * live[:, :, None] - p
        g_emit, g_move = one_hot.T @ gap[live], np.zeros_like(move)
        for t in range(1, longest):
            pair = np.exp(fw[:, t - 1][:, :, None] + mv[None] + (sc[:, t] + bw[:, t])[:, None, :] - z[:, None, None]) * live[:, t, None, None]
            g_move -= pair.sum(0)
            np.add.at(g_move, (y[live[:, t], t - 1], y[live[:, t], t]), 1)
        for w, g, (m, v) in ((emit, g_emit, state[0]), (move, g_move, state[1])):
            g = g / len(table) - L2 * w
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(emit.astype(np.float32), np.where(_legal(), move, -big).astype(np.float32))


def field_spans(field: Field, buf: np.ndarray, offs: np.ndarray):
    """(document, start byte, end byte, kind's place) of the field's spans in a slice."""
    starts, ends = C.word_spans(buf, offs, C.NON_SPACE)
    if not len(starts):
        return
    trig = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(_SETS[0][buf] | _SETS[2][buf], out=trig[1:])
    at = np.flatnonzero(trig[ends] > trig[starts])
    if not len(at):
        return
    doc = C.owner(starts[at], offs)
    whole = C.owner(starts, offs)
    need = np.unique(np.clip(np.concatenate([at - 1, at, at + 1]), 0, len(starts) - 1))
    f = shapes(buf, starts[need], ends[need])
    pad = _OFFSET[:-1]

    def near(step):
        to = np.clip(at + step, 0, len(starts) - 1)
        same = (at + step == to) & (whole[to] == doc)
        return np.where(same[:, None], f[np.searchsorted(need, to)], pad)

    scores = field.emissions(f[np.searchsorted(need, at)], near(-1), near(1))
    run = np.concatenate([[0], np.cumsum((np.diff(at) > 1) | (np.diff(doc) > 0))])
    lab = field.decode(scores, run)
    begin = np.flatnonzero(lab % 2 == 1)
    for i in begin.tolist():
        j = i + 1
        while j < len(lab) and lab[j] == lab[i] + 1 and run[j] == run[i]:
            j += 1
        yield int(doc[i]), int(starts[at[i]]), int(ends[at[j - 1]]), (int(lab[i]) - 1) // 2


_EDGE = " \t\n\x0b\x0c\r.,;:!?\"'<>[]{}"


def all_spans(text: str, raw: np.ndarray, extra) -> list[tuple[int, int, int, bool]]:
    """(start, kind's place, end, base) of a text's spans, sorted; extra: (start, end, kind) by the field, in bytes of raw.

    A field's span goes without its outer punctuation, and only where it meets no base span; those are
    looked up by the greatest end of all that begin before it, so time doesn't grow with their product.
    """
    found = [(s, k, e, True) for s, k, e in base_spans(text)]
    if extra:
        begins = [s for s, *_ in found]
        reach = list(accumulate((e for _, _, e, _ in found), max))
        point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        for s, e, k in extra:
            s, e = int(point[s]), int(point[e])
            while s < e and text[s] in _EDGE:
                s += 1
            while e > s and text[e - 1] in _EDGE:
                e -= 1
            before = bisect_left(begins, e)
            if s < e and not (before and reach[before - 1] > s):
                found.append((s, k, e, False))
    return sorted(found)


def find(docs: DataFrame, field: Field | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, starts, ends, kinds, base): the spans of each row by start, and which are base ones."""
    shared = docs.sparkSession.sparkContext.broadcast(train() if field is None else field)

    def spans(buf, offs):
        """Of each document, its spans (start, kind's place, end, base)."""
        extra: dict[int, list] = {}
        for d, s, e, k in field_spans(shared.value, buf, offs):
            extra.setdefault(d, []).append((s, e, k))
        mark = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(_SETS[0][buf] | _SETS[2][buf], out=mark[1:])
        out: list[list] = [[] for _ in range(len(offs) - 1)]
        for d in np.flatnonzero(mark[offs[1:]] > mark[offs[:-1]]).tolist():
            raw = buf[offs[d] : offs[d + 1]]
            mine = [(s - int(offs[d]), e - int(offs[d]), k) for s, e, k in extra.get(d, ())]
            out[d] = all_spans(raw.tobytes().decode("utf-8", "replace"), raw, mine)
        return out

    def run(batches):
        longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
        for rows, buf, offs in C.text_slices(batches):
            got = spans(buf, offs)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([[x[0] for x in g] for g in got], longs), pa.array([[x[2] for x in g] for g in got], longs),
                 pa.array([[KINDS[x[1]] for x in g] for g in got], strings), pa.array([[x[3] for x in g] for g in got], pa.list_(pa.bool_()))],
                ["doc_id", "starts", "ends", "kinds", "base"],
            )

    return C.source(docs, text_col, id_col).mapInArrow(run, "doc_id long, starts array<long>, ends array<long>, kinds array<string>, base array<boolean>")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of what find() returns; the hashes are made by Spark."""
    item = F.transform(F.arrays_zip("kinds", "starts", "ends", "base"), lambda x: F.struct(F.concat_ws(":", x["kinds"], x["starts"], x["ends"]).alias("said"), x["kinds"].alias("kind"), x["base"].alias("base")))
    base = F.filter("items", lambda x: x["base"])
    count = lambda k: F.size(F.filter("items", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    said = lambda a: F.array_join(F.transform(a, lambda x: x["said"]), ",")
    return found.withColumn("items", item).select("doc_id", *[count(k) for k in BASE], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("items")).alias("spans"))


def mask(docs: DataFrame, field: Field | None = None, text_col: str = "text", tag: str = "[{}]") -> DataFrame:
    """docs with every span of the text replaced by its kind; all columns stay, row by row."""
    shared = docs.sparkSession.sparkContext.broadcast(train() if field is None else field)
    texts = docs.select("*")
    schema = docs.schema

    def run(batches):
        for batch in batches:
            col = batch.schema.get_field_index(text_col)
            texts_ = batch.column(col).to_pylist()
            for i, t in enumerate(texts_):
                if not t or not _TRIGGER.search(t):
                    continue
                raw = np.frombuffer(t.encode(), np.uint8)
                spans = all_spans(t, raw, [(s, e, k) for _, s, e, k in field_spans(shared.value, raw, np.array([0, len(raw)]))])
                if spans:
                    out, at = [], 0
                    for s, e, k in sorted((s, e, k) for s, k, e, _ in spans):
                        if s >= at:
                            out += [t[at:s], tag.format(KINDS[k])]
                        at = max(at, e)
                    texts_[i] = "".join(out) + t[at:]
            yield batch.set_column(col, batch.schema.field(col), pa.array(texts_, batch.schema.field(col).type))

    return texts.mapInArrow(run, schema)


_TRIGGER = re.compile("[0-9@]")
