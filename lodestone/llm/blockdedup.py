"""Exact repeats of word windows across documents, found with fixed-block anchors.

Every document's non-overlapping blocks of half a window's words are the reference; every rolling
block of every document probes them. A window of 50 words holds a whole reference block of whichever
document it came from, so a window without a hit repeats nowhere. Of the hits in a window that with the
least hash is its anchor. Hits with one anchor meet in its bucket, each with the words around it, and are
extended to both sides, word by word, the words themselves compared, to maximal repeats; of those of 50
words and more the documents with a greater doc_id than the smallest lose their words.

An anchor that comes more than HOT times is not extended in one bucket: its windows are dealt out by
128-bit hashes of their own, each distinct one once for each chunk. Later copies of a whole text of 50
words or more go whole, by a hash of 128 bits, and send nothing.

Defined results: a null or empty text has no words and keeps none; rows with one doc_id don't remove
each other's words; a null doc_id comes after all others; an empty table gives an empty result; other
columns are ignored; a very long text is one chunk, whose memory grows with it.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
from pyspark.sql import DataFrame

from . import chunks as K
from . import common as C

WINDOW, HOT = 50, 1 << 12
_SALT = np.uint64(0xA5A5F00DC0FFEE11)


def _words(buf, offs):
    s, e = C.word_spans(buf, offs, C.NON_SPACE)
    return s, e, C.spans_hash(buf, s, e) if len(s) else np.zeros(0, np.uint64), C.owner(s, offs)


def _rolling(h, doc, k):
    """The hash of each run of k words, and whether it lies within one document."""
    r = C.windows_hash(h, k)
    return r, doc[: len(r)] == doc[k - 1 :] if len(r) else np.zeros(0, bool)


def _classes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One number for each pair of a class and the next word."""
    return np.unique(before * (int(word.max()) + 2) + word + 1, return_inverse=True)[1]


def extend(left: np.ndarray, size: np.ndarray, ids: np.ndarray, said: bytes, window: int, block: int) -> np.ndarray:
    """Bitmask, by segment, of its windows that start in a document with a smaller doc_id too.

    A segment is size windows long; its anchor, a block, begins at its word left. Segments whose anchors
    are equal words are extended by one word after another to the left and to the right; those that still
    agree have one class. A window is a class to the left and one to the right.
    """
    mask, n = np.zeros(len(left), np.uint64), len(left)
    if n < 2:
        return mask
    lut: dict = {}
    word = np.fromiter(map(lut.setdefault, said.split(b" "), count()), np.int64)
    many = size + window - 1
    begin = np.cumsum(many) - many
    at = begin + left
    here = np.zeros(n, np.int64)
    for k in range(block):
        here = _classes(here, word[at + k])
    sides = []
    for step, room in ((-1, left), (1, many - left - block)):
        held = [here]
        for k in range(1, window - block + 1):
            place = at - k if step < 0 else at + block + k - 1
            held.append(_classes(held[-1], np.where(k <= room, word[np.clip(place, 0, len(word) - 1)], -1)))
        sides.append(held)
    for j in range(window - block + 1):  # windows with j words to the anchor's left
        who = np.flatnonzero((left - j >= 0) & (left - j < size))
        if len(who) < 2:
            continue
        both = sides[0][j][who] * n + sides[1][window - block - j][who]
        _, group = np.unique(both, return_inverse=True)
        least = np.full(int(group.max()) + 1, K.NO_ID)
        np.minimum.at(least, group, ids[who])
        late = ids[who] > least[group]
        mask[who[late]] |= np.uint64(1) << (left[who[late]] - j).astype(np.uint64)
    return mask


def repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256, starts, ends) of each row: spans in words."""
    chunks = K.make(docs, text_col, id_col)
    n, block = chunks.buckets, (window + 1) // 2
    assert window - block < 63

    def long_enough(doc, texts):
        return np.bincount(doc, minlength=texts) >= window

    def probe(ids, offs, buf, _):
        _, _, h, doc = _words(buf, offs)
        r, ok = _rolling(h, doc, block)
        at = np.flatnonzero(ok)
        is_ref = (at - np.searchsorted(doc, doc[at])) % block == 0
        k, times, several, ref = K.counted(K.key(r[at], n), ids[doc[at]], is_ref)
        return [(K.bucket_of(k), [K.inside(k), ref + 2 * several.astype(np.uint8), times]), K.copies_sent(ids, offs, buf, long_enough(doc, len(ids)), n)]

    def hit(kinds):
        sender, (h, flags, times) = kinds[0]
        order, at, group = K.of_keys(kinds[0])
        if not len(at):
            return [(sender, [h, flags]), K.least_told(kinds[1])]
        flags, times = flags[order].astype(np.uint8), times[order]
        either = np.bitwise_or.reduceat(flags, at)
        there = (either & 1 > 0) & ((either & 2 > 0) | (np.diff(np.append(at, len(order))) > 1))
        which = np.flatnonzero(there[group])
        return [(sender[order][which], [h[order][which].astype(np.uint32), (np.add.reduceat(times, at) > hot)[group[which]].astype(np.uint8)]), K.least_told(kinds[1])]

    hits = K.exchange(chunks, probe, hit)

    def segments(ids, offs, buf, answers):
        s, e, h, doc = _words(buf, offs)
        told = K.joined(answers)
        copy = K.copies(told and told[1], ids, offs, buf, long_enough(doc, len(ids)))
        gone = np.flatnonzero(copy)
        r, inside = _rolling(h, doc, block)
        w, ok = _rolling(h, doc, window)
        live, very = np.zeros(len(r), bool), np.zeros(len(r), bool)
        if told:
            known = K.whole(told[0][0], told[0][1][0])
            order = np.argsort(known)
            at = K.among(K.key(r, n), known[order])
            live = (at >= 0) & inside & ~copy[doc[: len(r)]]
            very = live & (told[0][1][1][order][at] > 0)
        first, last, a = K.anchored(r, live, ok, window - block + 1) if len(w) else [np.zeros(0, np.int64)] * 3
        cold = ~very[a]
        v0, v1, c = first[cold], last[cold], a[cold]
        space = np.cumsum(e - s + 1)
        raw = np.full(int(space[-1]) if len(s) else 0, 32, np.uint8)
        place = np.ones(len(raw), bool)
        place[space - 1] = False
        raw[place] = buf[C.NON_SPACE[buf]]
        begin = np.concatenate([[0], space])
        said = K.Pieces(begin[v0], begin[v1 + window], raw.tobytes())
        hot_at = K.each(first[~cold], last[~cold])
        second = C.windows_hash(C.mix(h ^ _SALT), window)[hot_at]
        return [
            (K.bucket_of(K.key(r[c], n)), [v0.astype(np.uint32), (c - v0).astype(np.uint8), (v1 - v0 + 1).astype(np.uint8), ids[doc[v0]], said]),
            K.least_sent(w[hot_at], second, ids[doc[hot_at]], n),
            (K.home(ids, buf, n, len(gone)), [gone.astype(np.uint32)]),
            (K.home(ids, buf, n, int((~cold).sum())), [first[~cold].astype(np.uint32), last[~cold].astype(np.uint32)]),
        ]

    def solve(kinds):
        sender, (v0, left, size, ids, said) = kinds[0]
        mask = extend(left.astype(np.int64), size.astype(np.int64), ids, said[:-1], window, block)
        which = np.flatnonzero(mask)
        return [(sender[which], [v0[which], mask[which]]), K.least_told(kinds[1]), *kinds[2:]]

    found = K.exchange(chunks, segments, solve, hits)
    C.forget(hits)

    def finish(batches):
        for _, ids, offs, buf, answers in K.unpack(batches, True):
            s, e, h, doc = _words(buf, offs)
            cut = np.zeros(len(s), bool)
            if told := K.joined(answers):
                gone = K.bits(*told[0][1])
                at = K.each(*(x.astype(np.int64) for x in told[3][1]))
                if len(at) and len(told[1][1][0]):
                    hashes = C.windows_hash(h, window)[at], C.windows_hash(C.mix(h ^ _SALT), window)[at]
                    gone = np.concatenate([gone, at[K.least_of(told[1], *hashes) < ids[doc[at]]]])
                cut = K.cover(gone, window, len(s))
                copy = np.zeros(len(ids), bool)
                copy[told[2][1][0].astype(np.int64)] = True
                cut |= copy[doc]
            size = np.bincount(doc, minlength=len(ids)) if len(doc) else np.zeros(len(ids), np.int64)
            first = np.cumsum(size) - size
            raw, rows = buf.tobytes(), []
            for d in range(len(ids)):
                a, b = int(first[d]), int(first[d] + size[d])
                mine = cut[a:b]
                if mine.any():
                    keep = a + np.flatnonzero(~mine)
                    kept = b" ".join(raw[i:j] for i, j in zip(s[keep].tolist(), e[keep].tolist()))
                else:
                    kept = b" ".join(raw[offs[d] : offs[d + 1]].split())
                starts, ends = K.removed_spans(mine)
                rows.append((int(ids[d]), b - a, int(mine.sum()), len(starts), hashlib.sha256(kept).hexdigest(), starts.tolist(), ends.tolist()))
            yield K.report(rows, "n_words")

    out = C.materialize(K.with_answers(chunks, found).mapInArrow(finish, K.found_schema("n_words")))
    C.forget(chunks.rows, found)
    return out
