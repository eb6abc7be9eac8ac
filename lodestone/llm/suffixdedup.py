"""Repeats of byte strings across documents, from intervals of common prefixes in suffix arrays.

A 50-byte window's anchor is its least 24-byte string by a hash; a run of windows with one anchor is a
segment of at most 76 bytes. Equal windows have equal anchors, so segments are dealt out by their
anchor's hash, those first that stand alone in the corpus falling away. In a bucket the suffixes of all
segments are sorted, their common prefixes measured, and a stack scan makes the tree of prefix
intervals of 50 bytes or more; those with different bytes to the left of their occurrences are the
maximal repeats, each with all its occurrences. An occurrence in a document with a greater doc_id than
its group's smallest goes.

An anchor that comes more than HOT times is not sorted in one bucket: its windows are dealt out by
128-bit hashes of their own, each distinct one once for each chunk. Later copies of a whole text of 50
bytes or more go whole, by a hash of 128 bits, and send nothing.

Defined results: a null or empty text has no bytes; rows with one doc_id don't remove each other's
bytes; a null doc_id comes after all others; matches never cross documents; an empty table gives an
empty result; other columns are ignored; a very long text is one chunk, whose memory grows with it.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import chunks as K
from . import common as C

LENGTH, ANCHOR, WIDE, HOT = 50, 24, 80, 1 << 12


def anchors(offs: np.ndarray, buf: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(anchor's hash, first window, last window) of each run of windows with one anchor."""
    found = [_anchors(offs[i : j + 1] - offs[i], buf[offs[i] : offs[j]], length, anchor, int(offs[i])) for i, j in C.pieces(offs)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchors(offs, buf, length, anchor, at):
    n, none = len(buf), np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, np.uint64), none, none
    up, down = C._powers(C._R, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(C._BYTE[buf] * up[:n], out=total[1:])
    g = C.mix((total[anchor:] - total[:-anchor]) * down[: n - anchor + 1])
    ok = np.ones(n - length + 1, bool)
    for e in offs[1:-1].tolist():  # no window across two texts
        ok[max(0, e - length + 1) : e] = False
    first, last, a = K.anchored(g, np.ones(len(g), bool), ok, length - anchor + 1)
    return g[a], first + at, last + at


def intervals(lcp: np.ndarray, least: int):
    """(prefix, left, right, parent's prefix) of each interval of prefixes of least or more; lcp[i] is that of i - 1 and i.

    The stack scan of an enhanced suffix array: an interval closes when a shorter prefix comes. Between two
    places with a shorter prefix than least the stack is empty, so each run of others is scanned by itself, and
    a run of one prefix throughout is one interval without a scan.
    """
    lcp = np.concatenate([[0], lcp[1:], [0]]).astype(np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], lcp >= least, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros((0, 4), np.int64)
    outside = np.maximum(lcp[start - 1], lcp[end])
    flat = np.maximum.reduceat(lcp, np.stack([start, end], 1).ravel())[::2] == np.minimum.reduceat(lcp, np.stack([start, end], 1).ravel())[::2]
    out = [np.stack([lcp[start], start - 1, end - 1, outside], axis=1)[flat]]
    for s, e, o in zip(start[~flat].tolist(), end[~flat].tolist(), outside[~flat].tolist()):
        rows, stack = [], [(o, s - 1)]
        for i, x in enumerate([*lcp[s:e].tolist(), o], s):
            left = i - 1
            while x < stack[-1][0]:
                depth, left = stack.pop()
                rows.append((depth, left, i - 1, max(x, stack[-1][0])))
            if x > stack[-1][0]:
                stack.append((x, left))
        out.append(np.array(rows, np.int64))
    return np.concatenate(out)


def suffix_array(s: np.ndarray, most: int | None = None) -> np.ndarray:
    """The order of all suffixes of the codes s, by doubling (or of their first most codes)."""
    n = len(s)
    rank, k = s.astype(np.int64) + 1, 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] if k < n else 0
        sa = np.lexsort((nxt, rank))
        new = np.zeros(n, np.int64)
        new[sa[1:]] = np.cumsum((rank[sa[1:]] != rank[sa[:-1]]) | (nxt[sa[1:]] != nxt[sa[:-1]]))
        rank = new + 1
        k *= 2
        if (n and rank.max() == n) or k >= n or (most and k >= most):
            return sa


def maximal_repeats(texts: list[bytes], least: int = LENGTH):
    """[(length, [(text, start), ...])]: every string of least bytes or more that comes at least twice and
    can be lengthened on neither side in all its occurrences, with all of them."""
    codes = np.concatenate([np.concatenate([np.frombuffer(t, np.uint8).astype(np.int64) + len(texts), [i]]) for i, t in enumerate(texts)]) if texts else np.zeros(0, np.int64)
    if not len(codes):
        return []
    sa = suffix_array(codes)
    rank = np.empty(len(sa), np.int64)
    rank[sa] = np.arange(len(sa))
    lcp, h = np.zeros(len(sa), np.int64), 0
    for i in range(len(codes)):  # prefixes of neighbours, in the order of the text
        if rank[i]:
            j = sa[rank[i] - 1]
            while max(i, j) + h < len(codes) and codes[i + h] == codes[j + h] and codes[i + h] >= len(texts):
                h += 1
            lcp[rank[i]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    ends = np.cumsum([len(t) + 1 for t in texts])
    out = []
    for depth, left, right, _ in intervals(lcp, least).tolist():
        at = np.sort(sa[left : right + 1])
        before = np.where(at > 0, codes[at - 1], -1)
        if len(np.unique(before)) > 1 or (before < len(texts)).any():  # a text's start differs from all
            of = np.searchsorted(ends, at, "right")
            out.append((depth, list(zip(of.tolist(), (at - np.concatenate([[0], ends])[of]).tolist()))))
    return out


def groups(columns: list[np.ndarray], own: np.ndarray, before: np.ndarray, length: int):
    """(order of the suffixes, their segment and place, nodes) of distinct segments of one bucket.

    A node (prefix, left, right) is a maximal repeat of these segments: the suffixes left to right of the
    order, all its occurrences, share prefix bytes and no more, and have different bytes before them. A
    segment's first suffix goes on beyond it to the left, where other anchors' buckets see it, so its
    occurrences count as different there. Suffixes whose first length bytes come once, by a hash, are left out.
    """
    n = own - length + 1
    begin = np.cumsum(n) - n
    text = np.stack([c.astype("<u8") for c in columns], axis=1).view(np.uint8).reshape(len(own), WIDE)
    flat = np.concatenate([text, np.zeros_like(text)], axis=1).ravel()
    up, down = C._powers(C._R, WIDE)
    total = np.zeros((len(own), WIDE + 1), np.uint64)
    np.cumsum(C._BYTE[text] * up[:WIDE], axis=1, out=total[:, 1:])
    h = (total[:, length:] - total[:, :-length]) * down[: WIDE - length + 1]
    h = h[np.arange(WIDE - length + 1) < n[:, None]]
    by = np.argsort(h)
    new = np.concatenate([[True], h[by][1:] != h[by][:-1], [True]])
    often = np.zeros(len(h), bool)
    often[by] = ~(new[1:] & new[:-1])
    some = np.flatnonzero(often)
    seg = np.searchsorted(begin, some, "right") - 1
    at = some - begin[seg]
    place = seg * (2 * WIDE) + at
    words = [np.zeros(len(seg), np.uint64) for _ in range(WIDE // 8)]
    for k, w in enumerate(words):
        for j in range(8):
            w <<= np.uint64(8)
            w |= flat[place + 8 * k + j]
    order = np.lexsort(words[::-1])
    room = (own[seg] - at)[order]
    lcp, open_ = np.zeros(len(seg), np.int64), np.ones(len(seg), bool)
    for w in words:
        x = w[order]
        gap = np.concatenate([[np.uint64(1) << np.uint64(63)], x[1:] ^ x[:-1]])[: len(x)]
        same = sum((gap < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(8))
        lcp += np.where(open_, same, 0)
        open_ &= gap == 0
    lcp[1:] = np.minimum(lcp[1:], np.minimum(room[1:], room[:-1]))
    lcp[:1] = 0
    node = intervals(lcp, length)[:, :3]
    previous = np.where(at > 0, flat[np.maximum(place - 1, 0)].astype(np.int64), -1 - before[seg])[order]
    edge = np.concatenate([[0], np.cumsum(at[order] == 0)])
    change = np.concatenate([[0], np.cumsum(previous[1:] != previous[:-1])])
    diverse = (change[node[:, 2]] > change[node[:, 1]]) | (edge[node[:, 2] + 1] > edge[node[:, 1]])
    return order, seg, at, begin, node[diverse]


def bucket_repeats(columns: list[np.ndarray], size: np.ndarray, before: np.ndarray, doc: np.ndarray, length: int):
    """Bitmask, by segment, of the windows that a document with a smaller doc_id has too.

    Equal segments are sorted as one, with the smallest doc_id of theirs; then each occurrence of a maximal
    repeat in a document with a greater doc_id than its group's smallest is covered.
    """
    if not len(size):
        return np.zeros(0, np.uint64)
    rows = np.stack([*(c.astype("<u8") for c in columns), (size * 512 + before).astype("<u8")], axis=1)
    _, pick, of = np.unique(rows.view(f"V{8 * rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    first = np.full(len(pick), np.iinfo(np.int64).max)
    np.minimum.at(first, of, doc)
    order, seg, at, begin, node = groups([c[pick] for c in columns], size[pick], before[pick], length)
    n = size[pick] - length + 1
    least = np.repeat(first, n)  # of each window the smallest doc_id that has it
    if len(node):
        where = order[K.each(node[:, 1], node[:, 2])]
        many = node[:, 2] - node[:, 1] + 1
        low = np.repeat(np.minimum.reduceat(first[seg[where]], np.cumsum(many) - many), many)
        span = np.repeat(node[:, 0] - length + 1, many)  # the windows of each occurrence
        start = begin[seg[where]] + at[where]
        np.minimum.at(least, K.each(start, start + span - 1), np.repeat(low, span))
    n = size - length + 1
    who = np.repeat(np.arange(len(size)), n)
    at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    late = np.flatnonzero(doc[who] > least[begin[of][who] + at])
    mask = np.zeros(len(size), np.uint64)
    np.bitwise_or.at(mask, who[late], np.uint64(1) << at[late].astype(np.uint64))
    return mask


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends) of each row: spans in bytes."""
    assert length - anchor < 63 and 2 * length - anchor <= WIDE
    chunks = K.make(docs, text_col, id_col)
    n = chunks.buckets

    def probe(ids, offs, buf, _):
        g, first, _ = anchors(offs, buf, length, anchor)
        k, times, several = K.counted(K.key(g, n), ids[C.owner(first, offs)])
        return [(K.bucket_of(k), [K.inside(k), several.astype(np.uint8), times]), K.copies_sent(ids, offs, buf, np.diff(offs) >= length, n)]

    def shared(kinds):
        sender, (h, several, times) = kinds[0]
        order, at, group = K.of_keys(kinds[0])
        if not len(at):
            return [(sender, [h, several]), K.least_told(kinds[1])]
        there = (np.maximum.reduceat(several[order], at) > 0) | (np.diff(np.append(at, len(order))) > 1)
        which = np.flatnonzero(there[group])
        return [(sender[order][which], [h[order][which].astype(np.uint32), (np.add.reduceat(times[order], at) > hot)[group[which]].astype(np.uint8)]), K.least_told(kinds[1])]

    hits = K.exchange(chunks, probe, shared)

    def both_hashes(buf, at):
        return C.spans_hash(buf, at, at + length), C.spans_hash(buf, at, at + length, C._OTHER)

    def segments(ids, offs, buf, answers):
        told = K.joined(answers)
        copy = K.copies(told and told[1], ids, offs, buf, np.diff(offs) >= length)
        gone = np.flatnonzero(copy)
        g, first, last = anchors(offs, buf, length, anchor)
        doc = C.owner(first, offs)
        keep, very = np.zeros(len(first), bool), np.zeros(len(first), bool)
        if told:
            known = K.whole(told[0][0], told[0][1][0])
            order = np.argsort(known)
            at = K.among(K.key(g, n), known[order])
            keep = (at >= 0) & ~copy[doc]
            very = keep & (told[0][1][1][order][at] > 0)
        cold = keep & ~very
        v0, v1, d = first[cold], last[cold], doc[cold]
        before = np.where(v0 > offs[d], buf[np.maximum(v0 - 1, 0)].astype(np.int64), 256)
        hot_at, echo = K.each(first[very], last[very]), K.home(ids, buf, n, int(very.sum()))
        return [
            (K.bucket_of(K.key(g[cold], n)), [v0.astype(np.uint32), (v1 - v0 + length).astype(np.uint8), before.astype(np.uint16), ids[d], K.Pieces(v0, v1 + length, buf.tobytes())]),
            K.least_sent(*both_hashes(buf, hot_at), ids[C.owner(hot_at, offs)], n),
            (K.home(ids, buf, n, len(gone)), [gone.astype(np.uint32)]),
            (echo, [first[very].astype(np.uint32), last[very].astype(np.uint32)]),
        ]

    def solve(kinds):
        sender, (v0, size, before, ids, said) = kinds[0]
        size = size.astype(np.int64)
        wide = np.zeros((len(size), WIDE), np.uint8)
        wide[np.arange(WIDE) < size[:, None]] = np.frombuffer(said, np.uint8)
        mask = bucket_repeats(list(wide.view("<u8").T), size, before.astype(np.int64), ids, length)
        which = np.flatnonzero(mask)
        return [(sender[which], [v0[which], mask[which]]), K.least_told(kinds[1]), *kinds[2:]]

    found = K.exchange(chunks, segments, solve, hits)
    C.forget(hits)

    def finish(batches):
        for _, ids, offs, buf, answers in K.unpack(batches, True):
            gone = np.zeros(len(buf), bool)
            if told := K.joined(answers):
                start = K.bits(*told[0][1])
                at = K.each(*(x.astype(np.int64) for x in told[3][1]))
                if len(at) and len(told[1][1][0]):
                    start = np.concatenate([start, at[K.least_of(told[1], *both_hashes(buf, at)) < ids[C.owner(at, offs)]]])
                gone = K.cover(start, length, len(buf))
                for d in told[2][1][0].tolist():
                    gone[offs[d] : offs[d + 1]] = True
            raw, rows = buf.tobytes(), []
            for d, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                mine, text = gone[s:e], raw[s:e]
                starts, ends = K.removed_spans(mine)
                kept = buf[s:e][~mine].tobytes() if len(starts) else text
                rows.append((int(ids[d]), e - s, int(mine.sum()), len(starts), hashlib.sha256(kept).hexdigest(), starts.tolist(), ends.tolist()))
            yield K.report(rows, "n_bytes")

    out = C.materialize(K.with_answers(chunks, found).mapInArrow(finish, K.found_schema("n_bytes")))
    C.forget(chunks.rows, found)
    return out
