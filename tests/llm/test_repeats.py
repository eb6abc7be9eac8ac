"""Repeats over many small chunks, hot anchors, very long runs, and the maximal repeats of a bucket."""

import random

import numpy as np
import pytest

from lodestone.llm import blockdedup, suffixdedup
from lodestone.llm import chunks as K


def brute(texts, units, length):
    """{row: removed places}: texts are (doc_id, sequence)."""
    first = {}
    for d, t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length] if isinstance(t, bytes) else tuple(t[i : i + length])
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length] if isinstance(t, bytes) else tuple(t[i : i + length])] < d:
                gone[i : i + length] = True
        out.append((d, len(t), int(gone.sum())))
    return sorted(out)


def corpus(seed):
    """Passages of 40 to 140 words at any place of many texts, copies, runs of one word, and repeated ids."""
    r = random.Random(seed)
    word = lambda: "abcdefghij"[r.randrange(10)] * r.randrange(1, 4)
    passages = [[word() for _ in range(r.choice((40, 49, 50, 51, 75, 140)))] for _ in range(12)]
    rows = []
    for _ in range(220):
        own = [word() for _ in range(r.randrange(0, 60))]
        for p in r.sample(passages, r.randrange(0, 3)):
            i = r.randrange(len(own) + 1)
            own[i:i] = p[r.randrange(4) :]
        rows.append((r.randrange(150), " ".join(own)))
    rows += [(k, rows[5][1]) for k in range(200, 260)]  # copies
    rows += [(300, "x " * 4000), (301, "x " * 300), (302, "x y " * 500), (303, "y x " * 90)]
    rows += [(r.randrange(150), " ".join([*[word() for _ in range(r.randrange(30))], *passages[0], *[word() for _ in range(r.randrange(30))]])) for _ in range(120)]
    return rows


@pytest.mark.parametrize("hot", [1 << 12, 3])
def test_repeats_over_small_chunks(spark, monkeypatch, hot):
    monkeypatch.setattr(K, "LEAST", 2000)
    monkeypatch.setattr(K, "MOST", 2000)
    rows = corpus(hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert K.make(docs).rows.count() > 20
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in blockdedup.repeats(docs, hot=hot).collect())
    assert got == brute([(d, t.split()) for d, t in rows], None, 50)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffixdedup.repeats(docs, hot=hot).collect())
    assert got == brute([(d, t.encode()) for d, t in rows], None, 50)


def test_a_megabyte_of_spaces(spark):
    docs = spark.createDataFrame([(1, " " * (1 << 20)), (2, "a" + " " * 100 + "b"), (3, "é" * 1000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffixdedup.repeats(docs).collect()) == [(1, 0), (2, 100), (3, 0)]
    assert sorted((r.doc_id, r.n_removed) for r in blockdedup.repeats(docs).collect()) == [(1, 0), (2, 0), (3, 0)]


def test_maximal_repeats_of_a_bucket():
    """Every left-diverse interval is a repeat that can't be lengthened, and all of them are found."""
    r = np.random.default_rng(4)
    core = r.integers(97, 100, 40).astype(np.uint8)
    own = r.integers(50, 77, 60)
    rows = np.zeros((60, suffixdedup.WIDE), np.uint8)
    for i, n in enumerate(own):
        t = r.integers(97, 100, n).astype(np.uint8)
        k = int(r.integers(0, n - 40 + 1))
        t[k : k + 40] = core
        rows[i, :n] = t
    length = 20
    order, seg, at, _, node = suffixdedup.groups(list(rows.view("<u8").T), own, np.full(60, 256), length)
    text = [rows[i, :n].tobytes() for i, n in enumerate(own)]
    found = set()
    for depth, left, right in node.tolist():
        where = [(int(seg[j]), int(at[j])) for j in order[left : right + 1]]
        said = {text[s][a : a + depth] for s, a in where}
        assert len(said) == 1 and len(where) > 1
        (said,) = said
        assert sorted(where) == sorted((s, a) for s in range(60) for a in range(own[s] - depth + 1) if text[s][a : a + depth] == said)
        found.add(said)
    for s in range(60):
        for a in range(own[s] - length + 1):
            for depth in range(length, own[s] - a + 1):
                said = text[s][a : a + depth]
                where = [(i, j) for i in range(60) for j in range(own[i] - depth + 1) if text[i][j : j + depth] == said]
                if len(where) < 2:
                    break
                left = {text[i][j - 1] if j else -1 - i for i, j in where}
                right = {text[i][j + depth] if j + depth < own[i] else -1 - i for i, j in where}
                if (len(left) > 1 or min(left) < 0) and (len(right) > 1 or min(right) < 0):
                    assert said in found
