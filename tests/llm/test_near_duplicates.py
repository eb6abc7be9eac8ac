"""The near-duplicate stage finds every pair of a 5-word Jaccard similarity of 0.8 or more."""

import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chunks, setjoin, simhash


def kept_brute(docs):
    """The smallest doc_id of each group, by comparing all pairs."""
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in docs.items() for w in [t.lower().split()]}
    label = {k: k for k in docs}
    pairs = [(a, b) for a in docs for b in docs if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while True:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return {k for k in docs if label[k] == k}


def kept(spark, docs):
    return {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).select("doc_id").collect()}


def changed(r, words, n):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"w{r.randrange(10**6)}"
    return words


def template(r, groups, each):
    """groups texts of one template of 600 words, each with close variants of its own."""
    base = [f"w{r.randrange(10**6)}" for _ in range(600)]
    ids = r.sample(range(10**6), groups * each)
    return {ids[g * each + k]: " ".join(changed(r, own, 5)) for g in range(groups) for own in [changed(r, base, 30)] for k in range(each)}


def test_templated_texts_are_tied_beyond_their_nearest(spark, monkeypatch):
    docs = template(random.Random(3), 40, 6)
    want = kept_brute(docs)
    assert 40 <= len(want) < 60
    assert kept(spark, docs) == want
    monkeypatch.setattr(setjoin, "HOT", 16)  # shared shingles dealt out in blocks
    monkeypatch.setattr(chunks, "LEAST", 20000)
    monkeypatch.setattr(chunks, "MOST", 20000)
    assert kept(spark, docs) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_appended_and_scattered_edits_at_the_border(spark, seed):
    r, docs = random.Random(seed), {}
    for g in range(60):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([20, 100, 300]))]
        docs[10 * g] = " ".join(words)
        docs[10 * g + 1] = " ".join(words + [f"w{r.randrange(3000)}" for _ in range(len(words) // 5 - 1)])
        docs[10 * g + 2] = " ".join(changed(r, words, max(1, len(words) // 60)))
    assert kept(spark, docs) == kept_brute(docs)


def test_awkward_rows_and_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None, 7), (2, "", 7), (3, " \n", 7), (4, text, 7), (5, text.upper(), 7), (6, text + " x", 7), (None, text, 7), (4, text, 8), (7, "one two", 7), (8, "two one", 7), (9, "ONE  two", 7), (10, text[:200], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id_0 int").withColumn("_gone", F.lit(1))
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 1, 4, 4, 7, 8, 10]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_no_pair_is_missed_at_sf_0_01(spark):
    """Against all pairs that share a shingle, by an inverted list; pairs of unequal texts are there to be found."""
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    first: dict = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(" ".join((r["text"] or "").encode().lower().decode().split()), r["doc_id"])
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for t, k in first.items() for w in [t.split()] if w}
    having, common = defaultdict(list), Counter()
    for k, x in sets.items():
        for g in x:
            having[g].append(k)
    for v in having.values():
        common.update((a, b) for i, a in enumerate(sorted(v)) for b in sorted(v)[i + 1 :])
    pairs = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    label = {k: k for k in first.values()}
    for _ in range(len(pairs)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    kept_ = {r.doc_id for r in simhash.keep_one(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id").collect()}
    assert len(pairs) >= 3 and kept_ == {k for k in label if label[k] == k}
