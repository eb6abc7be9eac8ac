"""The corpus pipeline, stage by stage, against brute force."""

import re

import pyarrow.parquet as pq
import pytest

import corpus_pipeline as cp
from lodestone.llm import decontam, packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at, docs, out = tmp_path_factory.mktemp("pipe"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(at / name))
        docs = spark.read.parquet(str(at / name))
        out[name] = docs
    return out


def test_all_but_the_last_keep_the_columns(spark, stages):
    want = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [s for s, _ in cp.STAGES] == ["language", "near_duplicates", "benchmark", "personal_data", "pack"]
    assert all(stages[s].columns == want for s, _ in cp.STAGES[:-1])


def test_near_duplicates_keep_one_of_each_group(spark, stages):
    before = {r.doc_id: r.text for r in stages["language"].select("doc_id", "text").collect()}
    after = {r.doc_id for r in stages["near_duplicates"].select("doc_id").collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in before.items() for w in [t.lower().split()]}
    label = {k: k for k in before}
    pairs = [(a, b) for a in before for b in before if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(20):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert after == {k for k in label if label[k] == k} and len(after) < len(before)


def test_personal_data_goes_and_the_rest_stays(stages):
    before = {r.doc_id: r.text for r in stages["benchmark"].collect()}
    after = {r.doc_id: r.text for r in stages["personal_data"].collect()}
    assert set(before) == set(after)
    from lodestone.llm import pii

    assert all(a == before[k] or pii.base_spans(before[k]) or "[" in a for k, a in after.items())


def test_run(spark):
    words = sum(r.n_words for r in cp.run(spark, SF).collect())
    assert 0 < words <= sum(len((t or "").split()) for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist()) * 1.05


def test_pack_puts_every_word_of_every_document_into_one_compatible_bin(stages):
    docs = {r.doc_id: r for r in stages["personal_data"].collect()}
    rows = stages["pack"].collect()
    words = {k: (r.text or "").encode().lower().split() for k, r in docs.items()}
    held, bins = {}, {}
    for r in rows:
        held.setdefault(r.doc_id, []).append((r.start, r.n_words))
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for k, w in words.items():
        edges = sorted(held[k])
        assert edges[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(edges, edges[1:])) and sum(n for _, n in edges) == len(w)
    for b in bins.values():
        ends = sorted((r.bin_start, r.bin_start + r.n_words) for r in b)
        assert ends[0][0] == 0 and all(x[1] == y[0] for x, y in zip(ends, ends[1:])) and ends[-1][1] <= packing.CAPACITY
        source = [docs[r.doc_id].source for r in b if docs[r.doc_id].source is not None]
        assert len(set(source)) == len(source) and len({tuple(words[r.doc_id]) for r in b}) == len(b)


def test_language_and_benchmark_decide_as_told(spark, stages):
    """What goes is what the rules say, text by text, and nothing else."""
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r.doc_id for r in stages["language"].collect()}
    assert {k for k in before if k not in kept} == {k for k, t in before.items() if not any(map(str.isalpha, t or ""))}  # all others are of a learned language
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        if len(w) >= decontam.SHORT:
            windows |= {" ".join(w[i : i + 8]) for i in range(max(1, len(w) - 7))}
    said = {r.doc_id: f" {' '.join(words(r.text))} " for r in stages["near_duplicates"].collect()}
    assert {r.doc_id for r in stages["benchmark"].collect()} == {k for k, t in said.items() if not any(f" {x} " in t for x in windows)}
