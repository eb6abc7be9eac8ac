"""The training-data operators against brute force, on the smallest tables and on rows that are awkward."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import blockdedup, common, decontam, langid, licenses, oracle, packing, pii, quality, queries, simhash, suffixdedup, tiff

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, fp string"
LONG = " ".join(f"w{i}" for i in range(300))
AWKWARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", None, "a"), (4, LONG, "en", "a"), (5, LONG, "en", "a"), (6, "x " + LONG + " y", "fr", None),
    (7, "é  MIT License \u0085 gnu general public license", "fr", "b"), (8, "a@b.co +1 555 123 4567 4111 1111 1111 1111 10.0.0.256 10.0.0.1", "en", "b"),
    (9, "z" * 70000, "en", "c"), (None, LONG, "en", "a"), (10, "permission is hereby granted free of charge to any person obtaining a copy\nall rights reserved", None, "a"), (5, LONG, "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, 7, "fp") for r in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


SPACE, WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = SPACE.findall((text or "").translate(LOW))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    label = {i: i for i in fps}
    while True:
        new = {a: min(label[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= 2) for a in fps}
        if new == label:
            return label
        label = new


def test_simhash(spark, docs, odd):
    got = by_id(queries.op2_simhash(spark, SF))
    want = {k: fingerprint(t) for k, t in docs.items()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{v:016x}" for k, v in want.items()}
    assert {k: r.component_id for k, r in got.items()} == groups(want)
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(AWKWARD) and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}


def test_bk_tree_finds_all():
    r = np.random.default_rng(1)
    v = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    v = np.unique(np.concatenate([v, v[:100] ^ np.uint64(5), v[:50] ^ np.uint64(1)]))
    found = {(int(v[q]), int(v[i])) for near, i in simhash.BKTree(v).within(v, 2) for q in near}
    assert found == {(int(a), int(b)) for a in v for b in v if (int(a) ^ int(b)).bit_count() <= 2}


def removed(texts, words, window):
    """{doc_id: covered places} by brute force; texts: {doc_id: sequence}."""
    first = {}
    for k in sorted(texts):
        for i in range(len(words[k]) - window + 1):
            first.setdefault(tuple(words[k][i : i + window]), k)
    out = {}
    for k in texts:
        gone = np.zeros(len(words[k]), bool)
        for i in range(len(words[k]) - window + 1):
            if first[tuple(words[k][i : i + window])] < k:
                gone[i : i + window] = True
        out[k] = gone
    return out


def test_block_repeats(spark, docs, odd):
    words = {k: SPACE.findall(t or "") for k, t in docs.items()}
    want = {k: (len(words[k]), int(g.sum()), sha(" ".join(w for w, x in zip(words[k], g) if not x))) for k, g in removed(docs, words, 50).items()}
    assert {k: tuple(r)[1:] for k, r in by_id(queries.op8_blocks(spark, SF)).items()} == want
    rows = defaultdict(list)
    for r in blockdedup.repeats(odd).collect():
        rows[r.doc_id].append((r.n_words, r.n_removed))
    assert rows[4] == [(300, 0)] and rows[5] == [(300, 300)] * 2 and rows[6] == [(302, 300)] and rows[None] == [(300, 300)] and rows[1] == [(0, 0)]


def test_suffix_repeats(spark, docs, odd):
    """Against SQL for whole texts; the intervals themselves by brute force."""
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.op10_suffix(spark, SF)
    want = c.sql(oracle.SUFFIX).select(*got.columns).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    rows = defaultdict(list)
    for r in suffixdedup.repeats(odd).collect():
        rows[r.doc_id].append(r.n_removed)
    assert rows[1] == [0] and rows[5] == [len(LONG)] * 2 and rows[9] == [0] and rows[6] == [len(LONG)]


def test_maximal_repeats():
    texts = [b"xabcdefy", b"zabcdefw", b"abcd"]
    got = {(n, tuple(sorted(where))) for n, where in suffixdedup.maximal_repeats(texts, 3)}
    assert (6, ((0, 1), (1, 1))) in got and (4, ((0, 1), (1, 1), (2, 0))) in got and len(got) == 2


def test_decontamination(spark, docs, odd):
    items = {str(r["item_id"]): WORD.findall(r["text"].translate(LOW)) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    windows = defaultdict(set)
    for k, w in items.items():
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(k)
    want = {}
    for k, t in docs.items():
        w = WORD.findall((t or "").translate(LOW))
        hit, who = np.zeros(len(w), bool), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit[i : i + n] = True
                    who |= found
        want[k] = (len(w), int(hit.sum()), len(who), sha(",".join(sorted(who))), len(who) >= 2)
    assert {k: tuple(r)[1:] for k, r in by_id(queries.op3_decontamination(spark, SF)).items()} == want
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (2, None), (3, ""), (4, "W250"), (1, "w1 w2 w3 w4 w5 w6 w7 w8 w9")], "item_id long, text string")
    for block in (1 << 20, 3):
        got = decontam.contamination(odd, bench, block=block).collect()
        assert {r.doc_id: (r.n_hit, sorted(r["items"])) for r in got if r.doc_id in (1, 4, 9)} == {1: (0, []), 4: (10, ["1", "4"]), 9: (0, [])}
    assert decontam.contamination(odd, bench.limit(0)).where(F.size("items") > 0).count() == 0
    assert decontam.keep_clean(odd, bench).count() == len(AWKWARD) - 5


def test_tiff_round_trip(spark, docs, odd):
    got = by_id(queries.op4_tiff(spark, SF))
    assert set(got) == set(docs)
    for k, t in docs.items():
        raw = (t or "").encode()
        pay = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert tuple(got[k])[1:5] == (len(raw), len(pay), sha(pay), zlib.crc32(pay[-64:]))
        assert (got[k].media_bytes, got[k].media_sha256) == (len(tiff.write(pay)), sha(tiff.write(pay)))
    assert tiff.encode(odd).count() == len(AWKWARD)
    pages = tiff.pages(tiff.encode(odd)).where("doc_id = 9").orderBy("page").collect()
    assert len(pages) == 2 and sum(len(r.pixels) for r in pages) == 70016
    broken = spark.createDataFrame([(1, None), (2, b"II*\0"), (3, b"MM\0*\0\0\0\x08\xff\xff")], "doc_id long, media binary")
    assert tiff.pages(broken).count() == 0


@pytest.mark.parametrize("size", [64, 640, 2112, 70016])
def test_tiff_layouts(size):
    """Every compression, in strips and tiles, with the predictor and without, at every size."""
    r, seen = np.random.default_rng(size), set()
    for k in range(60 if size < 9999 else 30):
        data = r.integers(97, 97 + [2, 20, 150][k % 3], size, dtype=np.uint8).tobytes()
        raw = tiff.write(data)
        got = list(tiff.read(raw))
        assert b"".join(p.pixels.tobytes() for p in got) == data and len(got) == -(-size // 65536)
        seen.add((got[0].compression, any(322 in tags for _, tags in tiff._directories(raw)), got[0].predictor))
    assert len(seen) >= 8
    for data in (bytes(size), (b"abcab" * size)[:size]):
        assert b"".join(p.pixels.tobytes() for p in tiff.read(tiff.write(data))) == data


def test_packbits_and_lzw():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 127, 128, 129, 5000, 30000):
        data = r.integers(0, 3, n, dtype=np.uint8).tobytes()
        assert tiff.unpack_bits(tiff.pack_bits(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def scan_brute(text):
    w = WORD.findall((text or "").translate(LOW))
    places, labels = [], set()
    for p, label in licenses.PHRASES.items():
        q = p.split()
        at = [i for i in range(len(w)) if w[i : i + len(q)] == q]
        places += at
        labels |= {label} if at else set()
    added, best = set(), 0.0
    lines = (text or "").split("\n")
    for line in ("\n".join(lines[i : i + k]) for i in range(len(lines)) for k in range(1, licenses.LINES + 1)):
        held = set(WORD.findall(line.translate(LOW)))
        for label, said in licenses.TEMPLATES.items():
            share = len(held & set(said.split())) / len(set(said.split()))
            if share >= licenses.THRESHOLD - 1e-12:
                added.add(label)
                best = max(best, share)
    one = lambda f: f(places) if places else None
    return (len(w), len(places), one(min), one(max), ",".join(sorted(labels)), ",".join(sorted(labels | added)), 1.0 if places else best)


def test_licenses(spark, docs, odd):
    assert {k: tuple(r)[1:] for k, r in by_id(queries.op5_licenses(spark, SF)).items()} == {k: scan_brute(t) for k, t in docs.items()}
    got = sorted((str(r.doc_id), tuple(r)[1:]) for r in licenses.scan(odd).drop("blocks").collect())
    assert got == sorted((str(r[0]), scan_brute(r[1])) for r in AWKWARD)


def base_brute(text):
    out, text = [], text or ""
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    for n, (kind, pattern, ok) in enumerate(kinds):
        out += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(out)


def test_pii(spark, docs, odd):
    def said(t):
        b = base_brute(t)
        return (*(sum(x[3] == k for x in b) for k in pii.BASE), sha(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in b)))

    got = by_id(queries.op9_pii(spark, SF))
    assert {k: tuple(r)[1:6] for k, r in got.items()} == {k: said(t) for k, t in docs.items()}
    for k, t in docs.items():
        spans = got[k].spans.split(",")
        assert {f"{x[3]}:{x[0]}:{x[2]}" for x in base_brute(t)} <= set(spans)
    masked = pii.mask(odd)
    assert masked.columns == odd.columns and masked.count() == len(AWKWARD)
    text = masked.where("doc_id = 8").first().text
    assert "@" not in text and "4111" not in text and "10.0.0.1" not in text.replace("10.0.0.256", "")


@pytest.mark.parametrize("text", ["1.2.3.4.5.6.7.8", "a@b.c@d.e", "..@x.y", "+1 (2) 3.4-5 6789 0", "4111-1111-1111-1111 4111111111111111", "999.1.1.1 1.1.1.1", "é@x.com", "1@1.1.1.1", "+12345678901234567", "0000.1.2.3"])
def test_pii_base_patterns(text):
    assert [(s, pii.BASE[k], e) for s, k, e in pii.base_spans(text)] == [(s, kind, e) for s, _, e, kind in base_brute(text)]


def test_language(spark, odd, nothing):
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = queries.op6_language(spark, SF).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id][0] for r in held]) > 0.9
    got = {r.doc_id: r for r in langid.identify(odd, langid.train(odd)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert langid.identify(odd, langid.train(nothing)).where("lang_pred <> 'und'").count() == 0
    parser = langid.train(odd)
    want = [r.doc_id or 0 for r, (_, t, *_) in zip(langid.identify(odd, parser).collect(), AWKWARD) if r.lang_pred != "und" and (r.phrases_per_byte < langid.UNKNOWN or len(t.encode()) < langid.JUDGED)]
    assert len(want) == len(AWKWARD) - 5 and sorted(r.doc_id or 0 for r in langid.keep_identified(odd, parser).collect()) == sorted(want)


def phrases_naive(sample, text):
    fold = lambda x: bytes(langid._FOLD[np.frombuffer(x, np.uint8)])
    sample, text, at, n = fold(sample), fold(text), 0, 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at : at + k] in sample:
            k += 1
        at, n = at + max(1, k - 1), n + 1
    return n


@pytest.mark.parametrize("block", [512, 37, 1])
def test_phrases_are_longest_matches(block):
    r = np.random.default_rng(0)
    samples = {k: bytes(r.integers(97, 97 + m, 300).astype(np.uint8)) for k, m in (("a", 4), ("b", 6), ("c", 3))} | {"d": b"abcab", "e": b"zzz"}
    parser = langid.Parser(samples)
    texts = [bytes(r.integers(96, 100, int(n)).astype(np.uint8)) for n in r.integers(0, 300, 30)] + [b"abcabzab", b"aaaa" * 300, samples["a"] * 3]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n = parser.phrases(np.frombuffer(b"".join(texts), np.uint8), offs, block)
    assert n.tolist() == [[phrases_naive(samples[k], t) for k in parser.langs] for t in texts]
    assert n[30].tolist()[3:] == [3, 8]


def test_language_stage_parses(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat " * 20, "en"), (2, "qzxjvkwyqxzjkvwqpzx", None), (3, "the cat", None), (4, "12 34", "en"), (5, None, None), (None, "sat on", "en")], "doc_id long, text string, lang string")
    parser = langid.train(docs)
    assert sorted(r.doc_id or 0 for r in langid.keep_identified(docs, parser).collect()) == [0, 1, 3]
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    assert got[2].lang_pred == "en" and got[4].lang_pred == "und" and got[None].held_out is False
    assert langid.keep_identified(docs.limit(0), parser).count() == 0


def test_quality(spark, odd, nothing):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    rows = queries.op7_quality(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.8
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality(odd, none).collect()} == {0.5}
    assert quality.quality(nothing, none).count() == 0


def test_packing(spark, odd):
    docs = {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = queries.op1_packing(spark, SF).collect()
    words = {k: len((r["text"] or "").encode().lower().split()) for k, r in docs.items()}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.n_words))
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for k, n in words.items():
        at = 0
        for s, w in sorted(pieces[k]):
            assert s == at and w <= packing.CAPACITY
            at += w
        assert at == n
    for b in bins.values():
        assert sum(r.n_words for r in b) <= packing.CAPACITY
        sources = [docs[r.doc_id]["source"] for r in b if docs[r.doc_id]["source"] is not None]
        texts = [" ".join((docs[r.doc_id]["text"] or "").lower().split()) for r in b]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)
        end = 0
        for r in sorted(b, key=lambda r: r.bin_start):
            assert r.bin_start == end
            end += r.n_words
    got = packing.pack(odd).collect()
    assert {r.doc_id for r in got if r.bin_id is None} == {1, 2, 3}


def test_best_fit_is_tightest_compatible():
    r = np.random.default_rng(5)
    n = r.integers(1, 60, 200).tolist()
    source, cluster = r.integers(0, 6, 200).tolist(), r.integers(0, 40, 200).tolist()
    got = packing.pack_shard(list(range(200)), source, n, cluster, capacity=100)
    bins = []
    for _, i in sorted((-w, i) for i, w in enumerate(n)):
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n[i] and source[i] not in b["s"] and cluster[i] not in b["c"]]
        if fit:
            left = min(fit)[0]
            mine = next(x for x in got if x[0] == i)
            k = mine[4]
            assert bins[k]["left"] == left
        else:
            k = len(bins)
            bins.append({"left": 100, "s": set(), "c": set()})
            assert next(x for x in got if x[0] == i)[4] == k
        bins[k]["left"] -= n[i]
        bins[k]["s"].add(source[i])
        bins[k]["c"].add(cluster[i])


def test_components(spark):
    r = np.random.default_rng(2)
    e = r.integers(0, 120, (90, 2)).tolist()
    lab = {x: x for p in e for x in p}
    for _ in range(200):
        for a, b in e:
            lab[a] = lab[b] = min(lab[a], lab[b])
    got = {x.node: x.label for x in common.components(spark.createDataFrame([tuple(x) for x in e], "a long, b long")).collect()}
    assert got == {k: v for k, v in lab.items() if k in got} and all(v == k for k, v in lab.items() if k not in got)


def test_empty_tables(nothing, spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for df in (packing.pack(nothing), simhash.near_duplicates(nothing), decontam.report(decontam.contamination(nothing, bench)), tiff.digest(tiff.encode(nothing)), licenses.scan(nothing), blockdedup.repeats(nothing), pii.report(pii.find(nothing)), suffixdedup.repeats(nothing), langid.languages(nothing)):
        assert df.count() == 0
