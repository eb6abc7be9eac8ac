"""The benchmark stage looks for short items as whole windows."""

from lodestone.llm import decontam


def test_short_items_are_looked_for_whole(spark):
    docs = spark.createDataFrame([(1, "so Who wrote the Odyssey, they asked"), (2, "who wrote the"), (3, "the answer is yes"), (4, None), (5, "who wrote an odyssey"), (6, "a b c d e f g h")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Who wrote the Odyssey?"), (2, "yes"), (3, "the answer is"), (4, "A b c d e f g h i"), (5, None)], "item_id long, text string")
    for block in (1 << 20, 3):
        assert {r.doc_id for r in decontam.keep_clean(docs, bench, block=block).collect()} == {2, 3, 4, 5}


def test_prefix_join_against_all_windows(spark):
    """Windows under any order of shingles, in blocks of few hashes, over copies, null ids and clashing columns."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(7)
    word = lambda: r.choice("abcdefgh")
    items = [(k, " ".join(word() for _ in range(r.choice((1, 2, 3, 7, 8, 9, 20))))) for k in range(40)] + [(None, "a b c"), (41, None), (3, "a b a b a b a b a")]
    texts = []
    for k in range(150):
        w = [word() for _ in range(r.randrange(0, 40))]
        if k % 3 == 0:
            w[r.randrange(len(w) + 1) : 0] = items[r.randrange(40)][1].split()
        texts.append(" ".join(w))
    rows = [(None if k % 11 == 0 else k, texts[k % 120], k, "x") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int, h_0 string")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    windows = {}
    for k, t in items:
        w = (t or "").split()
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if n and k is not None else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(k))

    def brute(text):
        w, hit, who = text.split(), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    who |= found
        return len(w), len(hit), sorted(who)

    want = sorted((str(d), *brute(t)) for d, t, _, _ in rows)
    for block in (1 << 20, 7):
        got = decontam.contamination(docs, bench, block=block).collect()
        assert sorted((str(x.doc_id), x.n_words, x.n_hit, x["items"]) for x in got) == want
        assert all(sum(x.ends) - sum(x.starts) == x.n_hit for x in got)
    whole = {" ".join(x) for x in windows if len(x) >= decontam.SHORT}
    clean = [(d, t) for d, t, _, _ in rows if not any(f" {x} " in f" {t} " for x in whole)]
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted((str(x.doc_id), x.text) for x in kept.collect()) == sorted((str(d), t) for d, t in clean)
    assert decontam.keep_clean(docs.limit(0), bench).count() == 0 and decontam.keep_clean(docs, bench.limit(0)).count() == 200
