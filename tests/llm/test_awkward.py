"""Every stage and operator on empty tables, awkward rows, clashing columns and keys that very many rows have."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lodestone.llm import blockdedup, common, decontam, langid, licenses, packing, pii, quality, simhash, suffixdedup, tiff
from lodestone.operators import joins

SF = "/root/testdata/sf0.001"
NAMES = ["h", "h_0", "id", "id_0", "fp", "chunk", "row", "text_", "n_words", "said", "bucket", "answers", "label", "spans", "items", "_gone", "source_"]
LONG = "the cat sat on the mat and " * 12_000  # a third of a megabyte


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({x: F.lit(7) for x in NAMES})


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, None, None, None), (1, None, "en", "a"), (2, "", None, None), (3, " \t\r\n\x0b\x0c ", "en", "a"), (4, "the cat", "en", "a"), (4, "the cat", "en", "a"), (None, "the cat", "en", None)]
    rows += [(10, LONG, "en", "a"), (11, LONG, "en", "a"), (12, LONG + " x", None, "b"), (13, "\x00\x01\x7f", "en", "c"), (14, "𝔘𝔫𝔦 é ä " * 30, "de", "c"), (15, "a@b.co " * 400, "en", "a"), (16, "x" * 200_000, None, None)]
    return table(spark, [(*r, len(r[1] or "")) for r in rows])


@pytest.fixture(scope="module")
def nothing(spark, odd):
    return odd.limit(0)


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages(spark, odd, nothing, name, stage):
    got = stage(spark, odd, SF)
    if name != "pack":
        assert got.columns == odd.columns and got.dtypes == odd.dtypes
        assert all(r[x] == 7 for r in got.collect() for x in NAMES)
    empty = stage(spark, nothing, SF)
    assert empty.count() == 0 and (name == "pack" or empty.columns == odd.columns)


def test_operators_give_each_row_its_row(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and the cat"), (2, None), (None, "x")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    labels = spark.createDataFrame([(4, 1), (10, 0), (4, 0), (None, 1), (11, None)], "doc_id long, quality int").withColumn("text", F.lit("no"))
    run = {
        "simhash": simhash.near_duplicates, "decontam": lambda x: decontam.report(decontam.contamination(x, bench)), "tiff": lambda x: tiff.digest(tiff.encode(x)), "licenses": licenses.scan,
        "language": langid.languages, "quality": lambda x: quality.quality(x, labels), "blocks": blockdedup.repeats, "pii": lambda x: pii.report(pii.find(x)), "suffix": suffixdedup.repeats,
    }
    want = sorted(str(r.doc_id) for r in odd.collect())
    for name, f in run.items():
        assert sorted(str(r.doc_id) for r in f(odd).select("doc_id").collect()) == want, name
        assert f(nothing).count() == 0, name
    assert {str(r.doc_id) for r in packing.pack(odd).collect()} == set(want) and packing.pack(nothing).count() == 0


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    monkeypatch.setattr(joins, "MOST_HOT", 4)
    left = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    got = joins.spread_join(left, right, "k", "n", 1000)
    assert got.columns == ["k", "id", "most"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right.drop("n"), "k").collect()))


def test_one_fingerprint_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 8)
    monkeypatch.setattr(joins, "MOST_HOT", 4)
    rows = [(i, "one text that a third of all rows have" if i % 3 == 0 else f"w{i} x{i * 7} y{i * 13}") for i in range(300)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 300 and {got[i] for i in range(0, 300, 3)} == {0}
    star = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(500, 501)], "a long, b long")
    assert {r.node: r.label for r in common.components(star).collect()} == {**{i: 0 for i in range(200)}, 500: 500, 501: 500}
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0] + [i for i in range(300) if i % 3]


def test_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "_configured", lambda _: f"file://{tmp_path}/shared/")
    frame = common.materialize(spark.range(5))
    assert frame._lodestone_path.startswith(f"file://{tmp_path}/shared/lodestone-") and frame.count() == 5
    common.forget(frame)
    assert not list((tmp_path / "shared").glob("lodestone-*"))
    monkeypatch.setattr(common, "_configured", lambda _: None)  # nothing is configured: one folder for the application
    assert common.shared_dir(spark) == common.shared_dir(spark) != f"file://{tmp_path}/shared"
    assert common.materialize(spark.range(3)).count() == 3
