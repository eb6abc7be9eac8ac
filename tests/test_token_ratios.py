import duckdb

from lodestone import catalog
from lodestone.operators import index

TEXTS = ["The the THE cat", "a cat, a dog", "", None, "ｃａｔ été", "!?", "the_cat 42 42"]


def shuffled(spark, df):
    """The rows of a result, and how many rows the stages that it ran have written for others."""
    sc = spark.sparkContext
    stages = lambda: sum(s.shuffleWriteRecords() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)))
    before = stages()
    rows = df.collect()
    return rows, stages() - before


def test_shuffles_no_postings(spark, tmp_path):
    texts = [" ".join(f"word{(i + k) % 300}" for k in range(200)) for i in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows, n = shuffled(spark, catalog.QUERIES["index_df_ratio"](spark, str(tmp_path)))
    assert len(rows) == 300 and sum(r.df for r in rows) == 80000
    assert n <= 2 * 300


def test_ratios_by_hand(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, s string")
    got = {r.token: (r.df, round(r.ratio, 6)) for r in index.token_ratios(df, "id", "s").collect()}
    assert got == {"the": (1, 0.142857), "cat": (3, 0.428571), "a": (1, 0.142857), "dog": (1, 0.142857), "été": (1, 0.142857), "the_cat": (1, 0.142857), "42": (1, 0.142857)}
    assert index.token_ratios(df.limit(0), "id", "s").collect() == []


def test_ratios_of_shared_keys_are_those_of_the_sql(spark, tmp_path):
    keys = [1, 1, None, None, 2, 3, 3]
    texts = [t and t.replace("ｃａｔ", "cat") for t in TEXTS]  # the SQL folds no widths
    spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(duck.sql(catalog.ORACLE_SQL["index_df_ratio"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["index_df_ratio"](spark, str(tmp_path)).collect())) == want
