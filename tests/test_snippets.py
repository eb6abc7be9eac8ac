import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalar as A


def by_one_pattern(x, words, width, most):
    """The pieces as the SQL of the snippet queries finds them: up to side characters, a keyword, up to side characters."""
    some = "|".join(A.keyword_pattern(w) for w in sorted(words, key=lambda w: -len(w)))
    side = max((width - max(map(len, words))) // 2, 0)
    found = F.slice(F.regexp_extract_all(x, F.lit(f"((?s:.{{0,{side}}}?)(?:{some})(?s:.{{0,{side}}}))"), F.lit(1)), 1, most)
    return F.transform(found, lambda s: A.highlight(F.ltrim(s), [(w, "[[", "]]") for w in words]))


def took(df):
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


@pytest.mark.parametrize("word", ["the", "zz"])
def test_time_does_not_grow_with_the_width(spark, word):
    text = spark.createDataFrame([("the " + "lorem " * 30000,)], "s string")
    narrow, wide = (text.select(A.snippets(F.col("s"), [word, "and"], width)) for width in (40, 20000))
    took(narrow)
    assert took(wide) < 5 * took(narrow) + 2


@pytest.mark.parametrize("words, width, most", [(["ab"], 9, 3), (["ab", "a"], 4, 1), (["a", "abb"], 30, 17), (["a"], 0, 16), (["a"], 6, 100000), (["a", "b"], 5, 0), (["😀"], 10, 3), (["zz"], 10, 3), (["a", ""], 8, 4)])
def test_pieces_are_those_of_one_pattern(spark, words, width, most):
    r = random.Random(7)
    letters = ["a", "b", "A", "ｂ", "é", "😀", " ", "\n", "\r\n", "xxxxx"]
    texts = ["".join(r.choices(letters, k=r.choice([0, 1, 3, 10, 40, 150]))) for _ in range(300)] + [None, "", "ab"]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", by_one_pattern(F.col("s"), words, width, most).alias("want"), A.snippets(F.col("s"), words, width, most).alias("got"))
    assert [x for x in got.collect() if x.want != x.got] == []


def test_very_many_pieces(spark):
    text = spark.createDataFrame([("the " * 100000,)], "s string")
    assert text.select(F.size(A.snippets(F.col("s"), ["the"], 3, 1000000))).first()[0] == 100000
