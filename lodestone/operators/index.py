"""The inverted index as a table of postings, and what is computed from it.

A posting is (token, key, positions); the table can be written partitioned by the token's bucket, so a
search for a few tokens reads their buckets alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .joins import spread_join

BUCKETS = 64


def postings(df: DataFrame, key: str, column: str, tokenizer: str = "TokenWord", normalizer: str = "auto") -> DataFrame:
    """(token, key, tf, positions), one row for each token of each record."""
    each = df.select(F.col(key).alias("key"), F.posexplode(X.tokenize(F.col(column), tokenizer, normalizer)).alias("at", "token"))
    rows = each.groupBy("token", "key").agg(F.array_sort(F.collect_list("at")).alias("positions"))
    return rows.select("token", "key", F.size("positions").alias("tf"), "positions")


def word_pattern(words) -> str:
    """A pattern of any of the words, whole; the words come first in it, as they are found sooner than a border is."""
    order = sorted(set(words), key=lambda w: (-len(w), w))
    return "(" + "|".join(f"{re.escape(w)}(?<!{X.IN_WORD}{re.escape(w)})" for w in order) + f")(?!{X.IN_WORD})"


def frequencies(df: DataFrame, key: str, column: str, tokenizer: str = "TokenWord", only=None) -> DataFrame:
    """(token, key, tf) without positions, summed up before the shuffle.

    key: the unique column. only: the tokens that are wanted. Of words nothing else is taken out of the text, by
    one pattern, and they are counted record by record, so a search without a written index shuffles nothing here.
    """
    x = F.col(column)
    if only is None:
        return df.select(F.col(key).alias("key"), F.explode(X.tokenize(x, tokenizer)).alias("token")).groupBy("token", "key").agg(F.count("*").alias("tf"))
    only = sorted({X.fold(w) for w in only})
    if not only:
        return df.select(F.lit("").alias("token"), F.col(key).alias("key"), F.lit(0).cast("long").alias("tf")).limit(0)
    found = F.regexp_extract_all(X.normalize(x), F.lit(word_pattern(only)), F.lit(1)) if tokenizer == "TokenWord" else X.tokenize(x, tokenizer)
    each = X.let(found, lambda t: F.transform(F.array(*map(F.lit, only)), lambda w: F.struct(w.alias("token"), F.size(F.filter(t, lambda y: y == w)).cast("long").alias("tf"))))
    return df.select(F.col(key).alias("key"), F.inline(F.filter(each, lambda e: e["tf"] > 0))).select("token", "key", "tf")


def write(p: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The postings by bucket of their token."""
    p.withColumn("bucket", bucket(F.col("token"), buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def bucket(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def search(p: DataFrame, words: list[str], every: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """(key, _score): records with all words, or any; the score is the sum of term frequencies."""
    words = list(dict.fromkeys(words))
    if "bucket" in p.columns:  # reads these partitions only
        at = p.sparkSession.range(1).select(*[bucket(F.lit(w), buckets) for w in words]).first()
        p = p.where(F.col("bucket").isin(sorted(set(at))))
    found = p.where(F.col("token").isin(words)).groupBy("key").agg(F.count("*").alias("_n"), F.sum("tf").alias("_score"))
    return found.where(F.col("_n") == len(words)).select("key", "_score") if every else found.select("key", "_score")


def df_ratio(p: DataFrame, records: int) -> DataFrame:
    """(token, df, ratio): in how many records, and what share of them, each token stands."""
    return p.groupBy("token").agg(F.count("*").alias("df")).withColumn("ratio", F.col("df") / F.lit(records))


def token_ratios(df: DataFrame, key: str, column: str, tokenizer: str = "TokenWord") -> DataFrame:
    """What df_ratio makes of all tokens of a table's texts, without a posting for each token of each record.

    A record's different tokens are told in its own row and summed up before the shuffle, which grows with the
    different tokens there are. Records that share a key are one record, so postings are made where some do.
    """
    n = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    if (n["most"] or 0) > 1:
        return df_ratio(frequencies(df, key, column, tokenizer), n["all"])
    return df_ratio(df.select(F.explode(F.array_distinct(X.tokenize(F.col(column), tokenizer))).alias("token")), n["all"] or 0)


def tf_idf(p: DataFrame, token: str, records: int) -> DataFrame:
    """(key, _score) of a token: max(tf * ln(N / df), 1), with the exact df."""
    mine = p.where(F.col("token") == token).repartition("key")  # found once: both sides reuse this exchange of its few rows
    df = mine.groupBy("token").agg(F.count("*").alias("df"))
    return mine.join(df, "token").select("key", F.greatest(F.col("tf") * F.log(F.lit(float(records)) / F.col("df")), F.lit(1.0)).alias("_score"))


def _vectors(df: DataFrame, key: str, column: str, tokenizer: str) -> tuple[DataFrame, int, float]:
    """((key, size, token, tf, df), records, mean size): each record's tokens with their document frequency.

    A token that very many records have is joined by a broadcast of the few such tokens.
    """
    tokens = df.select(F.col(key).alias("key"), X.tokenize(F.col(column), tokenizer).alias("_t")).withColumn("size", F.size("_t"))
    whole = tokens.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.sum("size").alias("all")).first()
    p = tokens.select("key", "size", F.explode("_t").alias("token")).groupBy("token", "key", "size").agg(F.count("*").alias("tf"))
    freq = p.groupBy("token").agg(F.count("*").alias("df")).withColumn("n", F.col("df"))
    return spread_join(p, freq, "token", "n", whole["all"] or 0), whole["n"], whole["mean"] or 1.0


def bm25(df: DataFrame, key: str, column: str, k1: float = 1.2, b: float = 0.75, tokenizer: str = "TokenWord") -> DataFrame:
    """(key, token, weight): each record's weighted vector.

    A record's length goes along with its postings, and the two corpus sizes are one row, so the only
    shuffles are the two counts by token.
    """
    p, n, mean = _vectors(df, key, column, tokenizer)
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / mean))
    return p.select("key", "token", weight.alias("weight"))


def tf_idf_vectors(df: DataFrame, key: str, column: str, tokenizer: str = "TokenWord", unit: bool = True) -> DataFrame:
    """(key, token, weight): tf * ln(N / df), each record's vector of length 1 if unit."""
    p, n, _ = _vectors(df, key, column, tokenizer)
    p = p.select("key", "token", (F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))).alias("weight"))
    if not unit:
        return p
    from pyspark.sql import Window

    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("key")))
    return p.select("key", "token", F.when(length > 0, F.col("weight") / length).otherwise(F.lit(0.0)).alias("weight"))


def learn_pairs(events: DataFrame, session: str, order: str, item: str) -> DataFrame:
    """(item, next, n): how often an item follows another in a session, for completion and suggestion."""
    from pyspark.sql import Window

    w = Window.partitionBy(session).orderBy(order)
    return events.select(F.col(item).alias("item"), F.lead(item).over(w).alias("next")).where("next is not null").groupBy("item", "next").agg(F.count("*").alias("n"))


def complete(items: DataFrame, column: str, prefix: str, limit: int = 10) -> DataFrame:
    """(item, n) of the items that begin with prefix, the frequent first."""
    return items.where(F.startswith(F.lower(column), F.lit(prefix.lower()))).groupBy(F.col(column).alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(limit)


def correct(items: DataFrame, column: str, word: str, most: int = 2, limit: int = 10) -> DataFrame:
    """(item, n, distance) of the items within an edit distance of word."""
    return items.groupBy(F.col(column).alias("item")).agg(F.count("*").alias("n")).withColumn("distance", F.levenshtein(F.lower("item"), F.lit(word.lower()))).where(F.col("distance").between(1, most)).orderBy("distance", F.desc("n"), "item").limit(limit)
