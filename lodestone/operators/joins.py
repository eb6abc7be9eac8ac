"""Lookups through references, and semi-joins by conditions on other tables.

No broadcast is hinted: the optimizer broadcasts a side by its size on disk and runs a sort-merge or
shuffled hash join beyond that, and splits skewed partitions at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..plans import syntax as S
from .expression import Compiler
from .tables import MODES, in_records_flag


def reference(df: DataFrame, table: DataFrame, column: str, key: str, prefix: str = "") -> DataFrame:
    """df with the columns of the record of table that column refers to, null where there is none."""
    other = table.select(F.col(key).alias("_ref"), *[F.col(c).alias(prefix + c) for c in table.columns if c != key])
    return df.join(other, F.col(column) == F.col("_ref"), "left").drop("_ref")


def reference_vector(df: DataFrame, table: DataFrame, column: str, key: str, value: str, out: str, row_key: str) -> DataFrame:
    """The values of the records that a vector of references names, in its order."""
    each = df.select(row_key, F.posexplode(column).alias("_at", "_ref")).join(table.select(F.col(key).alias("_ref"), F.col(value).alias("_v")), "_ref", "left")
    got = each.groupBy(row_key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(out))
    return df.join(got, row_key, "left")


def source_records(table: DataFrame, key: str, source: DataFrame, column: str) -> DataFrame:
    """(key, _nsubrecs): how many records refer to each record of table."""
    n = source.groupBy(F.col(column).alias("_ref")).agg(F.count("*").alias("_n"))
    return table.join(n, F.col(key) == F.col("_ref"), "left").select(key, F.coalesce("_n", F.lit(0)).alias("_nsubrecs"))


def sub_filter(df: DataFrame, column: str, table: DataFrame, key: str, condition: str, anti: bool = False) -> DataFrame:
    """The records whose referenced record satisfies the condition, or with anti those whose doesn't."""
    keep = table.where(Compiler(table).holds(S.parse_script(condition))).select(F.col(key).alias("_ref"))
    return df.join(keep, F.col(column) == F.col("_ref"), "left_anti" if anti else "left_semi")


def in_records(df: DataFrame, conditions: DataFrame, *triples: tuple[Column, str, str]) -> DataFrame:
    """The records that satisfy some row of conditions: every (value, mode, column of conditions) of it.

    With an equality the semi-join goes by that key. Without one the conditions are asked in blocks, each a
    condition of the scan, however many there are.
    """
    if any(mode == "EQUAL" for _, mode, _ in triples):
        renamed = conditions.select(*[F.col(c).alias(f"_c_{c}") for c in conditions.columns]).distinct()
        on = reduce(lambda a, b: a & b, [MODES[mode](value, F.col(f"_c_{c}")) for value, mode, c in triples])
        return df.join(renamed, on, "left_semi")
    return in_records_flag(df, conditions, triples, None, "__hit").where("__hit").drop("__hit")


HOT_ROWS, MOST_HOT = 1 << 10, 1 << 13


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """left joined to right (one row a key) on key, without a task that has one key's rows alone.

    n: right's column with the number of left's rows of the key; total: left's rows. A key is hot from
    max(HOT_ROWS, total / MOST_HOT) rows on, so MOST_HOT keys are hot at most: they are broadcast, the
    others joined by a shuffle. n isn't in the result.
    """
    hot = F.col(n) >= max(HOT_ROWS, -(-total // MOST_HOT))
    few, rest = right.where(hot).drop(n), right.where(~hot).drop(n)
    near = left.join(F.broadcast(few), key)
    far = left.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key)
    return near.unionByName(far)


def nearest(df: DataFrame, vector: str, to: list[float], k: int, key: str, distance=scalar.distance_cosine) -> DataFrame:
    """The k records nearest to a vector, exactly: a top-k of partial top-ks, no full sort."""
    d = distance(F.col(vector), F.array(*[F.lit(float(v)) for v in to]))
    return df.withColumn("distance", d).orderBy("distance", key).limit(k)
