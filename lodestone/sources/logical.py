"""Logical tables: one table partitioned by day or month, read by a range of its time column.

The partition column is asked along with the time, so partitions outside of the range are never listed
or read; borders inside a partition are told by the time itself.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import select as Q
from ..operators.facets import sort_columns
from ..plans import syntax as S

UNITS = {"day": "yyyyMMdd", "month": "yyyyMM"}
_PATTERNS = {"day": "%Y%m%d", "month": "%Y%m"}


def write(df: DataFrame, path: str, time: str, unit: str = "day") -> None:
    """Partition by the time's day or month; the rows of a partition are spread by the writing tasks, not moved to one."""
    df.withColumn("shard", F.date_format(time, UNITS[unit])).write.mode("overwrite").partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("basePath", path).parquet(path)
    return df.withColumn("shard", F.col("shard").cast("string"))


def shard_list(df: DataFrame) -> DataFrame:
    """The shards; of a written table no column is read, only the files' footers."""
    return df.select("shard").distinct().orderBy("shard")


def _at(x) -> datetime:
    return x if isinstance(x, datetime) else datetime(x.year, x.month, x.day) if isinstance(x, date) else datetime.fromisoformat(x)


def within(df: DataFrame, time: str, least=None, most=None, least_border: str = "include", most_border: str = "include", unit: str = "day") -> DataFrame:
    """The records in a range of time, from the shards that it touches."""
    pattern = _PATTERNS[unit]
    if least is not None:
        v = _at(least)
        df = df.where(F.col(time) >= F.lit(v) if least_border == "include" else F.col(time) > F.lit(v))
        df = df.where(F.col("shard") >= v.strftime(pattern)) if "shard" in df.columns else df
    if most is not None:
        v = _at(most)
        df = df.where(F.col(time) <= F.lit(v) if most_border == "include" else F.col(time) < F.lit(v))
        df = df.where(F.col("shard") <= v.strftime(pattern)) if "shard" in df.columns else df
    return df


def range_filter(df: DataFrame, time: str, least=None, most=None, filter: str | None = None, order: str = "ascending", offset: int = 0, limit: int | None = 10, output_columns=None, key: str | None = None, columns=None, post_filter=None, **borders) -> DataFrame:
    """The records of a range in the order of time, which satisfy the filter; -1 for no limit."""
    got = Q.select(within(df, time, least, most, **borders), filter=filter, columns=columns, post_filter=post_filter, key=key).records
    keys = [time if order == "ascending" else f"-{time}"]
    got = Q.page(got.orderBy(*sort_columns(keys, [key] if key else [])), offset, limit)
    return got.select(*S.split(output_columns)) if output_columns else got


def count(df: DataFrame, time: str, least=None, most=None, filter: str | None = None, **borders) -> DataFrame:
    """(n): how many records of a range satisfy the filter."""
    return Q.select(within(df, time, least, most, **borders), filter=filter).records.agg(F.count("*").alias("n"))


def select(df: DataFrame, time: str, least=None, most=None, borders: dict | None = None, **options) -> Q.Result:
    return Q.select(within(df, time, least, most, **(borders or {})), **options)


def _in_range(time: str, least, most, borders: dict):
    lo = F.lit(True) if least is None else (F.col(time) >= F.lit(_at(least)) if borders.get("least_border", "include") == "include" else F.col(time) > F.lit(_at(least)))
    hi = F.lit(True) if most is None else (F.col(time) <= F.lit(_at(most)) if borders.get("most_border", "include") == "include" else F.col(time) < F.lit(_at(most)))
    return F.coalesce(lo & hi, F.lit(False))


def remove(df: DataFrame, time: str, least=None, most=None, unit: str = "day", **borders) -> DataFrame:
    """What stays when the records of a range are removed; a shard outside of the range isn't asked for its times."""
    if least is None and most is None:
        return df.limit(0)
    gone = _in_range(time, least, most, borders)
    if "shard" in df.columns:
        pattern = _PATTERNS[unit]
        if least is not None:
            gone = gone & (F.col("shard") >= _at(least).strftime(pattern))
        if most is not None:
            gone = gone & (F.col("shard") <= _at(most).strftime(pattern))
    return df.where(~F.coalesce(gone, F.lit(False)))


def remove_in_place(spark: SparkSession, path: str, time: str, least=None, most=None, unit: str = "day", **borders) -> None:
    """Remove a range from a written table: shards inside go as folders, only those at its borders are read and written again."""
    df, pattern = read(spark, path), _PATTERNS[unit]
    shards = [r[0] for r in shard_list(df).collect()]
    low, high = (None if x is None else _at(x).strftime(pattern) for x in (least, most))
    hit = [s for s in shards if (low is None or s >= low) and (high is None or s <= high)]
    border = [s for s in hit if s in (low, high)]
    with_rest = {}
    if border:
        rest = df.where(F.col("shard").isin(border) & ~_in_range(time, least, most, borders))
        with_rest = {r["shard"] for r in rest.select("shard").distinct().collect()}
        if with_rest:
            before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
            try:
                rest.write.mode("overwrite").partitionBy("shard").parquet(path)
            finally:
                spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in hit:
        if s not in with_rest:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={s}"), True)


def stream(df: DataFrame, time: str, least=None, most=None, order: str = "ascending", limit: int | None = None, key: str | None = None, unit: str = "day", **options):
    """The records of a range, shard by shard in the order of time, as they come: a shard is asked once those before it are through.

    Memory is that of one partition; what comes after the limit is never asked. options: as of range_filter().
    """
    inside = within(df, time, least, most, unit=unit, **{k: options.pop(k) for k in ("least_border", "most_border") if k in options})
    shards = sorted((r[0] for r in inside.select("shard").distinct().collect()), reverse=order != "ascending")
    left = limit
    for s in shards:
        if left is not None and left <= 0:
            return
        part = range_filter(inside.where(F.col("shard") == s), time, order=order, limit=left, key=key, **options)
        for row in part.toLocalIterator(prefetchPartitions=True):
            yield row
            left = None if left is None else left - 1


def with_neighbours(df: DataFrame, shard: str, shards: list[str], ahead: int = 1, behind: int = 1) -> DataFrame:
    """The records of a shard, and of those next to it in the list with _neighbour -1, -2, ... before and 1, 2, ... behind, for what must look over a border."""
    at = shards.index(shard)
    near = {shards[i]: i - at for i in range(max(0, at - behind), min(len(shards), at + ahead + 1))}
    place = F.create_map(*[F.lit(x) for kv in near.items() for x in kv])
    return df.where(F.col("shard").isin(list(near))).withColumn("_neighbour", place[F.col("shard")])


def each_shard(df: DataFrame, time: str, run, least=None, most=None, order: str = "ascending", ahead: int = 0, behind: int = 0, unit: str = "day"):
    """Yields (shard, run(its records)) in the order of time; with neighbours where ahead or behind say so."""
    inside = within(df, time, least, most, unit=unit)
    shards = sorted(r[0] for r in inside.select("shard").distinct().collect())
    for s in shards if order == "ascending" else reversed(shards):
        yield s, run(with_neighbours(inside, s, shards, ahead, behind) if ahead or behind else inside.where(F.col("shard") == s))
