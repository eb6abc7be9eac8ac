"""Facets: groups of a result by keys, with counts, calculations and aggregators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import extensions
from ..functions import scalar
from ..plans import syntax as S
from .expression import Compiler, quoted

CALC = {"MAX": ("_max", F.max), "MIN": ("_min", F.min), "SUM": ("_sum", F.sum), "AVG": ("_avg", F.avg), "MEAN": ("_mean", F.avg)}


def sort_columns(keys, tie=(), compiler: Compiler | None = None) -> list[Column]:
    """'-a, b, f(c)' as ordering columns, then the tie breakers; with a compiler a key can be any expression, or a sorter."""
    out, seen = [], set()
    for said in S.split(keys):
        name = said.lstrip("-+").strip()
        seen.add(name)
        if compiler is None or name in compiler.kinds:
            c = quoted(name)
        else:
            tree = S.parse_script(name)
            own = extensions.find("sorter", tree.name) if isinstance(tree, S.Call) else None
            c = own(*map(compiler.value, tree.args)) if own else compiler.value(tree)
        out.append(c.desc() if said[0] == "-" else c.asc())
    return out + [quoted(t).asc() for t in tie if t not in seen]


def aggregator_sum(x) -> Column:
    return F.sum(x)


def aggregator_mean(x) -> Column:
    return F.avg(x)


def aggregator_sd(x, unbiased: bool = False) -> Column:
    """The population's standard deviation; unbiased, the sample's, which one value doesn't have (NaN)."""
    return F.coalesce(F.stddev_samp(x), F.lit(float("nan"))) if unbiased else F.stddev_pop(x)


BUILT_IN = {"aggregator_sum": aggregator_sum, "aggregator_mean": aggregator_mean, "aggregator_sd": aggregator_sd}


def aggregate(df: DataFrame, script: str, **context) -> Column:
    """'aggregator_sum(column)', or a registered aggregator, as an aggregate Column."""
    tree = S.parse_script(script)
    make = isinstance(tree, S.Call) and (extensions.find("aggregator", tree.name) or BUILT_IN.get(tree.name))
    if not make:
        raise S.SyntaxProblem(f"no aggregator: {script}")
    c = Compiler(df, **context)
    options = {k: v.value for a in tree.args if isinstance(a, S.Options) for k, v in a.items}
    return make(*[c.value(a) for a in tree.args if not isinstance(a, S.Options)], **options)


def drilldown(
    df: DataFrame, keys, calc_types=(), calc_target: str | None = None, aggregates: Mapping[str, Column | str] | None = None, columns: Mapping[str, str | dict] | None = None,
    filter: str | None = None, adjuster: str | None = None, sort_keys=None, output_columns=None, offset: int = 0, limit: int | None = None,
    key_vector_expansion: str = "NONE", max_n_target_records: int | None = None, order: str | None = None, key_table=None,
) -> DataFrame:
    """One row for each value of the keys: the keys, _nsubrecs and what is calculated.

    A vector key counts under each of its elements, or with POWER_SET under each non-empty subset, of which n
    elements have 2 ** n - 1, each a row before it is counted. order names
    the unique column by which max_n_target_records takes the first records (negative: all but so many, and one).
    A key may be an expression or an accessor; it is named as it is said. columns: an expression, or a dict of
    stage (initial, group, filtered, output), value and type: group has an aggregator as value, initial is there
    before the filter, output after the page. key_table: the Table that the only key refers to; its columns can be
    named in columns, filter, sorting and output then, and _key is the key.
    """
    keys = S.split(keys)
    kinds = {f.name: f.dataType for f in df.schema}
    for k in keys:
        if k not in kinds:
            df = df.withColumn(k, Compiler(df).value(S.parse_script(k)))
    kinds = {f.name: f.dataType for f in df.schema}
    if max_n_target_records is not None:
        n = max_n_target_records if max_n_target_records >= 0 else max(df.count() + max_n_target_records + 1, 0)
        df = (df.orderBy(order) if order else df).limit(n)
    for k in keys:
        if isinstance(kinds[k], T.ArrayType):
            power = key_vector_expansion == "POWER_SET"
            df = df.withColumn(k, F.explode(scalar.power_set(F.array_sort(quoted(k)), kinds[k].elementType.simpleString()) if power else quoted(k)))
    calc_types = [c.strip().upper() for c in (calc_types.split(",") if isinstance(calc_types, str) else calc_types) if c.strip().upper() not in ("COUNT", "NONE", "")]
    if calc_target and calc_target not in kinds:
        df = df.withColumn(calc_target, Compiler(df).value(S.parse_script(calc_target)))
        kinds = {f.name: f.dataType for f in df.schema}
    target = quoted(calc_target) if calc_target else None
    if calc_target and isinstance(kinds[calc_target], T.ArrayType):  # every element counts
        each = lambda f, zero: F.aggregate(target, zero, f)
        size = F.sum(F.size(target))
        total = F.sum(each(lambda s, v: s + v, F.lit(0).cast(kinds[calc_target].elementType)))
        made = {"SUM": total, "MAX": F.max(F.array_max(target)), "MIN": F.min(F.array_min(target)), "AVG": total / size, "MEAN": total / size}
        aggs = [made[c].alias(CALC[c][0]) for c in calc_types]
    else:
        aggs = [CALC[c][1](target).alias(CALC[c][0]) for c in calc_types]
    staged = {k: v if isinstance(v, dict) else {"stage": "initial", "value": v} for k, v in (columns or {}).items()}
    grouped = {**(aggregates or {}), **{k: v["value"] for k, v in staged.items() if v.get("stage") == "group"}}
    made = [(aggregate(df, c) if isinstance(c, str) else c).alias(n) for n, c in grouped.items()]
    out = df.groupBy(*map(quoted, keys)).agg(F.count("*").alias("_nsubrecs"), *aggs, *made)
    if key_table is not None:
        columns_ = [c for c in key_table.df.columns if c != key_table.key]
        out = out.join(key_table.df.select(quoted(key_table.key).alias("__ref"), *map(quoted, columns_)), quoted(keys[0]) == F.col("__ref"), "left").drop("__ref")
    only = keys[0] if len(keys) == 1 else None

    def stage(out, name):
        for k, v in staged.items():
            if v.get("stage", "initial") == name:
                c = Compiler(out, key=only).value(S.parse_script(v["value"]))
                out = out.withColumn(k, c.cast(v["type"]) if v.get("type") else c)
        return out

    out = stage(out, "initial")
    if filter:
        out = out.where(Compiler(out, key=only).holds(S.parse_script(filter)))
    out = stage(out, "filtered")
    if adjuster:
        out = out.withColumn("_score", F.col("_nsubrecs") + Compiler(out, key=only).score(S.parse_script(adjuster)))
    late = any(v.get("stage") == "output" for v in staged.values())
    if sort_keys or limit is not None or offset:
        out = stage(out, "output") if late and _names_output(sort_keys, staged) else out
        out = out.orderBy(*sort_columns(sort_keys, keys, Compiler(out, key=only)))
    out = out.offset(offset) if offset else out
    out = out if limit is None or limit < 0 else out.limit(limit)
    out = stage(out, "output") if late and not _names_output(sort_keys, staged) else out
    chosen = S.split(output_columns) if isinstance(output_columns, str) else output_columns
    if not chosen:
        return out
    return out.select(*[quoted(c) if c in out.columns else quoted(only).alias("_key") if c == "_key" and only else Compiler(out, key=only).value(S.parse_script(c)).alias(c) for c in chosen])


def _names_output(sort_keys, staged) -> bool:
    """Whether the sorting names a column of the output stage, which then comes before it."""
    return any(k.lstrip("-+").strip() in staged and staged[k.lstrip("-+").strip()].get("stage") == "output" for k in S.split(sort_keys))


def many(df: DataFrame, keys: list[str], aggregates: Mapping[str, Column] | None = None) -> DataFrame:
    """Several one-key facets of one scan and one shuffle: (facet, key, _nsubrecs, ...), keys as strings."""
    sets = [[F.col(k)] for k in keys]
    grouped = df.groupingSets(sets, *map(F.col, keys)).agg(F.grouping_id().alias("_g"), F.count("*").alias("_nsubrecs"), *[c.alias(n) for n, c in (aggregates or {}).items()])
    n = len(keys)
    facet, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        own = ((1 << n) - 1) ^ (1 << (n - 1 - i))
        facet = F.when(F.col("_g") == own, F.lit(k)).otherwise(facet)
        key = F.when(F.col("_g") == own, F.col(k).cast("string")).otherwise(key)
    return grouped.select(facet.alias("facet"), key.alias("key"), "_nsubrecs", *(aggregates or {}))


def chained(facet: DataFrame, lookup: DataFrame, key: str, lookup_key: str, keys, **options) -> DataFrame:
    """A facet over the records that another facet's keys refer to."""
    return drilldown(facet.select(key).join(lookup, F.col(key) == F.col(lookup_key)), keys, **options)
