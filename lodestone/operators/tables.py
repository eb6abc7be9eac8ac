"""Tables that know their key and what their columns refer to, and what an expression needs of other tables.

Accessors (ref.column, through any number of references), _id, and the functions that ask another table
(sub_filter, in_records, index_column_*, escalate) can't be Columns of one scan. attach() and resolve() join
what they need once, as further columns, before an expression is compiled. No join is hinted: a side is
broadcast only where Spark knows it to be small, and skewed references are split at run time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import syntax as S
from .expression import Compiler, quoted

_PATH = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+")


@dataclass
class Table:
    """A DataFrame with its unique key and the tables that columns refer to, by name."""

    df: DataFrame
    key: str | None = None
    references: dict[str, str] = field(default_factory=dict)


def table_of(x) -> Table:
    """A Table as it is; of a DataFrame, its first column is the key."""
    return x if isinstance(x, Table) else Table(x, x.columns[0])


def said_paths(*texts) -> set[str]:
    """Everything that looks like an accessor in parameters, however nested."""
    out: set[str] = set()
    for t in texts:
        if isinstance(t, str):
            out |= set(_PATH.findall(t))
        elif isinstance(t, dict):
            out |= said_paths(*t.values())
        elif isinstance(t, (list, tuple)):
            out |= said_paths(*t)
    return out


def attach(df: DataFrame, paths, references: dict[str, str], tables: dict, key: str | None = None) -> DataFrame:
    """df with a column for each accessor of paths whose first part is a reference; others are left alone.

    The column is named like the accessor. A reference to no record gives null. Of a vector of references it
    is the vector of values, in order, without those of no record; that needs the key.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    by: dict[str, set[str]] = {}
    for p in paths:
        head, _, rest = p.partition(".")
        if p not in kinds and rest and head in references and head in kinds:
            by.setdefault(head, set()).add(rest)
    for head, rests in sorted(by.items()):
        other = table_of(tables[references[head]])
        there = attach(other.df, rests, other.references, tables, other.key)
        if "_id" in rests and "_id" not in there.columns:
            there = with_id(there, other.key)
        rests = sorted(r for r in rests if r == "_key" or r in there.columns)
        if not rests:
            continue
        values = there.select(quoted(other.key).alias("__ref"), *[quoted(other.key if r == "_key" else r).alias(f"{head}.{r}") for r in rests])
        if isinstance(kinds[head], T.ArrayType):
            if not key:
                raise S.SyntaxProblem(f"{head}: an accessor of a vector needs the table's key")
            each = df.select(quoted(key).alias("__row"), F.posexplode(head).alias("__at", "__ref")).join(values, "__ref")
            got = each.groupBy("__row").agg(*[F.transform(F.array_sort(F.collect_list(F.struct("__at", quoted(f"{head}.{r}").alias("v")))), lambda x: x["v"]).alias(f"{head}.{r}") for r in rests])
            df = df.join(got, quoted(key) == F.col("__row"), "left").drop("__row")
        else:
            df = df.join(values, quoted(head) == F.col("__ref"), "left").drop("__ref")
    return df


IDS, PIECES = 1 << 12, 200


def with_id(df: DataFrame, key: str, name: str = "_id") -> DataFrame:
    """df with record numbers from 1 in the order of its key, without one task that sorts them all.

    Keys drawn by their hash part the table into pieces; each is numbered by itself, after those before it.
    """
    total = df.count()
    part = max(1, total // IDS)
    some = sorted(r[0] for r in df.select(quoted(key)).where(quoted(key).isNotNull() & (F.pmod(F.xxhash64(quoted(key)), F.lit(part)) == 0)).collect())  # about IDS keys
    edges = some[:: max(1, len(some) // PIECES)]
    piece = reduce(lambda a, e: a + F.coalesce(quoted(key) >= F.lit(e), F.lit(False)).cast("int"), edges, F.lit(0))
    df = df.withColumn("__piece", piece)
    sizes = {r["__piece"]: r["n"] for r in df.groupBy("__piece").agg(F.count("*").alias("n")).collect()}  # PIECES rows or so
    before, at = {}, 0
    for k in sorted(sizes):
        before[k], at = at, at + sizes[k]
    offset = F.create_map(*[F.lit(x) for k, v in (before or {0: 0}).items() for x in (k, v)])[F.col("__piece")]
    number = F.row_number().over(Window.partitionBy("__piece").orderBy(quoted(key)))
    return df.withColumn(name, (number + offset).cast("long")).drop("__piece")


# ---- functions that ask other tables --------------------------------------------------------------
@dataclass
class Context:
    tables: dict
    key: str | None = None
    references: dict[str, str] = field(default_factory=dict)
    made: int = 0

    def fresh(self) -> str:
        self.made += 1
        return f"__asked_{self.made}"

    def compiler(self, df: DataFrame) -> Compiler:
        return Compiler(df, tables={k: table_of(v).df for k, v in self.tables.items()}, key=self.key)


def resolve(df: DataFrame, tree, context: Context, given: Column | None = None):
    """(df with what the tree asks of other tables, the tree that names it instead).

    given: the condition under which an escalation counts its hits.
    """
    df = attach(df, S.paths(tree), context.references, context.tables, context.key)
    if "_id" in S.paths(tree) and "_id" not in df.columns and context.key:
        df = with_id(df, context.key)
    return _resolve(df, tree, context, given)


def _resolve(df, tree, context, given):
    if isinstance(tree, S.Binary) and tree.op == "&&":
        df, left = _resolve(df, tree.left, context, given)
        under = context.compiler(df).truth(left) if _asks(tree.right, "escalate") else None
        df, right = _resolve(df, tree.right, context, under if given is None or under is None else given & under)
        return df, S.Binary("&&", left, right)
    if isinstance(tree, S.Call) and tree.name in ASKING:
        return ASKING[tree.name](df, tree.args, context, given)
    state = [df]

    def one(node):
        if isinstance(node, S.Call) and node.name in ASKING:
            state[0], node = ASKING[node.name](state[0], node.args, context, given)
        return node

    tree = S.rewrite(tree, one)
    return state[0], tree


def _asks(tree, name: str) -> bool:
    return isinstance(tree, S.Call) and tree.name == name or any(_asks(x, name) for x in S.parts(tree))


def _path(node) -> str:
    return node.path if isinstance(node, S.Name) else str(node.value)


def sub_filter(df, args, context, given):
    """sub_filter(reference, "condition"): the referenced record, or one of a vector's, satisfies the condition."""
    column, name = _path(args[0]), context.fresh()
    head, _, rest = column.partition(".")
    if rest:  # through another reference: the condition holds for a record further on
        inner = table_of(context.tables[context.references[head]])
        sub = Context(context.tables, inner.key, inner.references)
        there, tree = resolve(inner.df, S.Call("sub_filter", (S.Name(rest), *args[1:])), sub)
        keep = there.where(sub.compiler(there).holds(tree)).select(quoted(inner.key).alias("__ref"))
    else:
        other = table_of(context.tables[context.references[head]])
        sub = Context(context.tables, other.key, other.references)
        there, tree = resolve(other.df, S.parse_script(args[1].value), sub)
        keep = there.where(sub.compiler(there).holds(tree)).select(quoted(other.key).alias("__ref"))
    keep = keep.distinct().withColumn(name, F.lit(True))
    if isinstance(df.schema[head].dataType, T.ArrayType):
        if not context.key:
            raise S.SyntaxProblem("sub_filter of a vector needs the table's key")
        rows = df.select(quoted(context.key).alias("__row"), F.explode(head).alias("__ref")).join(keep, "__ref", "left_semi").select("__row").distinct().withColumn(name, F.lit(True))
        df = df.join(rows, quoted(context.key) == F.col("__row"), "left").drop("__row")
    else:
        df = df.join(keep, quoted(head) == F.col("__ref"), "left").drop("__ref")
    return df, S.Name(name)


MODES = {
    "EQUAL": lambda v, c: v == c, "NOT_EQUAL": lambda v, c: v != c, "LESS": lambda v, c: v < c, "GREATER": lambda v, c: v > c,
    "LESS_EQUAL": lambda v, c: v <= c, "GREATER_EQUAL": lambda v, c: v >= c, "MATCH": lambda v, c: F.contains(F.lower(v), F.lower(c)),
    "PREFIX": lambda v, c: F.startswith(v, c), "SUFFIX": lambda v, c: F.endswith(v, c), "REGEXP": lambda v, c: F.regexp_like(v, c),
}
BLOCK = 1000


def in_records_flag(df: DataFrame, conditions: DataFrame, triples, key: str | None, name: str) -> DataFrame:
    """df with a column that tells whether some row of conditions is satisfied in all its (value, mode, column).

    With an equality it is a join by that key; it needs df's key then, unless the equality is all. Without
    one the conditions are asked in blocks of BLOCK rows, each a condition of the scan, however many there are.
    """
    rows = conditions.select(*[quoted(c) for _, _, c in triples]).distinct()
    equal = [(v, c) for v, mode, c in triples if mode == "EQUAL"]
    if equal and (key or len(equal) == len(triples)):
        renamed = rows.select(*[quoted(c).alias(f"__c_{i}") for i, (_, _, c) in enumerate(triples)])
        on = reduce(lambda a, b: a & b, [MODES[mode](v, F.col(f"__c_{i}")) for i, (v, mode, _) in enumerate(triples)])
        if len(equal) == len(triples):
            return df.join(renamed.withColumn(name, F.lit(True)), on, "left").drop(*renamed.columns)
        hit = df.join(renamed, on, "left_semi").select(quoted(key).alias("__row")).withColumn(name, F.lit(True))
        return df.join(hit, quoted(key) == F.col("__row"), "left").drop("__row")
    n = -(-rows.count() // BLOCK)
    numbered = rows.withColumn("__part", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(max(n, 1))))
    flag = F.lit(False)
    for k in range(n):
        block = numbered.where(F.col("__part") == k).collect()  # about BLOCK rows
        each = [reduce(lambda a, b: a & b, [MODES[mode](v, F.lit(x[c])) for v, mode, c in triples]) for x in block]
        flag = flag | reduce(lambda a, b: a | b, [F.coalesce(e, F.lit(False)) for e in each], F.lit(False))
    return df.withColumn(name, flag)


def in_records(df, args, context, given):
    """in_records(Table, value, "MODE", "column", ...)."""
    c, name = context.compiler(df), context.fresh()
    other = table_of(context.tables[_path(args[0])])
    triples = [(c.value(args[i]), str(args[i + 1].value).upper(), _path(args[i + 2])) for i in range(1, len(args), 3)]
    columns = [x[2] for x in triples]
    there = attach(other.df, [x for x in columns if "." in x], other.references, context.tables, other.key)
    triples = [(v, m, other.key if x == "_key" else x) for v, m, x in triples]
    return in_records_flag(df, there, triples, context.key, name), S.Name(name)


def escalate(df, args, context, given):
    """escalate("condition", threshold, "condition", ...): the next condition too as long as no more than the threshold are hit.

    All counts are made in one pass.
    """
    said = [a.value for a in args if not isinstance(a, S.Options)]
    conditions, thresholds = said[::2], said[1::2]
    trees = []
    for text in conditions:
        df, tree = resolve(df, S.parse_script(text), context)
        trees.append(tree)
    c = context.compiler(df)
    under = F.lit(True) if given is None else given
    so_far = list(_running([c.truth(t) for t in trees]))
    n = df.agg(*[F.count_if(under & t).alias(f"n{i}") for i, t in enumerate(so_far)]).first()
    k = 0
    while k < len(thresholds) and k + 1 < len(trees) and n[k] <= thresholds[k]:
        k += 1
    return df, reduce(lambda a, b: S.Binary("||", a, b), trees[: k + 1])


def _running(conditions):
    out = None
    for c in conditions:
        out = c if out is None else out | c
        yield out


def _postings(context, name: str) -> DataFrame:
    """(token, key) of an index that the tables name."""
    return table_of(context.tables[name]).df


def index_column_df_ratio(df, args, context, given):
    """index_column_df_ratio("index"): in what share of the indexed records a lexicon's token stands."""
    p, name = _postings(context, _path(args[0])), context.fresh()
    n = p.select("key").distinct().count()
    ratio = p.groupBy(F.col("token").alias("__token")).agg((F.count_distinct("key") / F.lit(n)).alias(name))
    return df.join(ratio, quoted(context.key) == F.col("__token"), "left").drop("__token"), S.Binary("||", S.Name(name), S.Lit(0.0))


def index_column_df_ratio_between(df, args, context, given):
    """index_column_df_ratio_between("index", least, most): borders included."""
    df, ratio = index_column_df_ratio(df, args[:1], context, given)
    return df, S.Call("between", (ratio, *args[1:3]))


def index_column_source_records(df, args, context, given):
    """index_column_source_records("index"): the keys of the records that have the token, sorted."""
    p, name = _postings(context, _path(args[0])), context.fresh()
    got = p.groupBy(F.col("token").alias("__token")).agg(F.array_sort(F.collect_set("key")).alias(name))
    return df.join(got, quoted(context.key) == F.col("__token"), "left").drop("__token"), S.Name(name)


def index_column_have_source_record(df, args, context, given):
    """index_column_have_source_record("index"): whether any record has the token."""
    name = context.fresh()
    got = _postings(context, _path(args[0])).select(F.col("token").alias("__token")).distinct().withColumn(name, F.lit(True))
    return df.join(got, quoted(context.key) == F.col("__token"), "left").drop("__token"), S.Name(name)


ASKING = {
    "sub_filter": sub_filter, "in_records": in_records, "escalate": escalate, "index_column_df_ratio": index_column_df_ratio, "index_column_df_ratio_between": index_column_df_ratio_between,
    "index_column_source_records": index_column_source_records, "index_column_have_source_record": index_column_have_source_record,
}
