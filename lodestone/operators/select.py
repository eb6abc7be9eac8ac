"""The select command: conditions, staged columns, scores, sorting, facets and slices as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import extensions
from ..plans import syntax as S
from . import facets, windows
from .expression import Compiler, keywords, quoted
from .tables import Context, Table, attach, resolve, said_paths, table_of, with_id

STAGES = ("initial", "result_set", "filtered", "output")


@dataclass
class Result:
    records: DataFrame
    drilldowns: dict[str, DataFrame] = field(default_factory=dict)
    slices: dict[str, "Result"] = field(default_factory=dict)


@dataclass
class Window:
    """What a registered window function gets besides its arguments."""

    group_keys: list[str]
    sort_keys: list[str]
    tie: list[str]


class _State:
    """The records while a select goes on: df, and what it may ask."""

    def __init__(self, df: DataFrame, context: Context, words=()):
        self.df, self.context, self.words = df, context, list(words)

    def tree(self, said):
        """The tree of an expression, whatever it asks of other tables joined to df."""
        self.df, tree = resolve(self.df, S.parse_script(said) if isinstance(said, str) else said, self.context)
        return tree

    @property
    def compiler(self) -> Compiler:
        c = self.context.compiler(self.df)
        c.keywords = self.words
        return c

    def value(self, said) -> Column:
        tree = self.tree(said)
        return self.compiler.value(tree)

    def column(self, spec: dict) -> Column:
        """A staged column; flags: COLUMN_VECTOR makes an array of a value that isn't one."""
        value = spec["value"]
        if isinstance(value, Column):
            return value
        tree = S.parse_script(value)
        group, sort = S.split(spec.get("window_group_keys")), S.split(spec.get("window_sort_keys"))
        own = extensions.find("window_function", tree.name) if isinstance(tree, S.Call) else None
        if own or isinstance(tree, S.Call) and tree.name in windows.BY_NAME:
            tie = S.split(spec.get("tie")) or ([self.context.key] if self.context.key else [])
            tree = self.tree(tree)
            if own:
                return own(Window(group, sort, tie), *map(self.compiler.value, tree.args))
            make = windows.BY_NAME[tree.name]
            if tree.name == "window_sum":
                return make(self.compiler.value(tree.args[0]), group, sort, tie)
            return make(group, sort) if tree.name == "window_rank" else make(group, sort, tie)
        c = self.value(tree)
        vector = "COLUMN_VECTOR" in str(spec.get("flags", "")) and self.compiler.kind(c).typeName() != "array"
        c = F.array(c) if vector else c
        return c.cast(spec["type"] if not vector or "array" in spec["type"] else f"array<{spec['type']}>") if spec.get("type") else c

    def stage(self, columns: dict[str, dict], name: str) -> None:
        """The columns of a stage, each after those that it uses."""
        todo = {k: v for k, v in columns.items() if v.get("stage", "filtered") == name}
        needs = {}
        for k, v in todo.items():
            used = set() if isinstance(v["value"], Column) else S.paths(S.parse_script(v["value"]))
            used |= {x.lstrip("-") for key in ("window_group_keys", "window_sort_keys") for x in S.split(v.get(key))}
            needs[k] = used & set(todo) - {k}
        while todo:
            ready = [k for k in todo if not needs[k] & set(todo)]
            if not ready:
                raise S.SyntaxProblem(f"columns that need each other: {', '.join(todo)}")
            for k in ready:
                c = self.column(todo.pop(k))
                self.df = self.df.withColumn(k, c)

    def assign(self, tree) -> None:
        """'_score = expr', '_score += expr', 'x++', several after commas."""
        if isinstance(tree, S.Binary) and tree.op == ",":
            self.assign(tree.left)
            self.assign(tree.right)
            return
        if not isinstance(tree, S.Assign):
            raise S.SyntaxProblem("a scorer assigns to a column")
        new = self.value(tree.x if tree.op == "=" else S.Binary(tree.op[:-1], S.Name(tree.target), tree.x))
        self.df = self.df.withColumn(tree.target, new)


def page(df: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """offset and limit; a negative offset counts from the end, and what it overshoots the start is taken off the limit."""
    if offset < 0:
        offset += df.count()
        if offset < 0:
            limit, offset = (None if limit is None or limit < 0 else max(limit + offset, 0)), 0
    df = df.offset(offset) if offset else df
    return df if limit is None or limit < 0 else df.limit(limit)


def last_page(df: DataFrame, order: list[Column], backward: list[Column], n: int, limit: int | None) -> DataFrame:
    """The page that begins at the n-th record from the end, without counting the records.

    Only the last n are gathered; where there are fewer, the page is as much shorter as it begins late.
    """
    from pyspark.sql import Window as W

    tail = df.orderBy(*backward).limit(n)
    if limit is not None and limit >= 0:
        tail = tail.withColumn("__from_end", F.row_number().over(W.orderBy(*backward))).where(F.col("__from_end") > n - limit).drop("__from_end")
    return tail.orderBy(*order)


def _looser(text: str) -> list[str]:
    """A query and what it escalates to: its words unsplit, then their beginnings."""
    words = text.split()
    plain = all(w.replace("_", "").isalnum() for w in words)
    return [text, " ".join(f"{w}*" for w in words)] if plain and words else [text]


def select(
    df: DataFrame | Table, *, filter: str | None = None, query: str | None = None, match_columns: str | None = None, query_flags=S.DEFAULT_FLAGS, query_expander=None,
    columns: dict[str, dict] | None = None, post_filter: str | None = None, scorer: str | None = None, adjuster: str | None = None, sort_keys=None, output_columns=None,
    offset: int = 0, limit: int | None = None, drilldowns: dict[str, dict] | None = None, slices: dict[str, dict] | None = None, key: str | None = None, tables=None,
    references: dict[str, str] | None = None, match_escalation: str = "auto", match_escalation_threshold: int | None = None,
    load_table: str | None = None, load_columns: str | None = None, load_values: str | None = None, database=None,
) -> Result:
    """The records of df that satisfy the filter and the query, with _score; key: its unique column, which settles ties.

    In order: initial columns, filter and query, result_set and filtered columns, post_filter, scorer, adjuster,
    facets and slices of that set, sorting, offset and limit, output columns.

    tables: DataFrames or Tables by name; references: which table a column of df refers to, so that ref.column can
    be named anywhere. match_escalation: with yes, or with auto and a threshold, a query that has no more hits than
    the threshold is asked again by the beginnings of its words. load_table: the records are also loaded, as
    load_columns, from load_values, into that table of the database.
    """
    if isinstance(df, Table):
        df, key, references = df.df, key or df.key, {**df.references, **(references or {})}
    columns, context = columns or {}, Context(tables or {}, key, references or {})
    if key and "_id" in str((filter, query, sort_keys, output_columns, [c.get("value") for c in columns.values() if isinstance(c.get("value"), str)])) and "_id" not in df.columns:
        df = with_id(df, key)
    own = list(df.columns)
    at = _State(df, context)
    at.stage(columns, "initial")
    trees = [at.tree(filter)] if filter else []
    if query is not None:
        said = [query]
        if match_escalation == "yes" or match_escalation == "auto" and match_escalation_threshold is not None:
            said = _looser(query)
        asked = [at.tree(S.parse_query(q, match_columns, query_flags, query_expander)) for q in said]
        tree = asked[0]
        if len(asked) > 1:
            under = reduce(lambda a, b: a & b, map(at.compiler.truth, trees), F.lit(True))
            hits = at.df.where(under & at.compiler.truth(tree)).limit((match_escalation_threshold or 0) + 1).count()
            tree = asked[1] if match_escalation == "yes" or hits <= match_escalation_threshold else tree
        trees.append(tree)
    at.words = keywords(*trees)
    score = reduce(lambda a, b: a + b, [at.compiler.score(t) for t in trees], F.lit(0.0)) if trees else F.lit(1.0)
    wants = "_score" in str((sort_keys, output_columns, scorer, post_filter, load_values)) or adjuster
    conditions = [at.compiler.holds(t) for t in trees]
    for c in conditions:
        at.df = at.df.where(c)
    at.df = at.df.withColumn("_score", score) if wants else at.df
    for stage in ("result_set", "filtered"):
        at.stage(columns, stage)
    if post_filter:
        tree = at.tree(post_filter)
        at.df = at.df.where(at.compiler.holds(tree))
    if scorer:
        at.assign(S.parse_script(scorer))
    if adjuster:
        more = at.tree(adjuster)
        at.df = at.df.withColumn("_score", F.col("_score") + at.compiler.score(more))
    at.df = attach(at.df, said_paths(sort_keys, output_columns, load_values, drilldowns), context.references, context.tables, key)
    out = Result(at.df)
    for name, spec in (drilldowns or {}).items():
        spec, base = dict(spec), at.df
        if "table" in spec:
            base = out.drilldowns[spec.pop("table")]
        only = S.split(spec.get("keys"))
        if len(only) == 1 and only[0] in context.references and "key_table" not in spec:
            spec["key_table"] = table_of(context.tables[context.references[only[0]]])
        if "key_table" in spec and not _needs_table(spec, only[0]):
            spec.pop("key_table")
        out.drilldowns[name] = facets.drilldown(base, **spec)
    for name, spec in (slices or {}).items():
        out.slices[name] = select(at.df, key=key, tables=tables, references=references, **spec)
    if sort_keys or offset or limit is not None:
        for k in S.split(sort_keys):
            at.tree(k.lstrip("-+"))
        tie = [key] if key else []
        order = facets.sort_columns(sort_keys, tie, at.compiler)
        if offset < 0 and order:
            turned = [k[1:] if k[0] == "-" else f"-{k.lstrip('+')}" for k in S.split(sort_keys)]
            at.df = last_page(at.df, order, facets.sort_columns([*turned, *[f"-{t}" for t in tie if t not in {k.lstrip("-+") for k in turned}]], (), at.compiler), -offset, limit)
            offset, limit = 0, None
        else:
            at.df = at.df.orderBy(*order)
    at.df = page(at.df, offset, limit)
    at.stage(columns, "output")
    visible = [c for c in at.df.columns if c in own or c in columns or c == "_score" or scorer and not c.startswith("__") and "." not in c]
    if load_table:
        _load(at, database, load_table, load_columns, load_values)
    if output_columns:
        chosen = []
        for x in S.split(output_columns):
            if x == "*":
                chosen += map(quoted, visible)
            elif x in at.df.columns:
                chosen.append(quoted(x))
            else:
                chosen.append(at.value(x).alias(x))
        at.df = at.df.select(*chosen)
    elif len(visible) < len(at.df.columns):
        at.df = at.df.select(*map(quoted, visible))
    out.records = at.df
    return out


def _needs_table(spec: dict, key: str) -> bool:
    """Whether a facet names more than its key and what it counts."""
    said = " ".join(str(spec.get(k) or "") for k in ("columns", "filter", "adjuster", "sort_keys", "output_columns"))
    return any(c != spec["key_table"].key and c in said for c in spec["key_table"].df.columns)


def _load(at: _State, database, table: str, columns: str | None, values: str | None) -> None:
    """The select's records into a table of the database, by the values for its columns."""
    to = S.split(columns) or at.df.columns
    said = S.split(values) or to
    rows = at.df.select(*[at.value(v).alias(c) for c, v in zip(to, said)])
    database.load(table, rows)


def range_filter(df: DataFrame | Table, column: str, least=None, most=None, least_border: str = "include", most_border: str = "include", order: str = "ascending", offset: int = 0, limit: int | None = 10, **parameters) -> DataFrame:
    """The records whose column lies in a range, in its order, a page of them; further parameters as of select()."""
    base = df.df if isinstance(df, Table) else df
    c, kept = quoted(column), base
    if least is not None:
        kept = kept.where(c >= F.lit(least) if least_border == "include" else c > F.lit(least))
    if most is not None:
        kept = kept.where(c <= F.lit(most) if most_border == "include" else c < F.lit(most))
    kept = kept.where(c.isNotNull())
    kept = Table(kept, df.key, df.references) if isinstance(df, Table) else kept
    return select(kept, sort_keys=column if order == "ascending" else f"-{column}", offset=offset, limit=limit, **parameters).records


def escalate(df: DataFrame, conditions: list[str], thresholds: list[int], **context) -> DataFrame:
    """The records of the first condition, and of the next ones as long as no more than the threshold are found.

    All counts are made in one pass.
    """
    asked = Context(context.get("tables") or {}, context.get("key"))
    args = [S.Lit(conditions[0])] + [S.Lit(x) for pair in zip(thresholds, conditions[1:]) for x in pair]
    df, tree = resolve(df, S.Call("escalate", tuple(args)), asked)
    return df.where(asked.compiler(df).truth(tree))
