"""Tables by name, and the commands on them: schema, loading, changing, selecting and registered commands.

A database is a mapping from names to DataFrames with their keys and references; a command that changes a
table puts another plan under its name, so nothing is written until a result is. There are no locks to take:
a plan that was built keeps what it read. Results can be kept by their parameters; a change of any table
drops what was kept.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import extensions
from ..operators import select as Q
from ..operators.expression import quoted
from ..operators.tables import Table, table_of
from ..plans import syntax as S
from . import io


@dataclass
class Loaded:
    """What load() did: ids are the keys of the loaded records, errors (key, column, value) what couldn't be read as the column's type."""

    records: DataFrame
    ids: DataFrame | None
    errors: DataFrame | None

    def count(self) -> int:
        return self.records.count()


class Database:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Table] | None = None, cache_limit: int = 100):
        self.spark, self.tables = spark, {k: table_of(v) for k, v in (tables or {}).items()}
        self._kept: OrderedDict[str, Q.Result] = OrderedDict()
        self._most = cache_limit

    def __getitem__(self, name: str) -> Table:
        if name not in self.tables:
            raise S.SyntaxProblem(f"no table {name}")
        return self.tables[name]

    def _put(self, name: str, table: Table) -> None:
        self.tables[name] = table
        self.clear()

    # -- tables ------------------------------------------------------------------------------------
    def table_create(self, name: str, schema: str | T.StructType, key: str | None = None, references: dict[str, str] | None = None) -> None:
        if name in self.tables:
            raise S.SyntaxProblem(f"{name} is there already")
        self._put(name, Table(self.spark.createDataFrame([], schema), key, dict(references or {})))

    def table_create_similar(self, name: str, like: str) -> None:
        old = self[like]
        self._put(name, Table(io.create_similar(old.df), old.key, dict(old.references)))

    def table_copy(self, source: str, target: str) -> None:
        """The records of source into target, by key where target has one."""
        if target not in self.tables:
            self.table_create_similar(target, source)
        self.load(target, self[source].df)

    def table_rename(self, name: str, to: str) -> None:
        """References to the table follow it."""
        table = self[name]
        if to in self.tables:
            raise S.SyntaxProblem(f"{to} is there already")
        del self.tables[name]
        self._put(to, table)
        for k, t in self.tables.items():
            self.tables[k] = replace(t, references={c: to if r == name else r for c, r in t.references.items()})

    def table_remove(self, name: str, dependent: bool = False) -> None:
        """Refused while other tables refer to it, unless dependent, which removes their columns too."""
        self[name]
        refer = {k: [c for c, r in t.references.items() if r == name] for k, t in self.tables.items() if k != name}
        if any(refer.values()) and not dependent:
            raise S.SyntaxProblem(f"{name} is referred to by {', '.join(f'{k}.{c}' for k, v in refer.items() for c in v)}")
        for k, columns in refer.items():
            for c in columns:
                self.column_remove(k, c)
        del self.tables[name]
        self.clear()

    def truncate(self, name: str) -> None:
        self._put(name, replace(self[name], df=io.create_similar(self[name].df)))

    def table_list(self) -> DataFrame:
        rows = [(i + 1, k, t.key, len(t.df.columns)) for i, (k, t) in enumerate(sorted(self.tables.items()))]
        return self.spark.createDataFrame(rows, "id long, name string, key string, columns long")

    # -- columns -----------------------------------------------------------------------------------
    def column_create(self, table: str, name: str, kind: str, value: str | None = None, reference: str | None = None) -> None:
        """A new column, of an expression's values or unset."""
        old = self[table]
        if name in old.df.columns:
            raise S.SyntaxProblem(f"{table}.{name} is there already")
        df = old.df.withColumn(name, F.lit(None).cast(kind)) if value is None else io.each(old.df, **{name: value}).withColumn(name, quoted(name).cast(kind))
        self._put(table, replace(old, df=df, references=old.references | ({name: reference} if reference else {})))

    def column_create_similar(self, table: str, name: str, like_table: str, like: str) -> None:
        self.column_create(table, name, self[like_table].df.schema[like].dataType.simpleString(), reference=self[like_table].references.get(like))

    def column_copy(self, from_table: str, from_name: str, to_table: str, to_name: str) -> None:
        """A column's values to the records of the same key."""
        a, b = self[from_table], self[to_table]
        kind = b.df.schema[to_name].dataType if to_name in b.df.columns else a.df.schema[from_name].dataType
        df = io.column_copy(b.df, a.df, b.key, a.key, from_name, to_name) if from_table != to_table else b.df.withColumn(to_name, quoted(from_name))
        self._put(to_table, replace(b, df=df.withColumn(to_name, quoted(to_name).cast(kind))))

    def column_rename(self, table: str, name: str, to: str) -> None:
        old = self[table]
        references = {to if c == name else c: r for c, r in old.references.items()}
        self._put(table, Table(old.df.withColumnRenamed(name, to), to if old.key == name else old.key, references))

    def column_remove(self, table: str, name: str) -> None:
        old = self[table]
        if name == old.key:
            raise S.SyntaxProblem("the key can't be removed")
        self._put(table, replace(old, df=old.df.drop(name), references={c: r for c, r in old.references.items() if c != name}))

    def column_list(self, table: str) -> DataFrame:
        t = self[table]
        rows = [(i + 1, f.name, f.dataType.simpleString(), "key" if f.name == t.key else "reference" if f.name in t.references else "value", t.references.get(f.name)) for i, f in enumerate(t.df.schema)]
        return self.spark.createDataFrame(rows, "id long, name string, type string, kind string, refers_to string")

    def schema(self) -> dict:
        """All tables and columns as one nested dict."""
        return {k: {"key": t.key, "columns": {f.name: {"type": f.dataType.simpleString(), "refers_to": t.references.get(f.name)} for f in t.df.schema}} for k, t in sorted(self.tables.items())}

    def object_exist(self, name: str) -> bool:
        table, _, column = name.partition(".")
        return table in self.tables and (not column or column in self[table].df.columns)

    def object_list(self) -> dict:
        return {**{k: "table" for k in self.tables}, **{f"{k}.{c}": "column" for k, t in self.tables.items() for c in t.df.columns}}

    # -- records -----------------------------------------------------------------------------------
    def load(self, table: str, values, columns: str | None = None, if_exists: str | None = None, each: dict[str, str] | None = None, output_ids: bool = False, output_errors: bool = False, lock_table: bool = False) -> Loaded:
        """Records into a table: DataFrame, dicts, or lists whose first row (or columns) names the fields.

        By key the new record's values win, of several the last; what the record doesn't have stays. A value that
        can't be read as its column's type is unset, and an error. if_exists: a condition on the old record
        under which it is overwritten. each: expressions for columns of the records that are loaded. lock_table
        changes nothing: a reader keeps the plan it has.
        """
        old = self[table]
        new = values if isinstance(values, DataFrame) else io.load_rows(self.spark, values, S.split(columns) or None)
        new = io.each(new, **each) if each else new
        kinds = {f.name: f.dataType for f in old.df.schema}
        known = [c for c in new.columns if c in kinds]
        cast = new.select(*[quoted(c).try_cast(kinds[c]).alias(c) for c in known], F.monotonically_increasing_id().alias("__at"))
        errors = None
        if output_errors:
            bad = F.filter(F.array(*[F.when(quoted(c).isNotNull() & quoted(c).try_cast(kinds[c]).isNull(), F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value"))) for c in known]), lambda x: x.isNotNull())
            who = quoted(old.key).cast("string") if old.key in known else F.lit(None).cast("string")
            errors = new.select(who.alias("key"), F.explode(bad).alias("e")).select("key", "e.column", "e.value")
        if old.key and old.key in known:
            cast = cast.where(quoted(old.key).isNotNull())
            self._put(table, replace(old, df=io.upsert(old.df, cast, old.key, "__at", if_exists)))
        else:
            self._put(table, replace(old, df=old.df.unionByName(cast.drop("__at"), allowMissingColumns=True)))
        return Loaded(cast.drop("__at"), cast.select(quoted(old.key)) if output_ids and old.key in known else None, errors)

    def delete(self, table: str, key=None, filter: str | None = None, limit: int | None = None) -> None:
        """The record of a key, or those that satisfy the filter (by key, the first so many)."""
        old = self[table]
        if key is not None:
            self._put(table, replace(old, df=old.df.where(~quoted(old.key).eqNullSafe(F.lit(key)))))
            return
        gone = Q.select(old, filter=filter, tables=self.tables, sort_keys=old.key if limit is not None else None, limit=limit).records
        self._put(table, replace(old, df=old.df.join(gone.select(quoted(old.key)), old.key, "left_anti").select(*old.df.columns) if old.key else io.delete(old.df, filter)))

    def select(self, table: str, cache: str = "no", **parameters) -> Q.Result:
        """Q.select over a table; with cache="yes" the result is kept under its parameters until a table changes."""
        ask = lambda: Q.select(self[table], tables=self.tables, database=self, **parameters)
        if cache != "yes" or parameters.get("load_table"):
            return ask()
        name = f"{table} {json.dumps(parameters, sort_keys=True, default=str)}"
        if name in self._kept:
            self._kept.move_to_end(name)
        else:
            got = ask()
            got.records = got.records.persist(StorageLevel.MEMORY_AND_DISK)
            self._kept[name] = got
            self._trim()
        return self._kept[name]

    def cache_limit(self, most: int | None = None) -> int:
        """How many results are kept at most; a new limit drops those that were asked longest ago."""
        before, self._most = self._most, self._most if most is None else most
        self._trim()
        return before

    def _trim(self) -> None:
        while len(self._kept) > self._most:
            self._kept.popitem(last=False)[1].records.unpersist()

    def clear(self) -> None:
        while self._kept:
            self._kept.popitem()[1].records.unpersist()

    def dump(self, path: str) -> str:
        return io.dump({k: t.df for k, t in self.tables.items()}, path)

    def command(self, name: str, /, **arguments):
        """A registered command, or one of this class by its name."""
        if own := extensions.find("command", name):
            return own(self, **arguments)
        if name.startswith("_") or not callable(method := getattr(self, name, None)):
            raise S.SyntaxProblem(f"no command {name}")
        return method(**arguments)
