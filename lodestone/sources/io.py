"""Loading, upserting, copying and writing records."""

from __future__ import annotations

import re
import struct
from datetime import datetime, timezone
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.expression import DEFAULTS, Compiler, quoted
from ..plans import syntax as S


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fill_defaults(df: DataFrame) -> DataFrame:
    """Unset values as the type's default: 0, false or the empty string."""
    return df.select(*[F.coalesce(f.name, F.lit(DEFAULTS[type(f.dataType)])).alias(f.name) if type(f.dataType) in DEFAULTS else F.col(f.name) for f in df.schema])


def load_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Records, an object to the line or in one array; what can't be read is in _errors when the schema names it."""
    r = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_errors")
    return (r.schema(schema) if schema else r).json(path)


def load_rows(spark: SparkSession, rows: list, columns: list[str] | None = None, schema=None) -> DataFrame:
    """Objects, or arrays whose first row (or columns) names the fields."""
    if rows and isinstance(rows[0], dict):
        return spark.createDataFrame(rows, schema)
    head, body = (columns, rows) if columns else (rows[0], rows[1:])
    return spark.createDataFrame([tuple(r) for r in body], schema or list(head))


def load_tsv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read.option("sep", "\t").option("header", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def load_arrow(spark: SparkSession, data) -> DataFrame:
    """An Arrow table."""
    return spark.createDataFrame(data)


def each(df: DataFrame, **columns: str | Column) -> DataFrame:
    """An expression for each record that is loaded."""
    return df.withColumns({k: v if isinstance(v, Column) else Compiler(df).value(S.parse_script(v)) for k, v in columns.items()})


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, if_exists: str | None = None) -> DataFrame:
    """old with the records of new by key: new values win, unless if_exists, a condition on the old record, is false.

    Of several new records of one key that with the greatest order column counts. Columns that new lacks stay.
    """
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    fields = [c for c in last.columns if c != key]
    renamed = last.select(F.col(key).alias("_key_new"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    both = old.withColumn("_old", F.lit(True)).join(renamed, F.col(key) == F.col("_key_new"), "full")
    over = F.col("_key_new").isNotNull()
    if if_exists:
        over = over & (F.col("_old").isNull() | Compiler(both).truth(S.parse_script(if_exists)))
    return both.select(F.coalesce(key, "_key_new").alias(key), *[F.when(over, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns if c != key])


def delete(df: DataFrame, condition: str) -> DataFrame:
    """df without the records that satisfy the condition."""
    return df.where(~Compiler(df).truth(S.parse_script(condition)))


def column_copy(target: DataFrame, source: DataFrame, key: str, source_key: str, column: str, to: str) -> DataFrame:
    """target with a column of the records of source that have the same key."""
    got = source.select(F.col(source_key).alias("_k"), F.col(column).alias("_v"))
    return target.drop(to).join(got, F.col(key) == F.col("_k"), "left").withColumn(to, F.col("_v")).drop("_k", "_v")


def create_similar(df: DataFrame) -> DataFrame:
    """An empty table of df's columns."""
    return df.sparkSession.createDataFrame([], df.schema)


def extract_html(df: DataFrame, column: str) -> DataFrame:
    """The visible text of a column of HTML."""
    x = F.regexp_replace(column, r"(?is)<(script|style)\b.*?</\1>", " ")
    return df.withColumn(column, F.trim(F.regexp_replace(X.normalize_html(F.regexp_replace(x, "(?i)<(br|/p|/div|/h[1-6]|/li)[^>]*>", " ")), r"\s+", " ")))


def extract_json(df: DataFrame, column: str) -> DataFrame:
    """The text in a column of JSON: all strings and numbers that are values, in their order, parted by spaces.

    Keys are taken as well, with their colons, and dropped, so that nothing begins at a quote that ends one.
    """
    token = r'("(?:[^"\\]|\\.)*"(?:\s*:)?|-?\d[\d.eE+-]*)'
    values = F.filter(F.regexp_extract_all(column, F.lit(token), F.lit(1)), lambda x: ~x.endswith(":"))
    blank = F.transform(values, lambda x: F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), r"\\[nrtbf]", " "))
    plain = F.transform(blank, lambda x: F.trim(F.regexp_replace(x, r'\\(["\\/])', "$1")))
    return df.withColumn(column, F.array_join(F.filter(plain, lambda x: x != ""), " "))


def to_xml(df: DataFrame) -> DataFrame:
    """Each record as a HIT with its FIELDs; arrays as VECTORs of ELEMENTs, what is unset as an empty field."""

    def field(f: T.StructField) -> Column:
        value = lambda c: X.escape_html(c.cast("string"))
        name = f.name.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
        if isinstance(f.dataType, T.ArrayType):
            parts = F.array_join(F.transform(quoted(f.name), lambda e: F.concat(F.lit("<ELEMENT>"), F.coalesce(value(e), F.lit("")), F.lit("</ELEMENT>"))), "")
            return F.concat(F.lit(f'<VECTOR NAME="{name}">'), F.coalesce(parts, F.lit("")), F.lit("</VECTOR>"))
        x = F.to_json(quoted(f.name)) if isinstance(f.dataType, (T.StructType, T.MapType)) else quoted(f.name)
        return F.concat(F.lit(f'<FIELD NAME="{name}">'), F.coalesce(value(x), F.lit("")), F.lit("</FIELD>"))

    return df.select(F.concat(F.lit("<HIT>"), *map(field, df.schema), F.lit("</HIT>")).alias("value"))


def pack_message(x) -> bytes:
    """A value in MessagePack."""
    if x is None or isinstance(x, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[x]
    if isinstance(x, int):
        if 0 <= x < 128 or -32 <= x < 0:
            return struct.pack("b", x) if x < 0 else bytes([x])
        for lead, form, low, high in ((0xCC, ">B", 0, 1 << 8), (0xCD, ">H", 0, 1 << 16), (0xCE, ">I", 0, 1 << 32), (0xCF, ">Q", 0, 1 << 64), (0xD0, ">b", -(1 << 7), 0), (0xD1, ">h", -(1 << 15), 0), (0xD2, ">i", -(1 << 31), 0), (0xD3, ">q", -(1 << 63), 0)):
            if low <= x < high:
                return bytes([lead]) + struct.pack(form, x)
        return pack_message(str(x))
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, (bytes, bytearray)):
        return _sized(len(x), None, 0, (0xC4, 0xC5, 0xC6)) + bytes(x)
    if isinstance(x, str):
        raw = x.encode()
        return _sized(len(raw), 0xA0, 32, (0xD9, 0xDA, 0xDB)) + raw
    if isinstance(x, dict):
        return _sized(len(x), 0x80, 16, (None, 0xDE, 0xDF)) + b"".join(pack_message(y) for kv in x.items() for y in kv)
    if isinstance(x, (list, tuple)):
        return _sized(len(x), 0x90, 16, (None, 0xDC, 0xDD)) + b"".join(map(pack_message, x))
    if isinstance(x, datetime):
        return pack_message(x.timestamp() if x.tzinfo else x.replace(tzinfo=timezone.utc).timestamp())
    return pack_message(float(x) if isinstance(x, Decimal) else str(x))


def _sized(n: int, short: int | None, below: int, leads: tuple) -> bytes:
    if short is not None and n < below:
        return bytes([short | n])
    for lead, form, most in zip(leads, (">B", ">H", ">I"), (1 << 8, 1 << 16, 1 << 32)):
        if lead is not None and n < most:
            return bytes([lead]) + struct.pack(form, n)
    raise ValueError("too long for MessagePack")


def to_message_pack(df: DataFrame) -> DataFrame:
    """Each record as a MessagePack array of its values, by Arrow batches; times are seconds."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pack_message(list(row.values())) for row in b.to_pylist()], pa.binary())], ["value"])

    return df.mapInArrow(run, "value binary")


def table_expander(df: DataFrame, key: str, column: str):
    """A query expander from a table: a word's synonyms are those of the record with that key, itself not added.

    Each word of a query is looked up once, by its key.
    """
    kind = df.schema[column].dataType

    def expand(word: str) -> list[str] | None:
        rows = df.where(X.normalize(quoted(key)) == X.fold(word)).select(quoted(column)).collect()  # one row: key is unique
        found = [x for r in rows for x in (r[0] if isinstance(kind, T.ArrayType) else [r[0]]) if x]
        return found or None

    return expand


def tsv_expander(spark: SparkSession, path: str):
    """A query expander from lines of a word and its synonyms, parted by tabs; # begins a comment."""
    lines = [r[0].split("\t") for r in spark.read.text(path).where("value <> '' and value not like '#%'").collect()]  # a list of synonyms, kept by hand
    table: dict[str, list[str]] = {}
    for word, *more in lines:
        table.setdefault(X.fold(word), []).extend(x for x in more if x)
    return lambda word: table.get(X.fold(word)) or None


def query_expand(expander, query: str) -> str:
    """A query with every word that has synonyms as their alternatives, in brackets."""
    said = lambda m: m[0] if m[0] in ("OR",) or not (more := expander(m[0])) else "(" + " OR ".join(f"({x})" for x in more) + ")"
    return re.sub(r"[^\s()\"]+", said, query)


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def to_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def to_arrow(df: DataFrame):
    """A small result as an Arrow table, on the driver."""
    return df.toArrow()


def ddl(name: str, df: DataFrame) -> str:
    return f"CREATE TABLE {name} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}) USING parquet"


def dump(tables: dict[str, DataFrame], path: str) -> str:
    """Each table as JSON lines under path; returns the statements that make the tables again."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    return ";\n".join(ddl(n, df) for n, df in tables.items())


def restore(spark: SparkSession, path: str, name: str, like: T.StructType) -> DataFrame:
    return spark.read.schema(like).json(f"{path}/{name}")
