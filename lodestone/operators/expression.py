"""Syntax trees to Columns: conditions, values and scores of records.

A condition is never null: what is unset counts as false, as does a null on either side of a comparison.
Arrays satisfy a comparison where an element does.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import extensions
from ..functions import registry, text as X
from ..plans import syntax as S

_COMPARE = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}
_BITS = {"&": "bitwiseAND", "|": "bitwiseOR", "^": "bitwiseXOR"}
_SHIFT = {"<<": "shiftleft", ">>": "shiftright", ">>>": "shiftrightunsigned"}
_ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}
_TEXT = {"@", "@^", "@$", "@~", "@^word"}
_NEAR = {"*N", "*NP", "*ONP", "*NPP", "*ONPP"}
#: What an unset value of a type reads as.
DEFAULTS = {T.StringType: "", T.BooleanType: False, T.ByteType: 0, T.ShortType: 0, T.IntegerType: 0, T.LongType: 0, T.FloatType: 0.0, T.DoubleType: 0.0}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def java_pattern(pattern: str) -> str:
    r"""A regular expression of the script language as Java takes it: \h is a hex digit, \A and \z stay, named groups stay."""
    if re.search(r"\\[kgKRX]|\(\?~", pattern):
        raise S.SyntaxProblem(f"not supported in a pattern: {pattern!r}")
    return pattern.replace(r"\h", "[0-9a-fA-F]").replace(r"\H", "[^0-9a-fA-F]")


class Compiler:
    """Columns for trees over df; tables: the DataFrames that record literals name; keywords: those of the conditions, for highlighting."""

    def __init__(self, df: DataFrame, tables: dict[str, DataFrame] | None = None, key: str | None = None, keywords: list[str] | None = None):
        self.df, self.tables, self.key, self.keywords = df, tables or {}, key, keywords or []
        self.kinds = {f.name: f.dataType for f in df.schema}
        self._known: dict[str, T.DataType] = {}

    def kind(self, c: Column) -> T.DataType:
        said = str(c)
        if said not in self._known:
            name = said.removeprefix("Column<'").removesuffix("'>").strip("`")
            self._known[said] = self.kinds[name] if name in self.kinds else self.df.select(c.alias("_")).schema[0].dataType
        return self._known[said]

    # -- values --------------------------------------------------------------------------------
    def value(self, node) -> Column:
        if isinstance(node, S.Lit):
            return F.lit(node.value)
        if isinstance(node, S.Name):
            path = self.key if node.path == "_key" and self.key and "_key" not in self.kinds else node.path
            return quoted(path) if path in self.kinds else F.col(path)
        if isinstance(node, S.Listing):
            return F.array(*map(self.value, node.items))
        if isinstance(node, S.Element):
            return F.get(self.value(node.x), self.value(node.index))
        if isinstance(node, S.Record):
            return self.record(node)
        if isinstance(node, S.Call):
            return registry.call(self, node.name, node.args)
        if isinstance(node, S.Unary):
            if node.op == "!":
                return ~self.truth(node.x)
            x = self.value(node.x)
            return -x if node.op == "-" else F.bitwise_not(x)
        if isinstance(node, S.Binary):
            return self.binary(node)
        raise S.SyntaxProblem(f"not a value: {node}")

    def record(self, node: S.Record) -> Column:
        """Table["key"].path: one record of another table, looked up once."""
        t = self.tables[node.table]
        row = t.where(F.col(t.columns[0]) == F.lit(node.key)).select(t.columns[0] if node.path == "_key" else node.path).first()
        return F.lit(row[0] if row else None)

    def binary(self, node: S.Binary) -> Column:
        op = node.op
        if op == ",":
            return self.value(node.right)
        if op in _COMPARE or op in _TEXT or op in _NEAR or op in ("*Q", "*S", "*T", "&!", "*>", "*<", "*~"):
            return self.truth(node)
        if op in ("&&", "||"):
            a, b = self.value(node.left), self.value(node.right)
            if isinstance(self.kind(a), T.BooleanType) and isinstance(self.kind(b), T.BooleanType):
                return self.truth(node)
            t = self.truth(node.left)
            return F.when(t, a).otherwise(b) if op == "||" else F.when(t, b).otherwise(a)
        a, b = self.value(node.left), self.value(node.right)
        if op in _ARITHMETIC:
            if op == "+" and isinstance(self.kind(a), T.StringType):
                return F.concat(a, b.cast("string"))
            return _ARITHMETIC[op](a, b)
        if op in ("/", "%"):
            whole = isinstance(self.kind(a), _WHOLE) and isinstance(self.kind(b), _WHOLE)
            if op == "%":
                return F.when(b != 0, a % b)
            return F.when(b != 0, F.call_function("div", a.cast("long"), b.cast("long"))) if whole else F.try_divide(a, b)
        if op in _BITS:
            return getattr(a, _BITS[op])(b)
        if op in _SHIFT:
            return F.call_function(_SHIFT[op], a, b.cast("int"))
        raise S.SyntaxProblem(f"no operator {op}")

    # -- conditions ----------------------------------------------------------------------------
    def truth(self, node) -> Column:
        if isinstance(node, S.Binary):
            op = node.op
            if op == "&&":
                return self.truth(node.left) & self.truth(node.right)
            if op == "||":
                return self.truth(node.left) | self.truth(node.right)
            if op == "&!":
                return self.truth(node.left) & ~self.truth(node.right)
            if op in ("*>", "*<", "*~"):
                return self.truth(node.left)  # a score only
            if op in _COMPARE:
                return F.coalesce(self.compare(op, node.left, node.right), F.lit(False))
            if op in _TEXT or (op[0] == "*" and op != "*"):
                return F.coalesce(self.search(node), F.lit(False))
        if isinstance(node, S.Unary) and node.op == "!":
            return ~self.truth(node.x)
        if isinstance(node, S.Call) and node.name == "weighted":
            return self.truth(node.args[0])
        if isinstance(node, S.Call) and (node.name.startswith("scorer_") or extensions.find("scorer", node.name)):
            return self.truth(S.Binary("@", node.args[0], node.args[1]))
        x = self.value(node)
        kind = self.kind(x)
        if isinstance(kind, T.BooleanType):
            return F.coalesce(x, F.lit(False))
        if isinstance(kind, T.NullType):
            return F.lit(False)
        if isinstance(kind, T.StringType):
            return F.coalesce(x != "", F.lit(False))
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.size(x) > 0, F.lit(False))
        if isinstance(kind, T.NumericType):
            return F.coalesce(x != 0, F.lit(False))
        return x.isNotNull()

    def holds(self, node) -> Column:
        """truth() for a filter alone, where null is as good as false: what the scan understands reaches it."""
        if isinstance(node, S.Binary):
            op = node.op
            if op == "&&":
                return self.holds(node.left) & self.holds(node.right)
            if op == "||":
                return self.holds(node.left) | self.holds(node.right)
            if op == "&!":
                return self.holds(node.left) & ~self.truth(node.right)
            if op in ("*>", "*<", "*~"):
                return self.holds(node.left)
            if op in _COMPARE:
                return self.compare(op, node.left, node.right)
            if op in _TEXT or (op[0] == "*" and op != "*"):
                return self.search(node)
        if isinstance(node, S.Call) and node.name == "weighted":
            return self.holds(node.args[0])
        if isinstance(node, S.Call) and not node.name.startswith("scorer_") and not extensions.find("scorer", node.name):
            x = self.value(node)
            if isinstance(self.kind(x), T.BooleanType):
                return x
        return self.truth(node)

    def compare(self, op: str, left, right) -> Column:
        a, b = self.value(left), self.value(right)
        if isinstance(self.kind(a), T.ArrayType) and not isinstance(self.kind(b), T.ArrayType):
            return F.exists(a, lambda x: _COMPARE[op](x, b))
        if op in ("==", "!=") and isinstance(right, S.Lit) and right.value is None:
            return a.isNull() if op == "==" else a.isNotNull()
        return self.with_defaults(op, (left, a), (right, b))

    def with_defaults(self, op: str, left, right) -> Column:
        """A comparison in which an unset value reads as its type's default.

        Against a literal that is told here already, so the comparison itself still reaches the scan.
        """
        (x, a), (y, b) = left, right
        if isinstance(x, S.Lit) and not isinstance(y, S.Lit):
            flip = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
            return self.with_defaults(flip.get(op, op), right, left)
        default = DEFAULTS.get(type(self.kind(a))) if not isinstance(x, S.Lit) else None
        if isinstance(y, S.Lit):
            try:
                holds = default is not None and y.value is not None and _COMPARE[op](default, type(default)(y.value) if isinstance(default, str) else y.value)
            except TypeError:
                holds = False
            said = _COMPARE[op](a, b)
            return said | a.isNull() if holds else said
        other = DEFAULTS.get(type(self.kind(b)))
        if default is not None and other is not None:
            a, b = F.coalesce(a, F.lit(default)), F.coalesce(b, F.lit(other))
        return _COMPARE[op](a, b)

    def search(self, node: S.Binary) -> Column:
        op, x = node.op, self.value(node.left)
        arg = node.right
        if op in _TEXT:
            said = arg.value if isinstance(arg, S.Lit) else None

            def one(c: Column) -> Column:
                if op == "@~":
                    return c.rlike(java_pattern(str(said)))
                if op == "@^":
                    return F.startswith(c, F.lit(said) if said is not None else self.value(arg))
                if op == "@$":
                    return F.endswith(c, F.lit(said) if said is not None else self.value(arg))
                if op == "@^word":
                    word = re.escape(X.fold(str(said)))
                    return X.normalize(c).rlike(f"{word}(?<!{X.IN_WORD}{word})")
                if said is not None:
                    return X.match(c, str(said))
                return F.contains(X.normalize(c), X.normalize(self.value(arg)))

            if isinstance(self.kind(x), T.ArrayType):
                return F.exists(x, (lambda e: X.normalize(e.cast("string")) == X.fold(str(said))) if op == "@" else one)
            return one(x.cast("string"))
        words = str(arg.value)
        if op in _NEAR:
            most, least = _intervals(node.options)
            choices = X.product(words) if op.endswith("PP") else [[X.words_of(p[1] or p[2]) for p in re.finditer(r'"([^"]*)"|(\S+)', words)]]
            return X.near_in(x, choices, most, least, op.startswith("*O"))
        if op == "*Q":
            return X.quorum(x, words.split()) >= int((node.options or ("1",))[0] or 1)
        if op == "*S":
            return similarity(X.tokenize(x), X.words_of(words)) >= int((node.options or ("1",))[0] or 1)
        if op == "*T":
            return F.contains(F.lit(X.fold(words)), X.normalize(x)) & (x != "")
        raise S.SyntaxProblem(f"no operator {op}")

    # -- scores --------------------------------------------------------------------------------
    def score(self, node) -> Column:
        """Matches add up over and and or; and-not keeps the left score; the adjusting operators add or take away."""
        if isinstance(node, S.Binary) and node.op[0] in "@*=" and isinstance(node.right, S.Binary) and node.right.op == "*":
            weight = node.right.right  # a @ "b" * 3
            return self.score(S.Binary(node.op, node.left, node.right.left, node.options)) * F.lit(float(weight.value))
        if isinstance(node, S.Binary):
            op = node.op
            if op in ("&&", "||", "+"):
                return self.score(node.left) + self.score(node.right)
            if op == "&!":
                return self.score(node.left)
            if op in ("*>", "*<", "*~"):
                sign = F.lit(1.0 if op == "*>" else -1.0 if op == "*<" else -0.5)
                return self.score(node.left) + sign * self.score(node.right)
            if op == "@" and isinstance(node.right, S.Lit):
                x = self.value(node.left)
                if isinstance(self.kind(x), T.ArrayType):
                    return F.size(F.filter(x, lambda e: X.normalize(e.cast("string")) == X.fold(str(node.right.value)))).cast("double")
                return X.occurrences(x.cast("string"), str(node.right.value)).cast("double")
            if op == "*Q":
                return F.when(self.truth(node), X.quorum(self.value(node.left), str(node.right.value).split())).otherwise(0).cast("double")
            if op == "*S":
                return similarity(X.tokenize(self.value(node.left)), X.words_of(str(node.right.value))).cast("double")
        if isinstance(node, S.Call):
            if node.name == "weighted":
                return self.score(node.args[0]) * F.lit(float(node.args[1].value))
            if own := extensions.find("scorer", node.name):
                tf = self.score(S.Binary("@", node.args[0], node.args[1])) if len(node.args) > 1 else F.lit(1.0)
                return own(tf, *map(self.value, node.args)).cast("double")
            if node.name in registry.SCORES:
                return registry.SCORES[node.name](self, node.args)
        return F.when(self.truth(node), F.lit(1.0)).otherwise(F.lit(0.0))


def similarity(tokens: Column, words: list[str]) -> Column:
    """How many different words of the text the record has."""
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, dict.fromkeys(words))))) if words else F.lit(0)


def _intervals(options: tuple) -> tuple[int, int | None]:
    """(most, least) of the options most, last, elements, least."""
    at = lambda k: options[k] if len(options) > k and options[k] not in ("", None) else None
    most, least = at(0), at(3)
    return int(most) if most is not None else 10, int(least) if least is not None else None


def condition(df: DataFrame, script: str, **context) -> Column:
    """The condition that a script expression states over df."""
    return Compiler(df, **context).truth(S.parse_script(script))


def value(df: DataFrame, script: str, **context) -> Column:
    return Compiler(df, **context).value(S.parse_script(script))


def keywords(*trees) -> list[str]:
    """The words and phrases that conditions look for, in their order, without those that must not be there."""
    out: list[str] = []

    def walk(node):
        if isinstance(node, S.Unary) and node.op == "!":
            return
        if isinstance(node, S.Binary):
            if node.op == "&!":
                return walk(node.left)
            said = node.right.left if isinstance(node.right, S.Binary) and node.right.op == "*" else node.right
            if node.op in ("@", "@^word") and isinstance(said, S.Lit):
                out.append(str(said.value))
                return
            if node.op in _NEAR or node.op in ("*Q", "*S"):
                out.extend(re.findall(r"\w+", str(said.value)))
                return
        for x in S.parts(node):
            walk(x)

    for t in trees:
        walk(t)
    return list(dict.fromkeys(w for w in out if w))
