"""Scalar functions of numbers, strings, vectors, JSON and distances, all as built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# ---- comparisons ----------------------------------------------------------------------------------
def between(x: Column, least, most, least_border: str = "include", most_border: str = "include", array: bool = False) -> Column:
    """least <= x <= most, each border included or excluded; of an array, of any element."""
    lo, hi = _c(least), _c(most)

    def one(v):
        return (v >= lo if least_border == "include" else v > lo) & (v <= hi if most_border == "include" else v < hi)

    return F.exists(x, one) if array else one(x)


def cast_loose(kind: str, x: Column, default) -> Column:
    """x as kind, or the default where that can't be."""
    names = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float": "double", "float32": "float", "bool": "boolean", "shorttext": "string", "text": "string", "longtext": "string", "time": "timestamp"}
    return F.coalesce(x.try_cast(names.get(kind.lower(), kind)), _c(default).cast(names.get(kind.lower(), kind)))


# ---- numbers --------------------------------------------------------------------------------------
def number_classify(x: Column, interval) -> Column:
    """The multiple of the interval at or below x, below zero as well."""
    return F.floor(x / _c(interval)) * _c(interval)


def number_round(x: Column, digits=0) -> Column:
    """Half away from zero."""
    return F.round(x, _c(digits)) if isinstance(digits, Column) else F.round(x, digits)


# ---- strings --------------------------------------------------------------------------------------
def string_substring(x: Column, nth: int, length: int | None = None, default: str = "") -> Column:
    """From the nth character, counted from 0, or from the end if negative; the default where there is none."""
    size = F.char_length(x)
    start = F.lit(nth) if nth >= 0 else size + nth
    take = size if length is None or length < 0 else F.lit(length)
    return F.when((start < 0) | (start >= size) | (take == 0), F.lit(default)).otherwise(F.substr(x, start + 1, take))


def string_truncate(x: Column, length: int, omission: str = "...") -> Column:
    """At most length characters, of which the last are the omission mark where something is left out."""
    keep = max(length - len(omission), 0)
    return F.when(F.char_length(x) <= length, x).otherwise(F.concat(F.substr(x, F.lit(1), F.lit(keep)), F.lit(omission)))


def string_slice_regexp(x: Column, pattern: str, group=0, default: str = "") -> Column:
    """The group, by number or name, of the first match."""
    if isinstance(group, str):
        names = re.findall(r"(?<!\\)\((?:\?<([A-Za-z]\w*)>|(?!\?))", pattern)
        group = names.index(group) + 1
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group)).otherwise(F.lit(default))


def keyword_pattern(word: str) -> str:
    """A pattern of a keyword in either case and width."""
    out = ""
    for c in word:
        same = {c, c.lower(), c.upper()}
        same |= {chr(ord(x) + 0xFEE0) for x in same if "!" <= x <= "~"} | {chr(ord(x) - 0xFEE0) for x in same if "！" <= x <= "～"}
        same |= {y for x in same for y in (x.lower(), x.upper())}
        single = sorted(x for x in same if len(x) == 1)
        out += "[" + "".join("\\" + x if x in r"\[]^-&" else x for x in single) + "]"
    return out


def highlight(x: Column, words: list[tuple[str, str, str]], escape: bool = False, fold: bool = True) -> Column:
    """Every occurrence of a keyword between its two tags; words: (keyword, opening, closing).

    fold: in either case and width; escape: what stands for itself in HTML is escaped, tags are not. Of
    several keywords at one place the longest counts.
    """
    words = [w for w in words if w[0]]
    if not words:
        return X.escape_html(x) if escape else x
    order = sorted(dict.fromkeys(words), key=lambda w: -len(w[0]))
    pattern = lambda w: keyword_pattern(w) if fold else re.escape(w)
    mark = [(chr(0xE000 + 2 * i), chr(0xE001 + 2 * i)) for i in range(len(order))]
    some = "|".join(f"({pattern(w)})" for w, _, _ in order)
    # One pass: each keyword has a group of its own, and a group that didn't match adds its two marks around nothing.
    x = F.regexp_replace(x, some, "".join(f"{a}${i + 1}{b}" for i, (a, b) in enumerate(mark)))
    x = X.escape_html(x) if escape else x
    for (a, b), (_, opening, closing) in zip(mark, order):
        x = F.replace(F.replace(F.replace(x, F.lit(a + b), F.lit("")), F.lit(a), F.lit(opening)), F.lit(b), F.lit(closing))
    return x


def highlight_html(x: Column, words: list[str], opening: str = '<span class="keyword">', closing: str = "</span>") -> Column:
    return highlight(x, [(w, opening, closing) for w in words], escape=True)


def snippets(x: Column, words, width: int = 200, most: int = 3, opening: str = "[[", closing: str = "]]", escape: bool = False, prefix: str = "", suffix: str = "", skip_leading_spaces: bool = True) -> Column:
    """At most so many pieces of about width characters around the keywords, which stand between tags; pieces don't overlap.

    words: keywords, or (keyword, opening, closing).
    """
    words = [w if isinstance(w, tuple) else (w, opening, closing) for w in words]
    if not words:
        return F.array().cast("array<string>")
    some = "|".join(keyword_pattern(w) for w, _, _ in sorted(words, key=lambda w: -len(w[0])))
    side = max((width - max(len(w) for w, _, _ in words)) // 2, 0)
    # A pattern that begins with up to side characters tries each of them at each place of the text. Here the first
    # keyword is looked for from where the last piece ended, and the reading ends with the last piece that is wanted.
    gap, rest = "(?s:.*?)", f"(?:{some})(?s:.{{0,{side}}})"
    few = 0 < most <= 16  # a repeated group takes stack for each piece
    used = F.regexp_extract(x, f"^(?:{gap}{rest}){{1,{most}}}", 0) if few else x

    def dress(s):
        s = F.ltrim(s) if skip_leading_spaces else s
        return F.concat(F.lit(prefix), highlight(s, words, escape), F.lit(suffix))

    def pieces(u):
        before, found = (F.slice(F.regexp_extract_all(u, F.lit(f"\\G({gap})({rest})"), F.lit(k)), 1, most) for k in (1, 2))
        return F.zip_with(before, found, lambda b, f: dress(F.concat(F.right(b, F.lit(side)), f)))

    return X.let(used, pieces)


def fuzzy_distance(x: Column, query: str, prefix_length: int = 0, transposition: bool = True) -> Column:
    """The edit distance, one for two neighbours that change places if transposition; far away where the prefix differs.

    Swapping neighbours is one step less than Levenshtein counts where undoing one swap of the query explains it.
    """
    d = F.levenshtein(x, F.lit(query))
    if transposition:
        swapped = {query[:i] + query[i + 1] + query[i] + query[i + 2 :] for i in range(len(query) - 1) if query[i] != query[i + 1]}
        for s in sorted(swapped):
            d = F.least(d, F.levenshtein(x, F.lit(s)) + 1)
    if prefix_length:
        d = F.when(F.startswith(x, F.lit(query[:prefix_length])), d).otherwise(F.lit(1 << 20))
    return d


# ---- vectors --------------------------------------------------------------------------------------
def vector_slice(x: Column, start: int, length: int | None = None) -> Column:
    """From start, counted from 0, or from the end if negative."""
    size = F.size(x)
    at = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
    take = F.greatest(size, F.lit(1)) if length is None or length < 0 else F.lit(length)
    return F.when(at >= size, F.slice(x, F.lit(1), F.lit(0))).otherwise(F.slice(x, at + 1, take))


_MODES = {
    "EQUAL": lambda e, v: e == v, "NOT_EQUAL": lambda e, v: e != v, "LESS": lambda e, v: e < v, "GREATER": lambda e, v: e > v,
    "LESS_EQUAL": lambda e, v: e <= v, "GREATER_EQUAL": lambda e, v: e >= v, "PREFIX": lambda e, v: F.startswith(e, v),
    "MATCH": lambda e, v: F.contains(F.lower(e), F.lower(v)), "REGEXP": lambda e, v: F.regexp_like(e, v),
}


def vector_find(x: Column, value, mode: str = "EQUAL") -> Column:
    """The first element that satisfies the mode, else null."""
    return F.get(F.filter(x, lambda e: _MODES[mode.upper()](e, _c(value))), F.lit(0))


def power_set(x: Column, kind: str = "string") -> Column:
    """Every non-empty subset of an array's distinct elements."""
    empty = F.array().cast(f"array<array<{kind}>>")
    return F.aggregate(F.array_distinct(x), empty, lambda a, e: F.concat(a, F.array(F.array(e)), F.transform(a, lambda s: F.concat(s, F.array(e)))))


# ---- JSON and distances ---------------------------------------------------------------------------
def json_extract(x: Column, path) -> Column:
    return F.call_function("get_json_object", x, _c(path))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def distance_inner_product(a: Column, b: Column) -> Column:
    return 1 - _dot(a, b)


def distance_cosine(a: Column, b: Column) -> Column:
    """1 where the dot product is zero, so for zero vectors too."""
    dot = _dot(a, b)
    return F.when(dot == 0, F.lit(1.0)).otherwise(1 - dot / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))))


def distance_l1_norm(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def distance_l2_norm_squared(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gap, F.lit(0.0), lambda s, v: s + v * v)
