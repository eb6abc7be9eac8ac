"""The functions that script expressions can call, by name."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import extensions
from ..plans import syntax as S
from . import geo, scalar as A, text as X, times

PLAIN = {
    "math_abs": F.abs, "number_classify": A.number_classify, "number_round": A.number_round, "string_length": F.char_length,
    "binary_length": F.octet_length, "html_untag": X.html_untag, "vector_size": F.size, "json_extract": A.json_extract, "edit_distance": F.levenshtein,
    "distance_cosine": A.distance_cosine, "distance_inner_product": A.distance_inner_product, "distance_l1_norm": A.distance_l1_norm,
    "distance_l2_norm_squared": A.distance_l2_norm_squared, "all_records": lambda: F.lit(True), "now": F.current_timestamp,
    "vector_new": F.array, "time_classify_day": times.classify_day, "time_classify_week": times.classify_week,
    "time_classify_day_of_week": times.day_of_week, "time_format_iso8601": times.format_iso8601,
}
INTERVALS = {f"time_classify_{u}": f for u, f in (("second", times.classify_second), ("minute", times.classify_minute), ("hour", times.classify_hour), ("month", times.classify_month), ("year", times.classify_year))}


def _options(args: tuple) -> tuple[list, dict]:
    rest = [a for a in args if not isinstance(a, S.Options)]
    said = [a for a in args if isinstance(a, S.Options)]
    return rest, {k: v.value if isinstance(v, S.Lit) else v for k, v in (said[0].items if said else ())}


def call(c, name: str, args: tuple) -> Column:
    """The Column of a call; c: the compiler."""
    args, options = _options(args)
    for kind in ("function", "selector", "applier"):
        if own := extensions.find(kind, name):
            return own(*map(c.value, args), **options)
    lit = lambda k, d=None: args[k].value if len(args) > k and isinstance(args[k], S.Lit) else d
    v = lambda k: c.value(args[k])
    if name in PLAIN:
        return PLAIN[name](*map(c.value, args))
    if name in INTERVALS:
        return INTERVALS[name](v(0), int(lit(1, 1)))
    if name == "between":
        borders = (lit(2, "include"), lit(4, "include")) if len(args) == 5 else ("include", "include")
        lo, hi = (args[1], args[3]) if len(args) == 5 else (args[1], args[2])
        return A.between(v(0), c.value(lo), c.value(hi), *borders, array=isinstance(c.kind(v(0)), T.ArrayType))
    if name == "in_values":
        return F.arrays_overlap(v(0), F.array(*map(c.value, args[1:]))) if isinstance(c.kind(v(0)), T.ArrayType) else v(0).isin(*map(c.value, args[1:]))
    if name in ("min", "max"):
        arrays = [isinstance(c.kind(v(k)), T.ArrayType) for k in range(len(args))]
        flat = [(F.array_min if name == "min" else F.array_max)(v(k)) if arrays[k] else v(k) for k in range(len(args))]
        return flat[0] if len(flat) == 1 else (F.least if name == "min" else F.greatest)(*flat)
    if name == "rand":
        return F.floor(F.rand() * int(lit(0, 2**31)))
    if name == "cast_loose":
        return A.cast_loose(args[0].path if isinstance(args[0], S.Name) else lit(0), v(1), v(2))
    if name == "string_substring":
        return A.string_substring(v(0), int(lit(1)), lit(2), options.get("default_value", ""))
    if name == "string_truncate":
        return A.string_truncate(v(0), int(lit(1)), options.get("omission", "..."))
    if name == "string_slice":
        if isinstance(lit(1), str):
            return A.string_slice_regexp(v(0), lit(1), lit(2, 0), options.get("default_value", ""))
        return A.string_substring(v(0), int(lit(1)), lit(2), options.get("default_value", ""))
    if name == "string_tokenize":
        return X.tokenize(v(0), lit(1, "TokenWord"))
    if name == "time_format":
        return times.format(v(0), lit(1))
    if name == "vector_slice":
        return A.vector_slice(v(0), int(lit(1)), lit(2))
    if name == "vector_find":
        return A.vector_find(v(0), v(1), lit(2, "EQUAL"))
    if name == "vector_join":
        return F.array_join(v(0), lit(1))
    if name == "query":
        tree = S.parse_query(lit(1), lit(0), options.get("flags", S.DEFAULT_FLAGS))
        return c.truth(tree)
    if name == "query_parallel_or":
        return reduce(lambda p, q: p | q, [c.truth(S.parse_query(a.value, lit(0))) for a in args[1:]])
    if name == "fuzzy_search":
        return fuzzy(c, args, options)[0]
    if name == "prefix_rk_search":
        return F.translate(v(0), X._HIRA, X._KATA).rlike("^(?:" + X.kana_pattern(str(lit(1))) + ")")
    if name in ("snippet", "snippet_html"):
        return snippet(c, name, args, options)
    if name.startswith("geo_"):
        points = [geo.at(a.value) if isinstance(a, S.Lit) and isinstance(a.value, str) and k < 3 and re.fullmatch(r"\s*-?[\d.]+[x,]-?[\d.]+\s*", a.value) else _point(c, a) for k, a in enumerate(args[:3])]
        if name == "geo_distance":
            return geo.distance(*points[:2], lit(2, "rectangle"))
        if name == "geo_in_circle":
            radius = geo.distance(points[1], points[2], lit(3, "rectangle")) if isinstance(lit(2), str) else points[2]
            return geo.in_circle(*points[:2], radius, lit(3, "rectangle"))
        if name == "geo_in_rectangle":
            return geo.in_rectangle(*points)
    if name in ("highlight_html", "highlight_full", "highlight"):
        return highlight(c, name, args, options)
    if name in SCORES:
        return SCORES[name](c, args)
    raise S.SyntaxProblem(f"no function {name}")


def _point(c, arg) -> Column:
    """A point of an argument; a column of texts is read as points."""
    x = c.value(arg)
    return geo.from_text(x) if isinstance(c.kind(x), T.StringType) else x


def _tagged(c, said: list, options: dict) -> list[tuple[str, str, str]]:
    """(keyword, opening, closing) of the rest of the arguments, or of the default tags.

    Without keywords they are those of the select's own conditions.
    """
    if options.get("sequential_class_tag_mode"):
        return [(w, f'<mark class="keyword-{i}">', "</mark>") for i, w in enumerate(said or c.keywords)]
    if "default_open_tag" in options:
        return [(w, options["default_open_tag"], options.get("default_close_tag", "")) for w in said or c.keywords]
    if len(said) % 3:
        raise S.SyntaxProblem("keywords come with an opening and a closing tag each")
    return list(zip(said[::3], said[1::3], said[2::3]))


def _said(args) -> list[str]:
    return [str(a.value) for a in args if isinstance(a, S.Lit)]


def highlight(c, name: str, args: list, options: dict) -> Column:
    x = c.value(args[0])
    if name == "highlight_html":
        words = _said(args[1:]) or c.keywords
        if options.get("sequential_class_tag_mode"):
            return A.highlight(x, _tagged(c, words, options), escape=True)
        return A.highlight_html(x, words)
    if name == "highlight_full":
        normalizer, escape = args[1].value, bool(args[2].value)
        return A.highlight(x, _tagged(c, _said(args[3:]), options), escape, normalizer not in ("", None, "NormalizerNone"))
    escape = bool(options.get("html_mode", options.get("html_escape", False)))
    fold = options.get("normalizers", options.get("normalizer", "NormalizerAuto")) not in ("", None)
    return A.highlight(x, _tagged(c, _said(args[1:]), options), escape, fold)


def snippet(c, name: str, args: list, options: dict) -> Column:
    x = c.value(args[0])
    html = name == "snippet_html"
    words = [(w, '<span class="keyword">', "</span>") for w in _said(args[1:]) or c.keywords] if html else _tagged(c, _said(args[1:]), options)
    got = A.snippets(x, words, int(options.get("width", 200)), int(options.get("max_n_results", 3)), escape=html or bool(options.get("html_escape")), prefix=options.get("prefix") or "", suffix=options.get("suffix") or "", skip_leading_spaces=bool(options.get("skip_leading_spaces", True)))
    default = options.get("default")
    return X.let(got, lambda g: F.when(F.size(g) > 0, g).otherwise(F.lit(None) if default is None else F.array(F.lit(default))))


def fuzzy(c, args: list, options: dict) -> tuple[Column, Column]:
    """(whether a text is near enough, the score of it: max_distance - distance + 1)."""
    at = lambda k, name, d: args[k].value if len(args) > k and isinstance(args[k], S.Lit) else options.get(name, d)
    most, prefix, swaps = int(at(2, "max_distance", 1)), int(at(3, "prefix_length", 0)), bool(options.get("with_transposition", at(5, "", True)))
    d = A.fuzzy_distance(c.value(args[0]), args[1].value, prefix, swaps)
    return d <= most, F.when(d <= most, F.lit(float(most + 1)) - d).otherwise(0.0)


def _tf_idf(c, args) -> Column:
    """max(tf * ln(N / df), 1), df and N counted over the records that are asked."""
    tf = c.score(S.Binary("@", args[0], args[1]))
    n = c.df.agg(F.count("*").alias("n"), F.count_if(tf > 0).alias("df")).first()
    return F.when(tf > 0, F.greatest(tf * math.log(n["n"] / n["df"]), F.lit(1.0))).otherwise(0.0) if n["df"] else F.lit(0.0)


SCORES = {
    "scorer_tf_at_most": lambda c, args: F.least(c.score(S.Binary("@", args[0], args[1])), F.lit(float(args[2].value))),
    "scorer_tf_idf": _tf_idf,
    "fuzzy_search": lambda c, args: fuzzy(c, *_options(args))[1],
}
