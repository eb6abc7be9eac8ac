"""Window functions: row numbers, ranks, sums and counts, running when sorted and total otherwise.

Without group keys the whole table is one group, and Spark sorts it in one task: name group keys for what is
large, or number records by tables.with_id(), which parts them by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans import syntax as S
from .expression import quoted
from .facets import sort_columns


def _spec(group_keys, sort_keys, tie=()):
    group = [quoted(k) for k in S.split(group_keys)]
    w = Window.partitionBy(*group)
    order = sort_columns(sort_keys, tie) if sort_keys else []
    return group, order, w.orderBy(*order) if order else w


def record_number(group_keys=None, sort_keys=None, tie=()) -> Column:
    """1 for the first record; without sort keys the records stand by the tie breakers."""
    _, order, w = _spec(group_keys, sort_keys or list(tie), tie)
    if not order:
        raise ValueError("a record number needs sort keys or a tie breaker")
    return F.row_number().over(w)


def rank(group_keys=None, sort_keys=None) -> Column:
    """Equal sort keys share a rank, with gaps; without sort keys all rank 1."""
    _, order, w = _spec(group_keys, sort_keys)
    return F.rank().over(w) if order else F.lit(1)


def _frame(group_keys, sort_keys, tie):
    _, order, w = _spec(group_keys, sort_keys, tie)
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow) if order else w


def window_sum(x, group_keys=None, sort_keys=None, tie=()) -> Column:
    """Running by rows when sorted, else the group's total; tie: unique columns that settle equal keys."""
    return F.sum(x).over(_frame(group_keys, sort_keys, tie))


def window_count(group_keys=None, sort_keys=None, tie=()) -> Column:
    return F.count("*").over(_frame(group_keys, sort_keys, tie))


BY_NAME = {"record_number": record_number, "window_record_number": record_number, "window_rank": rank, "window_sum": window_sum, "window_count": window_count}
