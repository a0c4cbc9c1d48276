"""Bind a column once inside an expression tree."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated one time however often the body names it.

    Inside a lambda Spark re-evaluates a repeated subtree for every element, so a costly
    value that a lambda refers to has to be bound first. It is the start of an aggregate over nothing: an item
    taken out of a one-item ``transform`` would work out the type of the whole body anew for every row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)
