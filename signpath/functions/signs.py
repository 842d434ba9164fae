"""Sign algebra: 1 is positive, 0 negative; the product of two signs is 1 where they are equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_sign(raw: Column) -> Column:
    """Above zero is positive; zero and less is negative."""
    return F.when(raw > 0, 1).otherwise(0).cast("int")


def product(a: Column, b: Column) -> Column:
    return F.when(a == b, 1).otherwise(0).cast("int")


def is_simple(path: Column) -> Column:
    return F.size(F.array_distinct(path)) == F.size(path)


def meets_only_once(one: Column, two: Column) -> Column:
    """Whether two half paths that end in the same vertex share nothing else."""
    return F.size(F.array_intersect(one, two)) == 1


def sorted_insert(items: Column, item: Column) -> Column:
    return F.array_sort(F.array_union(items, F.array(item)))


def intersect_keeping(one: Column, two: Column, own: Column) -> Column:
    return F.array_union(F.array_intersect(one, two), F.array(own))


def edge_key(a: Column, b: Column) -> tuple[Column, Column]:
    """An undirected edge by its lesser and greater end."""
    return F.least(a, b), F.greatest(a, b)
