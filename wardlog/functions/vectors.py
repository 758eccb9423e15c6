"""Array, address and label expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlog.constants import DISPLAY_NAMES, RESULT_CODES


def constant_array(values: Sequence[float]) -> Column:
    """A number array as one folded constant instead of one node per entry."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays, 0 where one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))


def unit_length(a: Column) -> Column:
    """The array divided by its length; NULL where it has none."""
    length = F.sqrt(dot(a, a))
    return F.when(length > 0, F.transform(a, lambda x: x / length))


def mean_square_error(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.try_divide(total(gap), F.size(a))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(mean_square_error(a, b))


def array_median(xs: Column) -> Column:
    s = F.sort_array(xs)
    n = F.size(xs)
    low = F.get(s, F.floor((n - 1) / 2).cast("int"))
    high = F.get(s, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def pad(xs: Column, size: int) -> Column:
    """The array with zeros behind it, up to ``size`` entries."""
    missing = F.greatest(F.lit(size) - F.size(xs), F.lit(0))
    return F.concat(xs, F.array_repeat(F.lit(0.0), missing))


def count_equal(xs: Column, x: Column) -> Column:
    return F.size(F.filter(xs, lambda v: v == x))


def class_c(ip: Column) -> Column:
    """a.b.c.d -> a.b.c.xxx"""
    return F.concat(F.substring_index(ip, ".", 3), F.lit(".xxx"))


def lookup(c: Column, table: dict, default=None) -> Column:
    pairs = [F.lit(v) for item in table.items() for v in item]
    found = F.element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, F.lit(default))


def display_name(label: Column) -> Column:
    return lookup(label, DISPLAY_NAMES)


def result_code(name: Column, model_id: Column | int) -> Column:
    model_id = F.lit(model_id) if isinstance(model_id, int) else model_id
    return (lookup(name, RESULT_CODES) + model_id * 100).cast("bigint")


def by_score(names: Column, scores: Column) -> Column:
    """Pairs (score, name), highest score first; equal scores by name, last first."""
    pairs = F.zip_with(
        scores, names, lambda s, n: F.struct(s.alias("score"), n.alias("feature"))
    )
    return F.sort_array(pairs, asc=False)
