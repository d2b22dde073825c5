"""Collection verbs over an array inside a row.  For collections that are whole tables see
``sparkweave.operators.relational``: same names, DataFrame operators."""

from __future__ import annotations

import random as _random
from functools import reduce as _fold

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geo import mulberry, seed_of
from .registry import call, col, let, value_of, verb
from .scalar import num, text, truthy

OPERATORS = ("=", "==", "!=", "<>", "<", "<=", ">", ">=", "contains", "startsWith", "endsWith")


def predicate(x: Column, op: str, value, null_text: str = "null") -> Column:
    """Field op value.  Equality compares text, with null as ``null_text``; order needs two
    numbers; an unknown operator is false.  Never null."""
    s, v = F.coalesce(text(x), F.lit(null_text)), F.coalesce(text(value), F.lit(null_text))
    if op in ("=", "=="):
        return s == v
    if op in ("!=", "<>"):
        return s != v
    if op in ("<", "<=", ">", ">="):
        a, b = num(x), num(value)
        return F.coalesce({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], F.lit(False))
    if op in ("contains", "startsWith", "endsWith"):
        return {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[op](s, v)
    return F.lit(False)


def item_predicate(field=None, op=None, value=None, null_text: str = "null"):
    if op is not None:
        return lambda x: predicate(x[field], op, value, null_text)
    return (lambda x: truthy(x[field])) if field is not None else truthy


@verb("filter")
def filter_(array, field=None, op=None, value=None):
    return F.filter(col(array), item_predicate(field, op, value))


@verb("flatten")
def flatten(array):
    return F.flatten(col(array))


@verb("distinct", "unique")
def distinct(array):
    return F.array_distinct(col(array))


@verb("sort")
def sort(array):
    return F.array_sort(col(array))


@verb("sortDesc")
def sort_desc(array):
    return F.sort_array(col(array), asc=False)


def with_ordinal(array: Column) -> Column:
    return F.transform(array, lambda x, i: F.struct(i.alias("i"), x.alias("x")))


@verb("sortBy")
def sort_by(array, field):
    """Stable, nulls first: sorting (field, position, item) structs needs no comparator."""
    keyed = lambda a: F.transform(a, lambda x, i: F.struct(x[field].alias("k"), i.alias("i")))
    return let(col(array), lambda a: F.transform(F.sort_array(keyed(a)), lambda p: F.get(a, p["i"])))


@verb("map", "pluck")
def map_(array, field):
    return F.transform(col(array), lambda x: x[field])


@verb("indexOf")
def index_of(array, value):
    return (F.array_position(F.transform(col(array), text), text(value)) - 1).cast("int")


@verb("at")
def at(array, index):
    i = col(index).cast("int")
    return F.try_element_at(col(array), F.when(i >= 0, i + 1).otherwise(i))


def clamp_slice(array: Column, start: Column, end: Column) -> Column:
    """Half-open, clamped; negative bounds count from the end."""
    n = F.size(array)
    fix = lambda x: F.least(F.greatest(F.when(x < 0, x + n).otherwise(x), F.lit(0)), n)
    a, b = fix(start), fix(end)
    return F.slice(array, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))


@verb("slice")
def slice_(array, start, end=None):
    a = col(array)
    return clamp_slice(a, col(start), F.size(a) if end is None else col(end))


@verb("reverse")
def reverse(array):
    return F.reverse(col(array))


@verb("every")
def every(array, field=None, op=None, value=None):
    return F.forall(col(array), item_predicate(field, op, value))


@verb("some")
def some(array, field=None, op=None, value=None):
    return F.exists(col(array), item_predicate(field, op, value))


@verb("find")
def find(array, field, op, value):
    return F.try_element_at(filter_(array, field, op, value), F.lit(1))


@verb("findIndex")
def find_index(array, field, op, value):
    return (F.array_position(F.transform(col(array), item_predicate(field, op, value)), True) - 1).cast("int")


@verb("includes")
def includes(array, value):
    return F.coalesce(F.array_contains(F.transform(col(array), text), text(value)), F.lit(False))


@verb("concatArrays")
def concat_arrays(*arrays):
    return F.concat(*[F.coalesce(col(a), F.array()) for a in arrays])


@verb("zip")
def zip_(*arrays):
    """Tuples up to the shortest."""
    cols = [col(a) for a in arrays]
    n = _fold(lambda x, y: F.least(x, y), [F.size(a) for a in cols])
    return F.transform(F.slice(cols[0], F.lit(1), n), lambda x, i: F.struct(x.alias("0"), *[F.get(a, i).alias(str(k + 1)) for k, a in enumerate(cols[1:])]))


@verb("groupBy")
def group_by(array, field):
    """[{key, items}] in first-seen order of the keys, null as "null"."""
    key = lambda x: F.coalesce(text(x[field]), F.lit("null"))
    return let(col(array), lambda a: F.transform(F.array_distinct(F.transform(a, key)), lambda k: F.struct(k.alias("key"), F.filter(a, lambda x: key(x) == k).alias("items"))))


@verb("partition")
def partition(array, field, op, value):
    p = item_predicate(field, op, value)
    return F.struct(F.filter(col(array), p).alias("pass"), F.filter(col(array), lambda x: ~p(x)).alias("fail"))


@verb("take", "limit")
def take(array, n):
    n = col(n).cast("int")
    return F.when(n >= 0, F.slice(col(array), F.lit(1), n))


@verb("drop")
def drop(array, n):
    n = col(n).cast("int")
    return F.when(n >= 0, F.slice(col(array), n + 1, F.greatest(F.size(col(array)) - n, F.lit(0))))


@verb("chunk")
def chunk(array, size):
    a, n = col(array), int(value_of(size))
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1, F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i + 1, F.lit(n)))


@verb("range")
def range_(start, end=None, step=1):
    """End-exclusive integers, at most 10000."""
    a, b = (F.lit(0), col(start)) if end is None else (col(start), col(end))
    s = F.when(col(step) == 0, F.lit(1)).otherwise(col(step)).cast("bigint")
    n = F.least(F.greatest(F.ceil((b - a) / s), F.lit(0)), F.lit(10000)).cast("bigint")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: a.cast("bigint") + i * s)).otherwise(F.array().cast("array<bigint>"))


@verb("compact")
def compact(array):
    return F.filter(col(array), lambda x: x.isNotNull() & (x.cast("string") != ""))


@verb("rowNumber")
def row_number(array):
    """Items with their number, 1 first."""
    return F.transform(col(array), lambda x, i: F.struct((i + 1).alias("_rowNum"), x.alias("value")))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _places(size: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
    """Places of the items drawn; rows of one seed, size and number draw the same ones."""
    known: dict[tuple, list[int]] = {}

    def one(size, k, s):
        if size < 0 or k != k:
            return None
        if (size, k, s) in known:
            return known[size, k, s]
        u = mulberry(seed_of(str(s))) if s is not None else iter(_random.random, 2)
        m = min(int(k), int(size))
        moved: dict[int, int] = {}  # only what is not in its own place
        out = []
        for i in range(m):
            j = i + int(next(u) * (size - i))
            out.append(moved.get(j, j))
            moved[j] = moved.get(i, i)
        if s is not None:
            known[size, k, s] = out
        return out

    return pd.Series([one(*x) for x in zip(size, n, seed, strict=True)], dtype=object)


@verb("sample")
def sample(array, n, seed=None, kind: str = "bigint"):
    """A partial Fisher-Yates shuffle, seeded.  An Arrow-batched function draws the places;
    the items stay in the JVM."""
    places = _places(F.coalesce(F.size(col(array)), F.lit(-1)), col(n), col(seed).cast("string"))
    return F.transform(places, lambda i: F.get(col(array), i)).cast(f"array<{kind}>")


@verb("dedupe")
def dedupe(array, field):
    """First item of each key; items without key all stay."""
    first = lambda keys, k, i: k.isNull() | (F.array_position(keys, k) == i + 1)
    return let(F.transform(col(array), lambda x: text(x[field])), lambda keys: F.filter(col(array), lambda x, i: first(keys, F.get(keys, i), i)))


def _running(array: Column, op, zero: float) -> Column:
    """Running fold in one pass; the output grows by one item a step."""
    start = F.struct(F.lit(zero).alias("acc"), F.array().cast("array<double>").alias("out"))
    step = lambda s, x: F.struct(
        F.coalesce(op(s["acc"], num(x)), s["acc"]).alias("acc"), F.array_append(s["out"], op(s["acc"], num(x))).alias("out")
    )
    return F.aggregate(array, start, step, lambda s: s["out"])


@verb("cumsum")
def cumsum(array):
    return _running(col(array), lambda a, x: a + x, 0.0)


@verb("cumprod")
def cumprod(array):
    return _running(col(array), lambda a, x: a * x, 1.0)


def _before(a: Column, i: Column, n) -> Column:
    return F.when(i >= n, num(F.get(a, (i - n).cast("int"))))


@verb("diff")
def diff(array, periods=1):
    a, n = col(array), F.greatest(col(periods), F.lit(1))
    return let(a, lambda a: F.transform(a, lambda x, i: num(x) - _before(a, i, n)))


@verb("pctChange")
def pct_change(array, periods=1):
    a, n = col(array), F.greatest(col(periods), F.lit(1))
    return let(a, lambda a: F.transform(a, lambda x, i: let(_before(a, i, n), lambda b: F.try_divide(num(x) - b, b))))


@verb("shift")
def shift(array, n=1, fill=None):
    a, k = col(array), col(n).cast("int")
    inside = lambda a, i: ((i - k) >= 0) & ((i - k) < F.size(a))
    return let(a, lambda a: F.transform(a, lambda x, i: F.when(inside(a, i), F.get(a, i - k)).otherwise(col(fill))))


@verb("lag")
def lag(array, n=1, fill=None):
    return shift(array, F.greatest(col(n), F.lit(1)), fill)


@verb("lead")
def lead(array, n=1, fill=None):
    return shift(array, -F.greatest(col(n), F.lit(1)), fill)


@verb("rank")
def rank(array, field=None, direction="desc"):
    """Competition rank of each item, in the order of the array."""
    a = col(array)
    key = (lambda x: num(x[field])) if field is not None else num
    better = (lambda x, y: x > y) if value_of(direction) == "desc" else (lambda x, y: x < y)
    one = lambda values, x, k: F.struct((F.size(F.filter(values, lambda v: better(v, k))) + 1).alias("_rank"), x.alias("value"))
    return let(F.transform(a, key), lambda values: F.transform(a, lambda x, i: let(F.get(values, i), lambda k: one(values, x, k))))


@verb("fillMissing")
def fill_missing(array, fill=None, strategy="value"):
    a, s = col(array), value_of(strategy)
    if s == "mean":
        from .stats import avg

        return let(a, lambda a: let(avg(a), lambda m: F.transform(a, lambda x: F.coalesce(num(x), m, num(fill)))))
    if s in ("forward", "backward"):
        known = lambda a, i: F.filter(F.slice(a, F.lit(1), i + 1) if s == "forward" else F.slice(a, i + 1, F.size(a)), lambda v: v.isNotNull())
        return let(a, lambda a: F.transform(a, lambda x, i: F.coalesce(x, F.try_element_at(known(a, i), F.lit(-1 if s == "forward" else 1)), col(fill))))
    return F.transform(a, lambda x: F.coalesce(x, col(fill)))


@verb("reduce")
def reduce(array, name, initial):
    """Left fold with any verb of two arguments."""
    return F.aggregate(col(array), col(initial), lambda acc, x: call(value_of(name), acc, x))


@verb("pivot")
def pivot(array, key, value):
    from .objects import of_entries

    return of_entries(F.transform(col(array), lambda x: F.struct(text(x[key]).alias("key"), x[value].alias("value"))))


@verb("unpivot")
def unpivot(m, key="key", value="value"):
    return F.transform(F.map_entries(col(m)), lambda e: F.struct(e["key"].alias(key), e["value"].alias(value)))


@verb("intersection")
def intersection(a, b):
    return F.array_intersect(col(a), col(b))


@verb("union")
def union(a, b):
    return F.array_union(col(a), col(b))


@verb("difference")
def difference(a, b):
    return F.array_except(col(a), col(b))


@verb("symmetricDifference")
def symmetric_difference(a, b):
    a, b = col(a), col(b)
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


@verb("countBy")
def count_by(array, field=None):
    from .objects import UNSAFE

    key = lambda x: F.coalesce(text(x[field] if field is not None else x), F.lit(""))
    names = lambda keys: F.filter(F.sort_array(F.array_distinct(keys)), lambda k: ~k.isin(*UNSAFE))
    one = lambda keys, k: F.struct(k, F.size(F.filter(keys, lambda x: x == k)))
    return let(F.transform(col(array), key), lambda keys: F.map_from_entries(F.transform(names(keys), lambda k: one(keys, k))))


@verb("keyBy")
def key_by(array, field):
    from .objects import of_entries

    return of_entries(F.transform(col(array), lambda x: F.struct(text(x[field]).alias("key"), x.alias("value"))))


@verb("explode")
def explode(array, field):
    """One {row, item} for each element of the field; rows without elements stay, item null."""
    one = lambda x: F.when(F.size(x[field]) > 0, F.transform(x[field], lambda e: F.struct(x.alias("row"), e.alias("item"))))
    return F.flatten(F.transform(col(array), lambda x: F.coalesce(one(x), F.array(F.struct(x.alias("row"), F.try_element_at(x[field], F.lit(1)).alias("item"))))))


@verb("window")
def window(array, n):
    a, k = col(array), int(value_of(n))
    count = F.size(a) - k + 1
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i, F.lit(k)))


@verb("countIf")
def count_if(array, field, op, value):
    return F.coalesce(F.size(F.filter(col(array), item_predicate(field, op, value, ""))), F.lit(0))


@verb("sumIf")
def sum_if(array, field, op, value, sum_field=None):
    from .stats import total

    rows = F.filter(col(array), item_predicate(field, op, value, ""))
    return total(F.transform(rows, lambda x: num(x[sum_field or field])))


@verb("avgIf")
def avg_if(array, field, op, value, avg_field=None):
    """Sum over the count of matching rows, also those without a number."""
    from .stats import total

    rows = F.filter(col(array), item_predicate(field, op, value, ""))
    return F.try_divide(total(F.transform(rows, lambda x: num(x[avg_field or field]))), F.size(rows))
