"""Collection verbs over whole tables.

Tables have no order, so every operator that needs one takes ``order``: columns that fix
it, ties included.  Window operators take partition keys; without keys they run the
distributed prefix forms (range partitions, their totals, then offsets), never one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import predicate
from ..functions.registry import col
from ..functions.scalar import num, text, truthy
from ..storage import settle

#: A lookup table up to this many bytes of rows is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 64 << 20


def _names(x) -> list:
    return [x] if isinstance(x, str | Column) else list(x)


# -- rows ----------------------------------------------------------------------------------


def filter_rows(df: DataFrame, field: str, op: str | None = None, value=None) -> DataFrame:
    """Rows whose field matches.  Comparisons of numbers with numbers stay plain, so that
    they reach the scan; others follow the text rules of ``predicate``."""
    kind = df.schema[field].dataType.typeName()
    c = F.col(field)
    if op is None:
        return df.filter(truthy(c))
    if op in ("<", "<=", ">", ">=") and kind in ("integer", "long", "double", "float", "short", "byte") and isinstance(value, int | float):
        return df.filter({"<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op])
    if op in ("=", "==") and (kind == "string" and isinstance(value, str) or kind in ("integer", "long") and isinstance(value, int)):
        return df.filter(c == value)
    return df.filter(predicate(c, op, value))


def distinct(df: DataFrame, *fields: str) -> DataFrame:
    return df.select(*fields).distinct() if fields else df.distinct()


def dedupe(df: DataFrame, key: str, order) -> DataFrame:
    """First row of each key; rows without key all stay.  The first rows are found by a
    pre-aggregated minimum over (order, row), so a hot key is no hot task."""
    o = F.struct(*_names(order))
    row = F.struct(*df.columns)
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, o).alias("_r")).select("_r.*")
    return first.unionByName(df.filter(F.col(key).isNull()))


def key_by(df: DataFrame, key: str, order) -> DataFrame:
    """Last row of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*_names(order))).alias("_r")).select(key, "_r.*")


def top(df: DataFrame, order, n: int) -> DataFrame:
    """sortBy and take: each task keeps n rows."""
    return df.orderBy(*_names(order)).limit(n)


def skip(df: DataFrame, order, n: int) -> DataFrame:
    return slice_rows(df, order, n, None)


def slice_rows(df: DataFrame, order, start: int, end: int | None) -> DataFrame:
    """Rows start..end of the order, half-open.  Without an end, rows are numbered by
    ranges: an offset alone would move the whole table into one task."""
    if end is not None:
        return top(df, order, end).orderBy(*_names(order)).offset(start)
    return numbered(df, order, "_at").filter(F.col("_at") > start).drop("_at")


#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33


def _ranged(df: DataFrame, order) -> DataFrame:
    """``df`` in sorted ranges, written once, with ``_p``, the range, and ``_i``, the row's
    place in it.  Both are fixed by the write: two plans over two exchanges need not agree
    on the ranges."""
    at = settle(df.repartitionByRange(*_names(order)).sortWithinPartitions(*_names(order)).withColumn("_m", F.monotonically_increasing_id()), "ranges")
    return at.select(*df.columns, F.shiftright("_m", ROW_BITS).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_i"))


def numbered(df: DataFrame, order, name: str = "_rowNum", partition_by: Sequence[str] = ()) -> DataFrame:
    """1-based position.  Without keys: rows are range-partitioned, numbered inside their
    range, and shifted by the exact sizes of the ranges before."""
    if partition_by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition_by).orderBy(*_names(order))).cast("bigint"))
    own = _ranged(df, order)
    offsets = _offsets(own.groupBy("_p").agg(F.count(F.lit(1)).alias("_t")))
    return own.join(offsets, "_p").select(*[c for c in df.columns if c != name], (F.col("_i") + F.col("_o") + 1).cast("bigint").alias(name))


def _offsets(totals: DataFrame) -> DataFrame:
    """Totals before each range; one row a shuffle partition."""
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("_p", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_o")))


def prefix_sum(df: DataFrame, value: Column, order, name: str) -> DataFrame:
    """The sum of ``value`` over all rows up to each: totals of ranges, then offsets."""
    own = _ranged(df.withColumn("_v", value), order)
    w = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    offsets = _offsets(own.groupBy("_p").agg(F.sum("_v").alias("_t")))
    return own.withColumn("_own", F.sum("_v").over(w)).join(offsets, "_p").select(*[c for c in df.columns if c != name], (F.col("_own") + F.col("_o")).alias(name))


def _counted(df: DataFrame, keys: Sequence[str], value: str, descending: bool) -> DataFrame:
    """Each (keys, value) once: _n rows, _b rows of smaller values in its group, _t rows of
    the group.  Rows are counted before the shuffle, so a hot group costs its distinct
    values, and these are spread over ranges."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    c = prefix_sum(n, F.col("_n"), [*keys, F.desc(value) if descending else F.asc(value)], "_c")
    c = settle(c.withColumn("_c", F.col("_c") - F.col("_n")), "counted")
    per = c.groupBy(*keys).agg(F.min("_c").alias("_s"), F.sum("_n").alias("_t"))
    return _join(c, per, keys).select(*keys, value, "_n", (F.col("_c") - F.col("_s")).alias("_b"), "_t")


def _join(df: DataFrame, per: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``per``, one row a key; null keys meet."""
    if not keys:
        return df.join(F.broadcast(per), how="cross") if how == "inner" else df.join(F.broadcast(per), F.lit(True), how)
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    other = per.withColumnsRenamed(names)
    cond = reduce(lambda x, y: x & y, [df[k].eqNullSafe(other[n]) for k, n in names.items()])
    return df.join(other, cond, how).drop(*names.values())


def rank_rows(df: DataFrame, value: str, partition_by: Sequence[str], direction: str = "desc", name: str = "_rank") -> DataFrame:
    """1-based rank in each group, ties equal.  Groups may be few and hot: ranks are counted
    over distinct values by ranges, no group is gathered."""
    ranks = _counted(df, partition_by, value, direction == "desc").select(*partition_by, value, (F.col("_b") + 1).cast("bigint").alias(name))
    return _join(df, ranks, [*partition_by, value])


def quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """keys and one column for each ``name: (value, p)``: exact, linear between neighbours.
    The table of distinct values of a group is spread over ranges, not held in a task."""
    out = df.select(*keys).distinct()
    for value in dict.fromkeys(v for v, _ in wanted.values()):
        own = _counted(df.filter(F.col(value).isNotNull()), keys, value, False)
        at = {n: F.lit(p) * (F.col("_t") - 1) for n, (v, p) in wanted.items() if v == value}
        holds = lambda i: (F.col("_b") <= i) & (i < F.col("_b") + F.col("_n"))
        picks = [F.max(F.when(holds(f(h)), F.col(value).cast("double"))).alias(f"_{s}_{n}") for n, h in at.items() for s, f in (("lo", F.floor), ("hi", F.ceil))]
        parts = own.groupBy(*keys).agg(F.max("_t").alias("_t"), *picks)
        parts = parts.select(*keys, *[(F.col(f"_lo_{n}") + (h - F.floor(h)) * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n, h in at.items()])
        out = _join(out, parts, keys, "left")
    return out


def fill_mean(df: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """Nulls replaced by the group's mean; groups are averaged before the shuffle."""
    out = _join(df, df.groupBy(*keys).agg(F.avg(value).alias("_mean")), keys)
    return out.withColumn(name, F.coalesce(F.col(value), F.col("_mean"))).drop("_mean")


def zscores(df: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """Distance from the group's mean in population deviations; null where these are 0."""
    out = _join(df, df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_dev")), keys)
    return out.withColumn(name, F.try_divide(F.col(value) - F.col("_mean"), F.col("_dev"))).drop("_mean", "_dev")


def chunks(df: DataFrame, order, size: int, value: str) -> DataFrame:
    n = numbered(df, order, "_n")
    return n.groupBy(F.floor((F.col("_n") - 1) / size).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]).alias("items"))


def partition_rows(df: DataFrame, field: str, op: str, value) -> tuple[DataFrame, DataFrame]:
    p = predicate(F.col(field), op, value)
    return df.filter(p), df.filter(~p)


def explode_rows(df: DataFrame, field: str, item: str | None = None) -> DataFrame:
    """A row for each element; rows without elements stay, with null."""
    return df.withColumn(item or field, F.explode_outer(field))


def windows_of(df: DataFrame, value: str, n: int, order, partition_by: Sequence[str]) -> DataFrame:
    """Runs of n consecutive values."""
    w = Window.partitionBy(*partition_by).orderBy(*_names(order)).rowsBetween(0, n - 1)
    return df.withColumn("items", F.collect_list(value).over(w)).filter(F.size("items") == n)


# -- groups --------------------------------------------------------------------------------


def group_items(df: DataFrame, key: str, order) -> DataFrame:
    """key, items: the rows of a key as an ordered array (null as "null")."""
    o = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(_names(order))])
    return df.groupBy(F.coalesce(text(F.col(key)), F.lit("null")).alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), F.struct(*df.columns).alias("r")))), lambda x: x["r"]).alias("items"))


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.coalesce(text(F.col(key)), F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("count"))


def count_if(field: str, op: str, value) -> Column:
    return F.count_if(predicate(F.col(field), op, value, ""))


def sum_if(field: str, op: str, value, of: str | None = None) -> Column:
    return F.coalesce(F.sum(F.when(predicate(F.col(field), op, value, ""), num(F.col(of or field)))), F.lit(0.0))


def avg_if(field: str, op: str, value, of: str | None = None) -> Column:
    return F.try_divide(sum_if(field, op, value, of), count_if(field, op, value))


def every(field: str, op: str, value) -> Column:
    return F.coalesce(F.bool_and(predicate(F.col(field), op, value)), F.lit(True))


def some(field: str, op: str, value) -> Column:
    return F.coalesce(F.bool_or(predicate(F.col(field), op, value)), F.lit(False))


def mode_of(df: DataFrame, keys: Sequence[str], value: str, order) -> DataFrame:
    """Most frequent value of each group, the first seen of equals."""
    c = df.filter(num(F.col(value)).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*_names(order))).alias("_o"))
    return c.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_o"))).alias("mode"))


def correlation(x: str, y: str) -> Column:
    """Pearson; zero variance gives null."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def weighted_avg(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def pivot_rows(df: DataFrame, index: Sequence[str], key: str, keys: Sequence[str], agg: Column) -> DataFrame:
    """Keys are stated, so planning needs no pass over the data."""
    return df.groupBy(*index).pivot(key, list(keys)).agg(agg)


def unpivot_rows(df: DataFrame, ids: Sequence[str], values: Sequence[str], key: str = "key", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), key, value)


def salted_sum(df: DataFrame, keys: Sequence[str], aggs: dict[str, str], salt: int = 32) -> DataFrame:
    """Sums in two steps, for groupings whose rows can't be combined before the shuffle."""
    first = df.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(salt))).groupBy(*keys, "_s").agg(*[F.sum(c).alias(n) for n, c in aggs.items()])
    return first.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in aggs])


# -- windows -------------------------------------------------------------------------------


def _over(order, partition_by, lo=None, hi=0):
    w = Window.partitionBy(*partition_by).orderBy(*_names(order))
    return w.rowsBetween(Window.unboundedPreceding if lo is None else lo, hi)


def cumsum(value: str, order, partition_by) -> Column:
    v = num(F.col(value))
    return F.when(v.isNotNull(), F.sum(v).over(_over(order, partition_by)))


def cumprod(value: str, order, partition_by) -> Column:
    """By sign, zero and logarithm: a running product without a list of the frame."""
    v = num(F.col(value))
    w = _over(order, partition_by)
    size = F.exp(F.sum(F.when(v != 0, F.ln(F.abs(v)))).over(w))
    sign = F.when(F.sum(F.when(v < 0, 1).otherwise(0)).over(w) % 2 == 1, -1.0).otherwise(1.0)
    zero = F.coalesce(F.max(F.when(v == 0, 1).otherwise(0)).over(w), F.lit(0)) == 1
    return F.when(v.isNotNull(), F.when(zero, 0.0).otherwise(sign * F.coalesce(size, F.lit(1.0))))


def lag(value: str, order, partition_by, n: int = 1, fill=None) -> Column:
    return F.lag(value, max(1, n), fill).over(Window.partitionBy(*partition_by).orderBy(*_names(order)))


def lead(value: str, order, partition_by, n: int = 1, fill=None) -> Column:
    return F.lead(value, max(1, n), fill).over(Window.partitionBy(*partition_by).orderBy(*_names(order)))


def shift(value: str, order, partition_by, n: int = 1, fill=None) -> Column:
    w = Window.partitionBy(*partition_by).orderBy(*_names(order))
    return F.lag(value, n, fill).over(w) if n >= 0 else F.lead(value, -n, fill).over(w)


def diff(value: str, order, partition_by, n: int = 1) -> Column:
    return num(F.col(value)) - num(lag(value, order, partition_by, n))


def pct_change(value: str, order, partition_by, n: int = 1) -> Column:
    before = num(lag(value, order, partition_by, n))
    return F.try_divide(num(F.col(value)) - before, before)


def rank(value: str, partition_by, direction: str = "desc") -> Column:
    return F.rank().over(Window.partitionBy(*partition_by).orderBy(F.desc(value) if direction == "desc" else F.asc(value)))


def moving_avg(value: str, n: int, order, partition_by) -> Column:
    return F.avg(F.coalesce(num(F.col(value)), F.lit(0.0))).over(_over(order, partition_by, -(n - 1), 0))


def fill_missing(value: str, order, partition_by, fill=None, strategy: str = "value") -> Column:
    v = F.col(value)
    if strategy == "forward":
        v = F.last(v, ignorenulls=True).over(_over(order, partition_by))
    elif strategy == "backward":
        v = F.first(v, ignorenulls=True).over(_over(order, partition_by, 0, Window.unboundedFollowing))
    elif strategy == "mean":
        v = F.coalesce(v, F.avg(v).over(Window.partitionBy(*partition_by)))
    return F.coalesce(v, col(fill))


def zscore(value: str, partition_by) -> Column:
    w = Window.partitionBy(*partition_by)
    return F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))


def running(op: str, value: str, order, partition_by) -> Column:
    """Accumulators read inside a loop."""
    w, v = _over(order, partition_by), F.col(value)
    return {
        "sum": lambda: F.sum(num(v)).over(w), "add": lambda: F.sum(num(v)).over(w), "count": lambda: F.count(F.lit(1)).over(w),
        "min": lambda: F.min(num(v)).over(w), "max": lambda: F.max(num(v)).over(w), "first": lambda: F.first(v, ignorenulls=True).over(w),
        "last": lambda: F.last(v).over(w), "concat": lambda: F.array_join(F.collect_list(text(v)).over(w), ""),
    }[op]()


def global_running_sum(df: DataFrame, value: str, order, name: str) -> DataFrame:
    """A running total over the whole table; nulls and non-numbers add nothing."""
    return prefix_sum(df, F.coalesce(num(F.col(value)), F.lit(0.0)), order, name)


# -- set operations and joins --------------------------------------------------------------


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionByName(b.subtract(a))


def size_in_bytes(df: DataFrame) -> int:
    """The optimiser's estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup(df: DataFrame, table: DataFrame, on: dict[str, str], result: str, alias: str, order=None, default=None) -> DataFrame:
    """Left join with the first row of each key; keys compare as text.  A table that looks
    small is reduced to its keys and results, written, and measured: up to
    ``BROADCAST_BYTES`` it is broadcast, else both sides are shuffled and adaptive execution
    splits hot keys."""
    keys = {f"_k{i}": (a, b) for i, (a, b) in enumerate(on.items())}
    t = table.select(*[text(F.col(b)).alias(k) for k, (_, b) in keys.items()], F.col(result).alias(alias), *([F.struct(*_names(order)).alias("_ord")] if order else []))
    small = size_in_bytes(t) <= BROADCAST_BYTES
    pick = F.min_by(alias, "_ord") if order else F.first(alias)
    t = t.groupBy(*keys).agg(pick.alias(alias))
    if small:
        t = settle(t, "lookup")
        cells = [F.coalesce(F.octet_length(text(F.col(c))), F.lit(0)) + 16 for c in t.columns]
        if (t.agg(F.sum(reduce(lambda x, y: x + y, cells))).first()[0] or 0) <= BROADCAST_BYTES:
            t = F.broadcast(t)
    cond = reduce(lambda x, y: x & y, [text(df[a]) == t[k] for k, (a, _) in keys.items()])
    out = df.join(t, cond, "left").select(*[df[c] for c in df.columns], t[alias])
    return out if default is None else out.withColumn(alias, F.coalesce(alias, F.lit(default)))


def having_some(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_semi")


def having_none(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_anti")


# -- extensions that the collection verbs do not have --------------------------------------


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, value: str, alias: str) -> DataFrame:
    """Latest value of ``right`` at or before each row of ``left``: one union, one window."""
    a = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_l", F.lit(1))
    b = right.select(*on, time, F.col(value).alias("_v")).withColumn("_l", F.lit(0))
    w = Window.partitionBy(*on).orderBy(time, "_l").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(alias, F.last("_v", ignorenulls=True).over(w))
    return both.filter("_l = 1").select(*left.columns, alias)


def range_join(left: DataFrame, right: DataFrame, point: str, lo: str, hi: str, width: float) -> DataFrame:
    """Rows of ``left`` with lo <= point <= hi of ``right``, over bins of a width."""
    a = left.withColumn("_b", F.floor(F.col(point) / width))
    b = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return a.join(b, "_b").filter(F.col(point).between(F.col(lo), F.col(hi))).drop("_b")
