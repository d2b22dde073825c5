"""Aggregation, statistics, time value of money and interpolation over arrays or scalars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import col, let, value_of, verb
from .scalar import finite, num, text


def numbers(array) -> Column:
    return F.filter(F.transform(col(array), num), lambda x: x.isNotNull())


def total(array: Column, value=lambda x: x) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + F.coalesce(value(x), F.lit(0.0)))


def _items(xs) -> Column:
    return col(xs[0]) if len(xs) == 1 else F.array(*[num(x) for x in xs])


@verb("sum")
def sum_(*xs):
    return total(_items(xs), num)


@verb("count")
def count(*xs):
    return F.size(_items(xs))


@verb("min")
def min_(*xs):
    return F.array_min(numbers(_items(xs)))


@verb("max")
def max_(*xs):
    return F.array_max(numbers(_items(xs)))


@verb("avg")
def avg(*xs):
    return let(numbers(_items(xs)), _mean)


def _mean(n: Column) -> Column:
    return F.try_divide(total(n), F.size(n))


@verb("first")
def first(array):
    return F.try_element_at(col(array), F.lit(1))


@verb("last")
def last(array):
    return F.try_element_at(col(array), F.lit(-1))


#: accumulate and set are windows or later aggregates; inside one row they are these folds.
ACCUMULATORS = {
    "sum": lambda acc, x: acc + F.coalesce(num(x), F.lit(0.0)), "add": lambda acc, x: acc + F.coalesce(num(x), F.lit(0.0)), "count": lambda acc, x: acc + 1,
    "min": lambda acc, x: F.least(acc, num(x)), "max": lambda acc, x: F.greatest(acc, num(x)), "concat": lambda acc, x: F.concat_ws("", acc, text(x)),
    "first": lambda acc, x: F.coalesce(acc, col(x)), "last": lambda acc, x: col(x),
}


@verb("accumulate")
def accumulate(array, op="sum", initial=0.0):
    return F.aggregate(col(array), col(initial), ACCUMULATORS[value_of(op)])


@verb("set")
def set_(value):
    return col(value)


# -- mathematics ---------------------------------------------------------------------------


@verb("log")
def log(x, base=None):
    x = num(x)
    if base is None:
        return F.ln(x)
    b = num(base)
    return F.when((b > 0) & (b != 1), F.try_divide(F.ln(x), F.ln(b)))


@verb("ln")
def ln(x):
    return finite(F.ln(num(x)))


@verb("log10")
def log10(x):
    return finite(F.log10(num(x)))


@verb("exp")
def exp(x):
    return finite(F.exp(num(x)))


@verb("pow")
def pow_(b, e):
    return finite(F.pow(num(b), num(e)))


@verb("sqrt")
def sqrt(x):
    return F.when(num(x) >= 0, F.sqrt(num(x)))


# -- time value of money -------------------------------------------------------------------


@verb("compound")
def compound(principal, rate, periods):
    return finite(num(principal) * F.pow(1 + num(rate), num(periods)))


@verb("discount")
def discount(future, rate, periods):
    return finite(F.try_divide(num(future), F.pow(1 + num(rate), num(periods))))


@verb("pmt")
def pmt(principal, rate, nper):
    p, r, n = num(principal), num(rate), num(nper)
    return finite(F.when(n > 0, F.when(r == 0, F.try_divide(p, n)).otherwise(F.try_divide(p * r, 1 - F.pow(1 + r, -n)))))


@verb("fv")
def fv(payment, rate, nper):
    p, r, n = num(payment), num(rate), num(nper)
    return finite(F.when(r == 0, p * n).otherwise(F.try_divide(p * (F.pow(1 + r, n) - 1), r)))


@verb("pv")
def pv(payment, rate, nper):
    p, r, n = num(payment), num(rate), num(nper)
    return finite(F.when(r == 0, p * n).otherwise(F.try_divide(p * (1 - F.pow(1 + r, -n)), r)))


@verb("nper")
def nper(rate, payment, present):
    r, m, p = num(rate), num(payment), num(present)
    return finite(F.when(r == 0, F.try_divide(-p, m)).otherwise(F.try_divide(F.ln(F.try_divide(m, m + r * p)), F.ln(1 + r))))


@verb("rate")
def rate(nper_, payment, present, future=0.0):
    """Newton's steps on pv (1+r)^n + pmt ((1+r)^n - 1) / r + fv = 0, from 0.1."""
    n, m, p, f = num(nper_), num(payment), num(present), num(future)

    def step(s, _):
        r = s["r"]
        value = lambda g: p * g + m * F.try_divide(g - 1, r) + f
        slope = lambda g: p * n * F.try_divide(g, 1 + r) + m * (F.try_divide(n * F.try_divide(g, 1 + r), r) - F.try_divide(g - 1, r * r))
        to = lambda new: F.struct(F.coalesce(new, r).alias("r"), F.coalesce(F.abs(new - r) < 1e-10, F.lit(True)).alias("done"))
        return F.when(s["done"], s).otherwise(let(F.pow(1 + r, n), lambda g: let(r - F.try_divide(value(g), slope(g)), to)))

    start = F.struct(F.lit(0.1).alias("r"), F.lit(False).alias("done"))
    # most are done in a few of the hundred steps
    few = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step)
    return finite(let(few, lambda s: F.when(s["done"], s["r"]).otherwise(F.aggregate(F.sequence(F.lit(9), F.lit(100)), s, step, lambda s: s["r"]))))


def newton(flows: list, times: list, guess: pd.Series, steps: int, tolerance: float) -> pd.Series:
    """Internal rates of all rows of a batch: rows of one length take their steps together.
    A row without flows, or whose steps lead nowhere, has none."""
    out, guess = np.full(len(flows), np.nan), guess.to_numpy(float)
    lengths = np.array([-1 if c is None else len(c) for c in flows], dtype=np.int64)
    for n in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == n)
        c, t, r = np.stack([flows[i] for i in at]), np.stack([times[i] for i in at]), guess[at]
        for _ in range(steps):
            x = 1 + r[:, None]
            v, d = (c / x**t).sum(axis=1), (-t * c / x ** (t + 1)).sum(axis=1)
            ok = np.isfinite(v) & np.isfinite(d) & (d != 0)
            new = r[ok] - v[ok] / d[ok]
            done = np.abs(new - r[ok]) < tolerance
            out[at[ok][done]] = new[done]
            at, c, t, r = at[ok][~done], c[ok][~done], t[ok][~done], new[~done]
            if not len(at):
                break
    return pd.Series(np.where(np.isnan(out), None, out), dtype=object)


def _known(c) -> np.ndarray:
    return np.asarray(c if getattr(c, "dtype", object) != object else [x for x in c if x is not None], float)


@F.pandas_udf(T.DoubleType())
def _irr(flows: pd.Series, guess: pd.Series) -> pd.Series:
    own = [None if c is None or len(c) < 2 else _known(c) for c in flows]
    with np.errstate(all="ignore"):
        return newton(own, [None if c is None else np.arange(len(c)) for c in own], guess, 200, 1e-10)


@verb("irr")
def irr(flows, guess=0.1):
    return _irr(F.transform(col(flows), num), num(guess))


@F.pandas_udf(T.DoubleType())
def _xirr(flows: pd.Series, days: pd.Series, guess: pd.Series) -> pd.Series:
    fit = [c is not None and d is not None and len(c) == len(d) >= 2 for c, d in zip(flows, days, strict=True)]
    own = [np.asarray(c, float) if ok else None for c, ok in zip(flows, fit, strict=True)]
    times = [(np.asarray(d, float) - d[0]) / 365 if ok else None for d, ok in zip(days, fit, strict=True)]
    with np.errstate(all="ignore"):
        return newton(own, times, guess, 100, 1e-7)


def _days(dates) -> Column:
    return F.transform(col(dates), lambda d: F.unix_date(F.to_date(d.cast("string"))).cast("double"))


@verb("xirr")
def xirr(amounts, dates, guess=0.1):
    return _xirr(F.transform(col(amounts), num), _days(dates), num(guess))


@verb("npv")
def npv(rate_, flows):
    return finite(total(F.transform(col(flows), lambda x, i: num(x) / F.pow(1 + num(rate_), i))))


@verb("xnpv")
def xnpv(rate_, amounts, dates):
    d = _days(dates)
    return finite(total(F.transform(col(amounts), lambda x, i: num(x) / F.pow(1 + num(rate_), (F.get(d, i) - F.get(d, F.lit(0))) / 365))))


@verb("depreciation")
def depreciation(cost, salvage, life):
    c, s, n = num(cost), num(salvage), num(life)
    return F.when((n > 0) & (s <= c), F.try_divide(c - s, n))


# -- statistics over arrays ----------------------------------------------------------------


def _moment(array, ddof: int) -> Column:
    return let(numbers(array), lambda n: let(_mean(n), lambda m: _spread(n, m, ddof)))


def _spread(n: Column, mean: Column, ddof: int) -> Column:
    return F.when(F.size(n) > ddof, F.try_divide(total(n, lambda x: (x - mean) * (x - mean)), F.size(n) - ddof))


@verb("variance")
def variance(array):
    return _moment(array, 0)


@verb("std")
def std(array):
    return F.sqrt(_moment(array, 0))


@verb("varianceSample")
def variance_sample(array):
    return _moment(array, 1)


@verb("stdSample")
def std_sample(array):
    return F.sqrt(_moment(array, 1))


@verb("quantile")
def quantile(array, q):
    """Linear interpolation at q (n - 1)."""

    def between(n: Column) -> Column:
        at = num(q) * (F.size(n) - 1)
        lo = F.floor(at).cast("int")
        a, b = F.get(n, lo), F.get(n, F.ceil(at).cast("int"))
        return F.when((num(q) >= 0) & (num(q) <= 1), a + (b - a) * (at - lo))

    return let(F.sort_array(numbers(array)), between)


@verb("percentile")
def percentile(array, p):
    return quantile(array, num(p) / 100)


@verb("median")
def median(array):
    return quantile(array, 0.5)


@verb("mode")
def mode(array):
    """The most frequent number, the first seen of those."""
    counts = lambda n: F.transform(F.array_distinct(n), lambda v, i: F.struct(F.size(F.filter(n, lambda x: x == v)).alias("n"), (-i).alias("i"), v.alias("v")))
    return let(numbers(array), lambda n: F.array_max(counts(n))["v"])


def _pair(xs, ys, f) -> Column:
    """f(x, y) of the numbers of both up to the shorter."""
    same = lambda x, y: F.slice(x, F.lit(1), F.least(F.size(x), F.size(y)))
    return let(numbers(xs), lambda x: let(numbers(ys), lambda y: let(same(x, y), lambda a: let(same(y, x), lambda b: f(a, b)))))


@verb("covariance")
def covariance(xs, ys):
    return _pair(xs, ys, _covariance)


def _covariance(x: Column, y: Column) -> Column:
    return let(_mean(x), lambda mx: let(_mean(y), lambda my: F.try_divide(total(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my))), F.size(x))))


@verb("correlation")
def correlation(xs, ys):
    return _pair(xs, ys, lambda x, y: F.try_divide(_covariance(x, y), std(x) * std(y)))


@verb("zscore")
def zscore(value, array):
    return let(numbers(array), lambda n: let(_mean(n), lambda m: F.try_divide(num(value) - m, F.sqrt(_spread(n, m, 0)))))


@verb("clamp")
def clamp(x, lo, hi):
    x, a, b = num(x), num(lo), num(hi)
    return F.when(x.isNotNull() & a.isNotNull() & b.isNotNull(), F.least(F.greatest(x, a), b))


@verb("interpolate")
def interpolate(x, x1, y1, x2, y2):
    x, x1, y1, x2, y2 = map(num, (x, x1, y1, x2, y2))
    return F.when(x1 == x2, y1).otherwise(y1 + F.try_divide((x - x1) * (y2 - y1), x2 - x1))


@verb("weightedAvg")
def weighted_avg(values, weights):
    return let(col(weights), lambda w: F.try_divide(total(F.zip_with(col(values), w, lambda a, b: num(a) * num(b))), total(w, num)))


@verb("movingAvg")
def moving_avg(array, window):
    """Trailing mean with a short head; what is no number counts as 0."""
    a, n = F.transform(col(array), lambda x: F.coalesce(num(x), F.lit(0.0))), int(value_of(window))
    part = lambda a, i: F.slice(a, F.greatest(i + 2 - n, F.lit(1)), F.least(i + 1, F.lit(n)))
    return let(a, lambda a: F.transform(a, lambda x, i: total(part(a, i)) / F.least(i + 1, F.lit(n))))


LOCALES = {"en-US": (",", "."), "en-GB": (",", "."), "de-DE": (".", ","), "es-ES": (".", ","), "fr-FR": (" ", ",")}


@verb("formatLocaleNumber")
def format_locale_number(x, locale="en-US", places=None):
    group, point = LOCALES.get(value_of(locale), LOCALES["en-US"])
    x = num(x)
    s = F.format_number(x, int(value_of(places))) if places is not None else F.regexp_replace(F.format_number(x, 3), r"\.?0+$", "")
    return s if (group, point) == (",", ".") else F.translate(s, ",.", group + point)
