"""Object verbs: on maps, or on structs where the field names are known when planning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import col, let, value_of, verb
from .scalar import last_entries

#: Keys that are never written.
UNSAFE = ("__proto__", "constructor", "prototype")


def of_entries(entries: Column) -> Column:
    """A map in first-seen key order, the last value of a key, without unsafe keys."""
    return F.map_from_entries(last_entries(F.filter(entries, lambda e: ~e["key"].isin(*UNSAFE))))


@verb("keys")
def keys(m):
    return F.map_keys(col(m))


@verb("values")
def values(m):
    return F.map_values(col(m))


@verb("entries")
def entries(m):
    return F.map_entries(col(m))


@verb("has")
def has(m, path):
    return get(m, path).isNotNull()


@verb("get")
def get(m, path, default=None):
    out = col(m)
    for p in value_of(path).split("."):
        out = out[p]
    return out if default is None else F.coalesce(out, col(default))


@verb("merge")
def merge(*ms):
    return of_entries(F.concat(*[F.map_entries(col(m)) for m in ms]))


@verb("pick")
def pick(m, *names):
    of = lambda e, n: F.filter(e, lambda x: x["key"] == value_of(n))
    return of_entries(let(F.map_entries(col(m)), lambda e: F.flatten(F.array(*[of(e, n) for n in names]))))


@verb("omit")
def omit(m, *names):
    return F.map_filter(col(m), lambda k, _: ~k.isin(*map(value_of, names)))


@verb("fromEntries")
def from_entries(pairs):
    return of_entries(col(pairs))


@verb("invert")
def invert(m):
    return of_entries(F.transform(F.map_entries(col(m)), lambda e: F.struct(e["value"].cast("string").alias("key"), e["key"].alias("value"))))


@verb("defaults")
def defaults(m, base):
    missing = lambda m: F.filter(F.map_entries(col(base)), lambda e: ~F.map_contains_key(m, e["key"]))
    return of_entries(let(col(m), lambda m: F.concat(F.map_entries(m), missing(m))))


@verb("renameKeys")
def rename_keys(m, names: dict[str, str]):
    pairs = F.transform(F.map_entries(col(m)), lambda e: F.struct(_renamed(e["key"], names).alias("key"), e["value"].alias("value")))
    return of_entries(pairs)


def _renamed(k: Column, names: dict[str, str]) -> Column:
    out = None
    for a, b in names.items():
        out = (F if out is None else out).when(k == a, F.lit(b))
    return k if out is None else out.otherwise(k)


@verb("compactObject")
def compact_object(m):
    return F.map_filter(col(m), lambda _, v: v.isNotNull() & ~v.cast("string").isin("", "[]", "{}"))
