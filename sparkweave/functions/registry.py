"""Registry of functions ("verbs").  A verb maps columns to a column; it never sees rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BUILT_IN: dict[str, Callable[..., Column]] = {}
CUSTOM: dict[str, Callable[..., Column]] = {}


def col(x) -> Column:
    """A column as it is, anything else as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def let(x, f: Callable[[Column], Column]) -> Column:
    """f(x), x computed once: in a lambda's body, and wherever an expression names it twice
    beside one, a column is computed anew for every item and every mention."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def verb(name: str, *aliases: str):
    """Register a built-in; its arguments arrive as columns unless marked otherwise."""

    def add(f):
        for n in (name, *aliases):
            BUILT_IN[n] = f
        return f

    return add


def register_verb(name: str, f: Callable[..., Column]) -> None:
    """Register a function of columns; it shadows a built-in of the same name."""
    CUSTOM[name] = f


def unregister_verb(name: str) -> None:
    CUSTOM.pop(name, None)


def call(name: str, *args, custom: bool = False, **options) -> Column:
    """The column of a verb.  A custom call of an unknown name gives its first argument."""
    f = CUSTOM.get(name) or BUILT_IN.get(name)
    if f is None:
        if custom:
            return col(args[0]) if args else F.lit(None)
        raise KeyError(f"T001: unknown verb {name}")
    return f(*args, **options)


def value_of(x):
    """The Python value of a literal argument that shapes the plan (a field name, a unit)."""
    if isinstance(x, Column):
        raise TypeError("this argument must be a constant")
    return x
