"""All verbs.  ``call(name, *columns)`` gives the column of any of them."""

from . import arrays, dates, encoding, geo, objects, scalar, stats, strings  # noqa: F401
from .registry import BUILT_IN, call, register_verb, unregister_verb  # noqa: F401
