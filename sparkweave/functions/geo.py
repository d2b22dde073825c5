"""Geographic and generation verbs."""

from __future__ import annotations

import secrets

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import col, value_of, verb
from .scalar import num

#: Mean radius of the earth.
RADIUS = {"km": 6371.0, "mi": 3958.8, "miles": 3958.8}
_MASK = 0xFFFFFFFF


@verb("toRadians")
def to_radians(x):
    return F.radians(num(x))


@verb("toDegrees")
def to_degrees(x):
    return F.degrees(num(x))


@verb("distance")
def distance(lat1, lon1, lat2, lon2, unit="km"):
    r = RADIUS.get(value_of(unit).lower())
    if r is None:
        return F.lit(None).cast("double")
    a, b = F.radians(num(lat1)), F.radians(num(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(num(lon2) - num(lon1)) / 2), 2)
    return F.lit(2 * r) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))


@verb("inBoundingBox")
def in_bounding_box(lat, lon, min_lat, min_lon, max_lat, max_lon):
    return num(lat).between(num(min_lat), num(max_lat)) & num(lon).between(num(min_lon), num(max_lon))


def _on_earth(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


@verb("bearing")
def bearing(lat1, lon1, lat2, lon2):
    ok = _on_earth(num(lat1), num(lon1)) & _on_earth(num(lat2), num(lon2))
    a, b, d = F.radians(num(lat1)), F.radians(num(lat2)), F.radians(num(lon2) - num(lon1))
    angle = F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return F.when(ok, F.pmod(F.degrees(angle) + 360, F.lit(360.0)))


@verb("midpoint")
def midpoint(lat1, lon1, lat2, lon2):
    a, b, o, d = F.radians(num(lat1)), F.radians(num(lat2)), F.radians(num(lon1)), F.radians(num(lon2) - num(lon1))
    x, y = F.cos(b) * F.cos(d), F.cos(b) * F.sin(d)
    lat = F.atan2(F.sin(a) + F.sin(b), F.sqrt((F.cos(a) + x) * (F.cos(a) + x) + y * y))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(o + F.atan2(y, F.cos(a) + x)).alias("lon"))


# -- generation ----------------------------------------------------------------------------


def seed_of(text: str) -> int:
    """A 32-bit seed: h * 31 + code over the UTF-16 units of the text."""
    raw = text.encode("utf-16-le")
    h = 0
    for i in range(0, len(raw), 2):
        h = (h * 31 + int.from_bytes(raw[i : i + 2], "little")) & _MASK
    return h


def mulberry(seed: int):
    """Uniform numbers in [0, 1) of the Mulberry32 generator."""
    state = seed & _MASK
    while True:
        state = (state + 0x6D2B79F5) & _MASK
        t = (state ^ (state >> 15)) * (state | 1) & _MASK
        t = (t ^ ((t + ((t ^ (t >> 7)) * (t | 61) & _MASK)) & _MASK)) & _MASK
        yield (t ^ (t >> 14)) / 4294967296


@verb("random")
def random(*args, seed: str | None = None):
    """random(), random(max), random(min, max); a seed is folded when planning."""
    lo, hi = (0, args[0]) if len(args) == 1 else (args[0], args[1]) if len(args) >= 2 else (None, None)
    if len(args) == 3:
        seed = args[2]
    u = F.rand() if seed is None else F.lit(next(mulberry(seed_of(str(seed)))))
    return u if hi is None else F.floor(col(lo) + u * (col(hi) - col(lo) + 1))


@F.pandas_udf(T.StringType())
def _seeded_uuid(s: pd.Series) -> pd.Series:
    def one(x: str) -> str:
        out, a, b = [], 5381, 52711
        for k in range(4):
            for ch in f"{x}{k}".encode():
                a, b = (a * 33 ^ ch) & _MASK, (b * 33 ^ ch * 31) & _MASK
            out.append(a ^ (b >> 3))
        h = "".join(f"{v:08x}" for v in out)
        return f"{h[:8]}-{h[8:12]}-5{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:32]}"

    return s.map(one, na_action="ignore")


@verb("uuid")
def uuid(seed=None):
    return F.uuid() if seed is None else _seeded_uuid(col(seed).cast("string"))


ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz-"


def nanoid_udf(length: int):
    @F.pandas_udf("string")
    def run(n: pd.Series) -> pd.Series:
        return n.map(lambda _: "".join(secrets.choice(ALPHABET) for _ in range(length)))

    return run.asNondeterministic()


@verb("nanoid")
def nanoid(length=21):
    return nanoid_udf(int(value_of(length)))(F.lit(1))


@verb("sequence")
def sequence(order_by=None, start=1, partition_by=()):
    """A counter over the rows: consecutive with an order (and, at scale, a partition key),
    unique but with gaps without one."""
    if order_by is None:
        return F.monotonically_increasing_id() + start
    w = Window.partitionBy(*partition_by).orderBy(order_by)
    return (F.row_number().over(w) + (start - 1)).cast("bigint")


@verb("resetSequence")
def reset_sequence(order_by, reset_key, to=0):
    """The counter starts anew at ``to`` for each value of the key."""
    return sequence(order_by, to, (reset_key,))
