"""Encoding, hashing, URL and JSON verbs."""

from __future__ import annotations

import hashlib
import hmac as _hmac
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import col, let, value_of, verb
from .scalar import text


def utf8(x) -> Column:
    return F.encode(text(x), "UTF-8")


@verb("base64Encode")
def base64_encode(s):
    return F.base64(utf8(s))


@verb("base64Decode")
def base64_decode(s):
    plain = F.rtrim(F.translate(col(s), "-_", "+/"), F.lit("="))
    padded = F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, F.lit("="))
    return F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")


@verb("urlEncode")
def url_encode(s):
    return F.replace(F.replace(F.url_encode(text(s)), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))


@verb("urlDecode")
def url_decode(s):
    return F.try_url_decode(col(s))


JSON_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


@verb("jsonEncode")
def json_encode(x, nested: bool = False):
    """JSON of an object or array (``nested``: the column is one), else escaped text."""
    if nested:
        return F.coalesce(F.to_json(col(x), {"ignoreNullFields": "false"}), F.lit("null"))
    out = text(x)
    for a, b in JSON_ESCAPES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.coalesce(out, F.lit("null"))


@verb("jsonDecode")
def json_decode(s, schema: str | None = None):
    """A typed value with a schema, else VARIANT; malformed text gives null."""
    return F.from_json(col(s), schema) if schema else F.try_parse_json(col(s))


@verb("hexEncode")
def hex_encode(s):
    return F.lower(F.hex(utf8(s)))


@verb("hexDecode")
def hex_decode(s):
    return F.when(col(s).rlike("^([0-9A-Fa-f]{2})*$"), F.decode(F.unhex(col(s)), "UTF-8"))


@verb("sha256")
def sha256(s):
    return F.sha2(utf8(s), 256)


@verb("sha1")
def sha1(s):
    return F.sha1(utf8(s))


@verb("sha512")
def sha512(s):
    return F.sha2(utf8(s), 512)


@verb("md5")
def md5(s):
    return F.md5(utf8(s))


@verb("crc32")
def crc32(s):
    return F.lpad(F.lower(F.hex(F.crc32(utf8(s)))), 8, "0")


@verb("base64urlEncode")
def base64url_encode(s):
    return F.rtrim(F.translate(F.base64(utf8(s)), "+/", "-_"), F.lit("="))


@verb("base64urlDecode")
def base64url_decode(s):
    return F.when(col(s).rlike("^[A-Za-z0-9_=-]*$"), base64_decode(s))


def hmac_udf(algorithm: str):
    @F.pandas_udf("string")
    def run(message: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([None if m is None or k is None else _hmac.new(k.encode(), m.encode(), getattr(hashlib, algorithm)).hexdigest() for m, k in zip(message, key, strict=True)])

    return run


@verb("hmac")
def hmac(message, key, algorithm="sha256"):
    """No built-in HMAC: an Arrow-batched function; of two constants, one value."""
    a = value_of(algorithm).lower().replace("-", "")
    if isinstance(message, str) and isinstance(key, str) and a in ("sha1", "sha256", "sha512", "md5"):
        return F.lit(_hmac.new(key.encode(), message.encode(), getattr(hashlib, a)).hexdigest())
    return hmac_udf(a)(text(message), text(key)) if a in ("sha1", "sha256", "sha512", "md5") else F.lit(None).cast("string")


def _plus(s: Column) -> Column:
    return F.try_url_decode(s)


@verb("parseQuery")
def parse_query(s):
    """Sorted map of the first value of each key."""
    pairs = F.filter(F.split(F.regexp_replace(col(s), r"^\?", ""), "&"), lambda p: p != "")
    entry = F.transform(pairs, lambda p: F.struct(_plus(F.substring_index(p, "=", 1)).alias("key"), F.when(F.contains(p, F.lit("=")), _plus(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("value")))
    keys = lambda entry: F.array_sort(F.array_distinct(F.transform(entry, lambda e: e["key"])))
    first = lambda entry, k: F.element_at(F.filter(entry, lambda e: e["key"] == k), 1)["value"]
    return let(entry, lambda entry: F.map_from_entries(F.transform(keys(entry), lambda k: F.struct(k, first(entry, k)))))


def map_text(entries: Column) -> Column:
    """key=value&key=value of entries, keys sorted, nulls dropped."""
    kept = F.filter(F.array_sort(entries), lambda e: e["value"].isNotNull())
    return F.array_join(F.transform(kept, lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"].cast("string")))), "&")


@verb("buildQuery")
def build_query(m):
    return map_text(F.map_entries(col(m)))


@verb("parseUrl")
def parse_url(u):
    u = col(u)
    get = lambda part: F.try_parse_url(u, F.lit(part))
    authority = get("AUTHORITY")
    return F.struct(
        get("PROTOCOL").alias("scheme"), get("HOST").alias("host"), F.when(authority.rlike(r":\d+$"), F.regexp_extract(authority, r":(\d+)$", 1).try_cast("int")).alias("port"),
        get("PATH").alias("path"), parse_query(get("QUERY")).alias("query"), get("REF").alias("fragment"),
    )


@verb("buildUrl")
def build_url(parts):
    """From a struct with scheme, host and optional port, path, query (map), fragment."""
    p = col(parts)
    query = F.when(F.size(p["query"]) > 0, F.concat(F.lit("?"), map_text(F.map_entries(p["query"])))).otherwise("")
    path = F.coalesce(F.when(p["path"].startswith("/") | (p["path"] == ""), p["path"]).otherwise(F.concat(F.lit("/"), p["path"])), F.lit(""))
    return F.when(
        p["scheme"].isNotNull() & p["host"].isNotNull(),
        F.concat(p["scheme"], F.lit("://"), p["host"], F.coalesce(F.concat(F.lit(":"), p["port"].cast("string")), F.lit("")), path, F.coalesce(query, F.lit("")), F.coalesce(F.concat(F.lit("#"), p["fragment"]), F.lit(""))),
    )


@verb("stableStringify")
def stable_stringify(x, fields: tuple[str, ...] | None = None):
    """JSON with sorted keys: of a map, or of the named fields of a struct."""
    x = col(x)
    if fields is not None:
        return F.to_json(F.struct(*[x[f].alias(f) for f in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(x))))


@verb("canonicalHash")
def canonical_hash(x, fields: tuple[str, ...] | None = None):
    return F.sha2(stable_stringify(x, fields), 256)


@verb("jsonPath")
def json_path(s, path):
    """Dotted names and [n]; null if absent."""
    p = value_of(path)
    return F.get_json_object(col(s), p if p.startswith("$") else "$" + ("" if p.startswith("[") else ".") + re.sub(r"^\.", "", p))
