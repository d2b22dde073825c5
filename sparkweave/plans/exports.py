"""Long-form documents as nested JSON, CSV, XML and fixed-width text, and a builder for small ones.

A document is bounded by the parser's limits, so its rows are gathered; all but JSON stays in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.native import MARKS
from ..sources.readers import set_path
from ..sources.writers import Layout, fixed_line

LONG = "doc string, ord bigint, path string, type string, value string, modifiers string"


def typed(kind: str, value: str | None):
    if value is None or kind == "null":
        return None
    if kind == "integer":
        return int(value)
    if kind in ("number", "percent"):
        x = float(value)
        return int(x) if x.is_integer() and abs(x) < 1e15 else x
    if kind == "currency":
        return float(value.split(":")[0])
    return value == "true" if kind == "boolean" else value


def to_json(long: DataFrame, pretty: bool = False) -> DataFrame:
    """doc, value: one JSON text a document; metadata paths ($...) stay out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rows in b["rows"]:
                tree: dict = {}
                for r in rows:
                    if not r["path"].startswith("$"):
                        set_path(tree, r["path"], typed(r["type"], r["value"]))
                out.append(json.dumps(tree, ensure_ascii=False, indent=2 if pretty else None))
            yield pd.DataFrame({"doc": b["doc"], "value": out})

    rows = F.array_sort(F.collect_list(F.struct("ord", "path", "type", "value")))
    return long.groupBy("doc").agg(rows.alias("rows")).mapInPandas(run, "doc string, value string")


def shown(raw: bool = False) -> Column:
    """Text of a value: numbers as written (``raw``) or in shortest form, references and binary
    values with their sign; null where there is none."""
    value = F.when(F.col("type") == "currency", F.split_part("value", F.lit(":"), F.lit(1))).otherwise(F.col("value"))
    d = value.try_cast("double")
    short = F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("bigint").cast("string")).otherwise(d.cast("string"))
    number = F.col("type").isin("number", "currency", "percent") & d.isNotNull()
    return (
        F.when(F.col("type") == "null", F.lit(None).cast("string")).when(F.col("type") == "reference", F.concat(F.lit("@"), value)).when(F.col("type") == "binary", F.concat(F.lit("^"), value))
        .when(number & F.lit(not raw), short).otherwise(value)
    )


def to_csv(long: DataFrame, delimiter: str = ",", header: bool = True, array_path: str | None = None) -> DataFrame:
    """doc, value: a CSV text a document.  Its rows are the items of the array at
    ``array_path`` (else of the first array of records), under the union of their fields in
    order of appearance; without such items, one row of all plain paths.  A document without
    any gives an empty text."""
    quoted = lambda x: F.when(F.contains(x, F.lit(delimiter)) | x.rlike('["\n\r]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    item = r"^(.+?)\[(\d+)\]\.(.+)$"
    part = lambda k: F.when(F.col("path").rlike(item), F.regexp_extract("path", item, k))
    doc = Window.partitionBy("doc")
    of = F.lit(array_path) if array_path is not None else F.first("prefix", ignorenulls=True).over(doc.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cells = long.select("doc", "ord", "path", shown().alias("v"), part(1).alias("prefix"), part(2).cast("int").alias("index"), part(3).alias("name")).withColumn("of", of)
    some = F.coalesce(F.max(F.col("prefix") == F.col("of")).over(doc), F.lit(False))
    plain = ~F.startswith("path", F.lit("$")) & ~F.contains("path", F.lit("["))
    at = F.when(some, F.when(F.col("prefix") == F.col("of"), F.col("index"))).when(plain, 0)
    cells = cells.withColumn("row", at).withColumn("name", F.when(some, F.col("name")).otherwise(F.col("path")))
    rows = cells.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "v"))).alias("cells"))
    docs = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.when(F.col("row").isNotNull(), F.struct("row", "cells")))).alias("rows"))
    docs = docs.withColumn("names", F.array_distinct(F.flatten(F.transform("rows", lambda x: x["cells"]["name"]))))
    line = lambda x: F.array_join(F.transform("names", lambda n: F.coalesce(quoted(F.try_element_at(x, n)), F.lit(""))), delimiter)
    pairs = lambda x: F.map_from_entries(F.transform(x["cells"], lambda y: F.struct(y["name"], y["v"])))
    lines = F.transform("rows", lambda x: line(pairs(x)))
    if header:
        lines = F.concat(F.array(F.array_join(F.transform("names", quoted), delimiter)), lines)
    return docs.select("doc", F.when(F.size("rows") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("").alias("value"))


def to_xml(long: DataFrame, root: str = "root", types: bool = False, modifiers: bool = False, prefix: str = "doc", uri: str = "urn:document") -> DataFrame:
    """doc, value: an XML text a document.  Paths without a dot come first, then one element
    for each first part of a path, in order of appearance; nulls and metadata stay out.
    ``types`` adds type hints, ``modifiers`` these and the modifiers, as attributes of the
    namespace ``uri``."""
    types = types or modifiers
    text = shown(raw=True)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    dotted = F.instr("path", ".") > 1
    field = F.when(dotted, F.regexp_extract("path", r"(?s)^[^.]+\.(.*)$", 1)).otherwise(F.col("path"))
    name = F.when(field.rlike("^[0-9]"), F.concat(F.lit("_"), field)).otherwise(F.translate(field, " []", "___"))
    hints = F.lit("")
    if types:
        attribute = lambda k, v: F.concat(F.lit(f' {prefix}:{k}="'), v, F.lit('"'))
        code = F.split_part("value", F.lit(":"), F.lit(2))
        hints = F.concat(F.when(F.col("type") != "string", attribute("type", F.col("type"))).otherwise(""), F.when((F.col("type") == "currency") & (code != ""), attribute("currencyCode", code)).otherwise(""))
        if modifiers:
            hints = F.concat(hints, *[F.when(F.contains(F.coalesce("modifiers", F.lit("")), F.lit(k)), attribute(k, F.lit("true"))).otherwise("") for k in MARKS])
    section = F.when(dotted, F.split_part("path", F.lit("."), F.lit(1)))
    element = F.concat(F.when(dotted, "    ").otherwise("  "), F.lit("<"), name, hints, F.lit(">"), text, F.lit("</"), name, F.lit(">\n"))
    cells = long.select("doc", "ord", section.alias("section"), F.when(~F.startswith("path", F.lit("$")), element).alias("line"), F.startswith("path", F.lit("$")).alias("meta"))
    parts = cells.groupBy("doc", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("ord", "line")))), lambda x: x["line"]), "").alias("body"), F.min(F.when(~F.col("meta"), F.col("ord"))).alias("first"))
    whole = F.when(F.col("section").isNull(), F.col("body")).otherwise(F.concat(F.lit("  <"), "section", F.lit(">\n"), "body", F.lit("  </"), "section", F.lit(">\n")))
    ordered = F.array_sort(F.collect_list(F.when(F.col("first").isNotNull(), F.struct(F.col("section").isNotNull().alias("later"), "first", whole.alias("text")))))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}' + (f' xmlns:{prefix}="{uri}"' if types else "") + ">\n"
    return parts.groupBy("doc").agg(F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda x: x["text"]), ""), F.lit(f"</{root}>\n")).alias("value"))


def to_fixed_width(long: DataFrame, columns: Layout, width: int, pad: str = " ") -> DataFrame:
    """doc, value: one line of ``width`` characters a document; ``columns`` name paths.
    Absent and null values are filled, longer ones cut."""
    paths = [p for p, *_ in columns]
    wide = long.groupBy("doc").agg(*[F.max(F.when(F.col("path") == p, shown())).alias(f"f{k}") for k, p in enumerate(paths)])
    layout = [(f"f{k}", *rest) for k, (_, *rest) in enumerate(columns)]
    return wide.select("doc", F.substring(fixed_line(layout, width, pad), 1, width).alias("value"))


class Builder:
    """``Builder("d").set("a.b", 1).set("c", "x").frame(spark)``."""

    def __init__(self, doc: str):
        self.doc, self.rows = doc, {}

    def set(self, path: str, value, modifiers: str = "") -> Builder:
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "number" if isinstance(value, float) else "string"
        self.rows[path] = (kind, None if value is None else str(value).lower() if kind == "boolean" else str(value), modifiers)
        return self

    def without(self, path: str) -> Builder:
        self.rows.pop(path, None)
        return self

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.doc, i, p, *v) for i, (p, v) in enumerate(self.rows.items())], LONG)
