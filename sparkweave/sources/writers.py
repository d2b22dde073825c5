"""Writers and text formatters: JSON, XML, CSV, fixed-width, flat, YAML style, native."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import text
from .native import stringify

Layout = list[tuple[str, int, int, str, str]]  # name, position, length, pad, "left" or "right"


def _plain_numbers(c: Column, kind: T.DataType) -> Column:
    """Doubles as exact decimals where they are integral, so that they print as integers;
    the types of nested values follow.  Other values stay."""
    if isinstance(kind, T.StructType):
        parts = [_plain_numbers(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _plain_numbers(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.transform_values(c, lambda _, x: _plain_numbers(x, kind.valueType))
    if isinstance(kind, T.DoubleType | T.FloatType):
        d = c.cast("double")
        # a variant holds either kind of number
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        finite = ~F.isnan(d) & (F.abs(d) < float("inf"))
        return F.parse_json(F.when(whole, d.cast("bigint").cast("string")).when(finite, d.cast("string")))
    return c


def json_text(df: DataFrame, omit_nulls: bool = False, pretty: bool = False) -> DataFrame:
    """One JSON text a row; integral doubles print as integers, those that are no number as
    null.  Only numbers are rendered so, never what stands in a text."""
    row = F.struct(*[_plain_numbers(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    return df.select(F.to_json(row, {"ignoreNullFields": str(omit_nulls).lower(), "pretty": str(pretty).lower()}).alias("value"))


def write_json(df: DataFrame, path: str, omit_nulls: bool = False) -> None:
    json_text(df, omit_nulls).write.text(path)


def write_xml(df: DataFrame, path: str, root: str = "root", row: str = "row") -> None:
    df.write.format("xml").options(rootTag=root, rowTag=row, attributePrefix="@", valueTag="_text").save(path)


def xml_text(df: DataFrame, row: str = "row") -> DataFrame:
    return df.select(F.to_xml(F.struct(*df.columns), {"rowTag": row, "attributePrefix": "@", "valueTag": "_text"}).alias("value"))


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    df.write.options(sep=delimiter, header=header, quote='"', escape='"', emptyValue="").csv(path)


def csv_text(df: DataFrame, delimiter: str = ",") -> DataFrame:
    return df.select(F.to_csv(F.struct(*df.columns), {"sep": delimiter, "escape": '"'}).alias("value"))


def fixed_line(columns: Layout, width: int | None = None, pad: str = " ") -> Column:
    """Fields at their positions; values longer than their field are cut."""
    end = max([p + n for _, p, n, *_ in columns] + [width or 0])
    parts, at = [], 0
    for name, pos, n, fill, side in sorted(columns, key=lambda x: x[1]):
        if pos > at:
            parts.append(F.lit(pad * (pos - at)))
        s = F.coalesce(text(F.col(name)), F.lit(""))
        parts.append(F.lpad(F.substring(s, 1, n), n, fill) if side == "left" else F.rpad(F.substring(s, 1, n), n, fill))
        at = pos + n
    if end > at:
        parts.append(F.lit(pad * (end - at)))
    return F.concat(*parts)


def fixed_width_text(df: DataFrame, columns: Layout, width: int | None = None, pad: str = " ") -> DataFrame:
    return df.select(fixed_line(columns, width, pad).alias("value"))


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, column expression) of scalar fields, nested structs included."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += leaves(f.dataType, path + ".") if isinstance(f.dataType, T.StructType) else [(path, path)]
    return out


def flat_text(df: DataFrame, yaml: bool = False) -> DataFrame:
    """Sorted path=value lines of each row; null as ~."""
    sep = ": " if yaml else "="
    lines = [F.concat(F.lit(p + sep), F.coalesce(text(F.col(c)), F.lit("~"))) for p, c in sorted(leaves(df.schema))]
    return df.select(F.array_join(F.array(*lines), "\n").alias("value"))


def native_text(long: DataFrame, canonical: bool = False) -> DataFrame:
    """doc, value: the text of each document of long-form rows.  A document is bounded by
    the parser's limits, so it is gathered whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc": b["doc"], "value": [stringify([(r["path"], r["type"], r["value"], r["modifiers"]) for r in rows], canonical) for rows in b["rows"]]})

    grouped = long.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "path", "type", "value", "modifiers"))).alias("rows"))
    return grouped.mapInPandas(run, "doc string, value string")


def canonical_hash(long: DataFrame) -> DataFrame:
    return native_text(long, canonical=True).select("doc", F.sha2("value", 256).alias("hash"))


def wide(long: DataFrame, paths: list[str]) -> DataFrame:
    """A row for each document with stated paths as columns, for the tabular exports."""
    return long.filter(F.col("path").isin(paths)).groupBy("doc").pivot("path", paths).agg(F.first("value"))
