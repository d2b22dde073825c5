"""Readers: JSON, XML, CSV, fixed-width, flat (properties), YAML subset, native text, and
multi-record files.  Line formats are read by Spark's own scans; whole-document formats are
parsed in Arrow batches, one document a row, and come out as long-form rows or JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import try_coerce
from .native import NativeError, parse_document
from .yamlish import parse_yaml

LONG = "doc string, ord bigint, path string, type string, value string"


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Whole-file JSON values; without a schema it is inferred."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Attributes as @name, mixed text as _text; a declared schema fixes what repeats."""
    r = spark.read.format("xml").options(rowTag=row_tag, attributePrefix="@", valueTag="_text", nullValue="")
    return (r.schema(schema) if schema else r).load(path)


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, typed: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Strings first (short rows are padded with ""), then one type a column."""
    r = spark.read.options(sep=delimiter, header=header, multiLine=True, escape='"', emptyValue="", mode="PERMISSIVE")
    df = r.csv(path)
    if columns:
        df = df.toDF(*columns)
    df = df.na.fill("")
    return typed_columns(df) if typed else df


def typed_columns(df: DataFrame) -> DataFrame:
    """The narrowest type that all cells of a text column share; one pass for all columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    seen = df.agg(*[F.array_sort(F.collect_set(F.when(F.col(f"`{c}`") == "", "null").otherwise(try_coerce(F.col(f"`{c}`"))["type"]))).alias(c) for c in texts]).first()
    out = {}
    for c in texts:
        kinds = set(seen[c]) - {"null"}
        x = F.nullif(F.col(f"`{c}`"), F.lit(""))
        if kinds == {"integer"}:
            out[c] = x.try_cast("bigint")
        elif kinds and kinds <= {"integer", "number"}:
            out[c] = x.try_cast("double")
        elif kinds == {"boolean"}:
            out[c] = x == "true"
        elif kinds == {"date"}:
            out[c] = F.try_to_date(x, "yyyy-MM-dd")
    return df.withColumns(out) if out else df


def fixed_columns(spec: str) -> list[tuple[str, int, int]]:
    """"name:start:width;..." with 0-based starts."""
    return [(n, int(a), int(w)) for n, a, w in (p.split(":") for p in spec.strip().strip(";").split(";"))]


def read_fixed_width(spark: SparkSession, path: str, columns: str) -> DataFrame:
    lines = spark.read.text(path).filter(F.col("value") != "")
    return lines.select(*[F.rtrim(F.substring("value", a + 1, w)).alias(n) for n, a, w in fixed_columns(columns)])


def read_multi_record(spark: SparkSession, path: str, at: tuple[int, int] | None = None, field: int | None = None, delimiter: str = ",") -> DataFrame:
    """Lines with their record type: by position (start, length) or by a delimited field.
    Route a type with ``df.filter("record_type = 'X'")``."""
    lines = spark.read.text(path).filter(F.col("value") != "").withColumn("ord", F.monotonically_increasing_id())
    if at is not None:
        kind = F.btrim(F.substring("value", at[0] + 1, at[1]))
    elif field is not None:
        kind = F.btrim(F.get(F.split("value", r"\Q" + delimiter + r"\E", -1), F.lit(field)))
    else:
        raise ValueError("a discriminator by position or by field is needed")
    return lines.select("ord", kind.alias("record_type"), "value")


_PATH = re.compile(r"([^.\[\]]+)|\[(\d*)\]")


def set_path(root: dict, path: str, value) -> None:
    """a.b[0].c = value, with missing parents made and arrays padded with null."""
    steps = [(m.group(1) if m.group(1) is not None else (int(m.group(2)) if m.group(2) else -1)) for m in _PATH.finditer(path)]
    here = root
    for s, nxt in zip(steps, [*steps[1:], None], strict=True):
        if isinstance(s, int):
            s = len(here) if s == -1 else s
            while len(here) <= s:
                here.append(None)
        if nxt is None:
            here[s] = value
            return
        child = here[s] if isinstance(s, int) else here.get(s)
        if not isinstance(child, dict | list):
            child = [] if isinstance(nxt, int) else {}
            here[s] = child
        here = child


def scalar_of(s: str):
    if s == "~":
        return None
    if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'":
        return s[1:-1]
    if s in ("true", "false"):
        return s == "true"
    if re.fullmatch(r"[+-]?\d+", s):
        return int(s)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", s):
        return float(s)
    return s


def parse_flat(text: str) -> dict:
    """path=value lines; # and ; comments; ~ is null."""
    out: dict = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#;" and "=" in line:
            k, _, v = line.partition("=")
            set_path(out, k.strip(), scalar_of(v.strip()))
    return out


def _documents(spark: SparkSession, path: str, parse) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), "value")

    return parse_texts(files, parse)


def parse_texts(df: DataFrame, parse) -> DataFrame:
    """doc, json, _error of (doc, value) rows: a text that can't be parsed has null JSON and
    says why, it ends no job."""

    def one(t: str | None) -> tuple[str | None, str | None]:
        try:
            return json.dumps(parse(t or ""), ensure_ascii=False, default=str), None
        except Exception as e:  # noqa: BLE001  whatever a malformed text brings up
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [one(t) for t in b["value"]]
            yield pd.DataFrame({"doc": b["doc"], "json": [f[0] for f in found], "_error": [f[1] for f in found]})

    return df.select(F.col("doc").cast("string").alias("doc"), "value").mapInPandas(run, "doc string, json string, _error string")


def read_flat(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return typed_json(_documents(spark, path, parse_flat), schema)


def read_yaml(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return typed_json(_documents(spark, path, parse_yaml), schema)


def typed_json(df: DataFrame, schema: str | None) -> DataFrame:
    """doc, _error, and the columns of the schema or a VARIANT column ``value``."""
    return df.select("doc", "_error", F.from_json("json", schema).alias("v")).select("doc", "_error", "v.*") if schema else df.select("doc", "_error", F.parse_json("json").alias("value"))


def read_native(spark: SparkSession, path: str) -> DataFrame:
    """Long-form rows (doc, ord, path, type, value, modifiers) of native text documents."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("text"))
    return parse_native(files, "doc", "text")


def parse_native(df: DataFrame, doc: str, text: str) -> DataFrame:
    """The same for a text column.  A document that can't be parsed is one row of type
    ``error``: the place as path, the message as value, the code as modifiers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["doc"], b["text"], strict=True):
                try:
                    rows += [(d, i, *r) for i, r in enumerate(parse_document(t or ""))]
                except NativeError as e:
                    rows.append((d, 0, f"line {e.line}", "error", str(e), e.code))
            yield pd.DataFrame(rows, columns=["doc", "ord", "path", "type", "value", "modifiers"])

    return df.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text")).mapInPandas(run, LONG + ", modifiers string")


def auto(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """The reader of a format; the options hold for every format."""
    readers = {"json": read_json, "xml": read_xml, "csv": read_csv, "fixed-width": read_fixed_width, "flat": read_flat, "properties": read_flat, "yaml": read_yaml, "native": read_native, "parquet": lambda s, p: s.read.parquet(p)}
    return readers[kind](spark, path, **options)
