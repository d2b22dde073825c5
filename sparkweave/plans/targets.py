"""Where a transform's segments go: one folder of files a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import writers
from .language import TransformError

KNOWN = ("json", "xml", "csv", "fixed-width", "flat", "properties", "yaml", "parquet")


def visible(df: DataFrame) -> DataFrame:
    """The fields alone: no document key, loop position or error column."""
    return df.select(*[c for c in df.columns[1:] if not c.startswith("_")])


def text_of(df: DataFrame, target: str, **options) -> DataFrame:
    """One text a row in a target's format."""
    rows = visible(df)
    if target == "json":
        return writers.json_text(rows, **options)
    if target == "xml":
        return writers.xml_text(rows, **options)
    if target == "csv":
        return writers.csv_text(rows, **options)
    if target == "fixed-width":
        return writers.fixed_width_text(rows, **options)
    if target in ("flat", "properties", "yaml"):
        return writers.flat_text(rows, yaml=target == "yaml")
    raise TransformError("T006", f"unknown target {target}")


def write(outputs: dict[str, DataFrame], target: str, folder: str, **options) -> None:
    """Order inside a segment is that of its loops, kept by range partitions."""
    if target not in KNOWN:
        raise TransformError("T006", f"unknown target {target}")
    for name, df in outputs.items():
        keys = [df.columns[0], *[c for c in df.columns if c.startswith("_ord")]]
        ordered = df.orderBy(*map(F.col, keys))
        if target == "parquet":
            visible(ordered).write.parquet(f"{folder}/{name}")
        elif target == "csv":
            writers.write_csv(visible(ordered), f"{folder}/{name}", **options)
        else:
            text_of(ordered, target, **options).write.text(f"{folder}/{name}")
