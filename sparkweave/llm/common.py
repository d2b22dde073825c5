"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import threading
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import remove, shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Tables written by this thread; operators in other threads have lists of their own.
_mine = threading.local()
_all: list[list[tuple[SparkSession, str]]] = []


def _scratch() -> list[tuple[SparkSession, str]]:
    if not hasattr(_mine, "tables"):
        _mine.tables = []
        _all.append(_mine.tables)
    return _mine.tables


_shipped: list[object] = []


def ship(df: DataFrame) -> DataFrame:
    """Make this library importable in the Python workers of the session."""
    sc = df.sparkSession.sparkContext
    if not any(x is sc for x in _shipped):
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="sparkweave-")) / "sparkweave.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        _shipped[:] = [sc]
    return df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII values take the built-in byte path; the
    others go through ``translate``, which leaves É, Ä and the like alone."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def cut(df: DataFrame, tag: str, rows: int | None = None, per: int = 250_000) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives
    lost executors, and drops the partitioning so that a later join can split skew.
    ``rows``, a bound on its rows where one is known: tables with few rows for a shuffle's
    partitions are written by fewer tasks (one for each ``per`` rows, sixteen at least)."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(16, -(-rows // per)))
    path = f"{shared_dir(spark)}/sparkweave-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    _scratch().append((spark, path.rsplit("/", 1)[0]))
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkweave_path = path
    return out


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so when the plans
    that made them are garbage, which an idle driver may not notice for half an hour."""
    gc.collect()
    spark._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later plan reads."""
    for t in tables:
        path = t._sparkweave_path.rsplit("/", 1)[0]
        remove(t.sparkSession, path)
        _scratch()[:] = [x for x in _scratch() if x[1] != path]


def mark() -> int:
    """The place in the list of written tables from which ``release`` deletes."""
    return len(_scratch())


def release(since: int, *kept: DataFrame) -> None:
    """Delete the tables written since ``mark`` but those that the result reads."""
    stay = {t._sparkweave_path.rsplit("/", 1)[0] for t in kept}
    own = _scratch()
    for spark, path in own[since:]:
        if path not in stay:
            remove(spark, path)
    own[since:] = [x for x in own[since:] if x[1] in stay]


@atexit.register
def _sweep() -> None:
    for spark, path in (x for own in _all for x in own):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = f"_{name}"
    while out.lower() in taken:
        out = "_" + out
    return out


def same(a: list[Column], b: list[Column]) -> Column:
    """Null-safe equality of two key lists."""
    return reduce(lambda x, y: x & y, [p.eqNullSafe(q) for p, q in zip(a, b, strict=True)])


def bucket_of(c: Column, *more: Column, mod: int, least: int = 0) -> Column:
    return F.pmod(F.xxhash64(c, *more), F.lit(mod)).cast("int") + least


def crc_mod5(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5
