"""Helpers shared by the training-data operators: tables, columns, scratch tables."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, forget, release, scratch_root, settled  # noqa: F401

#: A word of the shingle operators: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent.parent
    if package.is_dir():  # else it was sent as an archive already
        archive = Path(tempfile.mkdtemp(prefix="recordloom-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))  # Spark serves it from the driver


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone, as the contracts ask."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """The lower-cased words of a text; an empty array for null or blank text."""
    text = F.coalesce(ascii_lower(c), F.lit(""))
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
