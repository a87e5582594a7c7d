"""Tables that cut lineage, and splits of ids that every operator makes alike."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.session import new_folder


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """``rows`` written below the folder that all executors share, and read again.

    Cuts the lineage like a reliable checkpoint, keeps columns apart on disk and
    survives lost executors.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, purpose)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


_shipped: set[str] = set()


def ship_library(spark: SparkSession) -> None:
    """Sends this library to the Python workers, as ``--py-files`` would, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tracewarden-")) / "tracewarden_lib.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_library(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text (fold 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def share(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the given values only."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)
