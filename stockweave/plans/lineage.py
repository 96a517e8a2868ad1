"""Cutting a plan so that several later jobs read a stored result, not the whole lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in `spark.checkpoint.dir`, which every executor reaches.

    Where a local session names none, as in tests, it is a folder of our own in the warehouse. A
    cluster's warehouse may lie on the driver's disk, so there a name is needed.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    return named.rstrip("/") if named else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stockweave-cuts"


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    The stored table survives lost executors, is read by column, and has a known size, so later
    joins are planned on real statistics. It is deleted with `drop_cuts` or when the driver ends.
    """
    path = f"{shared_folder(df.sparkSession)}/stockweave-cut-{uuid4().hex}"
    df.write.parquet(path)
    _made.add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Make this package importable on the executors unless PYTHONPATH names it already."""
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_stockweave_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="stockweave-code-"), "stockweave.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted((root / "stockweave").rglob("*.py")):
            z.write(path, path.relative_to(root))
    context.addPyFile(archive)
    context._stockweave_shipped = True


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _made.discard(path)


def drop_cuts(spark: SparkSession) -> None:
    """Delete every table that `cut` has stored; call it when no frame made from them is read again."""
    for path in list(_made):
        delete(spark, path)


def _at_end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            drop_cuts(spark)
        except Exception:  # noqa: BLE001 - the JVM may be gone by now; then the files stay
            _made.clear()


atexit.register(_at_end)
