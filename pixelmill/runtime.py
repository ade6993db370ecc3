"""Getting the package to the Python workers, cutting lineage, and names for helper columns."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a session, so that kernels import there without installation."""
    sc = spark.sparkContext
    if getattr(sc, "_pixelmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="pixelmill-")) / "pixelmill.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("pixelmill") / p.relative_to(root))
    sc.addPyFile(str(target))
    sc._pixelmill_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one in the warehouse where that is unset and
    the warehouse is no folder of one machine among several."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not sc.master.startswith("local") and (warehouse.startswith("file:") or ":" not in warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{warehouse}/_pixelmill"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that what follows neither repeats nor loses it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    prefix = "_"
    while any(f"{prefix}{n}" in taken for n in names):
        prefix += "_"
    return [f"{prefix}{n}" for n in names]
