"""Session-level helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once an application, so that their Python workers can import it wherever they
    run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="parolis-"), "parolis.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name, f.relative_to(root)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``). Where none is set a local master gets a local one; on
    a cluster that is an error, as other machines could not read it."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    chosen = spark.conf.get("spark.checkpoint.dir", None)
    if not chosen:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        chosen = os.path.join(tempfile.gettempdir(), "parolis-checkpoints")
    sc.setCheckpointDir(chosen)
    return chosen


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that it survives the loss of an executor and is
    computed once although several branches of the plan read it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def to_ms(seconds):
    """Seconds (double) to whole milliseconds (bigint); null and NaN give null."""
    return F.when(~F.isnan(seconds), F.round(seconds * 1000)).cast("bigint")
