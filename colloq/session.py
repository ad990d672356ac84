"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", name: str = "colloq", **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC time. ``conf`` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(master).appName(name).config(map=settings).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own (``spark.checkpoint.dir``, shared by all executors)
    if one is set, else a temporary one, which is right only where driver and executors share a machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="colloq-checkpoint-", dir=os.environ.get("TMPDIR"))
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; its lineage is cut, so a lost executor costs a re-read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Gives the package to the workers of this application, so that it need not be installed on every machine.
    Done once for each application; the archive is served by the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="colloq-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


_shipped: set[str] = set()
