"""Make this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark) -> None:
    """Give the executors a zip of the package unless their PYTHONPATH holds it already."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == str(ROOT):
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="loom-ship-")) / "corpusloom_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "corpusloom").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark) -> str:
    """The folder all executors share, from spark.checkpoint.dir; one of our own only where the session names none."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known:
        if not found.isDefined():
            spark.sparkContext.setCheckpointDir(known)
        return known
    if not found.isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loom-checkpoint-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def cut(df):
    """df written to the shared folder, its lineage forgotten."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
