"""The Spark session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with this engine's settings; on a cluster, master and sizes come from the submitting command."""
    b = SparkSession.builder.appName("kashida").config(map=SETTINGS | settings)
    return (b.master(master) if master else b).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the workers, once a session: they need not find it by path or working directory."""
    sc = spark.sparkContext
    if getattr(sc, "_kashida", None) is None:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="kashida-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(path := os.path.join(folder, "kashida.zip"), "w") as z:
            for at, _, names in os.walk(here):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(at, n), os.path.join("kashida", os.path.relpath(os.path.join(at, n), here)))
        sc.addPyFile(path)
        sc._kashida = path
    return spark
