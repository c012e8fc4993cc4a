"""Session settings and shipping of this package to the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("panelloom")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per context, for functions that run in Python workers."""
    sc = spark.sparkContext
    home = Path(__file__).resolve().parent
    if getattr(sc, "_panelloom_shipped", False) or not home.is_dir():
        return
    to = Path(tempfile.mkdtemp(prefix="panelloom-")) / "tree"
    shutil.copytree(home, to / home.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(to.parent / home.name), "zip", to))
    sc._panelloom_shipped = True
