"""Session settings for local runs, and the shared scratch folder of a session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int = 8, app: str = "salience") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the launcher makes the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the session's checkpoint folder.

    ``spark.checkpoint.dir`` names a folder every executor can reach. Only a session that leaves it unset,
    as local tests do, gets a temporary folder, which is then remembered in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.salience.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors reach")
        root = tempfile.mkdtemp(prefix="salience-")
        spark.conf.set("spark.salience.scratch", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session, once."""
    if spark.conf.get("spark.salience.shipped", None):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="salience-"), "salience.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("salience", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("spark.salience.shipped", "true")
