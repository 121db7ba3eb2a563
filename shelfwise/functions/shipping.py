"""Make the package importable in Python workers that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence

from pyspark.sql import SparkSession

_sent: set[tuple[str, str]] = set()


def ship(spark: SparkSession, packages: Sequence[str] = ("shelfwise",)) -> None:
    """Send the packages' source files to all workers, once per application and package.

    Needed where neither the workers' installation nor their path has them. The archive is served by
    the driver, so no folder is shared.
    """
    application = spark.sparkContext.applicationId
    for name in packages:
        if (application, name) in _sent:
            continue
        root = os.path.dirname(os.path.abspath(__import__(name).__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{name}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, files in sorted(os.walk(root)):
                for file in sorted(files):
                    if file.endswith(".py"):
                        path = os.path.join(folder, file)
                        out.write(path, os.path.relpath(path, os.path.dirname(root)))
        spark.sparkContext.addPyFile(archive)
        _sent.add((application, name))
