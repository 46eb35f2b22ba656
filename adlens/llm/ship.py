"""Bring the package to the Python workers, whatever path the driver was started from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import adlens

_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Give executors this package once per application (as ``--py-files`` would)."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = os.path.dirname(os.path.abspath(adlens.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="adlens-package-"), "adlens_package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("adlens", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    _sent.add(app)
