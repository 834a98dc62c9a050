"""Sending this package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()
_kept: list[tempfile.TemporaryDirectory] = []


def ship(spark: SparkSession) -> None:
    """In local mode, add the package to the session's Python files, once per application.

    On a cluster it is given to ``--py-files`` or installed on the nodes, as usual.
    """
    context = spark.sparkContext
    in_process = context.master.startswith("local") and not context.master.startswith("local-cluster")
    if not in_process or context.applicationId in _sent:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.dirname(package)
    # Tasks compare their copy with this file, so it stays until the driver's Python ends.
    folder = tempfile.TemporaryDirectory()
    _kept.append(folder)
    path = os.path.join(folder.name, "redactlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for at, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    archive.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), base))
    context.addPyFile(path)
    _sent.add(context.applicationId)
