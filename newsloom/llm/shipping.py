"""Sends this package to the Python workers, as ``--py-files`` would."""

import os
import tempfile
import zipfile
from pathlib import Path

_shipped = set()


def ship(spark):
    """Once per application; nothing to do where the package itself came in an archive."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    _shipped.add(context.applicationId)
    # the driver serves this file to the executors
    archive = os.path.join(tempfile.mkdtemp(prefix="newsloom-"), "newsloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
