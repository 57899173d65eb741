"""Getting this package to the Python workers of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the files of the session's application, once."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="amountlake-")  # served from there as long as the application runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*")):
            if file.is_file() and "__pycache__" not in file.parts:
                out.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(str(path))
