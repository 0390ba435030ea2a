"""Python workers need this package to run its functions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to all Python workers of the application, once; operators that run Python call it.

    Workers that have the package on their own path would do without, but on a cluster nothing says that they have. The driver
    serves the archive; executors that come later fetch it too.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).parent.parent
    folder = Path(tempfile.mkdtemp(prefix="millrace-code-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / f"{package.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(folder / f"{package.name}.zip"))
    _shipped.add(app)
