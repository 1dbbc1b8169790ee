"""Sends this package to the executors, for sessions whose workers cannot import it."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_sent: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Once per application. Spark's own file distribution carries the archive, so no shared folder is needed."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    if not _ROOT.joinpath("engramite").is_dir():
        return  # imported from an archive: it was shipped before
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in [*_ROOT.glob("engramite/**/*.py"), *_ROOT.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(_ROOT))
    folder = tempfile.mkdtemp(prefix="engramite-")  # on the driver, which serves the archive while it runs
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder, "engramite_package.zip")
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
