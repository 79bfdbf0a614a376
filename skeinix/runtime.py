"""What a session needs so that executors can run this package's Python functions."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch to a Python worker, where the session has no setting of its own: batches of long texts then stay small on both sides.
BATCH_BYTES, _BATCH = str(4 << 20), "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULT = "67108864b"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once an application; it costs nothing where they have it already."""
    if spark.sparkContext.getConf().get(_BATCH) is None and spark.conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        spark.conf.set(_BATCH, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        at = os.path.join(tempfile.mkdtemp(prefix="skeinix-ship-"), "skeinix-package.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(at)
        _SHIPPED.add(app)
    return spark
