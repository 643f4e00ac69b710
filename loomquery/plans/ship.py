"""Send this package to the executors, for the plans that run Python there."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from loomquery.plans.tables import own_dir

#: Bytes of an Arrow batch at most (unless the session sets its own): a Python worker's memory follows this, not 10,000 rows of any length.
BATCH_BYTES, _ARROW = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once per application, by way of the shared folder; bound Arrow batches."""
    sc = spark.sparkContext
    if sc._jsc.sc().conf().get(_ARROW, "") == "":
        spark.conf.set(_ARROW, str(BATCH_BYTES))
    if sc.applicationId in _sent:
        return
    root, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    name = f"{own_dir(spark)}/loomquery_package.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(name)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(name)
    _sent.add(sc.applicationId)

