"""tapeworks: Spark jobs over prediction-market trade tapes and training-data corpora."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


#: Rows and bytes of an Arrow batch: texts are long, and a worker holds a batch in several forms.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def distribute(spark: SparkSession) -> SparkSession:
    """Sends this package to the session's Python workers, once for each application.

    Also sets the rows and bytes of an Arrow batch to `BATCH_ROWS` and `BATCH_BYTES`, unless the session has values of its own.
    """
    app = spark.sparkContext.applicationId
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").startswith(str(64 << 20)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    if app not in _SHIPPED:
        here = Path(__file__).parent
        to = Path(tempfile.mkdtemp(prefix="tapeworks-py-")) / "tapeworks.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f"tapeworks/{f.relative_to(here)}")
        spark.sparkContext.addPyFile(str(to.resolve()))
        env = spark.sparkContext.environment  # for the Python processes that the driver starts itself
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), str(to.resolve())]))
        _SHIPPED.add(app)
    return spark
