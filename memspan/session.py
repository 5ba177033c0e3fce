"""Session settings shared by the benchmark, the command line and the tests."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", app: str = "memspan", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` entries override the defaults."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context: their Python workers need it
    wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_memspan_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="memspan-")) / "memspan.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(Path(root.name) / path.relative_to(root)))
    context.addPyFile(str(target))
    context._memspan_shipped = True
