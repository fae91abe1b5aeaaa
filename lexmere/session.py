"""Session helpers: the settings the library expects, and shipping the package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once an application, so that Python operators import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexmere-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for one machine, with the time zone and adaptive execution that the queries expect."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lexmere")
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
