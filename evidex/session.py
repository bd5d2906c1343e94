"""The session the engine expects, and shipping the package to the workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: UTC everywhere, adaptive plans with skewed joins split, and the later of two equal map keys kept.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

_shipped: set[str] = set()


def session(name: str = "evidex", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the workers, once an application, so that it needn't be on their path, and gives a session made elsewhere the SETTINGS that results depend on."""
    for name in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        if spark.conf.get(name) != SETTINGS[name]:
            spark.conf.set(name, SETTINGS[name])
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="evidex-")) / "evidex"), "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark
