"""Sending the package to Python workers that cannot import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession, root: Path) -> None:
    """Adds the package and the modules beside it to the session's files, once an application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    target = Path(tempfile.mkdtemp(prefix="ledgerloom-src-")) / "ledgerloom_src.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for p in sorted((root / "ledgerloom").rglob("*")):
            if p.suffix in (".py", ".json") and p.is_file():
                archive.write(p, p.relative_to(root))
        for p in root.glob("corpus_pipeline.py"):
            archive.write(p, p.name)
    spark.sparkContext.addPyFile(str(target))
    _sent.add(app)
