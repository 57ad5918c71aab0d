"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lamina")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_lamina_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="lamina-code-")) / "lamina_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(ROOT.rglob("*.py")):
            out.write(path, f"lamina/{path.relative_to(ROOT)}")
    context.addPyFile(str(target))
    context._lamina_shipped = True
