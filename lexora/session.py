"""Session with the settings the engine is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "lexora", cores: int | str | None = None, shuffle_partitions: int | None = None, driver_memory: str = "8g") -> SparkSession:
    """A local session for development and tests; on a cluster the master and
    memory come from spark-submit and only the SQL settings matter."""
    cores = cores or os.cpu_count() or 4
    shuffle_partitions = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run, by
    sending it once per application."""
    import tempfile
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if getattr(sc, "_lexora_shipped", False):
        return
    # Spark fetches it lazily, so the archive has to stay
    archive = Path(tempfile.mkdtemp(prefix="lexora-")) / "lexora_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._lexora_shipped = True
