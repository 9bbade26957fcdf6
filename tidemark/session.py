"""Session helpers."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import SparkSession


def local_session(app: str = "tidemark", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and measurements."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as set by ``spark.checkpoint.dir``.

    Only a single-machine session may go without that setting; it gets a new
    temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _own_dir(spark.conf.get("spark.app.id", "local"))


@functools.lru_cache(maxsize=None)
def _own_dir(app_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"tidemark-{app_id}-")
