"""Session defaults of the library."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", name: str = "veridict") -> SparkSession:
    """A local session with the settings that tests and benchmarks use.

    On a cluster, make the session as usual: adaptive execution on (Spark's
    default), time zone UTC, and ``spark.checkpoint.dir`` on shared storage.
    """
    parts = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
