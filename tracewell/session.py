"""The session that the library expects: UTC, adaptive plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "tracewell", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` overrides (``__`` stands for a dot)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path that driver and executors share, from ``spark.checkpoint.dir``.

    Where that isn't set, a local master gets a temporary folder; a cluster gets an error.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tracewell-"))
        top = f"file://{_own[0]}"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
