"""Session settings the jobs rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # events.ts has no zone and received_at has one: casts need a fixed zone.
    "spark.sql.session.timeZone": "UTC",
    # JSON objects with a repeated key keep the last value instead of failing.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # HotSpot never compiles a method above 8,000 bytes of bytecode. A stage whose fused method
    # would be larger runs faster as separate, smaller generated operators.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job assumes; safe to call repeatedly."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Reliable folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a session without that setting
    (a test on one machine) gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if configured is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = context.getCheckpointDir()
    return configured or current


def new_run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one; none is ever reused."""
    return f"{shared_dir(spark).rstrip('/')}/provenant-{label}-{uuid.uuid4().hex}"
