"""Session settings and the shared working folder.

Everything the library writes (logs, stream checkpoints, stream inputs built
for tests) goes under the folder the cluster names in ``spark.checkpoint.dir``.
That folder is shared by all executors on a real cluster. Where the setting is
absent, a machine-local temporary folder is created on ``local[...]`` masters
only, as in tests; on any other master that is an error.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on. AQE re-plans joins from runtime sizes
# (broadcast only when the observed side is small), splits skewed join
# partitions, and coalesces small shuffle partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # When every shuffled partition of one join side fits this size, AQE
    # hash-joins instead of sort-merging, so the big side is never sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


# Set only when a session starts. Checkpoint files (the ``keys`` join
# strategy checkpoints its answers) are removed once their DataFrame is
# garbage collected, so a long stream does not pile them up.
CORE_CONF = {
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    app: str = "parlance",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings above; the UI stays off."""
    b = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    for k, v in {**SCALE_CONF, **CORE_CONF}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def apply_conf(spark: SparkSession, overwrite: bool = False) -> None:
    """Set the settings above on an existing session; by default only the
    ones the session does not set itself."""
    for k, v in SCALE_CONF.items():
        if overwrite or spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one is made only if it is unset
    and driver and executors are one process (``local``, ``local[...]``)."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session has no context
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master or ""):
            raise RuntimeError(
                f"spark.checkpoint.dir is not set (master {master!r}); name a folder "
                "that the driver and all executors share"
            )
        configured = tempfile.mkdtemp(prefix="parlance-ckpt-")
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for code that needs a plain local path."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.normpath(path)
