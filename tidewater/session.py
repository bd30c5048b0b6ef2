"""Session helpers: a local session for tests/bench, and shared-folder lookup.

Library code never creates its own session; it receives one. The helpers
here only read settings from the session and, where a setting is unset (as
in tests on a laptop), fill in a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SCRATCH_CONF = "spark.tidewater.scratch.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tidewater") -> SparkSession:
    """A local session configured the way the tests and bench expect."""
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.local.dir", os.path.join(scratch, "local"))
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # the checkpoint folder comes from the configuration (spark-defaults or
    # --conf); only when none is configured is a fresh local one used
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    Only when the session names none (a local run) is a fresh folder made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/checkpoints"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared scratch root for written tables.

    The root is ``spark.tidewater.scratch.dir`` if set, else the checkpoint
    folder, so on a cluster it lives on shared storage.
    """
    root = spark.conf.get(SCRATCH_CONF, None)
    if not root:
        root = checkpoint_dir(spark).rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
