"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one group that a single task may be asked to order or buffer. Groups above it are split.
HOT_GROUP_ROWS = 2_000_000
#: Rows a table may have to be broadcast by hint; larger ones are left to Spark's own size checks.
BROADCAST_ROWS = 100_000


def hot_group_rows(spark: SparkSession) -> int:
    """The group size above which groups are split; ``rulespan.hotGroupRows`` overrides the default."""
    return int(spark.conf.get("rulespan.hotGroupRows", str(HOT_GROUP_ROWS)))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names, which all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rulespan-shared-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and return the written copy.

    The folder is the one the session names in ``spark.checkpoint.dir``. A machine-local folder is only
    chosen in local mode, where there is no other machine.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="rulespan-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
