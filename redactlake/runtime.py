"""Session helpers: cutting lineage and measuring what is about to be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        # One process, so its warehouse folder is shared by all tasks.
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def materialize(df: DataFrame) -> DataFrame:
    """Store ``df`` reliably and read it back.

    Used where a value may differ when computed again (row numbers after a range shuffle,
    model output), so a lost executor cannot change results half-way.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
