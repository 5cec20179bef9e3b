"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# Model answers may repeat a key; the last one counts.
RUNTIME_CONF = {"spark.sql.variant.allowDuplicateKeys": "true"}


def get_session(app_name: str = "trailtally", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to an existing session.

    The operators use zone-free timestamps only, so the caller's time zone is left alone.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder: the one the cluster names, else one in the warehouse.

    Both are folders that the driver and all executors share.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Store ``df`` reliably, so later uses see the same rows even after losing executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
