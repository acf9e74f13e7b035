"""Session construction and cluster-safe scratch locations."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (all timestamps are compared as
# UTC against the oracle), AQE for runtime join/partition decisions and skew
# splitting, Arrow for the few pandas batches.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Set when a session is built here: checkpoint files go once nothing refers to
# their DataFrame any more (a cluster sets the same in its own configuration).
CLEAN_CHECKPOINTS = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def build_session(master: str = "local[8]", app: str = "shelfwise", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, ``spark-submit`` provides the session
    and only :data:`BASE_CONF` matters."""
    b = SparkSession.builder.master(master).appName(app)
    conf = BASE_CONF | CLEAN_CHECKPOINTS
    conf.update({
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "16g",
    })
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_base_conf(spark: SparkSession) -> None:
    """Pin the runtime settings the operators depend on (UTC is needed for
    timestamp semantics; the rest are performance switches)."""
    for k, v in BASE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: keep the cluster's value
            pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the cluster.

    The folder named by ``spark.checkpoint.dir`` (or already set on the
    context) is used as is. Where nothing is configured, a local session (a
    laptop, a test) gets a fresh local folder; any other master is refused,
    because its executors would not share such a folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif not (sc.master or "").split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    else:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shelfwise-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique folder under the shared checkpoint directory for written
    intermediate tables (never a machine-local temp folder on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{os.getpid()}-{next(_counter)}"


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and continue from the
    written copy: cuts the lineage before iterative work (model fits, loops),
    survives executor loss (a reliable checkpoint, never a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, name: str = "table"):
    """Like :func:`materialize`, but as Parquet files in the shared folder: compressed, and a reader takes the columns that it
    needs. For tables of plain columns that are large or read several times. The layout of ``df`` is not kept; where it
    matters (positions, blocks) a checkpoint does."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
