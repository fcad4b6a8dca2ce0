"""Spark session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


# Settings for large inputs. All are runtime SQL options; `apply_recommended`
# sets only those the session has not set already.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # ~256 MB shuffle partitions after coalescing; skewed ones split at 5x the median
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    # scan splits: fewer, larger tasks over wide Parquet files
    "spark.sql.files.maxPartitionBytes": "256m",
    # streaming state (one row per report group) off-heap in RocksDB
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def _explicitly_set(spark: SparkSession, key: str) -> bool:
    """Set at launch or at run time (a registered default does not count)."""
    try:
        return bool(spark._jsparkSession.sessionState().conf().getAllConfs().contains(key))
    except Exception:  # noqa: BLE001 - no JVM handle (e.g. a remote session)
        sc = _context(spark)
        return sc is not None and sc.getConf().contains(key)


def apply_recommended(spark: SparkSession, overrides: dict | None = None) -> dict:
    """Set the recommended options the session does not set yet; returns what was set."""
    applied = {}
    for key, value in {**RECOMMENDED_CONF, **(overrides or {})}.items():
        if not _explicitly_set(spark, key):
            try:
                spark.conf.set(key, value)
                applied[key] = value
            except Exception:  # noqa: BLE001 - some deployments lock options
                pass
    return applied


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "kpishift",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (a cluster brings its own)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext  # not available on Spark Connect sessions
    except Exception:  # noqa: BLE001
        return None


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local session (tests) that names none gets a temporary folder; on a
    cluster executors would each write to their own disk, so that is refused.
    """
    sc = _context(spark)
    current = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.conf.get("spark.master", "") or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set: with master {master!r} it must name a folder on "
                               "storage that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="kpishift-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # noqa: BLE001 - core confs may be read-only at run time
            pass
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), name)


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder made under :func:`scratch_path` (through Spark's file system)."""
    root = checkpoint_dir(spark).rstrip("/")
    if not path.startswith(f"{root}/"):
        raise ValueError(f"{path} is not in the scratch folder {root}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
