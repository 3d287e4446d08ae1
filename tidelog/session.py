"""Session settings and the shared folder. Operators never create a session; callers do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

APP_NAME = "tidelog"
_MADE: dict[str, list[str]] = {}

# Event times are zone-less, so no result depends on the zone; pinning it keeps display stable.
# The adaptive settings are Spark's defaults, stated because the layer writer and the joins rely on
# them to split oversized partitions.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def get_spark(
    suffix: str | None = None,
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings above; ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(f"{APP_NAME}-{suffix}" if suffix else APP_NAME)
    if master:
        builder = builder.master(master)
    for name, value in {**SESSION_CONF, **(extra or {})}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def object_store_conf(
    endpoint: str, access_key: str, secret_key: str, path_style: bool = True, tls: bool = True
) -> dict[str, str]:
    """Settings for an S3-compatible store, to be passed as ``extra`` to :func:`get_spark`."""
    return {
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.access.key": access_key,
        "spark.hadoop.fs.s3a.secret.key": secret_key,
        "spark.hadoop.fs.s3a.path.style.access": str(path_style).lower(),
        "spark.hadoop.fs.s3a.connection.ssl.enabled": str(tls).lower(),
        "spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
    }


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder every executor can reach, under ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster such a folder would
    exist on one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tidelog-")
    folder = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def clear_shared_folders(spark: SparkSession) -> None:
    """Delete the folders :func:`shared_folder` has named in this application. Frames that read them are void."""
    for folder in _MADE.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
