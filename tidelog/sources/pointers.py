"""Folders that replace each other at once: a small pointer file names the one that counts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import SparkSession

POINTER, FOLDER = "CURRENT", "v-"


def _hadoop(spark: SparkSession):
    return spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()


def fresh_folder(path: str) -> str:
    return f"{path}/{FOLDER}{uuid.uuid4().hex}"


def current_folder(spark: SparkSession, path: str) -> str | None:
    """The folder that counts, None if there has been none yet."""
    fs, conf = _hadoop(spark)
    pointer = fs.Path(f"{path}/{POINTER}")
    if not pointer.getFileSystem(conf).exists(pointer):
        return None
    return f"{path}/{spark.read.text(f'{path}/{POINTER}').first()[0]}"


def point_to(spark: SparkSession, folder: str) -> None:
    """Make ``folder`` the one that counts, by one atomic rename."""
    fs, conf = _hadoop(spark)
    path, _, name = folder.rpartition("/")
    fresh, pointer = fs.Path(f"{path}/.{name}.pointer"), fs.Path(f"{path}/{POINTER}")
    out = fresh.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    rename = getattr(fs, "Options$Rename")
    overwrite = spark._sc._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    fs.FileContext.getFileContext(pointer.toUri(), conf).rename(fresh, pointer, overwrite)


def remove_but(spark: SparkSession, path: str, kept: Sequence[str | None]) -> None:
    """Remove all folders at ``path`` but those named."""
    fs, conf = _hadoop(spark)
    root = fs.Path(path)
    files = root.getFileSystem(conf)
    for found in files.listStatus(root):
        name = found.getPath().getName()
        if name.startswith(FOLDER) and f"{path}/{name}" not in kept:
            files.delete(found.getPath(), True)
