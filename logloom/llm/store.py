"""Files that tasks write to and read from the folder all executors share."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from logloom.session import checkpoint_dir


def address(spark: SparkSession, folder: str) -> str:
    """The whole address of a folder: one without a scheme lies in the cluster's default file system, as for Spark's own writers."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    if not path.isAbsolute():
        raise ValueError(f"name an absolute folder or an address in spark.checkpoint.dir, not {folder}")
    if path.toUri().getScheme() is None:
        path = path.makeQualified(hadoop.FileSystem.getDefaultUri(context._jsc.hadoopConfiguration()), hadoop.Path("/"))
    whole = path.toString()
    return whole if "://" in whole else whole.replace(":", "://", 1)


def new_folder(spark: SparkSession, name: str) -> str:
    """The address of a new folder below the one named by ``spark.checkpoint.dir``."""
    return f"{address(spark, checkpoint_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_file(folder: str, name: str, data: bytes) -> str:
    """Write a file of a task under a name no other attempt has; returns its address.

    What a lost attempt left behind is never read: only the addresses that a finished
    job recorded count.
    """
    address = f"{folder}/{uuid.uuid4().hex}-{name}"
    system, path = fs.FileSystem.from_uri(address)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)
    return address


def read_file(address: str) -> bytes:
    system, path = fs.FileSystem.from_uri(address)
    with system.open_input_stream(path) as source:
        return source.read()
